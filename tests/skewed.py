"""Order tables in which one order, one customer and one part hold a third of the rows."""

import os

import duckdb

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings"
         " pages benchmark labels conversations").split()


def write_skewed(source, target):
    os.makedirs(target, exist_ok=True)
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}/{name}.parquet'")
    con.execute(f"""
      COPY (SELECT * EXCLUDE (rn) REPLACE (
              CASE WHEN rn % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
              CASE WHEN rn % 3 = 1 THEN 11 ELSE l_partkey END AS l_partkey)
            FROM (SELECT *, row_number() OVER () AS rn FROM lineitem))
      TO '{target}/lineitem.parquet' (FORMAT parquet)""")
    con.execute(f"""
      COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey)
            FROM orders) TO '{target}/orders.parquet' (FORMAT parquet)""")
    for name in set(NAMES) - {"lineitem", "orders"}:
        con.execute(f"COPY {name} TO '{target}/{name}.parquet' (FORMAT parquet)")
