"""Attaching a keyed table (vectors, attributes) to many rows by an id."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.sources.shared import new_path, shuffles_removed

# A table is broadcast only after its size was measured to stay below this.
BROADCAST_BYTES = 64 << 20
# An id is hot when it fills more than one average task; it is then spread over
# this many tasks per average task it fills.
SALTS_PER_TASK = 4
# What is sent to all executors at once of a table that is looked up slice by slice.
SLICE_BYTES = 64 << 20


def held_bytes(table: DataFrame) -> int:
    """About the size of a table of ids and vectors.

    Every partition sends one row: its sum of sizes.
    """
    wide = [f.name for f in table.schema.fields if f.dataType.typeName() == "array"]
    strings = [f.name for f in table.schema.fields if f.dataType.typeName() in ("string", "binary")]
    width = F.lit(16 * len(table.columns))
    for c in wide:
        each = 4 if table.schema[c].dataType.elementType.typeName() == "float" else 8
        width = width + each * F.coalesce(F.size(c), F.lit(0))
    for c in strings:
        width = width + F.coalesce(F.length(c), F.lit(0))
    return table.agg(F.sum(width.cast("bigint"))).first()[0] or 0


def fits_broadcast(table: DataFrame, limit: int = None) -> bool:
    """Measure a table of ids and vectors against the broadcast limit."""
    return held_bytes(table) <= (BROADCAST_BYTES if limit is None else limit)


def as_floats(table: DataFrame, columns) -> DataFrame:
    """``columns`` of vectors in single precision, where that loses nothing."""
    single = {c: F.col(c).cast("array<float>") for c in columns}
    exact = table.agg(*[F.min(F.col(c).eqNullSafe(x.cast("array<double>"))).alias(c) for c, x in single.items()]).first()
    return table.withColumns({c: x for c, x in single.items() if exact[c]})


def slice_count(table: DataFrame) -> int:
    return max(1, math.ceil(held_bytes(table) / SLICE_BYTES))


def slice_of(key, count: int) -> Column:
    """The slice an id belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def by_slices(table: DataFrame, key: str, count: int, work) -> DataFrame:
    """What ``work(slice number, broadcast slice)`` gives for every slice of ``table`` by ``key``.

    For rows that are wide, or that need a wide lookup, and have narrow results: neither they nor
    the table are shuffled.  Slices are sent to the executors one after the other, so one is held at a time;
    results are written.
    """
    path, schema = new_path(table.sparkSession, "cut"), None
    for i in range(count):
        out = work(i, F.broadcast(table.where(slice_of(key, count) == i)))
        with shuffles_removed(table.sparkSession):
            out.write.mode("append").parquet(path)
        schema = out.schema
    written = table.sparkSession.read.schema(schema).parquet(path)
    written._cut_path = path
    return written


def _tasks(df) -> int:
    """Partitions of a shuffle as configured."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_ids(rows: DataFrame, key: str) -> DataFrame:
    """(key, salts) of ids holding more rows than one of ``n`` equal tasks.

    At most one id per shuffle partition can qualify, and the salts of all of
    them together are at most SALTS_PER_TASK + 1 per shuffle partition.
    """
    tasks = _tasks(rows)
    known = rows.where(F.col(key).isNotNull())
    counts = known.groupBy(key).agg(F.count("*").alias("_n"))
    everything = counts.agg(F.sum("_n")).scalar()
    share = F.col("_n") / everything
    return counts.where(share * tasks > 1).select(
        key, F.ceil(share * (tasks * SALTS_PER_TASK)).cast("int").alias("_salts"))


def gather(rows, table, key, table_key="id", spread=("row_idx", "t"), census=None,
           how="inner", limit=None, cluster_by=None, apart=False):
    """Join on a unique id (inner or left), safe for ids that hold much of the data.

    A table measured small is broadcast.  Otherwise both sides shuffle on
    (id, salt): rows of a hot id spread over as many tasks as their share asks
    for, by a hash of the ``spread`` columns they have, and only the table rows of
    hot ids are replicated.  Rows without an id spread over all tasks.  ``census``
    may name a cheaper DataFrame to count ids on than ``rows``.

    ``cluster_by`` names a column the result is grouped on next; the result is
    then partitioned by it.  With a broadcast table that shuffle happens before
    the join and moves ids only, not the attached values.  ``apart`` (for left joins) says that
    rows are cheap to make: those without an id are made apart and not shuffled.
    """
    table = table.withColumnRenamed(table_key, key) if table_key != key else table
    if fits_broadcast(table, limit):
        if cluster_by:
            # a fixed number: sized by the ids alone, partitions would be merged
            # into few, and each would grow many times over with the values
            rows = rows.repartition(_tasks(rows), cluster_by)
        return rows.join(F.broadcast(table), key, how)
    spread = [c for c in spread if c in rows.columns] or rows.columns
    # at most one row per shuffle partition
    hot = F.broadcast(hot_ids(rows if census is None else census, key))
    salts = F.when(F.col(key).isNull(), F.lit(_tasks(rows) * SALTS_PER_TASK)).otherwise(
        F.coalesce("_salts", F.lit(1)))
    without = rows.where(F.col(key).isNull()) if apart and how == "left" else None
    if without is not None:
        rows = rows.where(F.col(key).isNotNull())
    left = rows.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    right = table.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    joined = left.join(right, [key, "_salt"], how).drop("_salt")
    if without is not None:
        joined = joined.unionByName(without, allowMissingColumns=True)
    return joined.repartition(_tasks(rows), cluster_by) if cluster_by else joined
