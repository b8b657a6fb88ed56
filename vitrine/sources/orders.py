"""Slate log, items and vectors derived from order tables.

An order is a slate, its distinct parts the shown items; clicks are drawn by
hash.  The derived tables are written once per session and input folder to the
shared folder, since a stored log is what every operator reads.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.functions.hashing import hash60
from vitrine.functions.joins import _tasks, gather
from vitrine.functions.ranking import global_row_number
from vitrine.operators.validate import dataset_dims
from vitrine.schema import FIRST_REAL, MAX_SLATE, MAX_STEPS, NO_CLICK, UNKNOWN
from vitrine.sources import log as logs
from vitrine.sources.shared import new_path, shuffles_removed

# Names of interaction types 0, 1, 2 and of the reserved ids.
INTERACTION_TYPES = ("undefined", "search", "recommendation")
RESERVED_NAMES = ("PAD", "noClick", "<UNK>")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slates(spark, sf_dir) -> DataFrame:
    """(order_key, slate, click_idx, click) per order with lines.

    Lines are shuffled once, by order.  Repeated lines collapse there before a slate is
    gathered, so it is made of distinct parts only and is bounded by the catalogue.  An
    item stands where it first appears.
    """
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    line = line.repartition(_tasks(line), "l_orderkey")
    unknown = hash60("unk", F.col("l_orderkey"), F.col("l_partkey")) % 50 == 0
    item = F.when(unknown, F.lit(UNKNOWN)).otherwise(
        (FIRST_REAL + F.col("l_partkey")).cast("int")
    )
    shown = line.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("ln")).select(
        F.col("l_orderkey").alias("order_key"), "ln", item.alias("item_id"))
    listed = F.array_sort(F.collect_list(F.struct("ln", "item_id")))
    placed = shown.groupBy("order_key").agg(listed.alias("s")).select(
        "order_key", F.array_distinct("s.item_id").alias("placed"),
        hash60("click", F.col("order_key")).alias("h"))
    return placed.select(
        "order_key",
        F.concat(F.array(F.lit(NO_CLICK)), F.col("placed")).alias("slate"),
        F.expr("if(h % 5 < 2, 0, cast(1 + (h div 5) % size(placed) as int))").alias("click_idx"),
    ).withColumn("click", F.get("slate", F.col("click_idx")))


def _padded(values, length, fill):
    return F.concat(values, F.array_repeat(fill, F.lit(length) - F.size(values)))


def numbered_users(spark, sf_dir) -> DataFrame:
    """(row_idx, user_id, s): users with at least one slate, numbered by id, with their steps in order of date.

    ``s`` has the orders with lines as they are: padding would travel through every shuffle.
    A user is one row, so one user's orders must fit in a task.  Orders without a customer
    are nobody's steps, but count as the first user.
    """
    kind = F.substring("o_orderpriority", 1, 1).cast("int") % 3
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", kind.alias("interaction_type")
    )
    steps = orders.join(slates(spark, sf_dir), F.col("o_orderkey") == F.col("order_key"))
    step = F.struct("o_orderdate", "o_orderkey", "click", "click_idx", "interaction_type", "slate")
    owned = F.when(F.col("o_custkey").isNotNull(), step)
    users = steps.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.array_sort(F.collect_list(owned)).alias("s")
    )
    numbered = global_row_number(users, "user_id", name="row_idx")
    return numbered.where(F.col("user_id").isNotNull())


def wide_log(users: DataFrame) -> DataFrame:
    """The wide log of numbered users.

    Arrays hold at least MAX_STEPS entries and more for users with more orders.
    """
    padded = F.transform("s", lambda x: F.struct(
        x["click"].alias("click"), x["click_idx"].alias("click_idx"),
        F.size(x["slate"]).alias("slate_lengths"), x["interaction_type"].alias("interaction_type"),
        _padded(x["slate"], MAX_SLATE, F.lit(0)).alias("slate")))
    rows = users.select("row_idx", "user_id", padded.alias("s"))
    flat = [
        _padded(F.col(f"s.{c}"), MAX_STEPS, F.lit(0)).alias(c)
        for c in ("click", "click_idx", "slate_lengths", "interaction_type")
    ]
    empty = F.array_repeat(F.lit(0), MAX_SLATE)
    return rows.select(
        "row_idx", "user_id", *flat, _padded(F.col("s.slate"), MAX_STEPS, empty).alias("slate")
    )


def items(spark, sf_dir) -> DataFrame:
    """(item_id, category_id, category_name), reserved ids included."""
    real = _table(spark, sf_dir, "part").select(
        (FIRST_REAL + F.col("p_partkey")).cast("int").alias("item_id"),
        F.concat_ws(",", "p_type", "p_brand").alias("category_name"),
    )
    names = real.select("category_name").distinct()
    numbered = global_row_number(names, "category_name", name="n").select(
        "category_name", (FIRST_REAL + F.col("n")).alias("category_id"))
    reserved = spark.createDataFrame(
        [(i, i, name) for i, name in enumerate(RESERVED_NAMES)],
        "item_id int, category_id int, category_name string",
    )
    return real.join(numbered, "category_name").select(
        "item_id", F.col("category_id").cast("int").alias("category_id"), "category_name"
    ).unionByName(reserved)


def _embedded(spark, sf_dir, rows, key, spread) -> DataFrame:
    """``rows`` with the embedding numbered ``key`` modulo their count as ``vec``."""
    emb = _table(spark, sf_dir, "embeddings")
    n = emb.agg(F.count("*")).scalar()
    keyed = rows.withColumn("vec_id", key % n)
    found = gather(keyed, emb.select("vec_id", "embedding"), "vec_id", "vec_id", spread=(spread,))
    return found.withColumn("vec", F.col("embedding").cast("array<double>"))


def item_vectors(spark, sf_dir) -> DataFrame:
    """(id, vec) of every part; parts beyond the number of embeddings share them."""
    parts = _table(spark, sf_dir, "part").select("p_partkey")
    return _embedded(spark, sf_dir, parts, F.col("p_partkey"), "p_partkey").select(
        (FIRST_REAL + F.col("p_partkey")).cast("bigint").alias("id"), "vec")


def user_vectors(spark, sf_dir, users: DataFrame) -> DataFrame:
    """(id, row_idx, vec): every user gets one of the embeddings by hash."""
    return _embedded(spark, sf_dir, users, hash60("user", F.col("user_id")), "user_id").select(
        F.col("user_id").alias("id"), "row_idx", "vec")


def vocab(items_df: DataFrame) -> DataFrame:
    """(attr, idx, value) rows of the dictionaries."""
    spark = items_df.sparkSession
    cats = items_df.select(
        F.lit("category").alias("attr"), F.col("category_id").alias("idx"),
        F.col("category_name").alias("value"),
    ).distinct()
    kinds = spark.createDataFrame(
        [("interaction_type", i, name) for i, name in enumerate(INTERACTION_TYPES)],
        "attr string, idx int, value string",
    )
    return cats.unionByName(kinds)


@dataclass(frozen=True)
class SlateTables:
    """Paths of the derived tables of one input folder."""

    spark: SparkSession
    root: str

    @property
    def log(self):
        return logs.scan_slate_log(self.spark, f"{self.root}/log")

    @property
    def users(self):
        return self.log.select("row_idx", "user_id")

    @property
    def items(self):
        return logs.scan_item_attr(self.spark, f"{self.root}/items")

    @property
    def vocab(self):
        return logs.scan_vocab(self.spark, f"{self.root}/vocab", whole_file=False)

    @property
    def dims(self):
        return self.spark.read.parquet(f"{self.root}/dims")

    @property
    def itemvec(self):
        return logs.scan_vectors(self.spark, f"{self.root}/itemvec")

    @property
    def uservec(self):
        return self.spark.read.parquet(f"{self.root}/uservec")


def write_tables(spark, sf_dir, root) -> None:
    wide_log(numbered_users(spark, sf_dir)).write.mode("overwrite").parquet(f"{root}/log")
    stored = logs.scan_slate_log(spark, f"{root}/log")
    users = stored.select("row_idx", "user_id")
    catalogue = items(spark, sf_dir)
    catalogue.select("item_id", "category_id").write.mode("overwrite").parquet(f"{root}/items")
    logs.sink_vocab(vocab(catalogue), f"{root}/vocab")
    words = logs.scan_vocab(spark, f"{root}/vocab", whole_file=False)
    dataset_dims(stored, words).write.mode("overwrite").parquet(f"{root}/dims")
    item_vectors(spark, sf_dir).write.mode("overwrite").parquet(f"{root}/itemvec")
    user_vectors(spark, sf_dir, users).write.mode("overwrite").parquet(f"{root}/uservec")


_written: dict = {}


def slate_tables(spark: SparkSession, sf_dir: str) -> SlateTables:
    """Derived tables of ``sf_dir``, written on first use in this session."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _written:
        root = new_path(spark, "slates")
        with shuffles_removed(spark):
            write_tables(spark, sf_dir.rstrip("/"), root)
        _written[key] = root
    return SlateTables(spark, _written[key])
