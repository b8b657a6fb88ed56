"""Scans and sinks of slate logs, attributes, parameters and metrics."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.schema import ITEM, LOG, METRIC, VECTORS


def scan_slate_log(spark: SparkSession, path: str) -> DataFrame:
    """Wide log, one row per user; columns not used downstream are never read."""
    return spark.read.schema(LOG).parquet(path)


def scan_item_attr(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, category_id) rows."""
    return spark.read.schema(ITEM).parquet(path)


def item_attr_from_dense(df: DataFrame, column: str = "category") -> DataFrame:
    """Rows of an attribute stored as one dense array indexed by item id."""
    return df.select(F.posexplode(column).alias("item_id", "category_id"))


def scan_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def scan_vocab(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """(attr, key, idx, value) from JSON documents ``{attr: {key: value}}``.

    ``idx`` is the key as an integer when its text, leading minus signs aside,
    is all digits, else NULL.  A document is one file, or one line with
    ``whole_file=False``.
    """
    docs = spark.read.text(path, wholetext=whole_file)
    parsed = F.from_json("value", "map<string,map<string,string>>")
    attrs = docs.select(F.explode(parsed).alias("attr", "entries"))
    rows = attrs.select("attr", F.explode("entries").alias("key", "value"))
    digits = F.col("key").rlike("^-*[0-9]+$")
    return rows.select(
        "attr", "key", F.when(digits, F.col("key").try_cast("int")).alias("idx"), "value"
    )


def sink_vocab(vocab: DataFrame, path: str, chunk: int = 10_000) -> None:
    """Write (attr, idx, value) as JSON documents, one line per ``chunk`` ids."""
    docs = (
        vocab.groupBy("attr", F.floor(F.col("idx") / chunk).alias("part"))
        .agg(F.map_from_entries(F.collect_list(
            F.struct(F.col("idx").cast("string"), F.col("value")))).alias("entries"))
        .select(F.to_json(F.create_map("attr", "entries")).alias("value"))
    )
    docs.write.mode("overwrite").text(path)


def narrow_ids(log: DataFrame) -> DataFrame:
    """64-bit id arrays to 32-bit; ANSI casts fail on ids that do not fit."""
    return log.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in log.columns else F.lit(None)
        for f in LOG.fields if f.name in log.columns
    ], *[c for c in log.columns if c not in LOG.names])


def sink_phase_batches(batched: DataFrame, path: str) -> None:
    """Write phase batches, one directory per phase, whole batches per task.

    ``batched`` holds one row per user of a phase, with ``phase`` and
    ``batch_id``.  Each file lists its batches in order.
    """
    (
        batched.repartition("phase", "batch_id")
        .sortWithinPartitions("phase", "batch_id", "batch_pos")
        .write.mode("overwrite").partitionBy("phase").parquet(path)
    )


def phase_batch_counts(batched: DataFrame) -> DataFrame:
    """Users and batches per phase."""
    per_batch = batched.groupBy("phase", "batch_id").agg(F.count("*").alias("n"))
    return per_batch.groupBy("phase").agg(
        F.sum("n").cast("bigint").alias("num_users"),
        F.count("*").cast("bigint").alias("num_batches"),
    )


def sink_model_tables(tables: dict, path: str) -> None:
    """Save named parameter tables (id, vec, ...) below one folder."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model_tables(spark: SparkSession, path: str, names) -> dict:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def sink_metrics(metrics: DataFrame, path: str) -> None:
    """Append named scalars."""
    metrics.select(*[F.col(f.name).cast(f.dataType) for f in METRIC.fields]).write.mode(
        "append"
    ).parquet(path)


def scan_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC).parquet(path)
