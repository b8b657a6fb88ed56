"""From raw documents to packed sequences, stage by stage.

Every stage gets the documents that its predecessor kept and decides on them alone; what
it rejects is gone from the next stage's input.  Null texts count as empty, null ids are
ids of their own kind, extra columns are passed on, repeated rows are copies of each
other, and an empty table stays empty.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.llm import decontaminate, exact_dedup, langid, near_dedup, online_packing
from vitrine.llm.common import ascii_lower, small_or_shuffled, table
from vitrine.sources.shared import cut_lineage

MIN_SCORE = 0.5  # least corrected share of usual n-grams of a document in a known language


def _same_id(docs, ids):
    return docs["doc_id"].eqNullSafe(ids["_id"])


def _with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key per row (_key): the id, or a row number written once if ids repeat."""
    twice = docs.groupBy("doc_id").count().where("count > 1")
    if twice.isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    return cut_lineage(docs.withColumn("_key", F.monotonically_increasing_id()))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose _key is not among ``keys`` (column doc_id), without the key."""
    gone = small_or_shuffled(cut_lineage(keys.select(F.col("doc_id").alias("_gone")).distinct()))
    return docs.join(gone, docs["_key"].eqNullSafe(gone["_gone"]), "left_anti").drop("_key")


def _one_row_each(docs: DataFrame) -> DataFrame:
    """Of rows with the same id and the same text but for the case of A-Z, the largest stays.

    Only rows whose id comes more than once move.
    """
    ids = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    ids = cut_lineage(ids)
    if ids.isEmpty():
        return docs
    ids = small_or_shuffled(ids)
    repeated = docs.join(ids, _same_id(docs, ids), "left_semi")
    text = ascii_lower(F.coalesce("text", F.lit("")))
    largest = repeated.groupBy("doc_id", text.alias("_text")).agg(F.max(F.struct(*docs.columns)).alias("_row"))
    return docs.join(ids, _same_id(docs, ids), "left_anti").unionByName(largest.select("_row.*"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is one of the learned: texts without a letter go, and
    those of which less than MIN_SCORE is usual in any language."""
    model = langid.train(docs.select("lang", "text"))
    docs = _with_key(docs)
    found = langid.predict(docs, model, id_col="_key")
    return _without(docs, found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < MIN_SCORE)))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest id of each group of equal texts."""
    docs = _one_row_each(docs)
    found = exact_dedup.exact_dedup(docs)
    dropped = cut_lineage(found.where("not kept").select("doc_id", "text_sha256"))
    # an id may name texts that stay and texts that go
    twice = cut_lineage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if twice.isEmpty():
        return _without(docs.withColumn("_key", F.col("doc_id")), dropped)
    some = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    gone = dropped.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    gone = small_or_shuffled(gone)
    return docs.join(gone, _same_id(docs, gone) & (some == gone["_sha"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: five-word
    shingles, similarity 0.8.  A null id is the largest; of rows with the same id one stays."""
    docs = _with_key(docs)
    found = near_dedup.near_dedup(docs, id_col="_key")
    groups = cut_lineage(found.select(F.col("doc_id").alias("_key"), "component_id"))
    # only groups of several rows meet again, with the ids that decide
    several = cut_lineage(groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"))
    rows = groups.where(F.col("component_id").isNotNull()).join(several, "component_id")
    ids = docs.select(F.col("_key").alias("_own"), "doc_id")
    rows = cut_lineage(rows.join(ids, F.col("_key").eqNullSafe(F.col("_own"))).drop("_own"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    first = rows.groupBy("component_id").agg(F.min(order).alias("first")).select("component_id", "first._key")
    kept = first.select(F.col("component_id").alias("_group"), F.col("_key").alias("_kept"))
    gone = rows.join(kept, (F.col("component_id") == F.col("_group")) & F.col("_key").eqNullSafe(F.col("_kept")), "left_anti")
    return _without(docs, gone.select(F.col("_key").alias("doc_id")))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    docs = _with_key(docs)
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), id_col="_key"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 token ids."""
    return online_packing.pack_online(docs)


STAGES = [
    ("language", language),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]

ORACLE_SQL = None  # languages are learned, near duplicates sampled by hashes: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
