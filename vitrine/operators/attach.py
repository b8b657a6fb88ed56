"""Lookups by id: names, vectors, and set membership of recommendations."""

from pyspark.sql import DataFrame, functions as F

from vitrine.functions.joins import gather
from vitrine.functions.vectors import SCORES
from vitrine.schema import FIRST_REAL

MAX_TARGETS = 10_000


def _names(vocab, attr, key, name) -> DataFrame:
    return vocab.where(F.col("attr") == attr).select(
        F.col("idx").alias(key), F.col("value").alias(name))


def item_category_name(rows, items, vocab, column="click", name="category_name") -> DataFrame:
    """Item id -> category id -> category text.

    The two small hops are joined first, so the log meets one table only.
    """
    named = gather(items, _names(vocab, "category", "category_id", name),
                   "category_id", "category_id", spread=("item_id",))
    return gather(rows, named.select("item_id", name), column, "item_id")


def interaction_type_name(rows, vocab, name="type_name") -> DataFrame:
    """Type id -> text; NULL for ids without an entry."""
    names = _names(vocab, "interaction_type", "interaction_type", name)
    return gather(rows, names, "interaction_type", "interaction_type", how="left")


def inverse_vocab(entries: DataFrame) -> DataFrame:
    """(value, idx) from (pos, idx, value); of equal values the last one wins."""
    return entries.groupBy("value").agg(F.max_by("idx", "pos").alias("idx"))


def inverse_vocab_lookup(rows, entries, column) -> DataFrame:
    table = inverse_vocab(entries).withColumnRenamed("value", column)
    return gather(rows, table, column, column, spread=tuple(rows.columns))


def gather_item_vectors(rows, itemvec, column="item_id", spread=("row_idx", "t"), census=None,
                        how="inner", cluster_by=None, vecs=("vec",), apart=False):
    """Attach ``vec`` of each row's item; an inner join drops rows whose item has none."""
    table = itemvec.select(F.col("id").cast("int").alias("id"), *vecs)
    return gather(rows, table, column, "id", spread, census, how, cluster_by=cluster_by, apart=apart)


def gather_user_vectors(rows, uservec) -> DataFrame:
    """Attach the user's vector; a user has few rows, so keys are even."""
    return rows.join(uservec.select(F.col("id").alias("user_id"), "vec"), "user_id")


def semi_recommended(recs, clicks) -> DataFrame:
    """Recommendations among the user's clicks; clicks (row_idx, item_id)."""
    return recs.join(clicks, ["row_idx", "item_id"], "left_semi")


def anti_already_clicked(recs, clicks) -> DataFrame:
    """Recommendations the user has not clicked."""
    return recs.join(clicks, ["row_idx", "item_id"], "left_anti")


def _packed(targets) -> DataFrame:
    """One row holding the whole target list, refused beyond ``MAX_TARGETS``."""
    n = targets.limit(MAX_TARGETS + 1).count()
    if n > MAX_TARGETS:
        raise ValueError("too many targets to score one by one; use topk_targets")
    fields = F.struct(*targets.columns)
    return targets.agg(F.sort_array(F.collect_list(fields)).alias("targets"))


def users_x_items(users, targets) -> DataFrame:
    """Every user with every target id, for a short list of targets.

    The list travels as one literal; users are neither shuffled nor replicated.
    """
    listed = _packed(targets.select("item_id"))
    return users.withColumn("_t", F.explode(listed.scalar())).withColumn(
        "item_id", F.col("_t.item_id")).drop("_t")


def score_targets(uservec, itemvec, targets, dist="dot") -> DataFrame:
    """(id, item_id, score) of every user for each target item."""
    vecs = itemvec.select(F.col("id").cast("int").alias("item_id"), "vec").join(
        targets.select("item_id"), "item_id")
    listed = _packed(vecs)
    rows = uservec.select("id", "vec", F.explode(listed.scalar()).alias("_t"))
    return rows.select(
        "id", F.col("_t.item_id").alias("item_id"),
        SCORES[dist](F.col("vec"), F.col("_t.vec")).alias("score"))
