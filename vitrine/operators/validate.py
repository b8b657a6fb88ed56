"""Checks and dimensions of a slate log."""

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.schema import MASK_CODE, T_SPLIT

REQUIRED = ("slate", "click")


def _per_row_sum(xs) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)


def validate_log(log: DataFrame) -> DataFrame:
    """(check, violations): a sound log has zero everywhere.

    A missing required column counts as one violation and the checks needing it
    report NULL, so the caller sees which column is absent instead of an
    analysis error.
    """
    spark = log.sparkSession
    has = set(log.columns)
    present = {f"has_{c}": F.lit(0 if c in has else 1) for c in REQUIRED}
    steps = [c for c in ("click", "click_idx", "slate_lengths", "interaction_type") if c in has]
    checks = {}
    if "slate" in has:
        for c in steps:
            checks[f"steps_{c}"] = F.count_if(
                F.size(c).isNull() | (F.size(c) != F.size("slate"))
            )
        widths = F.transform("slate", lambda s: F.size(s))
        checks["slate_width"] = F.count_if(F.array_min(widths) != F.array_max(widths))
        row_width = F.array_max(widths)
        checks["slate_width_users"] = F.when(
            F.min(row_width) != F.max(row_width), F.lit(1)).otherwise(F.lit(0))
        checks["step_count_users"] = F.when(
            F.min(F.size("slate")) != F.max(F.size("slate")), F.lit(1)).otherwise(F.lit(0))
    if {"slate", "click", "click_idx"} <= has:
        zipped = F.arrays_zip("slate", "click", "click_idx")
        wrong = F.size(F.filter(
            zipped,
            lambda s: (s["click"] != 0)
            & ~F.equal_null(F.get(s["slate"], s["click_idx"]), s["click"]),
        ))
        checks["click_in_slate"] = F.coalesce(F.sum(wrong), F.lit(0))
    found = {**present, **{k: v for k, v in checks.items()}}
    one = log.agg(*[F.max(v).alias(k) if k in present else v.alias(k) for k, v in found.items()])
    rows = F.array(*[
        F.struct(F.lit(k).alias("check"), F.col(k).cast("bigint").alias("violations"))
        for k in found
    ])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def dataset_dims(log: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row of sizes; ids are counted as upper bounds (largest id + 1)."""
    kinds = vocab.where(F.col("attr") == "interaction_type").agg(F.count("*")).scalar()
    top = F.array_max(F.transform("slate", lambda s: F.array_max(s)))
    width = F.array_max(F.transform("slate", lambda s: F.size(s)))
    return log.agg(
        (F.max(top) + 1).cast("bigint").alias("num_items"),
        F.max(F.size("slate")).cast("bigint").alias("num_interactions"),
        F.max(width).cast("bigint").alias("maxlen_slate"),
        (F.max("user_id") + 1).cast("bigint").alias("num_users"),
    ).withColumn("num_interaction_types", kinds.cast("bigint"))


def num_items(log: DataFrame) -> Column:
    """Largest shown id + 1, as a scalar."""
    top = F.array_max(F.transform("slate", lambda s: F.array_max(s)))
    return log.agg((F.max(top) + 1).cast("bigint")).scalar()


def num_groups(items: DataFrame) -> DataFrame:
    """Distinct categories among the items."""
    return items.agg(F.countDistinct("category_id").cast("bigint").alias("num_groups"))


def checksum_columns(masked: DataFrame) -> DataFrame:
    """Mean of all elements per column, and their sum as row ``total``.

    ``masked`` is the wide log with ``mask_type``; no array is exploded.
    """
    sums, sizes = {}, {}
    for c in ("click", "click_idx", "slate_lengths", "interaction_type", "mask_type"):
        sums[c], sizes[c] = _per_row_sum(F.col(c)), F.size(c)
    sums["slate"] = _per_row_sum(F.flatten("slate"))
    sizes["slate"] = F.size(F.flatten("slate"))
    sums["user_id"], sizes["user_id"] = F.col("user_id"), F.lit(1)
    means = masked.agg(*[
        (F.sum(sums[c]).cast("double") / F.sum(sizes[c])).alias(c) for c in sums
    ])
    total = sum((F.col(c) for c in sums), F.lit(0.0))
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("mean")) for c in sums]
    rows.append(F.struct(F.lit("total").alias("column"), total.alias("mean")))
    return means.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def checksum_batch(log: DataFrame, batches: DataFrame, batch_id: int = 0) -> DataFrame:
    """Sum of all slate ids in one train batch."""
    chosen = batches.where((F.col("phase") == "train") & (F.col("batch_id") == batch_id))
    ids = log.select("row_idx", _per_row_sum(F.flatten("slate")).alias("s"))
    return ids.join(chosen, "row_idx", "left_semi").agg(
        F.count("*").cast("bigint").alias("num_users"), F.sum("s").alias("checksum")
    )
