"""Exact ranks and cut points without sorting everything in one task."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.sources.shared import cut_lineage

# Top bits of a 60-bit hash that name its bucket: at most 2**16 buckets, evenly
# filled because the hashed keys are unique.
BUCKET_SHIFT = 44
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def bucket_of(h: Column) -> Column:
    return F.shiftright(h, BUCKET_SHIFT)


def global_row_number(df: DataFrame, *order, name: str = "rn") -> DataFrame:
    """Zero-based position of each row in the total order ``order``.

    Range-partitions and sorts, numbers rows inside partitions, then adds the
    partition offsets.  The numbered rows are written before the offsets are
    counted, so both come from the same partitioning.
    """
    tagged = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    tagged = tagged.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    # one row per partition
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    low = F.lit((1 << _ROW_BITS) - 1)
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(low))
        .drop("_part", "_mid", "_off")
    )


def hash_rank(df: DataFrame, h: Column, tie: str, within=(), name: str = "rn") -> DataFrame:
    """Zero-based rank of (h, tie), per group of ``within``.

    Bucket offsets come from a histogram of at most 2**16 rows per group, the
    rest from a window inside each bucket.
    """
    keyed = df.withColumn("_h", h).withColumn("_b", bucket_of(F.col("_h")))
    sizes = keyed.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    before = (
        Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *within, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(*within, "_b").orderBy("_h", tie)
    return (
        keyed.join(F.broadcast(offsets), [*within, "_b"])
        .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_h", "_b", "_off")
    )


def hash_cuts(df: DataFrame, h: Column, tie: str, ranks: dict) -> DataFrame:
    """One row; field ``name`` holds the ``ranks[name]``-th smallest (h, tie).

    Only the buckets in which a wanted rank falls are sorted.  A rank of zero
    gives NULL.
    """
    keyed = df.select(h.alias("h"), F.col(tie).alias("tie"))
    keyed = keyed.withColumn("b", bucket_of(F.col("h")))
    sizes = keyed.groupBy("b").agg(F.count("*").alias("n"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = sizes.withColumn("hi", F.sum("n").over(upto)).withColumn("lo", F.col("hi") - F.col("n"))
    wanted = F.lit(False)
    for k in ranks.values():
        wanted = wanted | ((k > F.col("lo")) & (k <= F.col("hi")))
    edges = edges.where(wanted).select("b", "lo")  # at most one row per rank
    inside = Window.partitionBy("b").orderBy("h", "tie")
    ranked = keyed.join(F.broadcast(edges), "b").withColumn(
        "rank", F.col("lo") + F.row_number().over(inside)
    )
    return ranked.agg(*[
        F.max(F.when(F.col("rank") == k, F.struct("h", "tie"))).alias(name)
        for name, k in ranks.items()
    ])
