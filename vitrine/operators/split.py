"""User splits, phase masks and batches."""

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions.hashing import hash60
from vitrine.functions.ranking import hash_cuts, hash_rank
from vitrine.schema import MASK_CODE, T_SPLIT


def split_key(seed: int = 0) -> Column:
    return hash60("split", seed, F.col("row_idx"))


def _count(users) -> Column:
    return users.agg(F.count("*")).scalar().cast("double")


def sizes_pct(n: Column, valid_pct=0.05, test_pct=0.05):
    """int(N * pct) of each held-out set."""
    return (F.floor(n * F.lit(float(valid_pct))), F.floor(n * F.lit(float(test_pct))))


def sizes_ratio(n: Column, train_ratio=0.9):
    """int(N * (1 - ratio) / 2), in doubles: at times one user fewer."""
    half = F.floor(n * F.lit(1.0 - train_ratio) / F.lit(2.0))
    return half, half


def with_split(rows: DataFrame, users: DataFrame, sizes, seed: int = 0) -> DataFrame:
    """Add ``split`` (train, valid or test) to rows holding ``row_idx``.

    The users are ordered by a seeded hash; the first ones are valid, the next
    ones test.  Only the two cut points are computed, then every row is compared
    with them: the log itself is not shuffled.  ``sizes`` maps the number of
    users to the two set sizes.
    """
    n_valid, n_test = sizes(_count(users))
    cuts = hash_cuts(
        users, split_key(seed), "row_idx", {"valid": n_valid, "test": n_valid + n_test}
    )
    here = F.struct(split_key(seed).alias("h"), F.col("row_idx").alias("tie"))
    cut = F.col("_cut")
    return (
        rows.withColumn("_cut", cuts.select(F.struct("valid", "test")).scalar())
        .withColumn("split", F.when(F.coalesce(here <= cut["valid"], F.lit(False)), F.lit("valid"))
                    .when(F.coalesce(here <= cut["test"], F.lit(False)), F.lit("test"))
                    .otherwise(F.lit("train")))
        .drop("_cut")
    )


def split_users_pct(rows, users, valid_pct=0.05, test_pct=0.05, seed=0) -> DataFrame:
    return with_split(rows, users, lambda n: sizes_pct(n, valid_pct, test_pct), seed)


def split_users_ratio(rows, users, train_ratio=0.9, seed=0) -> DataFrame:
    return with_split(rows, users, lambda n: sizes_ratio(n, train_ratio), seed)


def in_phases(rows: DataFrame) -> DataFrame:
    """One row per phase a user is part of: train for all, plus the held-out one."""
    return rows.withColumn("phase", F.explode(
        F.when(F.col("split") == "train", F.array(F.lit("train")))
        .otherwise(F.array(F.lit("train"), F.col("split")))
    ))


def phase_mask(log: DataFrame, t_split: int = T_SPLIT) -> DataFrame:
    """The three phase data sets of a wide log with ``split``, in one pass.

    Train holds every user, without the late steps of held-out users; valid and
    test hold theirs, with the late steps only.  Padding steps are masked by
    position alone, like any other step.
    """
    late = lambda t: t >= t_split
    mask = F.transform("click", lambda x, t: F.when(
        F.col("phase") == "train", (F.col("split") == "train") | ~late(t)
    ).otherwise(late(t)))
    return in_phases(log).withColumn("phase_mask", mask)


def phase_of_step(t_split: int = T_SPLIT) -> Column:
    """Long form: the one phase an interaction belongs to."""
    late = (F.col("split") != "train") & (F.col("t") >= t_split)
    return F.when(late, F.col("split")).otherwise(F.lit("train"))


def mask_type(log: DataFrame, t_split: int = T_SPLIT) -> DataFrame:
    """1 per step, 2 or 3 on the late steps of valid or test users."""
    code = F.when(F.col("split") == "valid", F.lit(MASK_CODE["valid"])).when(
        F.col("split") == "test", F.lit(MASK_CODE["test"])).otherwise(F.lit(MASK_CODE["train"]))
    return log.withColumn("mask_type", F.transform(
        "click", lambda x, t: F.when(t >= t_split, code).otherwise(F.lit(MASK_CODE["train"]))
    ))


def phase_mask_from_type(masked: DataFrame) -> DataFrame:
    """Boolean mask per phase from the integer one, all three phases in one pass."""
    codes = F.array(*[
        F.struct(F.lit(p).alias("phase"), F.lit(c).alias("code")) for p, c in MASK_CODE.items()
    ])
    rows = masked.withColumn("_p", F.explode(codes))
    mask = F.transform("mask_type", lambda m: m == F.col("_p.code"))
    return rows.withColumn("phase", F.col("_p.phase")).withColumn("phase_mask", mask).drop("_p")


def batch_assign(split_users: DataFrame, batch_size: int = 1024, epoch: int = 0, seed: int = 0):
    """(row_idx, ..., phase, batch_id, batch_pos) of every user in every phase.

    Train is reshuffled each epoch; valid and test keep the order of the split
    permutation, in which their users were drawn.
    """
    rows = in_phases(split_users)
    shuffled = hash60("batch", seed, epoch, F.col("row_idx"))
    key = F.when(F.col("phase") == "train", shuffled).otherwise(split_key(seed))
    ranked = hash_rank(rows, key, "row_idx", within=("phase",), name="rank")
    return ranked.withColumn("batch_id", F.floor(F.col("rank") / batch_size)).withColumn(
        "batch_pos", (F.col("rank") % batch_size).cast("int")
    ).drop("rank")


def chunk_id(batch_size: int) -> Column:
    """Sequential chunks by position."""
    return F.floor(F.col("row_idx") / batch_size)
