"""Projections, filters and array reshaping."""

from pyspark.sql import DataFrame, functions as F

from vitrine.functions.vectors import let
from vitrine.schema import (
    FIRST_REAL, MAX_SLATE, MAX_STEPS, PAD, STEP_COLUMNS, T_SPLIT, UNKNOWN,
)

_LONG_NAME = {"slate_lengths": "slate_length"}


def explode_interactions(log, columns=STEP_COLUMNS, drop_pad=True) -> DataFrame:
    """One row per user and step.

    Name the step columns you need: the others, above all ``slate``, are then
    not read.  ``drop_pad`` removes padding steps before anything else.
    """
    wanted = list(dict.fromkeys([*columns, *(["click"] if drop_pad else [])]))
    keep = [c for c in log.columns if c not in STEP_COLUMNS]
    rows = log.select(*keep, F.posexplode(F.arrays_zip(*wanted)).alias("t", "s"))
    if drop_pad:
        rows = rows.where(F.col("s.click") != PAD)
    return rows.select(
        *keep, "t", *[F.col(f"s.{c}").alias(_LONG_NAME.get(c, c)) for c in columns]
    )


def explode_exposures(log, drop_pad=True, extra=()) -> DataFrame:
    """One row per shown item: row_idx, user_id, t, pos, item_id."""
    steps = explode_interactions(log, ("slate", *extra), drop_pad)
    rows = steps.select(
        *[c for c in steps.columns if c != "slate"],
        F.posexplode("slate").alias("pos", "item_id"),
    )
    return rows.where(F.col("item_id") != PAD) if drop_pad else rows


def pack_interactions(
    interactions, n_steps: int = MAX_STEPS, n_slots: int = MAX_SLATE
) -> DataFrame:
    """Inverse of ``explode_interactions``: dense, right-padded arrays.

    Longer users or slates stay whole; the padding is a minimum.
    """
    step = F.struct("t", "click", "click_idx", "slate_length", "interaction_type", "slate")
    users = interactions.groupBy("row_idx", "user_id").agg(
        F.array_sort(F.collect_list(step)).alias("s")
    )
    by_t = F.map_from_arrays(F.col("s.t"), F.col("s"))
    steps = F.sequence(F.lit(0), F.greatest(F.lit(n_steps), F.array_max("s.t") + 1) - 1)

    def full(step):
        slate = F.coalesce(step["slate"], F.array().cast("array<int>"))
        return F.struct(
            *[F.coalesce(step[c], F.lit(0)).alias(c)
              for c in ("click", "click_idx", "slate_length", "interaction_type")],
            F.concat(slate, F.array_repeat(F.lit(PAD), F.lit(n_slots) - F.size(slate))).alias("slate"),
        )

    dense = let(by_t, lambda m: F.transform(steps, lambda t: full(F.try_element_at(m, t))))
    users = users.select("row_idx", "user_id", dense.alias("d"))
    return users.select(
        "row_idx", "user_id", F.col("d.click"), F.col("d.click_idx"),
        F.col("d.slate_length").alias("slate_lengths"), F.col("d.interaction_type"),
        F.col("d.slate"),
    )


def pack_slates(exposures) -> DataFrame:
    """Exposure rows back to one slate array per interaction."""
    shown = F.array_sort(F.collect_list(F.struct("pos", "item_id")))
    return exposures.groupBy("row_idx", "user_id", "t").agg(shown.alias("s")).select(
        "row_idx", "user_id", "t", F.col("s.item_id").alias("slate")
    )


def interaction_lookup(log, t: int, row_idx: int = None) -> DataFrame:
    """The interaction at step ``t``, of one user or of every user.

    The row filter reaches the Parquet scan; the step is an array access.
    """
    rows = log if row_idx is None else log.where(F.col("row_idx") == row_idx)
    return rows.select(
        "row_idx", "user_id", F.lit(t).alias("t"),
        *[F.get(c, F.lit(t)).alias(_LONG_NAME.get(c, c)) for c in STEP_COLUMNS],
    )


def limit_users(log, n: int) -> DataFrame:
    """The first ``n`` users by position."""
    return log.where(F.col("row_idx") < n)


def slate_length(slate):
    """Number of non-padding positions of a slate column."""
    return F.size(F.filter(slate, lambda x: x != PAD))


def click_position(slate, click):
    """Zero-based position of the clicked item; -1 when it is not in the slate."""
    return (F.array_position(slate, click) - 1).cast("int")


def real_item_filter(rows, column="item_id") -> DataFrame:
    """Only real items: reserved ids are dropped."""
    return rows.where(F.col(column) >= FIRST_REAL)


def observed_step_filter(interactions, in_phase=None) -> DataFrame:
    """Steps that enter the likelihood: no padding, no unknown click, in phase."""
    seen = ~F.col("click").isin(PAD, UNKNOWN)
    return interactions.where(seen if in_phase is None else seen & in_phase)


def phase_clicks(masked, name="clicks", keep_pad=False) -> DataFrame:
    """Clicks inside the phase, in step order, from rows with ``phase_mask``.

    The mask is true on padding steps too, so padding is removed unless asked for.
    """
    zipped = F.arrays_zip("click", "phase_mask")
    kept = F.filter(
        zipped,
        lambda s: s["phase_mask"] if keep_pad else s["phase_mask"] & (s["click"] != PAD),
    )
    return masked.withColumn(name, F.transform(kept, lambda s: s["click"]))


def history_cut(log, t_start: int = T_SPLIT) -> DataFrame:
    """Zero every per-step column from ``t_start`` on; ids and masks stay."""
    def cut(c):
        if c == "slate":
            return F.transform(c, lambda s, t: F.when(t < t_start, s).otherwise(
                F.transform(s, lambda x: F.lit(PAD))))
        return F.transform(c, lambda x, t: F.when(t < t_start, x).otherwise(F.lit(0)))

    present = [c for c in STEP_COLUMNS if c in log.columns]
    return log.withColumns({c: cut(c) for c in present})


def left_pad_history(clicks, length: int = MAX_STEPS):
    """Click sequence column: padded on the left, last ``length`` kept."""
    padded = F.concat(F.array_repeat(F.lit(PAD), length), clicks)
    return F.slice(padded, -length, length)


def collapse_item_group(items) -> DataFrame:
    """Every item in group 0."""
    return items.withColumn("category_id", F.lit(0))
