"""Descriptive statistics, popularity and report aggregates."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions.joins import gather
from vitrine.functions.vectors import distance
from vitrine.operators.reshape import explode_exposures, explode_interactions
from vitrine.schema import FIRST_REAL, NO_CLICK, PAD


def _without(column, value) -> Column:
    """Entries other than ``value``, summed over rows; arrays are not exploded."""
    return F.sum(F.size(F.array_remove(column, value)).cast("bigint"))


def _equal_to(column, value) -> Column:
    others = F.size(F.array_remove(column, value))
    return F.sum((F.size(column) - others).cast("bigint"))


def noclick_ratio(log) -> DataFrame:
    """No-clicks per observed interaction."""
    none = _equal_to("click", NO_CLICK)
    seen = _without("click", PAD)
    return log.agg(F.try_divide(none, seen).alias("noclick_ratio"))


def avg_slate_length(log) -> DataFrame:
    """Mean slate length over steps that have one."""
    total = F.sum(F.aggregate("slate_lengths", F.lit(0).cast("bigint"), lambda s, x: s + x))
    seen = _without("slate_lengths", 0)
    return log.agg(F.try_divide(total, seen).alias("avg_slate_length"))


def recommendation_ratio(log) -> DataFrame:
    """Share of recommendation slates among slates of known type."""
    recs = _equal_to("interaction_type", 2)
    known = _without("interaction_type", 0)
    return log.agg(F.try_divide(recs, known).alias("recommendation_ratio"))


def avg_interactions_per_user(log) -> DataFrame:
    """Mean number of observed steps, users without any included."""
    return log.agg(
        F.avg(F.size(F.array_remove("click", PAD))).alias("avg_interactions"))


def id_range(spark, num_items: Column) -> DataFrame:
    """(item_id) for every id in [0, num_items), generated in parallel blocks."""
    block = 4096
    one = spark.range(1).select(num_items.alias("n"))
    blocks = one.select("n", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("n") - 1) / block))).alias("b"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(tasks, "b")  # tiny rows that grow: keep them apart
    ids = blocks.select(F.explode(F.sequence(
        F.col("b") * block, F.least(F.col("n"), (F.col("b") + 1) * block) - 1)).alias("item_id"))
    return ids.select(F.col("item_id").cast("int").alias("item_id"))


def items_left_counts(counts: DataFrame, num_items: Column, name: str = "n") -> DataFrame:
    """Every id in [0, num_items) with its count, zero where it has none."""
    ids = id_range(counts.sparkSession, num_items)
    return ids.join(counts, "item_id", "left").select(
        "item_id", F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name))


def _with_pad_row(counts, pad: DataFrame, name) -> DataFrame:
    return counts.unionByName(pad.select(F.lit(PAD).alias("item_id"), F.col(name)))


def item_click_counts(log, num_items: Column) -> DataFrame:
    """Occurrences of every id as a click; padding is counted without exploding it."""
    real = explode_interactions(log.select("click"), ("click",))
    counts = real.groupBy(F.col("click").alias("item_id")).agg(F.count("*").alias("clicks"))
    pad = log.agg(_equal_to("click", PAD).alias("clicks"))
    return items_left_counts(_with_pad_row(counts, pad, "clicks"), num_items, "clicks")


def item_view_counts(log, num_items: Column) -> DataFrame:
    """Occurrences of every id over all slate positions."""
    real = explode_exposures(log.select("click", "slate"))
    counts = real.groupBy("item_id").agg(F.count("*").alias("views"))
    pad = log.agg(_equal_to(F.flatten("slate"), PAD).alias("views"))
    return items_left_counts(_with_pad_row(counts, pad, "views"), num_items, "views")


def item_counts(log, num_items: Column) -> DataFrame:
    """(item_id, clicks, views): ``item_click_counts`` and ``item_view_counts`` in one pass."""
    entry = lambda item, clicks, views: F.struct(
        item.cast("int").alias("item_id"), clicks.cast("bigint").alias("clicks"), views.cast("bigint").alias("views"))
    steps = log.select(F.explode(F.arrays_zip("click", "slate")).alias("s")).select(
        "s.click", F.coalesce("s.slate", F.array().cast("array<int>")).alias("slate"))
    shown = F.array_remove("slate", PAD)
    real = F.col("click") != PAD
    pads = entry(F.lit(PAD), F.lit(0), F.size("slate") - F.size(shown))
    seen = F.transform(F.when(real, shown).otherwise(F.array().cast("array<int>")), lambda x: entry(x, F.lit(0), F.lit(1)))
    rows = steps.select(F.explode(F.concat(F.array(entry(F.col("click"), F.lit(1), F.lit(0)), pads), seen)).alias("e"))
    counts = rows.groupBy("e.item_id").agg(F.sum("e.clicks").alias("clicks"), F.sum("e.views").alias("views"))
    return id_range(log.sparkSession, num_items).join(counts, "item_id", "left").select(
        "item_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("clicks", "views")])


def item_ctr(clicks, views=None, min_views: int = 1000) -> DataFrame:
    """Clicks per view; zero below ``min_views``.  ``clicks`` may hold the views too."""
    both = clicks if views is None else clicks.join(views, "item_id")
    seen = F.when(F.col("views") == 0, F.lit(1e-6)).otherwise(F.col("views").cast("double"))
    ctr = F.when(seen < min_views, F.lit(0.0)).otherwise(F.col("clicks") / seen)
    return both.select("item_id", "clicks", "views", ctr.alias("ctr"))


def top_ctr_items(ctr, k: int = 20) -> DataFrame:
    """The ``k`` highest rates; ties go to the smaller id."""
    return ctr.orderBy(F.desc("ctr"), "item_id").limit(k)


def _all_bins(binned, bins, name="n"):
    ids = binned.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return ids.join(binned, "bin", "left").select(
        "bin", F.coalesce(name, F.lit(0)).cast("bigint").alias(name))


def histogram(rows, value: Column, low, high, bins: int = 100) -> DataFrame:
    """(bin, n): equal bins on [low, high], last one closed, outside dropped."""
    rows = rows.select(value.cast("double").alias("v"), low.alias("lo"), high.alias("hi"))
    inside = rows.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    guess = F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), width), F.lit(0.0)))
    inside = inside.withColumn("w", width).withColumn(
        "b", F.greatest(F.lit(0), F.least(guess, F.lit(bins - 1))).cast("int"))
    # the division may round across an edge: the edges decide
    below = F.col("v") < F.col("lo") + F.col("b") * F.col("w")
    above = (F.col("v") >= F.col("lo") + (F.col("b") + 1) * F.col("w")) & (F.col("b") < bins - 1)
    bin_ = F.col("b") - below.cast("int") + (above & (F.col("w") > 0)).cast("int")
    return _all_bins(
        inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")), bins)


def popularity_histogram(views, bins: int = 100, top: float = 1000.0) -> DataFrame:
    """Exposures per item, reserved ids counted as one, in bins on [0, top]."""
    shown = F.when(F.col("item_id") < FIRST_REAL, F.lit(1)).otherwise(F.col("views"))
    return histogram(views, shown, F.lit(0.0), F.lit(float(top)), bins)


def value_histogram(rows, value: Column, bins: int = 100) -> DataFrame:
    """Equal bins between the smallest and largest value."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    low, high = ends.select("lo").scalar(), ends.select("hi").scalar()
    return histogram(rows, value, low, high, bins)


def category_counts(items) -> DataFrame:
    """Every item with the number of items in its category."""
    sizes = items.groupBy("category_id").agg(F.count("*").alias("n"))
    return gather(items, sizes, "category_id", "category_id", spread=("item_id",)).select(
        "item_id", "category_id", F.col("n").cast("bigint").alias("n"))


def item_report(views, posterior, items, vocab, groups, skip: int = 3) -> DataFrame:
    """Per item: views + 1, mean posterior scale, vertical, category size and
    the distances of vector and scale to those of its category.

    ``posterior`` (id, vec, scale) and ``groups`` (id, vec, scale) are parameter
    tables.  Of the verticals, in order of first appearance, the first ``skip``
    are left out.
    """
    names = vocab.where(F.col("attr") == "category").select(
        F.col("idx").alias("category_id"), F.substring("value", 1, 3).alias("vertical"))
    sized = category_counts(items)
    named = gather(sized, names, "category_id", "category_id", spread=("item_id",))
    # a handful of verticals
    first = named.groupBy("vertical").agg(F.min("item_id").alias("at"))
    kept = first.withColumn("rn", F.row_number().over(Window.orderBy("at"))).where(
        F.col("rn") > skip).select("vertical")
    g = groups.select(F.col("id").cast("int").alias("category_id"),
                      F.col("vec").alias("gvec"), F.col("scale").alias("gscale"))
    p = posterior.select(F.col("id").cast("int").alias("item_id"), "vec", "scale")
    chosen = gather(named, kept, "vertical", "vertical", spread=("item_id",))
    rows = gather(chosen.join(p, "item_id"), g, "category_id", "category_id",
                  spread=("item_id",)).join(views, "item_id")
    size = F.size("scale")
    return rows.select(
        "item_id",
        (F.col("views") + 1).alias("views"),
        (F.aggregate("scale", F.lit(0.0), lambda s, x: s + x) / size).alias("mean_scale"),
        "vertical",
        F.col("n").alias("category_count"),
        distance("vec", "gvec").alias("dist_vec"),
        distance("scale", F.transform("gscale", lambda x: F.abs(x))).alias("dist_scale"),
    )


def density_2d(rows, x: Column, y: Column, by=("vertical",), per_decade: int = 10):
    """Log-log cell counts per ``by``; non-positive values have no cell."""
    cell = lambda c: F.floor(F.log10(c) * per_decade).cast("int")
    return rows.where((x > 0) & (y > 0)).groupBy(
        *by, cell(x).alias("bx"), cell(y).alias("by")).agg(F.count("*").cast("bigint").alias("n"))


def num_obs(phased) -> DataFrame:
    """Observed interactions inside each phase (long rows with ``phase``)."""
    return phased.groupBy("phase").agg(
        F.count_if(F.col("click") != PAD).cast("bigint").alias("num_obs"))


def phase_epoch_mean(metrics) -> DataFrame:
    """Per epoch, phase and name: sum of the values over the number of batches."""
    return metrics.groupBy("epoch", "phase", "name").agg(
        (F.sum("value") / F.countDistinct("batch_id")).alias("value"))


def best_epoch(epochs, criterion: str, report) -> DataFrame:
    """The epoch with the largest ``criterion``, the first one on ties.

    ``epochs`` has (epoch, key, value); the result has epoch and the reported keys.
    """
    wide = epochs.groupBy("epoch").agg(*[
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
        for k in dict.fromkeys([criterion, *report])
    ])
    best = F.max_by(F.struct("epoch", *report), F.struct(F.col(criterion), -F.col("epoch")))
    return wide.where(F.col(criterion).isNotNull()).agg(best.alias("r")).select("r.*")


def param_l1(tables: dict) -> DataFrame:
    """Mean absolute value per parameter table (id, vec)."""
    out = None
    for name, table in tables.items():
        sums = F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x)))
        row = table.agg((sums / F.sum(F.size("vec"))).alias("l1")).select(
            F.lit(name).alias("name"), "l1")
        out = row if out is None else out.unionByName(row)
    return out


def state_energy(states, dim: int) -> DataFrame:
    """Sum over users of z squared, per step and dimension."""
    sums = [F.sum(F.get("vec", F.lit(i)) * F.get("vec", F.lit(i))) for i in range(dim)]
    per_t = states.groupBy("t").agg(F.array(*sums).alias("e"))
    return per_t.select("t", F.posexplode("e").alias("dim", "energy"))


def _moments(dim: int):
    """Number, mean and sum of squared deviations per element of a task's vectors; nulls don't count."""
    def run(batches):
        n, mean, m2 = np.zeros(dim), np.zeros(dim), np.zeros(dim)
        for b in batches:
            vec = b.column("vec")
            lengths = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False)
            flat = vec.flatten()
            rows = np.repeat(np.arange(len(lengths)), lengths)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            some = ~flat.is_null().to_numpy(zero_copy_only=False) & (at < dim)
            x, known = np.zeros((len(lengths), dim)), np.zeros((len(lengths), dim), bool)
            x[rows[some], at[some]] = flat.to_numpy(zero_copy_only=False)[some]
            known[rows[some], at[some]] = True
            count = known.sum(0)
            own = x.sum(0) / np.maximum(count, 1)
            gap = own - mean
            m2 += (np.where(known, x - own, 0.0) ** 2).sum(0) + gap**2 * n * count / np.maximum(n + count, 1)
            n += count
            mean += gap * count / np.maximum(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), *map(pa.array, (n, mean, m2))],
                                         names=["dim", "n", "mean", "m2"])
    return run


def state_std(states, dim: int) -> DataFrame:
    """Sample standard deviation per dimension over users and steps.

    Every task sends its moments; they are added up by their distances to the common mean.
    """
    parts = states.select("vec").mapInArrow(_moments(dim), "dim int, n double, mean double, m2 double").where("n > 0")
    of = Window.partitionBy("dim")
    gap = F.col("mean") - F.sum(F.col("n") * F.col("mean")).over(of) / F.sum("n").over(of)
    sums = parts.select("dim", "n", (F.col("m2") + F.col("n") * gap * gap).alias("m2")).groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("m2").alias("m2"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / F.greatest(F.col("n") - 1, F.lit(1.0))))
    every = states.sparkSession.range(dim).select(F.col("id").cast("int").alias("dim"))
    return every.join(sums, "dim", "left").select("dim", std.alias("std"))


def user_hits(recs, clicks) -> DataFrame:
    """Distinct recommended items among a user's clicks.

    ``recs`` (row_idx, recs) and ``clicks`` (row_idx, clicks) hold one bounded
    array per user.
    """
    both = clicks.join(recs, "row_idx")
    return both.select(
        "row_idx", F.size(F.array_intersect("clicks", "recs")).cast("bigint").alias("hits"))
