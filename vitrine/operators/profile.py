"""User states folded over click sequences.

A user with T steps has T+1 states; state 0 is the start vector and a step
without a real click leaves the state as it was.

The folds read rows in order: per user a start row (t = -1, its vector is the state to begin
with), then one row per real click, or per step where step columns are wanted, then one for
the end.  ``vec`` is the vector of a real click, else null.  A row stands for the steps
``since`` to ``t``, at which the state is the same, and the fold adds this state, that
before the row's click.  A task holds one state and a batch of rows, however long a user is.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from vitrine.functions.vectors import let, matvec, zeros
from vitrine.operators.attach import gather_item_vectors
from vitrine.schema import FIRST_REAL, PAD

#: Rows of a user that are folded in one run; longer users of a linear fold are cut here.
SEGMENT = 1024

NEVER = -(1 << 60)


def click_vectors(log, itemvec, keep=()) -> DataFrame:
    """(row_idx, user_id, n_steps, since, t, _i, _last, click, vec, …keep): rows to fold, see the module's text.

    Arrays among ``keep`` are step columns: their values at step t; other columns of a user
    are repeated.  ``_i`` numbers a user's rows from -1 to ``_last``.  Items without a vector
    leave the state as it was.
    """
    steps = [c for c in dict.fromkeys(("click", *keep)) if log.schema[c].dataType.typeName() == "array"]
    fixed = ["row_idx", "user_id", "n_steps", *[c for c in keep if c not in steps]]
    users = log.withColumn("n_steps", F.size("click")).select(*fixed, *steps)

    def framed(values, first, last):
        return F.concat(F.array(first), values, F.array(last))

    none = F.lit(None)
    if len(steps) > 1:
        now = F.sequence(F.lit(-1), F.col("n_steps"))
        before = F.sequence(F.lit(-2), F.col("n_steps") - 1)
        values = {c: framed(c, none, none) for c in steps}
    else:
        real = F.filter("click", lambda c: c >= FIRST_REAL)
        at = F.filter(F.transform("click", lambda c, t: F.when(c >= FIRST_REAL, t)), lambda t: t.isNotNull())
        now = framed(at, F.lit(-1), F.col("n_steps"))
        before = F.concat(F.array(F.lit(-2), F.lit(-1)), at)
        values = {"click": framed(real, none, none)}
    rows = users.select(*fixed, (F.size(now) - 2).alias("_last"), F.posexplode(F.arrays_zip(
        before.alias("before"), now.alias("now"), *[v.alias(c) for c, v in values.items()])).alias("_p", "_r"))
    rows = rows.select(*fixed, "_last", (F.col("_p") - 1).alias("_i"), (F.col("_r.before") + 1).alias("since"),
                       F.col("_r.now").alias("t"), *[F.col(f"_r.{c}").alias(c) for c in values])
    real = rows.withColumn("_real", F.when(F.col("click") >= FIRST_REAL, F.col("click")))
    return gather_item_vectors(real, itemvec, "_real", how="left", apart=True).drop("_real")


def profile_start(users, kind, dim, table=None, matrix=None) -> DataFrame:
    """Add ``h0``: zeros, the user's own vector, or a low-rank one times a matrix.

    Rows to fold get it as the vector of their start row instead.
    """
    rows = users
    if "since" in users.columns:
        rows = users.where(F.col("t") < 0).drop("vec")
    if kind == "zero":
        rows = rows.withColumn("h0", zeros(dim))
    # joining on row_idx keeps users where they are
    elif "row_idx" in table.columns and "row_idx" in users.columns:
        rows = rows.join(table.select("row_idx", F.col("vec").alias("h0")), "row_idx")
    else:
        own = table.select(F.col("id").alias("user_id"), F.col("vec").alias("h0"))
        rows = rows.join(own, "user_id")
    if kind == "compact_normal":
        rows = rows.withColumn("h0", matvec(matrix, F.col("h0")))
    elif kind not in ("zero", "normal"):
        raise ValueError(f"unknown start model {kind!r}")
    if "since" in users.columns:
        return users.where(F.col("t") >= 0).unionByName(rows.withColumnRenamed("h0", "vec"))
    return rows


# --- cells: (state, input) -> state, and what is put out of a state ----------------------

def linear_cell(gamma: float):
    """g*h + (1-g)*v."""
    return lambda h, x: gamma * h + (1.0 - gamma) * x, lambda h: h


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def gru_cell(weights: dict):
    """``weights`` maps z, ir, id, in, hr, hd, hn to matrices [out][in]; z times the state is put out."""
    w = {k: np.asarray(v, dtype=float).T for k, v in weights.items()}

    def step(h, x):
        reset = _sigmoid(x @ w["ir"] + h @ w["hr"])
        keep = _sigmoid(x @ w["id"] + h @ w["hd"])
        return (1.0 - keep) * np.tanh(x @ w["in"] + reset * (h @ w["hn"])) + keep * h

    return step, lambda h: h @ w["z"]


def _scan(cells, key, name, after=False, gain=None):
    """Kernel over rows sorted by ``key``: adds the state before (or ``after``) each row.

    Rows of a key are a run, which a start row (t < 0) sets to its vector.  All runs of a
    batch advance together, one row of each at a time; the last run's state is carried to
    the next batch.  The states of several cells are averaged.  ``gain`` names a column that
    a row's state is multiplied by before its vector is added, in place of cells.
    ``_done`` counts the vectors of a run so far; it is negative before a start row, but for
    the sums of segments, which need none.
    """
    def run(batches):
        last, carried, done = None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in key], 1)
            new = np.ones(n, bool)
            new[1:] = (keys[1:] != keys[:-1]).any(1)
            new[0] = last is None or (keys[0] != last).any()
            starts = np.flatnonzero(new | (np.arange(n) == 0))
            lengths = np.diff(starts, append=n)
            vec = batch.column("vec")
            known = ~vec.is_null().to_numpy(zero_copy_only=False)
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            width = len(flat) // known.sum() if known.any() else 0
            dim = max(width, 0 if carried is None else carried[0].shape[1])
            x = np.zeros((n, dim))
            if width:
                x[known] = flat.reshape(-1, width)
            begins = batch.column("t").to_numpy() < 0
            factor = batch.column(gain).to_numpy() if gain else None
            h = [np.zeros((len(starts), dim)) for _ in cells]
            count = np.full(len(starts), 0 if after and not gain else NEVER)
            if not new[0]:
                for own, old in zip(h, carried):
                    own[0, :old.shape[1]] = old[0]  # a run may begin before its first vector
                count[0] = done
            out, counts = None, np.empty(n, np.int64)
            for j in range(lengths.max()):
                runs = np.flatnonzero(lengths > j)
                at = starts[runs] + j

                def write():
                    nonlocal out
                    z = sum(put(own[runs]) for own, (_, put) in zip(h, cells)) / len(cells)
                    out = np.empty((n, z.shape[1])) if out is None else out
                    out[at], counts[at] = z, count[runs]

                if not after:
                    write()
                some = known[at]
                moved, rows = runs[some], at[some]
                first = begins[rows]
                count[moved] = np.where(first, 0, count[moved] + 1)
                for own, (step, _) in zip(h, cells):
                    old = own[moved]
                    value = factor[rows][:, None] * old + x[rows] if gain else step(old, x[rows])
                    value[first] = x[rows][first]
                    own[moved] = value
                if after:
                    write()
            last, carried, done = keys[-1], [own[-1:].copy() for own in h], int(count[-1])
            states = pa.nulls(n, pa.list_(pa.float64()))
            if out.shape[1]:
                states = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            columns = [batch.column(c) for c in batch.schema.names if c != "vec"]
            names = [c for c in batch.schema.names if c != "vec"]
            yield pa.RecordBatch.from_arrays(
                [*columns, states, pa.array(counts)],
                names=[*names, name, "_done"])

    return run


def _folded(rows, cells, key, name, after=False, gain=None):
    """``rows`` sorted within runs of ``key`` and scanned; ``vec`` gives way to ``name`` and ``_done``."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartition(tasks, *key).sortWithinPartitions(*key, "t")
    fields = [f for f in rows.schema.fields if f.name != "vec"]
    states = [T.StructField(name, T.ArrayType(T.DoubleType())), T.StructField("_done", T.LongType())]
    return spread.mapInArrow(_scan(cells, key, name, after, gain), T.StructType([*fields, *states]))


def _states_of(folded):
    """Without start rows, and without users who have none."""
    return folded.where((F.col("t") >= 0) & (F.col("_done") >= 0)).drop("_seg", "_i", "_last", "_done")


def fold_linear(started, gamma: float, name: str = "z", segment: int = SEGMENT) -> DataFrame:
    """States g*h + (1-g)*v of rows to fold.

    A run of n clicks is the pair (g^n, weighted sum), and pairs compose.  Users of more
    than ``segment`` rows are cut: sums of their segments come first, are composed per user
    into the states that segments begin with, and the segments are folded side by side.
    """
    cells, key = [linear_cell(gamma)], ("row_idx", "_seg")
    seg = F.greatest(F.floor(F.col("_i") / segment), F.lit(0)).cast("int")
    rows = started.withColumn("_seg", seg)
    cut = rows.where(F.col("_last") >= segment)
    full = cut.where((F.col("_i") >= 0) & (F.col("_seg") < F.floor(F.col("_last") / segment)))
    sums = _folded(full.select("row_idx", "_seg", "_i", "t", "vec"), cells, key, "_sum", after=True)
    sums = sums.where(F.col("_i") % segment == segment - 1).select(
        "row_idx", (F.col("_seg") + 1).alias("t"), F.col("_sum").alias("vec"),
        F.pow(F.lit(float(gamma)), F.col("_done")).alias("_gain"))
    begin = cut.where(F.col("t") < 0).select("row_idx", "t", "vec", F.lit(0.0).alias("_gain"))
    carried = _folded(sums.unionByName(begin), cells, ("row_idx",), "_sum", after=True, gain="_gain")
    carried = carried.where((F.col("t") > 0) & (F.col("_done") >= 0))
    carried = carried.select("row_idx", F.lit(-1).alias("t"), F.col("t").alias("_seg"), F.col("_sum").alias("vec"))
    rows = rows.unionByName(carried, allowMissingColumns=True)
    return _states_of(_folded(rows, cells, key, name))


def fold_markov(clicked, dim: int, name: str = "z") -> DataFrame:
    """The last clicked vector; zero before the first click."""
    return fold_linear(profile_start(clicked, "zero", dim), 0.0, name)


def _fold_serially(started, cells, name):
    """Rows of a user in one run: a state that isn't composed of parts passes through all of them."""
    return _states_of(_folded(started, cells, ("row_idx",), name))


def fold_gru(started, weights: dict, name: str = "z") -> DataFrame:
    """Gated recurrent fold; serial per user."""
    return _fold_serially(started, [gru_cell(weights)], name)


def fold_linear_gru(started, gamma: float, weights: dict, name: str = "z") -> DataFrame:
    """Mean of the linear and the recurrent states."""
    return _fold_serially(started, [gru_cell(weights), linear_cell(gamma)], name)


def step_states(folded: DataFrame, name: str = "z", upto: int = None) -> DataFrame:
    """(row_idx, user_id, t, vec) for t = 0..n_steps, or 0..``upto``."""
    last = F.col("t") if upto is None else F.least(F.col("t"), F.lit(upto))
    rows = folded if upto is None else folded.where(F.col("since") <= upto)
    return rows.select("row_idx", "user_id", F.explode(F.sequence(F.col("since"), last)).alias("t"), F.col(name).alias("vec"))


def distinct_states(folded: DataFrame, name: str = "z", upto: int = None) -> DataFrame:
    """(row_idx, user_id, t, last, vec): a state once, for steps t to ``last``."""
    rows = folded if upto is None else folded.where(F.col("since") <= upto)
    last = F.col("t") if upto is None else F.least(F.col("t"), F.lit(upto))
    return rows.select("row_idx", "user_id", F.col("since").alias("t"), last.alias("last"), F.col(name).alias("vec"))


def steps_with_state(folded: DataFrame, columns, states=None) -> DataFrame:
    """One row per observed step: the kept log ``columns`` and ``z``, the state before it.

    ``folded`` was made with these columns.  ``states`` maps output names to state columns
    when there are several.
    """
    states = states or {"z": "z"}
    rows = folded.where((F.col("t") < F.col("n_steps")) & (F.col("click") != PAD))
    used = {"n_steps", "since", "t", *columns, "click", *states.values()}
    keep = [c for c in folded.columns if c not in used]
    return rows.select(*keep, "t", *columns, *[F.col(c).alias(name) for name, c in states.items()])


def state_at(folded: DataFrame, t: int = -1, name: str = "z") -> DataFrame:
    """(row_idx, user_id, vec) at one step; -1 is the state after all steps."""
    at = F.col("n_steps") if t < 0 else F.least(F.lit(t), F.col("n_steps"))
    rows = folded.where((F.col("since") <= at) & (at <= F.col("t")))
    return rows.select("row_idx", "user_id", F.col(name).alias("vec"))


def amortized_start(log, itemvec, dim, decay, scale_factor, masked=True, reserved=False):
    """(row_idx, user_id, vec, scale): start vector inferred from train clicks.

    Weights count clicks on ids above the first real one only; the centre used
    for the scale is the plain mean over all steps, and the scale's weights
    ignore the mask.  Reserved ids are zero vectors, unless ``reserved`` says that
    ``itemvec`` holds vectors for them.  All sums are partial sums per element; the
    running count of clicks is one pass over a user's steps.
    """
    cols = ("click", "mask_type") if masked else ("click",)
    keep = log.select("row_idx", "user_id", *cols)
    positive = F.transform("click", lambda x: F.when(x > FIRST_REAL, F.lit(1.0)).otherwise(0.0))
    steps = keep.select(
        "row_idx", F.size("click").alias("n"),
        F.posexplode(F.arrays_zip(*cols, positive.alias("pos"))).alias("t", "s"),
    ).select("row_idx", "n", "t", "s.*")
    if not reserved:
        # zero vectors add nothing to the plain mean and carry no weight
        steps = steps.where(F.col("click") >= FIRST_REAL)
    upto = Window.partitionBy("row_idx").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = F.col("pos") / (F.pow(F.sum("pos").over(upto), F.lit(float(decay))) + 1e-5)
    if masked:
        raw = F.when(F.col("mask_type") == 1, raw).otherwise(0.0)
    steps = steps.withColumn("raw", raw)
    # weights are sums' shares: the sums are divided at the end
    seen = gather_item_vectors(steps.select("row_idx", "t", "n", "click", "raw", "pos"), itemvec, "click", how="left")
    per_user = _amortized_sums(seen.where(F.col("vec").isNotNull() | (F.col("raw") > 0)), dim)
    zero = zeros(dim)
    stats = per_user.select(
        "row_idx", F.transform("wx", lambda x: F.coalesce(x, F.lit(0.0)) / (F.col("w") + 1e-5)).alias("mean"),
        let(F.transform("sx", lambda x: x / F.col("n")), lambda centre: F.zip_with(
            F.arrays_zip("vxx", "vx"), centre,
            lambda p, m: (p["vxx"] - 2.0 * m * p["vx"] + m * m * F.col("v")) / (F.col("v") + 1e-5))).alias("spread"))
    rows = keep.select("row_idx", "user_id").join(stats, "row_idx", "left")
    scale = F.transform(F.coalesce("spread", zero),
                        lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) + 1e-6) * float(scale_factor))
    return rows.select("row_idx", "user_id", F.coalesce("mean", zero).alias("vec"),
                       scale.alias("scale"))


def _amortized_sums(seen, dim):
    """Per user: sums of the weights w and v, and per element of w*x, x, v*x and v*x*x."""
    x = lambda i: F.get("vec", F.lit(i))
    sums = {
        "wx": lambda i: F.col("raw") * x(i), "sx": x, "vx": lambda i: F.col("pos") * x(i),
        "vxx": lambda i: F.col("pos") * x(i) * x(i),
    }
    return seen.groupBy("row_idx").agg(
        F.max("n").alias("n"), F.sum("raw").alias("w"), F.sum("pos").alias("v"),
        *[F.array(*[F.sum(term(i)) for i in range(dim)]).alias(name) for name, term in sums.items()])


USER_MODELS = {
    "markov": lambda started, dim, **kw: fold_markov(started, dim),
    "linear": lambda started, gamma, **kw: fold_linear(started, gamma),
    "gru": lambda started, weights, **kw: fold_gru(started, weights),
    "lingru": lambda started, gamma, weights, **kw: fold_linear_gru(started, gamma, weights),
}
