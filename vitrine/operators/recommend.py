"""Top-k recommendation over the whole catalogue, and lists built from it."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vitrine.functions.ranking import global_row_number
from vitrine.functions.vectors import squared_norm
from vitrine.schema import FIRST_REAL
from vitrine.sources.shared import cut_lineage, discard

# Users and items one multiplication takes: bounds the table of rough scores.
MAX_USERS, MAX_ITEMS = 1024, 4096
# The first items a user meets come in pieces that double from this size: they set the
# score that later ones must reach.
FIRST_ITEMS = 256
# Bytes of item blocks that are sent to the executors at a time.
ROUND_BYTES = 64 << 20
# Relative error granted to rough scores and bounds before exact scores decide.
SLACK = 1e-9
# Rough scores are single precision where no product comes near its range.
ROUGH_LIMIT = 1e30
# Pairs of user and item that are scored exactly at a time.
EXACT_PAIRS = 8192

_NONE = np.iinfo(np.int32).max  # an open place in a list; larger than any id


def _matrix(column):
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1)


def _ordered_sum(n, dim, term):
    """Sum of term(j) in index order, as the column expressions add it up."""
    out = np.zeros(n)
    for j in range(dim):
        out += term(j)
    return out


def _square(x):
    return _ordered_sum(len(x), x.shape[1], lambda j: x[:, j] * x[:, j])


def _ordered_dots(x, y, r, c):
    """Products of rows ``r`` of x and ``c`` of y, summed in index order, some thousand pairs at a time."""
    out = np.empty(len(r))
    for at in range(0, len(r), EXACT_PAIRS):
        part = slice(at, at + EXACT_PAIRS)
        out[part] = np.cumsum(x[r[part]] * y[c[part]], axis=1)[:, -1]
    return out


class _Space:
    """The tables of rough scores and of what reaches the lists, kept from block to block: fresh memory
    of that size costs as much as the product."""

    def __init__(self):
        self.held = {}

    def table(self, n, m, kind):
        held = self.held.get(kind)
        if held is None or held.size < n * m:
            held = self.held[kind] = np.empty(n * m, kind)
        return held[:n * m].reshape(n, m)


def pack_items(items, block_items=MAX_ITEMS) -> DataFrame:
    """(block, bytes, ids, vecs): items (item_id, vec) in binary blocks, longest vectors first.

    A block holds neighbours in the order of norms, so the range of its norms is narrow;
    block numbers follow that order.  Items without a vector are left out.
    """
    known = items.where(F.col("vec").isNotNull()).select("item_id", "vec", squared_norm("vec").alias("_norm"))
    order = [F.desc("_norm"), F.asc("item_id")]
    ordered = known.repartitionByRange(*order).sortWithinPartitions(*order).select("item_id", "vec")

    def run(batches):
        first, number, held = TaskContext.get().partitionId() << 32, 0, []

        def block(rows):
            nonlocal number
            rows = rows.combine_chunks()
            ids = rows.column("item_id").to_numpy().astype("<i4").tobytes()
            vecs = _matrix(rows.column("vec").combine_chunks()).astype("<f8").tobytes()
            number += 1
            columns = [pa.array([first + number], pa.int64()), pa.array([len(ids) + len(vecs)], pa.int64()),
                       pa.array([ids], pa.binary()), pa.array([vecs], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "bytes", "ids", "vecs"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= block_items:
                rows = pa.Table.from_batches(held)
                while len(rows) >= block_items:
                    yield block(rows.slice(0, block_items))
                    rows = rows.slice(block_items)
                held = rows.to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, "block bigint, bytes bigint, ids binary, vecs binary")


class _Block:
    """Items of one block: ids, and per draw their vectors, norms and bounds."""

    def __init__(self, ids, vecs, draws, dist):
        self.ids = ids
        y = vecs.reshape(len(ids), draws, -1)
        self.y = [np.ascontiguousarray(y[:, d]) for d in range(draws)]
        self.yy = [_square(v) for v in self.y]
        self.single = {}
        norms = [np.sqrt(s) for s in self.yy]
        self.low, self.high = [n.min() for n in norms], [n.max() for n in norms]
        self.dist = dist

    def bound(self, d, norm):
        """No item of the block scores more for a user vector of this norm."""
        if self.dist == "dot":
            return norm * self.high[d]  # Cauchy-Schwarz
        return -np.maximum(0.0, np.maximum(self.low[d] - norm, norm - self.high[d]))  # triangle

    def rough(self, d, x, norm, space=None):
        """(scores, error): rough scores in single precision if that can hold them, and what they may be off by.

        Any order of summation of n products errs by less than n + 2 roundings of |x| |y|; twice that is granted.
        For distances, half the squared norm of an item is one product more.  ``space`` holds the scores.
        """
        high, dim = self.high[d], x.shape[1]
        size = norm * high + (high * high if self.dist == "l2" else 0.0)
        scale = SLACK * (1.0 + norm * high + high ** 2)
        if not (norm.max() < ROUGH_LIMIT and high < ROUGH_LIMIT and size.max() < ROUGH_LIMIT):
            out = x @ self.y[d].T
            if self.dist == "l2":
                out -= 0.5 * self.yy[d]
            return out, scale
        wide = self.dist == "l2"
        if d not in self.single:
            self.single[d] = np.empty((len(self.ids), dim + wide), np.float32)
            self.single[d][:, :dim] = self.y[d]
            if wide:
                self.single[d][:, dim] = -0.5 * self.yy[d]
        mine = np.ones((len(x), dim + wide), np.float32)
        mine[:, :dim] = x
        out = np.matmul(mine, self.single[d].T, out=(space or _Space()).table(len(x), len(self.ids), np.float32))
        tiny = dim * 1e-37 * (1.0 + norm + high)  # of products below the range
        return out, scale + 2.0 * (dim + 4) * np.finfo(np.float32).eps * size + tiny

    def merge(self, d, x, xx, norm, best, k, space=None):
        """Let the block's items compete for the lists ``best`` (scores, ids); the number of users they can't concern."""
        scores, ids = best
        space = space or _Space()
        bound = self.bound(d, norm)
        kth = scores[:, -1]
        rows = np.flatnonzero(bound + SLACK * (1.0 + np.abs(bound)) >= kth)
        skipped = len(x) - len(rows)
        if not len(rows):
            return skipped
        if skipped:
            x, xx, norm, kth = x[rows], xx[rows], norm[rows], kth[rows]
        y, m = self.y[d], len(self.ids)
        rough, error = self.rough(d, x, norm, space)
        reach = kth
        if self.dist == "l2":  # rough is monotone in the score: (|x|^2 - distance^2) / 2
            reach = 0.5 * (xx - kth * kth)
        if m > k and np.isinf(kth).any():
            reach = np.maximum(reach, np.partition(rough, m - k, axis=1)[:, m - k])
        reach = reach - error - (SLACK * xx if self.dist == "l2" else 0.0)
        if rough.dtype == np.float32:  # compared in single precision, from below
            with np.errstate(over="ignore"):
                reach = np.nextafter(reach.astype(np.float32), np.float32(-np.inf))
        # mostly a block holds nothing for a user, which its best rough score tells (or one that is no number)
        near = np.flatnonzero(~(rough.max(axis=1) < reach))
        if 2 * len(near) < len(rough):
            rough, reach = rough[near], reach[near]
        else:
            near = np.arange(len(rough))
        at = np.flatnonzero(np.greater_equal(rough, reach[:, None], out=space.table(*rough.shape, bool)))
        r, c = near[at // m], at % m
        s = _ordered_dots(x, y, r, c)
        if self.dist == "l2":
            s = -np.sqrt(np.maximum(xx[r] - 2.0 * s + self.yy[d][c], 1e-10))
        found = np.unique(r)
        if not len(found):
            return skipped
        mine = rows[found]
        who = np.concatenate([np.repeat(found, k), r])
        every = np.concatenate([scores[mine].ravel(), s])
        names = np.concatenate([ids[mine].ravel(), self.ids[c]])
        order = np.lexsort((names, -every, who))
        who = who[order]
        keep = order[np.arange(len(who)) - np.searchsorted(who, who) < k]
        scores[mine], ids[mine] = every[keep].reshape(-1, k), names[keep].reshape(-1, k)
        return skipped


def _kernel(shared, k, dist, draws, opening, max_users, tally):
    """Lists of the rows' best items, continued by the items of one round."""
    def blocks(dim):
        out, size, seen = [], FIRST_ITEMS, 0
        for ids, vecs in shared.value:
            ids, vecs = np.frombuffer(ids, "<i4"), np.frombuffer(vecs, "<f8").reshape(-1, dim)
            at = 0
            while at < len(ids):
                end = min(len(ids), at + size) if opening else len(ids)
                out.append(_Block(ids[at:end], vecs[at:end], draws, dist))
                seen, at = seen + end - at, end
                size = max(seen, FIRST_ITEMS)
        return out

    def run(batches):
        items, space = None, _Space()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("vec"))
            items = blocks(x.shape[1]) if items is None else items
            x = x.reshape(n, draws, -1)
            scores, ids = np.full((n, draws, k), -np.inf), np.full((n, draws, k), _NONE, np.int32)
            before = batch.column("ids").flatten().to_numpy(zero_copy_only=False).reshape(n, draws, -1)
            had = before.shape[2]
            ids[:, :, :had] = before
            scores[:, :, :had] = batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(n, draws, -1)
            pairs = skipped = 0
            for d in range(draws):
                for start in range(0, n, max_users):
                    part = slice(start, start + max_users)
                    mine = np.ascontiguousarray(x[part, d])
                    xx = _square(mine)
                    norm = np.sqrt(xx)
                    best = scores[part, d], ids[part, d]
                    middle = np.median(norm)
                    for block in sorted(items, key=lambda b: -b.bound(d, middle)):
                        skipped += block.merge(d, mine, xx, norm, best, k, space)
                        pairs += len(mine)
            if tally:
                tally[0].add(pairs)
                tally[1].add(skipped)
            full = int((ids[0, 0] != _NONE).sum())  # the same in all lists: as many as there were items
            offsets = pa.array(np.arange(n + 1) * (draws * full), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a[:, :, :full]).ravel()))
                     for a in (ids, scores)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *lists], names=batch.schema.names)

    return run


def _rounds(blocks, round_bytes):
    """(first, last) block of each round of about ``round_bytes``; reads one short row per block."""
    out, held = [], 0
    for number, size in blocks.select("block", "bytes").orderBy("block").toLocalIterator():
        if out and held + size <= round_bytes:
            out[-1][1], held = number, held + size
        else:
            out.append([number, number])
            held = size
    return out


def best_lists(queries, items, k, dist="dot", draws=1, max_users=MAX_USERS, max_items=MAX_ITEMS,
               round_bytes=ROUND_BYTES, tally=None) -> DataFrame:
    """``queries`` with ``ids`` and ``scores``: the ``k`` best items of every row, best first, equal ones by the smaller id.

    ``queries`` (vec, …), ``items`` (item_id, vec); with several ``draws`` a vector is
    that of all draws in a row, and so are the lists.  Items are packed once into blocks,
    which go to every executor once, whatever the number of tasks, ``round_bytes`` at a
    time; rows stay where they are, and carry their lists from round to round; files of two
    rounds are kept at most.  A block is skipped for a user whom none of its items can concern by its range of norms.
    ``tally`` may be a pair of accumulators: pairs of user and block, and those skipped.
    """
    spark, held, shared = queries.sparkSession, None, None
    empty = {"ids": F.array().cast("array<int>"), "scores": F.array().cast("array<double>")}
    rows = queries.where(F.col("vec").isNotNull()).withColumns(empty)
    blocks = cut_lineage(pack_items(items, max_items))
    for i, (first, last) in enumerate(_rounds(blocks, round_bytes)):
        if i:
            # nothing reads the lists of the round before any more, nor its items
            before, held = held, cut_lineage(rows)
            rows = held
            shared.destroy()
            if before is not None:
                discard(before)
        taken = blocks.where(F.col("block").between(first, last)).orderBy("block").select("ids", "vecs")
        shared = spark.sparkContext.broadcast([(bytes(r[0]), bytes(r[1])) for r in taken.collect()])
        rows = rows.mapInArrow(_kernel(shared, k, dist, draws, not i, max_users, tally), rows.schema)
    discard(blocks)  # they were sent
    return rows


def topk_states(states, itemvec, k, dist="dot", reserved=False, draws=1, **blocks) -> DataFrame:
    """(draw, row_idx, t, item_id, score, rank) for every state row.

    ``states`` needs row_idx and vec; t defaults to 0.  Where it has ``last``, a state is that
    of steps t to ``last``: it is ranked once and its list is repeated.  States without a
    vector get no list.  ``reserved`` lets ids below the first real one compete.  With ``draws`` both sides hold the vectors of all draws in
    one, one after the other.
    """
    q = states if "t" in states.columns else states.withColumn("t", F.lit(0))
    last = F.col("last" if "last" in q.columns else "t").cast("int")
    q = q.select("row_idx", F.col("t").cast("int").alias("t"), last.alias("last"), "vec")
    items = itemvec.select(F.col("id").cast("int").alias("item_id"), "vec")
    items = items if reserved else items.where(F.col("item_id") >= FIRST_REAL)
    listed = best_lists(q, items, k, dist, draws, **blocks)
    steps = listed.withColumn("t", F.explode(F.sequence("t", "last")))
    each = steps.select("row_idx", "t", (F.size("ids") / draws).cast("int").alias("_k"),
                         F.posexplode(F.arrays_zip("ids", "scores")).alias("_p", "_s"))
    return each.select(
        F.expr("int(_p div _k)").alias("draw"), "row_idx", "t", F.col("_s.ids").alias("item_id"),
        F.col("_s.scores").alias("score"), (F.col("_p") % F.col("_k") + 1).alias("rank"))


def topk_items(uservec, itemvec, k, dist="dot", **blocks) -> DataFrame:
    """``k`` best real items per user: (row_idx, item_id, score, rank)."""
    return topk_states(uservec.select("row_idx", "vec"), itemvec, k, dist, **blocks).select(
        "row_idx", "item_id", "score", "rank")


def topk_targets(uservec, targets, k, dist="dot", **blocks) -> DataFrame:
    """The same against a list of targets (item_id, vec) of any length."""
    return topk_items(uservec, targets.select(F.col("item_id").alias("id"), "vec"), k, dist, **blocks)


def topk_inslate_thompson(states, posterior, k, temp=1.0, seed=0, dist="dot") -> DataFrame:
    """(row_idx, item_id, rank) from ``k`` posterior draws per user.

    Each draw ranks its own top k; the lists are read rank by rank, all draws'
    firsts first, and the first ``k`` distinct items are kept.  ``states`` (row_idx, vec)
    are the same in every draw, or a function from the drawn items (id, vec) to states
    that follow them; a vec there holds the vectors of all ``k`` draws one after the other.
    Draws are made once per item; a user is one row with k states.
    """
    from vitrine.operators.sampling import posterior_draws

    items = cut_lineage(posterior_draws(posterior, k, temp, seed))
    if callable(states):
        states = states(items)
    else:
        states = states.select("row_idx", F.flatten(F.array_repeat("vec", k)).alias("vec"))
    ranked = topk_states(states, items, k, dist, draws=k)
    listed = ranked.groupBy("row_idx").agg(
        F.array_sort(F.collect_list(F.struct("rank", "draw", "item_id"))).alias("s"))
    final = F.slice(F.array_distinct(F.col("s.item_id")), 1, k)
    return listed.select("row_idx", F.posexplode(final).alias("p", "item_id")).select(
        "row_idx", "item_id", (F.col("p") + 1).alias("rank"))


def rank_from_order(ordered, ids) -> DataFrame:
    """Inverse permutation: zero-based rank of each id of ``ids``, 0 if unlisted.

    ``ordered`` (item_id, rank) with ranks from 0.
    """
    return ids.join(ordered, "item_id", "left").select(
        "item_id", F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"))


def order_items(rows, *order) -> DataFrame:
    """(item_id, rank): ranks from 0 in the given total order."""
    return global_row_number(rows, *order, name="rank").select("item_id", "rank")


def rec_lists(ranked, name="recs") -> DataFrame:
    """(row_idx, recs): ranked rows back to one list per user."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return ranked.groupBy("row_idx").agg(listed.alias("s")).select(
        "row_idx", F.col("s.item_id").alias(name))


def category_report(log, ranked, items, vocab, n_steps=10, n_recs=2) -> DataFrame:
    """Per user, steps as columns: slate type, clicked category, recommended ones.

    ``ranked`` (row_idx, t, item_id, rank) per step.
    """
    from vitrine.operators.attach import interaction_type_name, item_category_name
    from vitrine.operators.reshape import explode_interactions

    steps = explode_interactions(
        log.select("row_idx", "click", "interaction_type"), ("click", "interaction_type"), False
    ).where(F.col("t") < n_steps)
    kinds = interaction_type_name(steps, vocab).select(
        "row_idx", "t", F.lit("slate type").alias("line"), F.col("type_name").alias("text"))
    clicks = steps.select("row_idx", "t", F.lit("click").alias("line"),
                          F.col("click").alias("item_id"))
    recs = ranked.where((F.col("t") < n_steps) & (F.col("rank") <= n_recs)).select(
        "row_idx", "t", F.concat(F.lit("rec item "), F.col("rank") - 1).alias("line"), "item_id")
    named = item_category_name(clicks.unionByName(recs), items, vocab, "item_id", "text")
    rows = kinds.unionByName(named.select("row_idx", "t", "line", "text"))
    return rows.groupBy("row_idx", "line").agg(*[
        F.max(F.when(F.col("t") == t, F.col("text"))).alias(f"t{t}") for t in range(n_steps)])


def recs_in_external_list(recs, external) -> DataFrame:
    """Per user: how many recommendations another recommender lists too."""
    shared = external.select("row_idx", "item_id").withColumn("_in", F.lit(1))
    return recs.join(shared, ["row_idx", "item_id"], "left").groupBy("row_idx").agg(
        F.count("_in").cast("bigint").alias("n"))
