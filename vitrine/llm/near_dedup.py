"""Near-duplicate groups by chosen-path set similarity join.

Documents become sets of word shingles; equal sets are one class.  In every tree a node
chooses positions of the minhash signature from its own path, and branches its classes
by the token found there: one position always and a second one so often that the mean
is 1 / similarity.  Nodes of few classes are compared exhaustively, larger ones branch
again.  Independent trees are repeated until a pair at the threshold is met with the
target recall.  Compared pairs that their sketches don't rule out are confirmed on the
full sets.

Comparing is sparse where groups are large.  The trees come in two batches.  Of each
batch a class's best partners are confirmed, in large nodes the best of sampled leaders,
and the links found are contracted: later nodes whose classes are one component already
are dropped before anything is attached to them, and in large ones only classes outside
the node's main component look for a leader.  After the trees the other partners met in
small nodes are confirmed, and the classes of large nodes that are still not connected
are compared on full sets.  Large nodes of different trees that hold the same component
are pooled where that makes fewer pairs.  There is no cap, and large nodes emit links,
never all pairs of a group.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import (
    WordHashes, gather, id_and_text, mix, shingle_hashes, small_batches, small_or_shuffled,
)
from vitrine.llm.components import components
from vitrine.sources.shared import cut_lineage, discard

WORDS, PERCENT = 5, 80
TARGET_RECALL = 0.999999
POSITIONS = 64   # minhash positions of a signature
SMALL_NODE = 32  # classes compared exhaustively at once
MIN_DEPTH = 2    # branchings before nodes are looked at
MAX_DEPTH = 3    # branchings before a still large node is compared in blocks
FIRST_TREES = 2  # trees whose links are contracted before the others are built
LEADERS, BLOCK = 64, 512  # leaders of a large node; rows on a side of a unit
CELLS = 1 << 22  # counters held at once when full sets are compared

_rng = np.random.default_rng(20260728)
_MUL = _rng.integers(1, 1 << 63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, POSITIONS, np.uint64)


def _agreeing(similarity: float) -> list:
    """Probability of each number of agreeing positions of a pair's signatures."""
    return [math.comb(POSITIONS, k) * similarity**k * (1 - similarity) ** (POSITIONS - k) for k in range(POSITIONS + 1)]


def _met(agreeing: int, similarity: float, depth: int) -> float:
    """Probability that a tree keeps a pair with ``agreeing`` positions together."""
    pairs = POSITIONS * (POSITIONS - 1)
    one = 2 * agreeing * (POSITIONS - agreeing) / pairs
    both = agreeing * (agreeing - 1) / pairs
    second = min(1.0, 1 / similarity - 1) * (POSITIONS - 1) / POSITIONS
    met = 1.0
    for _ in range(depth):
        two = one * met + both * (1 - (1 - met) ** 2)
        met = (1 - second) * agreeing / POSITIONS * met + second * two
    return met


def _passes(agreeing: int, least: int) -> float:
    """Probability that sketches agree in ``least`` positions: bytes of other tokens do in one of 256."""
    other = POSITIONS - agreeing
    return math.fsum(math.comb(other, j) * 255.0 ** (other - j) / 256.0**other for j in range(max(0, least - agreeing), other + 1))


def least_for(recall: float, similarity: float) -> int:
    """Sketch positions a pair must agree in: half of the misses ``recall`` allows go here."""
    def missed(least):
        return math.fsum(p * (1 - _passes(k, least)) for k, p in enumerate(_agreeing(similarity)))

    return max(least for least in range(POSITIONS + 1) if missed(least) <= (1 - recall) / 2)


def trees_for(recall: float, similarity: float, depth: int) -> int:
    """Trees that let a pair at ``similarity`` meet in a node and pass the sketch with
    probability ``recall``.  All trees draw from the same positions, so they are
    independent only for a given number of agreeing ones."""
    least = least_for(recall, similarity)
    cases = [(p, _passes(k, least), _met(k, similarity, depth)) for k, p in enumerate(_agreeing(similarity))]
    if math.fsum(p * (1 - seen * (met > 0)) for p, seen, met in cases) >= 1 - recall:
        raise ValueError(f"{POSITIONS} positions are too few for recall {recall} at {similarity}")
    trees = 1
    while math.fsum(p * (1 - seen * (1 - (1 - met) ** trees)) for p, seen, met in cases) > 1 - recall:
        trees += 1
    return trees


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, (shingles[i:i + 512, None] * _MUL + _ADD).min(0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def set_of(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Shingle hashes of a text; lower-cases A-Z and splits at ASCII white space."""
    return shingle_hashes(hashes.of(text.lower().split()), words)


def _key(shingles):
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sign(words):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            n, keys, sigs = [], [], []
            for text in b["text"]:
                s = set_of(text.as_buffer().to_pybytes(), words, hashes)
                n.append(len(s))
                keys.append(_key(s))
                sigs.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "sig"])
    return run


def _children(node, sig, similarity):
    """(index of the row, child node): branches of rows by their nodes' chosen positions."""
    h = mix(node)
    rows = np.arange(len(node))
    second = (h >> np.uint64(40)) < np.uint64((1 / similarity - 1) * (1 << 24))
    first_at, second_at = h % np.uint64(POSITIONS), (h >> np.uint64(16)) % np.uint64(POSITIONS)
    out = []
    for at, which in ((first_at, rows), (second_at, rows[second & (first_at != second_at)])):
        at = at[which].astype(np.int64)
        token = (at.astype(np.uint64) << np.uint64(32)) | sig[which, at]
        out.append((which, mix(node[which] ^ mix(token))))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _matrix(column, dtype, width):
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


NODE_ROWS = "node bigint, cid bigint, comp bigint"


def _rows(node, cid, comp):
    return pa.RecordBatch.from_arrays(
        [pa.array(node.view(np.int64)), pa.array(cid), pa.array(comp)], names=["node", "cid", "comp"])


def _roots(trees, similarity):
    """The nodes at MIN_DEPTH of ``trees``."""
    def run(batches):
        for b in batches:
            cid, sig = b["cid"].to_numpy(zero_copy_only=False), _matrix(b["sig"], "<u4", POSITIONS)
            comp = b["comp"].to_numpy(zero_copy_only=False)
            for tree in trees:
                rows, node = np.arange(len(cid)), np.full(len(cid), tree, np.uint64)
                for _ in range(MIN_DEPTH):
                    some, node = _children(node, sig[rows], similarity)
                    rows = rows[some]
                yield _rows(node, cid[rows], comp[rows])
    return run


def _branch(similarity):
    def run(batches):
        for b in batches:
            node, cid, comp = (b[c].to_numpy(zero_copy_only=False) for c in ("node", "cid", "comp"))
            rows, child = _children(node.view(np.uint64), _matrix(b["sig"], "<u4", POSITIONS), similarity)
            yield _rows(child, cid[rows], comp[rows])
    return run


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two components or more, with the number n of their classes."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return cut_lineage(rows.join(sizes.where("lo < hi").select("node", "n"), "node"))


def _one_of_equal(rows: DataFrame) -> DataFrame:
    """Of nodes with the same classes only one stays.  Only for nodes that are compared as
    they are: equal ones that branch on do so in ways of their own."""
    h = F.xxhash64("cid")
    nodes = rows.groupBy("node", "n").agg(F.bit_xor(h).alias("x"), F.min(h).alias("lo"), F.max(h).alias("hi"))
    nodes = nodes.groupBy("n", "x", "lo", "hi").agg(F.min("node").alias("node")).select("node")
    return cut_lineage(rows.join(nodes, "node", "left_semi"))


def tree_nodes(classes: DataFrame, similarity: float, trees: range) -> DataFrame:
    """(node, cid, comp, n): the nodes of ``trees`` in which classes (cid, sig, comp) are
    compared: those with several components."""
    rows = classes.select("cid", "sig", "comp").mapInArrow(_roots(trees, similarity), NODE_ROWS)
    done = sized = None
    for depth in range(MIN_DEPTH, MAX_DEPTH + 1):
        rows, above = cut_lineage(rows), sized
        sized = _sized(rows)
        for passed in (rows, above):
            if passed is not None:
                discard(passed)
        ends = _one_of_equal(sized if depth == MAX_DEPTH else sized.where(F.col("n") <= SMALL_NODE))
        done = ends if done is None else done.unionByName(ends)
        large = sized.where(F.col("n") > SMALL_NODE)
        rows = large.select("node", "cid", "comp").join(classes.select("cid", "sig"), "cid").mapInArrow(
            _branch(similarity), NODE_ROWS)
    discard(sized)
    return done


def _with_main(large: DataFrame) -> DataFrame:
    """Rows of large nodes with the node's most frequent component (main) and the number
    (m) of classes outside of it; nodes of one component are left out."""
    parts = large.groupBy("node", "comp").agg(F.count("*").alias("c"))
    main = parts.groupBy("node").agg(
        F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("n"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("node", "n", F.col("most.comp").alias("main"), (F.col("n") - F.col("most.c")).alias("m"))
    return large.select("node", "cid", "comp").join(main, "node")


def _units(large: DataFrame, small: DataFrame | None = None) -> DataFrame:
    """Deal each node's rows to units (node, unit): every ``left`` row meets every
    ``right`` row of its node in exactly one unit.  Rows stand on the left (1), right (2)
    or both (3).  ``lefts`` and ``rights`` are about the numbers of such rows; units of
    pooled nodes are negative."""
    blocks, groups = (F.ceil(F.greatest(c, F.lit(1)) / BLOCK) for c in ("lefts", "rights"))
    block, group = F.pmod(F.xxhash64("cid"), blocks), F.pmod(F.xxhash64("cid", F.lit(1)), groups)
    own = ("node", "cid", "comp", "n", "pooled")
    left = large.where("left").select(*own, blocks.alias("blocks"), block.alias("block"),
                                      F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1)).alias("group"))
    right = large.where("right").select(*own, blocks.alias("blocks"), group.alias("group"),
                                        F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))
    at = F.col("group") * F.col("blocks") + F.col("block")
    unit = F.when(F.col("pooled"), -1 - at).otherwise(at).alias("unit")
    dealt = left.select("node", unit, "cid", "comp", "n", F.lit(1).alias("side")).unionByName(
        right.select("node", unit, "cid", "comp", "n", F.lit(2).alias("side")))
    return dealt if small is None else dealt.unionByName(
        small.select("node", F.lit(0).cast("bigint").alias("unit"), "cid", "comp", "n", F.lit(3).alias("side")))


def _by_unit(names, own, work, out):
    """Arrow batches sorted by (node, unit) to ``work`` on one unit after the other.

    ``own`` makes the last column; ``work`` gets the columns of one unit and gives
    arrays, which become the columns ``out``.
    """
    def run(batches):
        held, done = None, []

        def flush():
            arrays = [np.concatenate(x) for x in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=out)

        for b in batches:
            cols = [b[n].to_numpy(zero_copy_only=False) for n in names] + [own(b[b.num_columns - 1])]
            if held is not None:
                cols = [np.concatenate(z) for z in zip(held, cols)]
            edges = [0, *(np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1)]
            for lo, hi in zip(edges, edges[1:]):
                done.extend(work(*[c[lo:hi] for c in cols]))
            held = [c[edges[-1]:] for c in cols]
            if done:
                yield flush()
        if held is not None:
            done.extend(work(*held))
        if done:
            yield flush()
    return run


def _best(least):
    """Partners (a, b) of different components by sketch, ``least`` positions or more agreeing: all pairs of a small
    node, ``best`` where b is the best of a or the other way round; of a large node each
    left row and its best partner on the right."""
    def work(node, unit, cid, comp, side, n, sketch):
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        for i in range(0, len(left) if len(right) else 0, 256):
            own = left[i:i + 256]
            same = (sketch[own][:, None, :] == sketch[right][None]).sum(2, dtype=np.int16)
            same[comp[own][:, None] == comp[right][None]] = -1
            best = np.zeros(same.shape, bool)
            best[np.arange(len(own)), same.argmax(1)] = True
            x, y = np.nonzero((same >= least) & (best | (n[0] <= SMALL_NODE)))
            a, b = cid[own[x]], cid[right[y]]
            yield np.minimum(a, b), np.maximum(a, b), best[x, y]
    return work


def _units_of(units, attached, column):
    """The rows of written ``units``, sorted unit by unit, with what is attached to their classes."""
    rows = gather(units, attached, "cid", spread=("node", "unit"))
    rows = rows.repartition("node", "unit").sortWithinPartitions("node", "unit", "cid")
    return rows.select("node", "unit", "cid", "comp", "side", "n", column)


def _first_partners(nodes, classes, least):
    """Distinct (a, b, best): see ``_best``, and the files it reads.  In large nodes the classes
    outside the main component stand on the left and sampled leaders on the right."""
    share = F.pmod(F.xxhash64("cid", "node"), F.lit(1 << 30)) / float(1 << 30)
    large = _with_main(nodes.where(F.col("n") > SMALL_NODE)).select(
        "node", "cid", "comp", "n", F.col("m").alias("lefts"), F.lit(LEADERS).cast("bigint").alias("rights"),
        (F.col("comp") != F.col("main")).alias("left"), (share < LEADERS / F.col("n")).alias("right"), F.lit(False).alias("pooled"))
    sketches = classes.select("cid", "sig").mapInArrow(_sketches, "cid bigint, sketch binary")
    work = _by_unit(("node", "unit", "cid", "comp", "side", "n"), lambda c: _matrix(c, np.uint8, POSITIONS),
                    _best(least), ["a", "b", "best"])
    # written: the look-up counts them too, and would plan and deal them again for every count
    units = cut_lineage(_units(large, nodes.where(F.col("n") <= SMALL_NODE)))
    pairs = _units_of(units, sketches, "sketch").mapInArrow(work, "a bigint, b bigint, best boolean")
    return pairs.groupBy("a", "b").agg(F.max("best").alias("best")), units


def _exact(percent):
    """Links (a, b) between components of a unit: shared shingles are counted for every
    pair of a left and a right row; of the links that join the same two components one
    is emitted."""
    def work(node, unit, cid, comp, side, n, sets):
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        if not len(right) or (comp == comp[0]).all():
            return
        sizes = np.array([len(s) for s in sets])
        known = np.unique(np.concatenate(list(sets[right])))
        for j in range(0, len(right), LEADERS):
            some = right[j:j + LEADERS]
            has = np.zeros((len(known) + 1, len(some)), np.int32)
            for k, r in enumerate(some):
                has[np.searchsorted(known, sets[r]), k] = 1
            step = max(1, CELLS // max(1, len(some) * int(sizes[left].max())))
            for i in range(0, len(left), step):
                own = left[i:i + step]
                flat = np.concatenate(list(sets[own]))
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                at[known[at] != flat] = len(known)  # no right row has it
                shared = np.add.reduceat(has[at], np.r_[0, np.cumsum(sizes[own])[:-1]])
                union = sizes[own][:, None] + sizes[some][None] - shared
                linked = (100 * shared >= percent * union) & (comp[own][:, None] != comp[some][None])
                x, y = np.nonzero(linked)
                a, b = own[x], some[y]
                ab = np.sort(np.stack([comp[a], comp[b]], 1), 1)
                _, first = np.unique(ab, axis=0, return_index=True)
                yield cid[a[first]], cid[b[first]]
    return work


def _labelled(rows, labels, key, name, spread, census=None):
    """The component of ``key``, or itself, as ``name``."""
    got = gather(rows, labels.select(F.col("v").alias(key), F.col("label").alias("_label")), key, spread=spread, census=census, how="left")
    return got.withColumn(name, F.coalesce("_label", F.col(key))).drop("_label")


def _open_members(large, labels):
    """Members of the large nodes that hold several components; all but those of the main
    one stand on the right.

    A group lies in large nodes of every tree, and what is near it, but not linked, keeps
    them open.  The nodes of one main component are pooled to one node, if its pairs are
    fewer than those of the nodes: each pair of theirs is a pair of the pool.
    """
    rows = cut_lineage(_labelled(large.select("node", "cid"), labels, "cid", "comp", ("node",)))
    rows = cut_lineage(_with_main(rows))
    pairs = lambda n, m: n.cast("double") * m
    apart = rows.select("node", "main", "n", "m").distinct().groupBy("main").agg(F.sum(pairs(F.col("n"), F.col("m"))).alias("apart"))
    pool = rows.select("main", "cid", "comp").distinct()
    sizes = pool.groupBy("main").agg(F.count("*").alias("n"), F.count_if(F.col("comp") != F.col("main")).alias("m"))
    sizes = cut_lineage(sizes.join(apart, "main").withColumn("pooled", pairs(F.col("n"), F.col("m")) <= F.col("apart")))
    pooled = pool.join(sizes.where("pooled").select("main", "n", "m"), "main").withColumn("node", F.col("main"))
    alone = rows.join(sizes.where("not pooled").select("main"), "main")
    columns = lambda df, flag: df.select(
        "node", "cid", "comp", "n", F.col("n").alias("lefts"), F.col("m").alias("rights"), F.lit(True).alias("left"),
        (F.col("comp") != F.col("main")).alias("right"), F.lit(flag).alias("pooled"))
    return columns(pooled, True).unionByName(columns(alone, False))


def _in_large_nodes(members, sets, percent):
    """Links between the components of large nodes, and the files it reads."""
    own = lambda c: _object_array([np.asarray(x.values) for x in c])
    work = _by_unit(("node", "unit", "cid", "comp", "side", "n"), own, _exact(percent), ["a", "b"])
    units = cut_lineage(_units(members))
    return _units_of(units, sets, "shingles").mapInArrow(work, "a bigint, b bigint").distinct(), units


def _object_array(items):
    out = np.empty(len(items), object)
    out[:] = items
    return out


def _full_sets(words):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            cids, sets = [], []
            for cid, key, text in zip(b["cid"].to_pylist(), b["set_key"].to_pylist(), b["text"]):
                s = set_of(text.as_buffer().to_pybytes(), words, hashes)
                if _key(s) == key:  # rows may share an id
                    cids.append(cid)
                    sets.append(s.view(np.int64))
            flat = np.concatenate([*sets, np.zeros(0, np.int64)])
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["cid", "shingles"])
    return run


def _sets_of(wanted, docs, words):
    """(cid, shingles) of the classes (cid, set_key, rep); null ids meet null ids."""
    found = docs.join(small_or_shuffled(wanted), F.col("doc_id").eqNullSafe(F.col("rep")))
    return cut_lineage(found.select("cid", "set_key", "text").mapInArrow(_full_sets(words), "cid bigint, shingles array<bigint>"))


def _confirmed(pairs, sets, percent):
    """Pairs whose full sets are similar enough."""
    one = gather(pairs, sets.select(F.col("cid").alias("a"), F.col("shingles").alias("s")), "a", spread=("b",))
    two = gather(one, sets.select(F.col("cid").alias("b"), F.col("shingles").alias("t")), "b", spread=("a",), census=pairs)
    shared = F.size(F.array_intersect("s", "t"))
    return two.where(100 * shared >= percent * (F.size("s") + F.size("t") - shared)).select("a", "b")


def _with_sets_of(wanted, sets, classes, docs, words):
    """``sets`` (None: none so far) and those of the classes ``wanted`` (cid) that it lacks."""
    missing = wanted.distinct()
    if sets is not None:
        missing = missing.join(sets.select("cid"), "cid", "left_anti")
    missing = cut_lineage(classes.select("cid", "set_key", "rep").join(missing, "cid", "left_semi"))
    if sets is None:
        return _sets_of(missing, docs, words)
    return sets if missing.isEmpty() else sets.unionByName(_sets_of(missing, docs, words))


def _ends(pairs):
    return pairs.select(F.explode(F.array("a", "b")).alias("cid"))


def _contracted(labels, pairs):
    """Components of the links so far, each a star around its label, and of new ``pairs``."""
    return components(pairs if labels is None else labels.select(F.col("v").alias("a"), F.col("label").alias("b")).unionByName(pairs))


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int, recall: float) -> DataFrame:
    """(v, label): components of the classes that have links."""
    similarity = percent / 100
    least, trees = least_for(recall, similarity), trees_for(recall, similarity, MAX_DEPTH)
    labels = sets = tried = others = large = None
    for some in (range(1, min(FIRST_TREES, trees) + 1), range(FIRST_TREES + 1, trees + 1)):
        own = classes.withColumn("comp", F.col("cid")) if labels is None else _labelled(classes, labels, "cid", "comp", ("cid",))
        nodes = tree_nodes(own, similarity, some)
        partners, units = _first_partners(nodes, classes, least)
        partners = cut_lineage(partners if tried is None else partners.join(tried, ["a", "b"], "left_anti"))
        discard(units)
        best = partners.where("best").select("a", "b")
        sets = _with_sets_of(_ends(partners if sets is None else best), sets, classes, docs, words)
        labels = _contracted(labels, cut_lineage(_confirmed(best, sets, percent)))
        more = partners.where("not best").select("a", "b"), nodes.where(F.col("n") > SMALL_NODE)
        tried, others, large = (best, *more) if tried is None else (
            tried.unionByName(best), others.unionByName(more[0]), large.unionByName(more[1]))
    met = cut_lineage(others.distinct().join(tried, ["a", "b"], "left_anti"))
    others = _labelled(_labelled(met, labels, "a", "x", ("b",)), labels, "b", "y", ("a",), census=met)
    others = cut_lineage(others.where("x <> y").select("a", "b"))
    discard(met)
    members = cut_lineage(_open_members(large, labels))
    again = cut_lineage(_ends(others).union(members.select("cid")).distinct())
    sets = _with_sets_of(again, sets, classes, docs, words)
    # few sets are asked for again: the others stay where they are
    sets = cut_lineage(sets.join(small_or_shuffled(again), "cid", "left_semi"))
    confirmed = cut_lineage(_confirmed(others, sets, percent))
    inside, units = _in_large_nodes(members, sets, percent)
    second = confirmed.unionByName(cut_lineage(inside))
    discard(units)
    return labels if second.isEmpty() else _contracted(labels, second)


def near_dedup(docs: DataFrame, id_col="doc_id", text_col="text", words=WORDS, percent=PERCENT,
               recall=TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets
    of ``words``-word shingles.  component_id is the smallest doc_id reachable; the
    document with that id is kept.  A null or empty text, or one without words, has an
    empty set and is linked with nothing.  Repeated rows are copies of each other; a
    null doc_id counts only where no other is reachable.  Extra columns are ignored, an
    empty table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    signed = cut_lineage(
        docs.mapInArrow(_sign(words), "doc_id bigint, n_shingles bigint, set_key binary, sig binary")
        .withColumn("row", F.monotonically_increasing_id()))
    # a class's rows collapse before the shuffle; its members' signatures are equal
    classes = signed.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("row").alias("cid"), F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    classes = cut_lineage(classes)
    labels = links(docs, classes, words, percent, recall)
    known = classes.select("set_key", "cid", "rep").join(labels.withColumnRenamed("v", "cid"), "cid", "left")
    known = cut_lineage(known.withColumn("label", F.coalesce("label", "cid")))
    ids = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = cut_lineage(gather(known.select("set_key", "label"), ids, "label", spread=("set_key",)).drop("label"))
    out = gather(signed.select("doc_id", "n_shingles", "set_key", "row"), final, "set_key", spread=("row",), how="left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sketches(batches):
    for b in batches:
        low = _matrix(b["sig"], "<u4", POSITIONS).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([b["cid"], pa.array([r.tobytes() for r in low], pa.binary())],
                                         names=["cid", "sketch"])
