"""Benchmark decontamination by SimHash of item-sized windows.

Windows of a document have the size of a benchmark item and stand where a shingle of an
item stands in the document, aligned with its place in the item; a window without a
shingle in common has similarity 0.  Window and item fingerprints meet through blocks of
bits: fingerprints within the radius agree on at least one of radius + 1 blocks.  What
meets within the radius is verified by the exact weighted similarity of the shingles.
"""

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.common import gather, id_and_text, small_or_shuffled
from vitrine.sources.shared import cut_lineage

WORDS, SIMILARITY = 5, 0.8
RADIUS = 15  # of 64 bits: one in 40 windows at similarity 0.8 lies beyond, nearly none above 0.85
BITS = 64


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingles(hashes: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, given the words' hashes."""
    n = F.size(hashes) - k + 1
    runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def weighted_shingles(words: Column, k: int) -> Column:
    """array<struct<h, w>>: distinct shingles, weighted by their letters and how often they come."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    lengths = F.transform(words, lambda w: F.length(w))
    runs = F.transform(shingles(hashes, k), lambda h, i: F.struct(
        h.alias("h"), F.aggregate(F.slice(lengths, i + 1, F.lit(k)), F.lit(0), lambda a, x: a + x).alias("w")))
    total = lambda h: F.aggregate(F.filter(runs, lambda r: r["h"] == h), F.lit(0), lambda a, r: a + r["w"])
    return F.transform(F.array_distinct(F.transform(runs, lambda r: r["h"])), lambda h: F.struct(h.alias("h"), total(h).alias("w")))


def simhash(weighted: Column) -> Column:
    """64-bit fingerprint: the sign of every bit's weighted sum."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def vote(s, b):
        is_set = F.call_function("shiftright", s["h"], b).bitwiseAND(one) == 1
        return F.when(is_set, s["w"]).otherwise(-s["w"])

    def set_bit(acc, b):
        total = F.aggregate(weighted, F.lit(0), lambda votes, s: votes + vote(s, b))
        return acc.bitwiseOR(F.when(total > 0, F.call_function("shiftleft", one, b)).otherwise(none))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), none, set_bit)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of distinct weighted shingles."""
    total = lambda s: F.aggregate(s, F.lit(0), lambda acc, x: acc + x["w"])
    shared = F.aggregate(a, F.lit(0), lambda acc, x: acc + F.aggregate(
        F.filter(b, lambda y: y["h"] == x["h"]), F.lit(0), lambda m, y: F.greatest(m, F.least(x["w"], y["w"]))))
    union = total(a) + total(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def blocks(fingerprint: Column, radius: int) -> Column:
    """array<struct<block, bits>>: radius + 1 blocks of bits, as even as they go."""
    n = radius + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return F.array(*[F.struct(
        F.lit(i).alias("block"),
        F.shiftright(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint")).alias("bits"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def _items(items: DataFrame, words: int) -> DataFrame:
    """(item_id, k, size, words): an item of fewer words than a shingle is one shingle."""
    split = items.withColumn("words", words_of(F.col("text"))).withColumn("size", F.size("words"))
    return cut_lineage(split.where("size > 0").select(
        F.col("doc_id").alias("item_id"), F.least("size", F.lit(words)).alias("k"), "size", "words"))


def _windows(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(doc_id, start, size): item-sized windows where an item's shingle stands."""
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    own = items.where(F.col("k") == k).select("size", F.posexplode(shingles(hashes(F.col("words")), k)).alias("at", "h"))
    own = cut_lineage(own.distinct())
    met = docs.select("doc_id", hashes(words_of(F.col("text"))).alias("hashes"))
    met = met.select("doc_id", F.posexplode(shingles(F.col("hashes"), k)).alias("p", "h"))
    return met.join(small_or_shuffled(own), "h").select(
        "doc_id", F.greatest(F.col("p") - F.col("at"), F.lit(0)).alias("start"), "size").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
                 item_text_col="text", words=WORDS, threshold=SIMILARITY, radius=RADIUS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start, n_words, similarity.

    start and n_words tell the best window in words (the first of equal ones).  Null
    and empty texts and items hold nothing and are never found; rows that share an id
    are searched one by one and reported once; a null id is reported as null; extra
    columns are ignored; without documents or items there are no rows.  Only texts with
    a shingle of an item are split into windows; equal windows are compared once.
    """
    docs = id_and_text(docs, id_col, text_col)
    items = _items(id_and_text(items, item_col, item_text_col), words)
    found = None
    for k in [r["k"] for r in items.select("k").distinct().orderBy("k").collect()]:  # at most `words` sizes
        part = _found(docs, items.where(F.col("k") == k), k, threshold, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, start int, n_words int, similarity double")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("rest"), "n_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.rest")).alias("start"), "b.n_words", "b.similarity")


def _found(docs, items, k, threshold, radius):
    places = cut_lineage(_windows(docs, items, k))
    places = cut_lineage(places.groupBy(F.col("doc_id").alias("at_id")).agg(F.collect_list(F.struct("start", "size")).alias("places")))
    held = docs.join(small_or_shuffled(places), F.col("doc_id").eqNullSafe(F.col("at_id")))
    held = held.select("doc_id", "places", words_of(F.col("text")).alias("words"))
    windows = held.select("doc_id", F.explode("places").alias("p"), "words").select(
        "doc_id", "p.start", "p.size", F.slice("words", F.col("p.start") + 1, F.col("p.size")).alias("words"))
    # equal windows are one class: a passage that many documents share is compared once
    windows = cut_lineage(windows.withColumn("key", F.sha2(F.concat_ws(" ", "words"), 256)))
    kinds = windows.groupBy("size", "key").agg(F.min("words").alias("words"))
    kinds = kinds.withColumn("shingles", weighted_shingles(F.col("words"), k)).select(
        "size", "key", "shingles", simhash(F.col("shingles")).alias("print"))
    kinds = cut_lineage(kinds)
    known = items.select("item_id", "size", weighted_shingles(F.col("words"), k).alias("shingles"))
    known = cut_lineage(known.withColumn("print", simhash(F.col("shingles"))))
    left = kinds.select("key", "size", "print", F.explode(blocks(F.col("print"), radius)).alias("b"))
    right = known.select("item_id", F.col("size").alias("isize"), F.col("print").alias("iprint"),
                         F.explode(blocks(F.col("print"), radius)).alias("ib"))
    near = left.join(small_or_shuffled(right), (F.col("size") == F.col("isize")) & (F.col("b") == F.col("ib")))
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("iprint"))) <= radius)
    near = near.select("key", "size", "item_id").distinct()
    pairs = near.join(kinds.select("key", "size", "shingles"), ["key", "size"]).join(
        known.select("item_id", F.col("shingles").alias("ishingles")), "item_id")
    pairs = pairs.withColumn("similarity", similarity(F.col("shingles"), F.col("ishingles")))
    pairs = pairs.where(F.col("similarity") >= threshold).select(F.concat("key", "size").alias("kind"), "item_id", "similarity")
    matched = cut_lineage(pairs.groupBy("kind").agg(F.collect_list(F.struct("item_id", "similarity")).alias("items")))
    at = windows.select("doc_id", "start", F.col("size").alias("n_words"), F.concat("key", "size").alias("kind"))
    at = gather(at, matched, "kind", spread=("doc_id", "start"))
    return at.select("doc_id", "start", "n_words", F.explode("items").alias("i")).select("doc_id", "start", "n_words", "i.*")
