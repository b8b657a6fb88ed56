"""Phrases of two and three words by collocation score, counted in counting quotient filters.

A word's id is a hash of its language and itself, made unique over the corpus: words whose
hashes meet get ids of their own.  The ids of a phrase are packed into 126 bits and permuted
by an invertible mixing, so that keys spread evenly and can be read back.  A task counts the
phrases it reads and sends sorted filters, one per shard of the key space: the leading bits of
a key are its shard and its quotient, kept as two bit vectors (quotients that occur, ends of
runs); the rest of the key is stored in full, so no two phrases are confused; counters take
one byte up to 254.  The filters of a shard are merged in order.

Words that occur fewer times than a candidate must can't be part of one, nor of any count
that is asked for.  They are left out of phrases by a bitmap of fixed size over ids, which
may let some through but never holds one back.

Null texts are empty, a null language is `und`; an empty table gives an empty one; repeated
rows count once each; ties are ranked by the phrase; other columns are not read.
"""

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.llm.common import ASCII_LOWER, ASCII_UPPER, gather, mix, small_batches
from vitrine.sources.shared import cut_lineage

MIN_COUNT, PER_LANG = 10, 2000
#: A phrase goes if a longer candidate around it has at least this share (percent) of its count.
LONGER_PERCENT = 50
SCALE = 1_000_000
#: Bits of a word id; the highest one marks ids of words whose hashes met.
ID_BITS = 42
#: Words with ids of their own: they are sent to all tasks, so their number is checked.
MAX_MET = 1 << 20
#: Bits of the bitmap of words that may be part of a candidate.
BITMAP_BITS = 1 << 24
#: Phrases a task counts before it sorts them, and distinct ones it holds before it sends them.
SORTED_AT, HELD_PHRASES = 1 << 21, 1 << 20
#: Distinct words a task numbers or counts before it starts anew.
HELD_WORDS = 1 << 19
#: Phrases read per shard, about, and the bounds of the number of shards.
SHARD_PHRASES, MIN_SHARDS, MAX_SHARDS = 1 << 21, 64, 1 << 16

_LOCAL_BITS = 21
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(ASCII_UPPER.encode() + _BREAKS, ASCII_LOWER.encode() + b"." * len(_BREAKS))


def _words(text: str) -> list:
    """Words of a text in order, b"." between pieces; no word holds a full stop."""
    return text.encode().translate(_LOWER).replace(b".", b" . ").split()


# --- packed keys ------------------------------------------------------------------------

def packed(a, b, c, bits=ID_BITS):
    """(hi, lo): three ids in 3 * ``bits`` <= 126 bits of two unsigned 64-bit numbers."""
    return a << np.uint64(2 * bits - 64) | b >> np.uint64(64 - bits), b << np.uint64(bits) | c


def unpacked(hi, lo, bits=ID_BITS):
    mask = np.uint64((1 << bits) - 1)
    return hi >> np.uint64(2 * bits - 64), (hi << np.uint64(64 - bits) | lo >> np.uint64(bits)) & mask, lo & mask


def permuted(hi, lo):
    """An invertible mixing of 128 bits: four rounds, each half by the other's hash."""
    for i, key in enumerate(_ROUNDS):
        if i % 2:
            lo = lo ^ mix(hi + np.uint64(key))
        else:
            hi = hi ^ mix(lo + np.uint64(key))
    return hi, lo


def unpermuted(hi, lo):
    for i, key in reversed(list(enumerate(_ROUNDS))):
        if i % 2:
            lo = lo ^ mix(hi + np.uint64(key))
        else:
            hi = hi ^ mix(lo + np.uint64(key))
    return hi, lo


def merged(hi, lo, n):
    """Sorted distinct keys with the sums of their counters."""
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    first = np.flatnonzero(new)
    return hi[first], lo[first], np.add.reduceat(n, first) if len(first) else n[:0]


# --- filters ----------------------------------------------------------------------------

def to_filter(hi, lo, n, shard_bits: int) -> bytes:
    """A counting quotient filter of sorted distinct keys of one shard.

    Layout: number of keys, quotient bits; bit vector of quotients that occur; bit vector
    of slots that end a run; remainders in full, whole bytes; counters, 255 standing for
    an eight-byte one that follows in order.
    """
    q = max(3, int(len(hi) - 1).bit_length())
    quotient = (hi << np.uint64(shard_bits)) >> np.uint64(64 - q)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    run_end = np.ones(len(hi), bool)
    run_end[:-1] = quotient[1:] != quotient[:-1]
    keys = np.empty((len(hi), 2), ">u8")
    keys[:, 0], keys[:, 1] = hi, lo
    remainder = keys.view(np.uint8)[:, (shard_bits + q) // 8:]
    small = np.minimum(n, 255).astype(np.uint8)
    return b"".join([
        np.array([len(hi), q], "<u4").tobytes(), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(),
        np.ascontiguousarray(remainder).tobytes(), small.tobytes(), n[small == 255].astype("<u8").tobytes()])


def from_filter(data: bytes, shard: int, shard_bits: int):
    """(hi, lo, n): the sorted keys and counters of a filter."""
    size, q = (int(x) for x in np.frombuffer(data, "<u4", 2))
    at = 8

    def take(count, dtype=np.uint8):
        nonlocal at
        out = np.frombuffer(data, dtype, count, at)
        at += out.nbytes
        return out

    occupied = np.unpackbits(take((1 << q) // 8))
    run_end = np.unpackbits(take((size + 7) // 8), count=size)
    known = (shard_bits + q) // 8  # whole bytes that shard and quotient tell
    keys = np.zeros((size, 16), np.uint8)
    keys[:, known:] = take(size * (16 - known)).reshape(size, 16 - known)
    n = take(size).astype(np.int64)
    n[n == 255] = take(int((n == 255).sum()), "<u8")
    pair = keys.view(">u8").astype(np.uint64)
    ends = np.flatnonzero(run_end)
    quotient = np.repeat(np.flatnonzero(occupied), np.diff(ends, prepend=-1)).astype(np.uint64)
    left = 64 - shard_bits - q
    head = np.uint64(shard) << np.uint64(64 - shard_bits) if shard_bits else np.uint64(0)
    hi = head | quotient << np.uint64(left) | pair[:, 0] & np.uint64((1 << left) - 1)
    return hi, pair[:, 1], n


# --- words ------------------------------------------------------------------------------

def _seed(lang: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(lang)


def _hash(word: bytes, seed: int, bits: int) -> int:
    """An id from 1 to 2**(bits - 1) - 1."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word, seed) % ((1 << bits - 1) - 1) + 1


def _lang_text(docs, lang_col, text_col):
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, id_bits=ID_BITS, lang_col="lang", text_col="text") -> DataFrame:
    """(lang, word, n, id) of all words; ids are unique, see the module's text."""
    def run(batches):
        held = {}

        def sent():
            langs, words, counts, ids = [], [], [], []
            for lang, counter in held.items():
                seed = _seed(lang.encode())
                langs += [lang] * len(counter)
                words += counter
                counts += counter.values()
                ids += [_hash(w, seed, id_bits) for w in counter]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                 pa.array(counts, pa.int64()), pa.array(ids, pa.int64())], names=["lang", "word", "n", "id"])

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                counter = held.setdefault(lang.as_py(), Counter())
                counter.update(_words(text.as_py()))
                counter.pop(b".", None)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield sent()
        yield sent()

    counted = _lang_text(docs, lang_col, text_col).mapInArrow(run, "lang string, word string, n bigint, id bigint")
    words = cut_lineage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.max("id").alias("id")))
    one = F.struct("lang", "word")
    met = words.groupBy("id").agg(F.count("*").alias("k"), F.min(one).alias("first")).where("k > 1").select("id", "first")
    further = gather(words, cut_lineage(met), "id", spread=("lang", "word")).where(one > F.col("first")).select("lang", "word")
    further = sorted(map(tuple, further.limit(MAX_MET + 1).collect()))
    if len(further) > MAX_MET:
        raise ValueError("too many words share an id; use more id_bits")
    if not further:
        return words
    own = words.sparkSession.createDataFrame(
        [(lang, word, (1 << id_bits - 1) + i) for i, (lang, word) in enumerate(further)], "lang string, word string, own bigint")
    return cut_lineage(words.join(F.broadcast(own), ["lang", "word"], "left").select(
        "lang", "word", "n", F.coalesce("own", "id").alias("id")))


def _bitmap(words: DataFrame, min_count: int) -> np.ndarray:
    """Bytes with a bit for every id of a word that occurs ``min_count`` times: BITMAP_BITS in all."""
    bit = F.col("id") % BITMAP_BITS
    blocks = words.where(F.col("n") >= min_count).select(F.floor(bit / 32).alias("block"), (bit % 32).cast("int").alias("bit"))
    rows = blocks.groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 32, "<u4")
    out[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().astype("<u4")
    return out.view(np.uint8)


# --- phrases ----------------------------------------------------------------------------

class _Numbers(dict):
    """Numbers of a language's words within a task; 0 ends a piece or is a rare word."""

    def __init__(self, lang, held, met, bitmap, bits):
        super().__init__({b".": 0})
        self.seed, self.held, self.bitmap, self.bits = _seed(lang.encode()), held, bitmap, bits
        self.met = met.get(lang, {})

    def __missing__(self, word):
        own = self.met.get(word) or _hash(word, self.seed, self.bits)
        bit = own % BITMAP_BITS
        number = 0
        if self.bitmap[bit >> 3] >> (bit & 7) & 1:
            number = len(self.held)
            self.held.append(own)
        self[word] = number
        return number


class _Phrases:
    """Counts of a task's phrases, by numbers that hold within the task."""

    def __init__(self, met, bitmap, bits, shard_bits):
        self.met, self.bitmap, self.bits, self.shard_bits = met, bitmap, bits, shard_bits
        self.held, self.open, self.waiting, self.n_waiting = array("Q", [0]), array("I"), [], 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.start()

    def start(self):
        """New numbers; of the open words those that start further phrases keep theirs."""
        carried = [self.held[i] for i in self.open[-2:]]
        self.held, self.of_lang = array("Q", [0]), {}
        self.open = array("I")
        for own in carried:
            if own:
                self.held.append(own)
            self.open.append(len(self.held) - 1 if own else 0)

    def numbers(self, lang):
        if lang not in self.of_lang:
            self.of_lang[lang] = _Numbers(lang, self.held, self.met, self.bitmap, self.bits)
        return self.of_lang[lang]

    def add(self, lang, text):
        """Filters that are full, while a text's words are taken in."""
        words = _words(text)
        for at in range(0, len(words), 1 << 16):
            part = words[at:at + (1 << 16)]
            self.open.extend(map(self.numbers(lang).__getitem__, part))
            if len(self.open) > 1 << 18:
                self.count()
            if len(self.held) + sum(map(len, self.of_lang.values())) > 2 * HELD_WORDS:
                self.count()
                yield from self.sent()
                self.start()
            elif len(self.keys) > HELD_PHRASES:
                yield from self.sent()
        self.open.append(0)

    def count(self):
        """Phrases that start at the open words but for the last two."""
        x = np.frombuffer(self.open, np.uint32).astype(np.uint64)
        self.open = self.open[-2:]
        if len(x) < 3:
            return
        pairs = x[:-2] << np.uint64(2 * _LOCAL_BITS) | x[1:-1] << np.uint64(_LOCAL_BITS)
        two = (x[:-2] != 0) & (x[1:-1] != 0)
        three = two & (x[2:] != 0)
        self.waiting += [pairs[two], pairs[three] | x[2:][three]]
        self.n_waiting += len(self.waiting[-1]) + len(self.waiting[-2])
        if self.n_waiting > SORTED_AT:
            self.sort()

    def sort(self):
        if not self.waiting:
            return
        keys, n = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.n_waiting = [], 0
        keys, n = np.concatenate([self.keys, keys]), np.concatenate([self.counts, n])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
        self.keys, self.counts = keys[first], np.add.reduceat(n, first) if len(first) else n

    def sent(self):
        """(shard, filter) of all that is counted; counting starts anew."""
        self.sort()
        mask = np.uint64((1 << _LOCAL_BITS) - 1)
        own = np.frombuffer(self.held, np.uint64)
        a, b, c = (own[(self.keys >> np.uint64(i * _LOCAL_BITS) & mask).astype(np.int64)] for i in (2, 1, 0))
        hi, lo, n = merged(*permuted(*packed(a, b, c, self.bits)), self.counts)
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        shard = hi >> np.uint64(64 - self.shard_bits)
        starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(hi) else []
        for start, end in zip(starts, [*starts[1:], len(hi)]):
            yield int(shard[start]), to_filter(hi[start:end], lo[start:end], n[start:end], self.shard_bits)


def phrase_filters(docs: DataFrame, words: DataFrame, shard_bits: int, min_count=MIN_COUNT, id_bits=ID_BITS,
                   lang_col="lang", text_col="text") -> DataFrame:
    """(shard, filter): counting quotient filters of each task's phrases of two and three words."""
    bitmap = _bitmap(words, min_count)
    met = {}
    for lang, word, own in words.where(F.col("id") >= 1 << id_bits - 1).select("lang", "word", "id").collect():
        met.setdefault(lang, {})[word.encode()] = own  # at most MAX_MET, see word_counts
    shared = docs.sparkSession.sparkContext.broadcast((met, bitmap))

    def run(batches):
        phrases = _Phrases(*shared.value, id_bits, shard_bits)

        def batch_of(rows):
            shards, filters = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), pa.array(filters, pa.binary())], names=["shard", "filter"])

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                rows = list(phrases.add(lang.as_py(), text.as_py()))
                if rows:
                    yield batch_of(rows)
        phrases.open.extend([0, 0])
        phrases.count()
        rows = list(phrases.sent())
        if rows:
            yield batch_of(rows)

    return _lang_text(docs, lang_col, text_col).mapInArrow(run, "shard int, filter binary")


def merge_filters(filters: DataFrame, shard_bits: int, min_count=MIN_COUNT, id_bits=ID_BITS) -> DataFrame:
    """(w1, w2, w3, a): phrases of ``min_count`` and more; w3 is 0 for two words.

    A task reads the filters of its shards in order and holds one shard at a time.
    """
    def run(batches):
        now, parts, size = None, [], 0

        def rows():
            hi, lo, n = merged(*(np.concatenate(p) for p in zip(*parts)))
            keep = n >= min_count
            ids = unpacked(*unpermuted(hi[keep], lo[keep]), id_bits)
            columns = [pa.array(x.astype(np.int64)) for x in (*ids, n[keep])]
            return pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "w3", "a"])

        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("filter")):
                if shard != now and parts:
                    yield rows()
                    parts, size = [], 0
                now = shard
                parts.append(from_filter(data.as_py(), shard, shard_bits))
                size += len(parts[-1][0])
                if size > 2 * SHARD_PHRASES:
                    parts = [merged(*(np.concatenate(p) for p in zip(*parts)))]
                    size = len(parts[0][0]) // 2  # merged again once as many have come
        if parts:
            yield rows()

    spark = filters.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return filters.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(
        run, "w1 bigint, w2 bigint, w3 bigint, a bigint")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exact for counts below 10**15."""
    exact = lambda c: c.cast("decimal(15,0)")
    up = F.lit(SCALE).cast("decimal(7,0)") * (exact(a) * exact(a))
    return F.call_function("div", up, exact(left) * exact(right)).cast("bigint")


def _first_per_lang(rows: DataFrame, per_lang: int) -> DataFrame:
    """The first ``per_lang`` rows of each language with their rank; parts of a language first."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(tasks)))
    part = part.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    part = part.where(F.col("_n") <= per_lang).drop("_part", "_n")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return part.withColumn("rank", rank).where(F.col("rank") <= per_lang)


def collocations(docs: DataFrame, min_count=MIN_COUNT, per_lang=PER_LANG, longer_percent=LONGER_PERCENT,
                 id_bits=ID_BITS, shards=None, lang_col="lang", text_col="text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its two parts at the cut of the
    lowest score, ``n`` the words of the language.  ``shards`` defaults to a power of two
    that grows with the number of words.
    """
    if not 33 <= id_bits <= ID_BITS:
        raise ValueError(f"id_bits is from 33 to {ID_BITS}")
    words = word_counts(docs, id_bits, lang_col, text_col)
    totals = cut_lineage(words.groupBy("lang").agg(F.sum("n").alias("total")))
    if shards is None:
        read = 2 * (totals.agg(F.sum("total")).first()[0] or 0)
        shards = min(max(read // SHARD_PHRASES, MIN_SHARDS), MAX_SHARDS)
    shard_bits = max(1, int(shards - 1).bit_length())
    filters = phrase_filters(docs, words, shard_bits, min_count, id_bits, lang_col, text_col)
    phrases = cut_lineage(merge_filters(filters, shard_bits, min_count, id_bits))

    known = words.where(F.col("n") >= min_count)
    word = lambda i, *more: known.select(
        F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("n").alias(f"f{i}"), *more)
    pair = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    pairs, three = phrases.where("w3 = 0"), phrases.where("w3 <> 0")
    count_of = lambda key, name: pairs.select(pair("w1", "w2").alias(key), F.col("a").alias(name))

    inside = three.select("a", F.explode(F.array(pair("w1", "w2"), pair("w2", "w3"))).alias("p"))
    inside = inside.groupBy("p.x", "p.y").agg(F.max("a").alias("longer"))
    two = pairs.join(inside.select(F.col("x").alias("w1"), F.col("y").alias("w2"), "longer"), ["w1", "w2"], "left")
    two = two.where(F.col("longer").isNull() | (100 * F.col("longer") < longer_percent * F.col("a"))).drop("longer")
    look_up = lambda rows, table, key, census: gather(rows, table, key, spread=("w1", "w2", "w3"), census=census)
    two = look_up(look_up(two, word(1, "lang"), "w1", pairs), word(2), "w2", pairs)
    two = two.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))

    three = three.withColumns({"head": pair("w1", "w2"), "tail": pair("w2", "w3")})
    read = three
    for key, table in {"head": count_of("head", "f_head"), "tail": count_of("tail", "f_tail"),
                       "w1": word(1, "lang"), "w2": word(2), "w3": word(3)}.items():
        three = look_up(three, table, key, read)
    after_two = score(F.col("a"), F.col("f_head"), F.col("f3")) < score(F.col("a"), F.col("f1"), F.col("f_tail"))
    three = three.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
                         F.when(after_two, F.col("f_head")).otherwise(F.col("f1")).alias("l"),
                         F.when(after_two, F.col("f3")).otherwise(F.col("f_tail")).alias("r"))

    scored = two.unionByName(three).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    ranked = _first_per_lang(scored, per_lang)
    return ranked.join(totals.withColumnRenamed("total", "n"), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
