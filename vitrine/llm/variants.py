"""Spelling variants: words one edit apart, by asymmetric q-chunks, and the form each belongs to.

Of two words the shorter one (of equal ones the smaller) contributes two disjoint chunks that
cover it; the other contributes positional grams of the chunks' lengths.  One inserted,
deleted or replaced code point leaves one chunk whole.  It then stands in the other word at
the same place, or, behind the edit, shifted by the difference of lengths (0 or 1), so only
grams at these places are sent.  Words meet where a gram equals a chunk and are verified.

A chunk that many words share is not joined as it is: what the chunk leaves over must
itself be one edit apart, so it is cut into two chunks again, and words meet on both, until
no group is large or one code point is left.  Groups of that kind are bounded by the
alphabet.

Null and empty texts hold no words; a null id counts as an empty string in the checksum;
an empty table gives an empty one; repeated rows count once each; equal forms by count go
to the smallest word; other columns of the input are not read.
"""

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.common import ASCII_LOWER, ASCII_UPPER, gather, id_and_text, small_batches
from vitrine.sources.shared import cut_lineage

MIN_CHARS, MIN_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
FORM_TIMES = 5
#: One run in so many loses a code point, by its checksum; 0 leaves all runs as they are.
DELETE_ONE_IN = 199
#: Chunk rows times gram rows of a key from which it is cut further.
PAIRS_PER_KEY = 4096
#: Distinct words a task holds before it sends their counts on.
HELD_WORDS = 400_000

_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def word_counts(docs: DataFrame, min_chars=MIN_CHARS, min_count=MIN_COUNT, delete_one_in=DELETE_ONE_IN,
                id_col="doc_id", text_col="text") -> DataFrame:
    """(word, n): maximal runs of letters, A-Z in lower case, of ``min_chars`` code points at least.

    A run whose crc32 (of `<id>:<run>`) is divisible by ``delete_one_in`` loses the code
    point at crc32 modulo its length.  Counts are summed per task before they are sent.
    """
    small_batches(docs.sparkSession)
    deleted = delete_one_in > 0

    def run(batches):
        import re

        runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_chars).findall
        held, encoded = Counter(), {}

        def sent():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            encoded.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                found = runs(text.as_py().encode().translate(_LOWER).decode())
                if not deleted:
                    held.update(found)
                    continue
                name = doc_id.as_py()
                start = zlib.crc32(b":" if name is None else b"%d:" % name)
                for word, n in Counter(found).items():
                    data = encoded.get(word)
                    if data is None:
                        data = encoded[word] = word.encode()
                    h = zlib.crc32(data, start)
                    if h % delete_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_chars:
                            continue
                    held[word] += n
                if len(held) + len(encoded) > HELD_WORDS:
                    yield sent()
        yield sent()

    counted = id_and_text(docs, id_col, text_col).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _cut(rows: DataFrame) -> DataFrame:
    """Two keys for every row: the chunk or gram joined to the path, and what is left over.

    ``longer`` is 1 if the rest may be one longer than the rest of the chunks' word, and
    ``gram`` tells the role.
    """
    more = F.when(F.col("gram"), F.col("longer")).otherwise(0)
    length = F.char_length("rest")
    half = F.floor((length - more) / 2).cast("int")

    def part(start: Column, n: Column) -> Column:
        return F.substring(F.col("rest"), start, n)

    first = F.struct(F.concat_ws("|", "path", F.lit("1"), part(F.lit(1), half)).alias("path"),
                     part(half + 1, length).alias("rest"))
    second = F.struct(F.concat_ws("|", "path", F.lit("2"), part(half + more + 1, length)).alias("path"),
                      part(F.lit(1), half + more).alias("rest"))
    return rows.select("gram", "longer", "word", "n", F.explode(F.array(first, second)).alias("c")).select(
        "gram", "longer", "word", "n", "c.path", "c.rest")


def near_pairs(words: DataFrame, pairs_per_key=PAIRS_PER_KEY) -> DataFrame:
    """(a, n_a, b, n_b): every pair of distinct words exactly one edit apart, once.

    ``words`` (word, n) are distinct.  Rows of a path, the chunks so far, meet only when
    there are at most ``pairs_per_key`` pairs of them or one code point is left to differ.
    """
    size = F.char_length("word")
    role = lambda gram: F.transform(F.array(F.lit(0), F.lit(1)), lambda d: F.struct(
        F.lit(gram).alias("gram"), d.alias("longer"),
        F.concat_ws(":", (size - (d if gram else 0)).cast("string"), d.cast("string")).alias("path")))
    rows = words.select("word", "n", F.explode(F.concat(role(False), role(True))).alias("r")).select(
        "r.gram", "r.longer", "word", "n", "r.path", F.col("word").alias("rest"))
    rows = _cut(rows)
    met = []
    while True:
        rows = cut_lineage(rows)
        sizes = rows.groupBy("path").agg(
            F.count(F.when(~F.col("gram"), 1)).alias("chunks"), F.count(F.when(F.col("gram"), 1)).alias("grams"),
            F.max(F.char_length("rest") - F.when(F.col("gram"), F.col("longer")).otherwise(0)).alias("left"))
        large = cut_lineage(sizes.where(
            (F.col("chunks") * F.col("grams") > pairs_per_key) & (F.col("left") > 1)).select("path", F.lit(True).alias("large")))
        more = not large.isEmpty()
        if more:
            marked = cut_lineage(gather(rows, large, "path", spread=("word", "gram"), how="left"))
            rows = marked.where(F.col("large").isNull()).drop("large")
        chunk = rows.where(~F.col("gram")).select("path", F.col("word").alias("a"), F.col("n").alias("n_a"), "longer")
        gram = rows.where("gram").select("path", F.col("word").alias("b"), F.col("n").alias("n_b"))
        apart = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
        ordered = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
        met.append(chunk.join(gram, (chunk["path"] == gram["path"]) & ordered & apart).select("a", "n_a", "b", "n_b"))
        if not more:
            break
        rows = _cut(marked.where("large").drop("large"))
    every = met[0]
    for further in met[1:]:
        every = every.unionByName(further)
    return every.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms, by doubling steps."""
    ends = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = cut_lineage(gather(ends, step, "root", spread=("word",), how="left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        ends = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return ends


def group_variants(words: DataFrame, form_times=FORM_TIMES, pairs_per_key=PAIRS_PER_KEY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n).

    A word's form is the near word of largest n, the smallest of equal ones, if that n is
    at least ``form_times`` its own; its root is where its forms lead.
    """
    words = cut_lineage(words)
    pairs = cut_lineage(near_pairs(words, pairs_per_key))
    links = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("own"), F.col("b").alias("other"), F.col("n_b").alias("times")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("own"), F.col("a").alias("other"), F.col("n_a").alias("times")),
    )).alias("l")).select("l.*")
    best = links.groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("own").alias("own"),
        F.min(F.struct((-F.col("times")).alias("less"), F.col("other").alias("form"))).alias("best"))
    found = F.when(-F.col("best.less") >= form_times * F.col("own"), F.col("best"))
    best = cut_lineage(best.select("word", "n_near", found["form"].alias("form"), (-found["less"]).alias("form_n")))
    ends = roots(best.where(F.col("form").isNotNull()).select("word", "form"))
    return words.join(best.join(ends, "word", "left"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
