"""Language identification by bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of the n-grams usual in it.  The filters share one
table: a slot holds one bit per language, so the slots of an n-gram, and-ed, give the
mask of all languages that contain it.  A text's masks are counted per language; the
counts are corrected for each filter's rate of false positives and the largest wins.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import id_and_text, mix, small_batches

GRAM = 3
MIN_SHARE = 2e-5     # share of a language's n-grams from which one belongs in its filter
SLOTS = 1 << 20      # slots of the table: at most 8 MB for each 63 languages
PROBES = 3
UNKNOWN = "und"
CHUNK = 1 << 20      # characters looked at once
_BITS = 63           # languages per mask


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of lower-cased texts, and how many each text has.

    Whatever is not a letter counts as one blank, runs of blanks as one; n-grams with
    the blank in the middle are left out.  A text without letters has none.
    """
    joined = "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds, where = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds])[where]
    code = np.where(letter, points, np.where(points == 0, 0, 32)).astype(np.uint64)
    keep = letter | ~np.r_[False, ~letter[:-1]] | (points == 0)
    text_of = np.cumsum(points == 0) - (points == 0)
    code, text_of, letter = code[keep], text_of[keep], letter[keep]
    padded = np.r_[np.uint64(32), code, np.uint64(32)]
    middle = letter  # n-grams are named by their middle character
    left, right = padded[:-2].copy(), padded[2:].copy()
    left[left == 0] = 32
    right[right == 0] = 32
    out = (left << np.uint64(42)) | (code << np.uint64(21)) | right
    return out[middle], np.bincount(text_of[middle], minlength=len(texts))


def slots(codes: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Slots of each code, one row per probe."""
    h = mix(codes)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) % np.uint64(table)).astype(np.int64) for i in range(probes)])


def chunks(ids, texts):
    """(ids, texts) of at most CHUNK characters, or of one text."""
    own_ids, own, size = [], [], 0
    for i, t in zip(ids, texts):
        if own and size + len(t) > CHUNK:
            yield own_ids, own
            own_ids, own, size = [], [], 0
        own_ids.append(i)
        own.append(t)
        size += len(t)
    if own:
        yield own_ids, own


def _count(batches):
    for b in batches:
        by = {}
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for _, some in chunks(texts, texts):
                codes, n = np.unique(grams(some)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"])


def _bits(index, table, probes):
    def run(batches):
        for b in batches:
            codes = b["gram"].to_numpy(zero_copy_only=False).view(np.uint64)
            which = np.array([index[x] for x in b["lang"].to_pylist()], np.int64)
            at = slots(codes, table, probes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(which // _BITS, probes)), pa.array(at.ravel()),
                 pa.array(np.tile(np.int64(1) << (which % _BITS), probes))], names=["plane", "slot", "mask"])
    return run


@dataclass(frozen=True)
class Model:
    """Names of the languages, one table of masks for each 63 of them, and the rate of
    false positives of each language's filter."""

    languages: tuple
    planes: tuple
    false_rate: tuple
    probes: int


def train(labelled: DataFrame, min_share=MIN_SHARE, table=SLOTS, probes=PROBES) -> Model:
    """Learn from (text, lang): rows without a language or text teach nothing.

    Counts cover all rows.  A language has at most 1 / min_share n-grams in its filter;
    the driver gets at most ``table`` slots for each 63 languages.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # one row per language
    usual = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * min_share)
    languages = tuple(r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect())
    index = {x: i for i, x in enumerate(languages)}
    set_bits = usual.select("lang", "gram").mapInArrow(_bits(index, table, probes), "plane bigint, slot bigint, mask bigint")
    made = set_bits.groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    planes = np.zeros((max(1, math.ceil(len(languages) / _BITS)), table), np.uint64)
    planes[made["plane"].to_numpy(), made["slot"].to_numpy()] = made["mask"].to_numpy().view(np.uint64)
    fill = [((planes[i // _BITS] >> np.uint64(i % _BITS)) & np.uint64(1)).mean() for i in range(len(languages))]
    return Model(languages, tuple(planes), tuple(float(x) ** probes for x in fill), probes)


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Corrected share of n-grams per text and language, and the texts' numbers of n-grams."""
    codes, n = grams(texts)
    out = np.zeros((len(texts), len(model.languages)))
    some = np.flatnonzero(n)
    if not len(some):
        return out, n
    starts = np.r_[0, np.cumsum(n[some])[:-1]]
    at = slots(codes, len(model.planes[0]), model.probes)
    for i in range(len(model.languages)):
        if i % _BITS == 0:
            plane = model.planes[i // _BITS]
            mask = plane[at[0]]
            for row in at[1:]:
                mask = mask & plane[row]
        hits = np.add.reduceat(((mask >> np.uint64(i % _BITS)) & np.uint64(1)).astype(np.int64), starts)
        rate = model.false_rate[i]
        out[some, i] = np.clip((hits / n[some] - rate) / max(1e-9, 1 - rate), 0, 1)
    return out, n


def _predict(shared):
    def run(batches):
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for b in batches:
            for ids, texts in chunks(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                share, n = scores(model, texts)
                share = np.c_[share, np.zeros(len(texts))]  # the last stands for "unknown"
                best = np.where(n > 0, share.argmax(1), share.shape[1] - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(names[best], pa.string()),
                     pa.array(share[np.arange(len(texts)), best])], names=["doc_id", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned; of equal scores the first language by name wins.  Null ids and repeated
    rows are kept, extra columns ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: SLOTS masks per 63 languages
    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(_predict(shared), "doc_id bigint, lang_pred string, score double")


def held_out(doc_id, parts=5, part=0):
    """crc32 of the id as text, modulo ``parts``, equals ``part``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
