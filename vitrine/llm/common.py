"""Input handling and text helpers shared by the operators."""

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.functions import joins

#: Rows of an Arrow batch sent to Python: bounds what a task holds when texts are long.
BATCH_ROWS = 500
#: A table is broadcast only if it was measured to be no larger; beyond, it is shuffled.
BROADCAST_BYTES = 2 << 20
#: The same where the other side holds whole texts, which are dear to shuffle.
TEXT_BROADCAST_BYTES = 16 << 20
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col="doc_id", text_col="text", **more) -> DataFrame:
    """(doc_id, text[, more...]) and nothing else: extra columns can't clash later.

    A null text becomes the empty text; a null id stays null.
    """
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *[docs[c].alias(name) for name, c in more.items()],
    )


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS rows, if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def gather(rows, table, key, **options):
    """Look up ``table`` by ``key``: see ``joins.gather``, with the bound above."""
    return joins.gather(rows, table, key, key, limit=BROADCAST_BYTES, **options)


def small_or_shuffled(table: DataFrame, limit=TEXT_BROADCAST_BYTES) -> DataFrame:
    """``table``, to be joined with texts, marked for broadcast if it was measured to be within the bound."""
    return F.broadcast(table) if joins.fits_broadcast(table, limit) else table


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bounded number of words."""

    def __init__(self, limit=400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words.

    ``h`` holds the words' hashes.  Fewer words make one shingle of the whole
    sequence, no words none.
    """
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out * _ODD + h[i:i + n])
    return np.unique(out)
