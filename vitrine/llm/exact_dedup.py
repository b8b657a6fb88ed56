"""Exact deduplication against immutable snapshots.

A snapshot is a published set of documents: its groups of equal texts by digest, and
one static binary-fuse filter per shard of digests.  Distinct digests of an incoming
batch are screened by the filters.  What a filter rejects is new for certain; positives
join the snapshot's exact buckets.  Copies inside the batch are grouped on their own,
before the screening.  Groups of more than one row are confirmed byte by byte.
"""

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import ascii_lower, gather, id_and_text, mix, small_batches, small_or_shuffled
from vitrine.sources.shared import cut_lineage, new_path

SHARD_KEYS = 1 << 17  # digests per filter
_TRIES = 100


class FuseFilter:
    """Static 3-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys.

    Never rejects one of its keys; accepts about one other key in 256.
    """

    def __init__(self, seed, segment, segments, table):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    def _hashes(self, keys):
        return mix(keys.astype(np.uint64) + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15))

    def _places(self, h):
        """Three places in neighbouring segments, one column each."""
        span, low = np.uint64(self.segments * self.segment), np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
        places = [first, (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & low),
                  (first + np.uint64(2 * self.segment)) ^ (h & low)]
        return np.stack(places, 1).astype(np.int64)

    @staticmethod
    def _prints(h):
        return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys):
        keys = np.unique(np.asarray(keys, np.uint64))
        n = max(len(keys), 2)
        segment = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        room = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        segments = max(1, -(-room // segment) - 2)
        for seed in range(_TRIES):
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if made._fill(keys):
                return made
        raise RuntimeError("no seed gave a filter")

    def _fill(self, keys):
        """Peel places that only one remaining key has, round by round; then set
        fingerprints in the opposite order.  False if some keys can't be peeled."""
        h = self._hashes(keys)
        places, size = self._places(h), len(self.table)
        degree = np.bincount(places.ravel(), minlength=size)
        # the sum of the keys' numbers at a place: the one number left at degree 1
        number = np.bincount(places.ravel(), np.repeat(np.arange(len(keys)), 3), size).astype(np.int64)
        single, rounds, peeled = np.flatnonzero(degree == 1), [], 0
        while len(single):
            key, at = np.unique(number[single], return_index=True)
            rounds.append((key, single[at]))
            peeled += len(key)
            touched = places[key].ravel()
            np.subtract.at(degree, touched, 1)
            np.subtract.at(number, touched, np.repeat(key, 3))
            touched = np.unique(touched)
            single = touched[degree[touched] == 1]
        if peeled < len(keys):
            return False
        prints = self._prints(h)
        for key, slot in reversed(rounds):
            t = self.table[places[key]]
            self.table[slot] = prints[key] ^ t[:, 0] ^ t[:, 1] ^ t[:, 2]  # the slot itself is still 0
        return True

    def has(self, keys) -> np.ndarray:
        h = self._hashes(np.asarray(keys, np.uint64))
        t = self.table[self._places(h)]
        return (t[:, 0] ^ t[:, 1] ^ t[:, 2]) == self._prints(h)


def _sha(batches):
    for b in batches:
        low = pc.ascii_lower(b["text"])
        shas = [hashlib.sha256(x.as_buffer()).hexdigest() for x in low]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(shas, pa.string())], names=["doc_id", "text_sha256"])


def digests(docs: DataFrame, id_col="doc_id", text_col="text", digest_hex=64) -> DataFrame:
    """(doc_id, text_sha256, digest, row), written once: a row number tells repeated rows apart."""
    small_batches(docs.sparkSession)
    hashed = id_and_text(docs, id_col, text_col).mapInArrow(_sha, "doc_id bigint, text_sha256 string")
    return cut_lineage(hashed.select(
        "doc_id", "text_sha256", F.substring("text_sha256", 1, digest_hex).alias("digest"),
        F.monotonically_increasing_id().alias("row")))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, keep, n): a group of copies collapses before the shuffle."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n"))


def _key(digest):
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("key")


def _shard(digest, shards):
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int").alias("shard")


@dataclass(frozen=True)
class Snapshot:
    """Groups and filters of a published set of documents; never changed once written."""

    groups: DataFrame
    filters: DataFrame
    shards: int
    shard_keys: int = SHARD_KEYS


def _build(key, pdf):
    f = FuseFilter.build(pdf["key"].to_numpy())
    return pd.DataFrame({"shard": [key[0]], "seed": [f.seed], "segment": [f.segment],
                         "segments": [f.segments], "prints": [f.table.tobytes()]})


def publish(rows: DataFrame, path: str, shard_keys=SHARD_KEYS) -> Snapshot:
    """Write the groups and filters of ``rows`` under ``path``."""
    spark = rows.sparkSession
    grouped(rows).write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    shards = max(1, -(-groups.count() // shard_keys))
    keyed = groups.select(_key("digest"), _shard("digest", shards))
    keyed.groupBy("shard").applyInPandas(
        _build, "shard int, seed int, segment int, segments int, prints binary"
    ).write.parquet(f"{path}/filters")
    return Snapshot(groups, spark.read.parquet(f"{path}/filters"), shards, shard_keys)


def _probe(key, batch, filters):
    hit = np.zeros(len(batch), bool)
    for f in filters.itertuples():
        table = np.frombuffer(f.prints, np.uint8)
        hit |= FuseFilter(f.seed, f.segment, f.segments, table).has(batch["key"].to_numpy())
    return pd.DataFrame({"digest": batch["digest"], "maybe": hit})


def screen(batch_groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(digest, maybe): which distinct digests of a batch may be in the snapshot.

    A task gets one filter and digests of the batch of the same shard, about as many as
    a filter has: a batch larger than the snapshot is split by salts, to each of which
    the filter is copied.
    """
    salts = max(1, -(-batch_groups.count() // (snapshot.shards * snapshot.shard_keys)))
    salt = F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(salts)).cast("int").alias("salt")
    keyed = batch_groups.select("digest", _key("digest"), _shard("digest", snapshot.shards), salt)
    filters = snapshot.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return keyed.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(
        _probe, "digest string, maybe boolean")


def joined_groups(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(digest, keep, n) over snapshot and batch together."""
    groups = cut_lineage(grouped(batch))
    groups = groups.join(screen(groups, snapshot), "digest")
    positives = groups.where("maybe").select("digest", F.col("keep").alias("keep2"), F.col("n").alias("n2"))
    both = snapshot.groups.join(positives, "digest", "full").select(
        "digest", F.greatest("keep", "keep2").alias("keep"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))
    return both.unionByName(groups.where("not maybe").drop("maybe"))


def _decided(rows):
    own = F.struct("doc_id", "row")
    keep = F.coalesce(F.col("keep"), own)
    return rows.select("doc_id", keep["doc_id"].alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
                       (keep["row"] == F.col("row")).alias("kept"), "text_sha256", "digest")


def collided(docs: DataFrame, members: DataFrame, digest_hex: int) -> DataFrame:
    """Digests shared by texts that differ: the byte check of all groups.

    ``members``: distinct (doc_id, digest) of rows in groups.  Only their texts move,
    and equal texts collapse before they do.
    """
    members = small_or_shuffled(members.withColumnRenamed("doc_id", "member"))
    texts = docs.join(members, F.col("doc_id").eqNullSafe(F.col("member")))
    texts = texts.select("digest", ascii_lower(F.col("text")).alias("norm"))
    texts = texts.where(F.substring(F.sha2("norm", 256), 1, digest_hex) == F.col("digest"))
    return texts.distinct().groupBy("digest").count().where("count > 1").select("digest")


def exact_dedup(docs: DataFrame, id_col="doc_id", text_col="text", snapshot_share=0.5,
                digest_hex=64, shard_keys=SHARD_KEYS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of
    equal texts the row with the largest doc_id stays (a null id is the smallest; of
    repeated rows with that id exactly one stays).  Extra columns are ignored, an empty
    table gives no rows.

    ``snapshot_share`` of the ids, by hash, are published as the standing snapshot, the
    others come in as a batch.  The result is the same for any share.  ``digest_hex``
    hex digits of SHA-256 name a group; texts that differ under one digest are told
    apart by their bytes.
    """
    docs = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    rows = digests(docs, digest_hex=digest_hex)
    standing = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1000)) < int(snapshot_share * 1000)
    snapshot = publish(rows.where(standing), new_path(spark, "snapshot"), shard_keys)
    groups = cut_lineage(joined_groups(rows.where(~standing), snapshot).where("n > 1"))
    decided = _decided(gather(rows, groups, "digest", spread=("row",), how="left"))
    members = decided.where("group_size > 1").select("doc_id", "digest").distinct()
    clash = cut_lineage(collided(docs, cut_lineage(members), digest_hex))
    if clash.isEmpty():
        return decided.drop("digest")
    # texts that differ under one digest: exact buckets by the bytes themselves
    sha = F.sha2(ascii_lower(F.col("text")), 256)
    apart = docs.withColumn("text_sha256", sha).withColumn("digest", F.substring("text_sha256", 1, digest_hex))
    apart = cut_lineage(apart.join(clash, "digest", "left_semi").select(
        "doc_id", "text_sha256", "digest", ascii_lower(F.col("text")).alias("norm"), F.monotonically_increasing_id().alias("row")))
    exact = apart.groupBy("norm").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n"))
    return decided.join(clash, "digest", "left_anti").unionByName(
        _decided(apart.join(exact, "norm"))).drop("digest")
