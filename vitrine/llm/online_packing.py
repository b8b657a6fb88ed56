"""Bounded-space online packing of documents into windows of token ids.

Every partition keeps a fixed number of open windows.  A piece goes to the open
window that it fills best; when none fits, the fullest window is emitted, topped up
with the head of the piece if that is long enough to be worth a cut.  What is still
open at the end of a partition is merged with what neighbouring partitions left.
"""

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import id_and_text, small_batches
from vitrine.llm.tokens import TOKENIZER, encoder
from vitrine.sources.shared import cut_lineage

WINDOW = 1024
OPEN_WINDOWS = 64
MIN_CUT = 16      # fewest tokens worth cutting a piece for
MERGE_PARTS = 64  # partitions whose leftovers are merged in one group

_PIECE = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("part", pa.int64()), ("is_open", pa.bool_()), ("ids", pa.binary()),
]
_DDL = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, part bigint, is_open boolean, ids binary")
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def padded_length(used: int, window: int = WINDOW) -> int:
    """Length a sequence is padded to: the window, or nothing more at a power of two."""
    return used if used and used & (used - 1) == 0 else window


class Windows:
    """The open windows of one partition.  A piece is (length, payload...)."""

    def __init__(self, window, most, min_cut, cut):
        self.window, self.most, self.min_cut, self.cut = window, most, min_cut, cut
        self.open: list[tuple[int, int]] = []  # (free, window number), sorted
        self.held: dict[int, list] = {}
        self.made = 0

    def _new(self, piece):
        self.held[self.made] = [piece]
        insort(self.open, (self.window - piece[0], self.made))
        self.made += 1

    def _emit(self, at):
        return self.held.pop(self.open.pop(at)[1])

    def place(self, piece) -> Iterator[list]:
        """Yields the windows that this piece closes."""
        while True:
            need = piece[0]
            if need == self.window:
                yield [piece]
                return
            at = bisect_left(self.open, (need,))
            if at < len(self.open):
                free, k = self.open.pop(at)
                self.held[k].append(piece)
                if free == need:
                    yield self.held.pop(k)
                else:
                    insort(self.open, (free - need, k))
                return
            if len(self.open) < self.most:
                self._new(piece)
                return
            free, k = self.open[0]  # the fullest; nothing open fits the piece
            if self.cut and free >= self.min_cut:
                head, piece = self.cut(piece, free)
                self.held[k].append(head)
                yield self._emit(0)
            else:
                yield self._emit(0)
                self._new(piece)
                return


def _cut(piece, at):
    n, doc, start, ids, total = piece
    return (at, doc, start, ids[:at], total), (n - at, doc, start + at, ids[at:], total)


def _rows(window, number, part, is_open, keep_ids):
    offset = 0
    for n, doc, start, ids, total in window:
        raw = ids.tobytes()
        yield doc, start, n, zlib.crc32(raw), total, number, offset, part, is_open, raw if keep_ids else None
        offset += n


def _pack(tokenizer, window, most, min_cut, keep_ids):
    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        open_windows, number, rows = Windows(window, most, min_cut, _cut), 0, []

        def ready():
            arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PIECE)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in _PIECE])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = enc.ids(text.as_py())
                total = len(ids)
                for start in range(0, total, window):
                    own = ids[start:start + window]
                    for closed in open_windows.place((len(own), doc, start, own, total)):
                        rows.extend(_rows(closed, (part << 32) + number, part, False, keep_ids))
                        number += 1
            if rows:
                yield ready()
        for left in open_windows.held.values():
            rows.extend(_rows(left, (part << 32) + number, part, True, keep_ids))
            number += 1
        if rows:
            yield ready()
    return run


def _merge(window):
    def run(key, pdf):
        group = int(key[0])
        # longest first; ties in a fixed order, so that a retry gives the same windows
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], ignore_index=True)
        windows = Windows(window, len(pdf) + 1, window, None)
        closed = [w for i, n in enumerate(pdf["length"]) for w in windows.place((int(n), i))]
        closed += windows.held.values()
        number, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, w in enumerate(closed):
            at = 0
            for n, i in w:
                number[i], offset[i] = (1 << 60) + (group << 32) + k, at
                at += n
        return pdf.assign(sequence_id=pd.Series(number), offset=pd.Series(offset))
    return run


def pack_online(docs: DataFrame, id_col="doc_id", text_col="text", tokenizer=TOKENIZER, window=WINDOW,
                open_windows=OPEN_WINDOWS, min_cut=MIN_CUT, with_ids=False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Every document is its token ids and the end id, so a null or empty text is one
    token.  Each id lies in exactly one piece; pieces of a sequence follow each other
    without gaps.  Repeated rows are packed as often as they come, rows with a null id
    keep it, extra columns are ignored, an empty table gives no rows.

    Memory of a task: the open windows and one batch of texts.  Leftovers of
    MERGE_PARTS partitions (at most ``open_windows`` windows each) meet in one group.
    """
    small_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    packed = cut_lineage(rows.mapInArrow(_pack(tokenizer, window, open_windows, min_cut, with_ids), _DDL))
    left = packed.where("is_open").withColumn("part", F.expr(f"part div {MERGE_PARTS}"))
    merged = left.groupBy("part").applyInPandas(_merge(window), left.schema)
    columns = [*COLUMNS, "ids"] if with_ids else COLUMNS
    return packed.where("not is_open").select(*columns).unionByName(merged.select(*columns))


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids binary): padded id rows from pieces that carry their ids."""
    def fill(batches):
        for b in batches:
            out = []
            for parts in b["parts"].to_pylist():
                raw = b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["offset"]))
                more = padded_length(len(raw) // 4, window) - len(raw) // 4
                out.append(raw + np.full(more, pad, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b["sequence_id"], b["n_tokens"], pa.array(out, pa.binary())],
                                             names=["sequence_id", "n_tokens", "ids"])

    rows = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.collect_list(F.struct("offset", "ids")).alias("parts"))
    return rows.mapInArrow(fill, "sequence_id bigint, n_tokens bigint, ids binary")
