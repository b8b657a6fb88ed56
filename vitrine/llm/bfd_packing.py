"""Best-fit-decreasing packing of token ids into matrices written as binary.

A task collects documents up to a block of tokens, splits documents longer than a
row losslessly, and packs the pieces of the block, longest first, each into the row
with the least room that still holds it.  That row is found in a segment tree over
the room left.  A block is written as one id matrix with its cumulative segment
lengths and position resets.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import id_and_text, small_batches
from vitrine.llm.tokens import TOKENIZER, encoder

WINDOW = 1024
BLOCK_TOKENS = 1 << 20

_FIELDS = [
    ("block_id", pa.int64()), ("n_rows", pa.int32()), ("width", pa.int32()), ("id_bytes", pa.int32()),
    ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
    ("segments", pa.list_(pa.struct([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()),
        ("doc_tokens", pa.int64()), ("row", pa.int32()), ("offset", pa.int32())]))),
]
_DDL = ("block_id bigint, n_rows int, width int, id_bytes int, ids binary, cu_seqlens array<int>, "
        "position_resets array<int>, segments array<struct<doc_id:bigint,start:bigint,length:int,"
        "doc_tokens:bigint,row:int,offset:int>>")


class RoomTree:
    """Rows by the room they have left; finds the least room of at least a given size."""

    def __init__(self, window):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)  # rows below each node
        self.rows = [[] for _ in range(window + 1)]

    def add(self, room, row):
        self.rows[room].append(row)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need):
        """(room, row) of the tightest row with room for ``need``, removed; None if there is none."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(lengths, window):
    """(row, offset) of each piece and the number of rows; no length exceeds ``window``."""
    lengths = np.asarray(lengths, np.int64)
    tree, row_of, offset_of, rows = RoomTree(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, rows = (window, rows), rows + 1
        room, row = found
        row_of[i], offset_of[i] = row, window - room
        if room > need:
            tree.add(room - need, row)
    return row_of, offset_of, rows


def _block(pieces, number, window, dtype, pad):
    rows, offsets, n = best_fit_decreasing([len(p[2]) for p in pieces], window)
    order = np.lexsort((offsets, rows))
    matrix, cu, resets, segments, at = np.full((n, window), pad, dtype), [0], [], [], 0
    for i in order:
        doc, start, ids, total = pieces[i]
        r, o = int(rows[i]), int(offsets[i])
        begin = r * window + o
        if begin > at:  # the padding of the row before is a segment of its own
            resets.append(at)
            cu.append(begin)
        matrix[r, o:o + len(ids)] = ids
        resets.append(begin)
        at = begin + len(ids)
        cu.append(at)
        segments.append({"doc_id": doc, "start": start, "length": len(ids), "doc_tokens": total, "row": r, "offset": o})
    if n * window > at:
        resets.append(at)
        cu.append(n * window)
    values = [number, n, window, matrix.itemsize, matrix.tobytes(), cu, resets, segments]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _FIELDS)], names=[f for f, _ in _FIELDS])


def _pack(tokenizer, window, block_tokens, pad):
    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        dtype = np.dtype("<u2" if enc.size <= 1 << 16 else "<u4")
        pieces, held, made = [], 0, 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = enc.ids(text.as_py())
                for start in range(0, len(ids), window):
                    pieces.append((doc, start, ids[start:start + window].astype(dtype), len(ids)))
                    held += len(pieces[-1][2])
                    if held >= block_tokens:
                        yield _block(pieces, (part << 32) + made, window, dtype, pad)
                        pieces, held, made = [], 0, made + 1
        if pieces:
            yield _block(pieces, (part << 32) + made, window, dtype, pad)
    return run


def pack_matrices(docs: DataFrame, id_col="doc_id", text_col="text", tokenizer=TOKENIZER, window=WINDOW,
                  block_tokens=BLOCK_TOKENS, pad=0) -> DataFrame:
    """One row per block: ids (row-major matrix, little-endian), cu_seqlens, position_resets, segments.

    cu_seqlens are ends of segments in the flattened matrix, padding at the end of a
    row being a segment of its own; positions restart at position_resets.  A segment
    names its document, the ids of the document before it, its row and its offset.
    Documents end with the end id, so null and empty texts are one token.  Repeated
    rows are packed as often as they come, null ids are kept, extra columns ignored;
    an empty table gives no blocks.  A task holds one block.
    """
    small_batches(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(_pack(tokenizer, window, block_tokens, pad), _DDL)


def write_matrices(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the blocks as Parquet and read them back."""
    pack_matrices(docs, **options).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def segments(blocks: DataFrame) -> DataFrame:
    """One row per segment, its ids cut out of the written matrix."""
    each = blocks.select("block_id", "width", "id_bytes", "ids", F.size("position_resets").alias("resets"),
                         F.explode("segments").alias("s"))
    begin = (F.col("s.row") * F.col("width") + F.col("s.offset")) * F.col("id_bytes")
    return each.select(
        "s.doc_id", "s.start", F.col("s.length").cast("bigint").alias("length"), "s.doc_tokens", "block_id",
        F.col("s.row").cast("bigint").alias("row"), F.col("s.offset").cast("bigint").alias("offset"),
        F.substring("ids", begin + 1, F.col("s.length") * F.col("id_bytes")).alias("ids"))


def position_ids(cu_seqlens) -> np.ndarray:
    """Position of every token of the flattened matrix: counted from the last reset."""
    cu = np.asarray(cu_seqlens)
    return np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))
