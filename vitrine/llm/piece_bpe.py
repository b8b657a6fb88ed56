"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Nothing is trained.  Every byte stands as one code point of its own (256 + byte), every
entry of the vocabulary is a piece of such code points whose score is its negative rank,
and the normaliser is the identity.  The library merges the neighbours of the highest
score first, the leftmost of equal ones: the merge order of the ranks.  A pre-token that
is itself an entry is one id, as in the reference library of such files.

Null texts are empty and have no ids; an empty table gives an empty one; repeated rows and
null ids of rows are answered row by row; other columns of the input are not read.  Texts
of any length are encoded whole: pre-tokens are split off one at a time.
"""

import base64
import struct
from array import array
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import id_and_text, small_batches
from vitrine.llm.tokens import tokenizer_file

VOCABULARY = "byte_bpe_50k.tiktoken"
#: First code point that stands for a byte.
BYTE_BASE = 256
#: Pre-tokens a worker remembers, and the longest of them: bounds its memory.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64

# Fixed values of the model file format: field numbers, piece types, model type.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, UNK_ID, BPE = 3, 40, 2
NORMALIZER_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5

_TO_POINTS = {b: BYTE_BASE + b for b in range(256)}
_TO_BYTES = {BYTE_BASE + b: b for b in range(256)}


def as_points(data: bytes) -> str:
    """Bytes as the code points that stand for them."""
    return data.decode("latin-1").translate(_TO_POINTS)


def as_bytes(points: str) -> bytes:
    """The inverse of ``as_points``."""
    return points.translate(_TO_BYTES).encode("latin-1")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def read_ranks(name: str) -> dict:
    """{bytes: rank} of a rank file."""
    with open(tokenizer_file(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def serialised_model(tokens: list) -> bytes:
    """A sentencepiece BPE model of ``tokens`` (bytes), the best first.

    Piece i is token i with score -i; the unknown piece that the format asks for comes last
    and is never used, since all single bytes are required.
    """
    missing = 256 - sum(len(t) == 1 for t in tokens)
    if missing:
        raise ValueError(f"{missing} single bytes are not in the vocabulary")
    if len(tokens) >= 1 << 24:
        raise ValueError("scores beyond 2**24 ranks are not exact")

    def piece(text, score, kind):
        return _bytes(PIECES, _bytes(PIECE_TEXT, text.encode()) + _float(PIECE_SCORE, score) + _number(PIECE_TYPE, kind))

    pieces = [piece(as_points(token), -float(i), NORMAL) for i, token in enumerate(tokens)]
    trainer = _number(MODEL_TYPE, BPE) + _number(UNK_ID, len(tokens))
    normalizer = _bytes(NORMALIZER_NAME, b"identity") + b"".join(
        _number(field, 0) for field in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES))
    return b"".join([*pieces, piece("<unk>", 0.0, UNKNOWN), _bytes(TRAINER, trainer), _bytes(NORMALIZER, normalizer)])


def _ranges(points: list) -> str:
    """Sorted code points as the inside of a character set."""
    starts = [p for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
    ends = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends))


def split_pattern(pattern: str):
    """(pattern, first): ``pattern`` with the letters and numbers of the encoding library's Unicode version.

    Here and there different versions are built in.  ``first`` is the first code point
    they differ in: below it ``pattern`` itself does.
    """
    import regex
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    first = "\U0010ffff"
    for name in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(library.encode_ordinary(every)).decode())
        ours = set(regex.findall(name, every))
        if theirs != ours:
            first = min(first, *(theirs ^ ours))
            less, more = (_ranges(sorted(map(ord, x))) for x in (ours - theirs, theirs - ours))
            known = f"[{name}--[{less}]]" if less else name
            pattern = pattern.replace(name, f"[{known}[{more}]]" if more else known)
    return pattern, first


class Codec(dict):
    """Encodes and decodes by a serialised model; as a dict, it remembers pre-tokens' ids."""

    def __init__(self, name: str):
        super().__init__()
        import public_tokenizers
        import regex
        from sentencepiece import SentencePieceProcessor

        ranks = read_ranks(name)
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.entries = ranks
        self.ranks = [ranks[t] for t in tokens]  # a file may leave ranks out
        self.dense = self.ranks == list(range(len(tokens)))
        self.model = SentencePieceProcessor(model_proto=serialised_model(tokens))
        self.plain = regex.compile(public_tokenizers.PATTERN).finditer
        pattern, self.first = split_pattern(public_tokenizers.PATTERN)
        self.exact = regex.compile(pattern, regex.V1).finditer
        self.bytes_of = np.full(max(self.ranks) + 2, b"", object)
        for i, rank in enumerate(self.ranks):
            self.bytes_of[rank] = as_bytes(self.model.id_to_piece(i))

    def __missing__(self, token: str) -> bytes:
        data = token.encode()
        whole = self.entries.get(data)
        found = [whole] if whole is not None else self.model.encode(as_points(data))
        if whole is None and not self.dense:
            found = [self.ranks[i] for i in found]
        found = array("i", found).tobytes()
        if len(token) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = found
        return found

    def ids(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers in a row."""
        split = self.plain if text.isascii() or max(text) < self.first else self.exact
        return b"".join(map(self.__getitem__, map(itemgetter(0), split(text))))

    def pieces(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each id; none for ids that aren't in the vocabulary."""
        return self.bytes_of[np.where((ids >= 0) & (ids < len(self.bytes_of) - 1), ids, -1)]


@lru_cache(maxsize=2)
def codec(name: str = VOCABULARY) -> Codec:
    return Codec(name)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids array<int>) of every row: see the module's text."""
    small_batches(docs.sparkSession)

    def run(batches):
        code = codec(vocabulary)
        for batch in batches:
            found = [code.ids(text.as_py()) for text in batch.column("text")]
            ends = np.cumsum([0, *map(len, found)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded binary) from (doc_id, ids).

    The bytes of any ids, whole code points or not.  Null ids, ids that the vocabulary
    doesn't have and null lists decode to nothing.
    """
    small_batches(encoded.sparkSession)

    def run(batches):
        code = codec(vocabulary)
        for batch in batches:
            ids = batch.column("ids")
            pieces = code.pieces(ids.flatten().fill_null(-1).to_numpy()).tolist()
            ends = np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()]).tolist()
            back = pa.array([b"".join(pieces[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), back], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id bigint, ids array<int>, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
