"""Byte-level BPE encoding and decoding, exact and in linear time.

A text is cut by the tokenizer's pattern; each piece is encoded alone. The bytes of a piece are read as Latin-1
characters, so that one Aho-Corasick automaton over the vocabulary gives the longest token at each place. The encoder
goes from longest match to longest match and steps back to shorter ones where two neighbours could not both be left
by the merges: whether they could depends on the two tokens alone, so the answer is memoised. Each place of a piece
is ruled out at most once, which makes the whole linear.

Vocabulary files are read by each Python worker from the given path; nothing of them is kept in the repository.

Null text counts as empty: no ids, empty bytes. Repeated rows are encoded each. A text of any length is processed
in blocks of pieces, so memory holds its ids and its bytes and no list of all its pieces. An empty table gives no
rows. Other columns pass through; `ids` and `decoded` are added, and may not be among the input's names.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Pieces whose encoding a worker remembers (those not met again among half as many others go), and the longest of them
#: in characters; pairs of tokens it remembers, dropped when full. They save time only, and a worker outlives its task.
MEMO, MEMO_CHARS, PAIRS = 300_000, 64, 100_000
#: Characters of text that a batch sent back to Spark holds, about.
BATCH_CHARS = 1_000_000
#: Pieces of one text that are encoded at once.
BLOCK = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """The automaton and the tables of merges of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        top = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(token) for token in self.bytes_of]
        self.shorter: list[int] = [-1] * top  # the longest token that is a proper prefix
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        # In order of rank, which pair of tokens the last merge joins. A token that no merges reach is its own pair;
        # it can only stand as a whole piece, and is no match inside one.
        self.halves: list[tuple[int, int]] = [(r, r) for r in range(top)]
        self.merged: dict[tuple[int, int], int] = {}
        self.memo: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            reached = len(token) == 1
            left = -1 if reached else self.shorter[rank]
            while left >= 0:
                right = ranks.get(token[self.length[left] :], -1)
                if 0 <= right < rank and left < rank and self._together(left, right):
                    self.merged[left, right], self.halves[rank], reached = rank, (left, right), True
                    break
                left = self.shorter[left]
            if reached:
                self.automaton.add_word(token.decode("latin-1"), rank)
            self.memo.clear()
        self.automaton.make_automaton()
        self.reached = {rank for _, rank in self.automaton.items()}
        for rank in range(top):  # a match inside a piece may only be shortened to a token that merges reach
            while self.shorter[rank] >= 0 and self.shorter[rank] not in self.reached:
                self.shorter[rank] = self.shorter[self.shorter[rank]]

    def _together(self, left: int, right: int) -> bool:
        """Would the merges leave these two tokens side by side? Undo merges from the later one on; if at some moment
        a merge across the border has a lower rank than the one just undone, it would have come first."""
        first_undone = len(self.bytes_of)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < first_undone:
                return False
            # The token of the higher rank was made last; a single byte can't be undone.
            for side in ("left", "right") if left > right else ("right", "left"):
                token = left if side == "left" else right
                half = self.halves[token][1 if side == "left" else 0]
                if half != token:
                    # On the right side, a merge of equal rank further left in the text comes first.
                    first_undone = token if side == "left" else token + 1
                    left, right = (half, right) if side == "left" else (left, half)
                    break
            else:
                return True

    def together(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= PAIRS:
                self.memo.clear()
            known = self.memo[key] = self._together(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = [-1] * size
        length, shorter, memo = self.length, self.shorter, self.memo
        for end, token in self.automaton.iter(piece.decode("latin-1")):  # by end, so the last at a start is its longest
            longest[end - length[token] + 1] = token
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            while token >= 0:
                if open_at[at + length[token]]:
                    if last < 0:
                        break
                    known = memo.get(last << 32 | token)
                    if self.together(last, token) if known is None else known:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < size else -1
            elif out:  # nothing fits after `last` here: no encoding has a border at this place
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
            else:
                raise ValueError("the vocabulary lacks single bytes of this piece")
        return out


class _Pieces(dict):
    """Piece to its ids as int32 bytes; remembers short pieces in two generations of half of MEMO: when the new one is
    full, it takes the old one's place."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.vocabulary.encode_piece(piece.encode())).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple:
    import regex

    return regex.compile(pattern), _Pieces(Vocabulary(read_ranks(path)))


@lru_cache(maxsize=2)
def _tokens(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_text(text: str, split, pieces: _Pieces) -> bytes:
    """The ids of a text as int32 bytes."""
    if len(text) <= BLOCK:
        return b"".join(map(pieces.__getitem__, split.findall(text)))
    found, out = split.finditer(text), []
    while block := b"".join([pieces[m.group()] for m in islice(found, BLOCK)]):
        out.append(block)
    return b"".join(out)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about BATCH_CHARS each."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= BATCH_CHARS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _encoding(docs: DataFrame, path: str, pattern: str, text: str):
    """The schema of docs with ids in place of text, and the function of batches that makes it."""
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = _encoder(path, pattern)
        for batch in batches:
            texts = batch.column(place)
            sizes = texts.cast(pa.large_string()).fill_null("").to_numpy(zero_copy_only=False)
            for a, b in _slices(np.fromiter(map(len, sizes), np.int64, len(sizes))):
                blocks = [encode_text(t, split, pieces) for t in sizes[a:b]]
                ends = np.cumsum([0, *(len(x) // 4 for x in blocks)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blocks), np.int32)))
                kept = [c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != place]
                yield pa.RecordBatch.from_arrays([*kept, ids], names=[*rest, "ids"])

    return schema, work


def _decoding(schema: T.StructType, path: str):
    """The schema with decoded beside ids, and the function of batches that makes it."""
    if "decoded" in schema.names:
        raise ValueError("there is a column named decoded already")
    place = schema.names.index("ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(path).__getitem__
        for batch in batches:
            lists = batch.column(place)
            ends = lists.offsets.to_numpy()
            for a, b in _slices(np.diff(ends) * 4):
                values = lists.values.slice(ends[a], ends[b] - ends[a]).to_numpy().tolist()
                texts = [b"".join(map(token, values[ends[i] - ends[a] : ends[i + 1] - ends[a]])) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(texts, pa.binary())], names=[*schema.names, "decoded"])

    return T.StructType([*schema.fields, T.StructField("decoded", T.BinaryType(), False)]), work


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without `text`, with ids array<int>. A column named ids already there fails."""
    if "ids" in docs.columns:
        raise ValueError("there is a column named ids already")
    small_batches(docs.sparkSession)
    schema, work = _encoding(docs, path, pattern, text)
    return docs.mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with ids) and the bytes they stand for as decoded binary; an unknown id fails, and so does a column
    named decoded already there."""
    schema, work = _decoding(encoded.schema, path)
    return encoded.mapInArrow(work, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the ids joined by commas, and decoded_sha256 of what they decode to. Both ways
    run in one Python worker for each task."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    middle, there = _encoding(rows, path, pattern, "text")
    schema, back = _decoding(middle, path)
    return rows.mapInArrow(lambda batches: back(there(batches)), schema).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
