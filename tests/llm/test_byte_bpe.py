from __future__ import annotations

import pytest

from panelcast.llm import byte_bpe

TOKENS = [bytes([b]) for b in range(256)] + [b"ab", b"cd", b"abc", b"bc", b"abcd", b"dd", b"cdd"]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges one by one, lowest rank first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("size", [4, 300_000])
def test_memory_of_pieces(monkeypatch, size):
    """A piece that keeps coming is encoded once, however many others pass; ids are those of the merges."""
    monkeypatch.setattr(byte_bpe, "MEMO", size)
    ranks = {token: rank for rank, token in enumerate(TOKENS)}
    vocabulary, calls = byte_bpe.Vocabulary(ranks), []
    inner = vocabulary.encode_piece
    monkeypatch.setattr(vocabulary, "encode_piece", lambda piece: calls.append(piece) or inner(piece))
    pieces = byte_bpe._Pieces(vocabulary)
    others = ["abcd" * (i % 5) + "bcddab"[i % 6 :] + chr(233 + i) for i in range(40)]
    for piece in [p for other in others for p in (other, "abcddcab")]:
        ids = list(memoryview(pieces[piece]).cast("i"))
        assert ids == merged(piece.encode(), ranks)
    assert calls.count(b"abcddcab") == 1 and len(calls) == 41
    assert len(pieces) + len(pieces.old) <= size
