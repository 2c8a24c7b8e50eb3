"""Pieces that end in a mark are made of their words and take no place in the cache."""

from __future__ import annotations

import pyarrow as pa
import pytest

from churnlens.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_marked_pieces(name):
    pieces = tokens.Pieces(public_tokenizers.path(name))
    texts = ["so the END, the end. And\nthen, what? nothing!", "Straße, ñandú. é a1, -- . x,y ..", "I Kİ ﬁn, é"]
    assert pieces.short
    for t in texts:
        assert pieces.text(t) == pieces.whole(t)
    assert "end" in pieces and "end." not in pieces and "END," not in pieces
    got = list(tokens.encode_column(public_tokenizers.path(name), pa.array([*texts, None, ""])))
    assert [x.tobytes() for x in got] == [*map(pieces.whole, texts), b"", b""]
