"""Ids are those of an untouched library, added tokens included."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from churnlens.llm import tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_the_library(name):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    for x in ("a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b", "the end.<|endoftext|>\nthe <|startoftext|> next", "<|ENDOFTEXT|> a",
              "<|endof text|>", "plain words, no marker", "two  blanks <|endoftext|>  two"):
        assert tokens.encode_text(path, x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x
