"""Token ids through the tokenizers library, with a bounded cache of pieces.

The vocabularies used here split at white space, so a text's ids are those of its
pieces between single blanks.  A block of texts is split at once, its distinct pieces are
looked up once each, and all ids are gathered by their numbers.  A piece seen before comes from a dictionary.  A new
one that is a word of Latin letters, with at most one mark after it, goes straight
to the library's model, since its pre-tokenizer would leave it whole; any other
piece goes through the whole library.  Both ways are compared when a tokenizer is
loaded, and one that this does not hold for is used without short cuts.  A text that
holds the string of an added token (such as <|endoftext|>) goes through the library
whole and gets that token's id, as by the library's default.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from churnlens.llm.common import blocks, text_buffer

#: Cached pieces of a Python worker (about 200 bytes each): two generations of at
#: most so many; when the younger is full, the older goes.
CACHE_PIECES = 400_000
#: Blanks that are not single: such texts go through the library whole where blanks count.
_ODD = re.compile(r"^[ \n]|[ \n]$|[ \n]{2}|[^\S \n]")
_MARKS = frozenset(".,;:!?")
#: Letters below this are handled alike by any Unicode version.
_LATIN_END = "ɐ"
_PROBES = ("ab", "Ab", "thereof", "Ünïcödé", "straße", "ñandú", "Ça", "ABC", "the", "zzxq", "idiot", "É")
_LOADED: dict[str, object] = {}


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: b if b in plain else next(other) for b in range(256)}


class Pieces(dict):
    """Ids (little-endian unsigned 32 bits) by piece; a piece stands after a blank
    unless it begins with a new line."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self.library, self.model, self.alphabet = t, t.model, _byte_letters()
        added = t.get_added_tokens_decoder().values()
        self.added = tuple(a.content for a in added)
        one = lambda s: t.encode(s, add_special_tokens=False).ids
        # whether pieces can be joined: without their blanks, with them, or not at all
        self.kind = ("dropped" if one("ab cd") == one("ab") + one("cd") and one("ab cd\nef") == one("ab") + one("cd") + one("ef")
                     else "kept" if one("ab cd\nef") == one("ab") + one(" cd") + one("\nef") else "whole")
        if any(a.normalized for a in added):  # these match other spellings too
            self.kind = "whole"
        self.short = False
        self.short = self.kind != "whole" and all(
            self._short(p) in (None, self.whole(self._spaced(p))) for w in _PROBES for p in (w, w + ".", "\n" + w))

    def _spaced(self, piece: str) -> str:
        return piece if self.kind == "dropped" or piece[0] == "\n" else " " + piece

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, word: str, lead: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(lead + word)]).tobytes()

    def _short(self, piece: str) -> bytes | None:
        """Ids of a plain word; None if the piece is not one."""
        if piece.isascii() and piece.isalpha():  # nearly all: lower case is one to one, and normal
            return self._model(piece.lower(), "") if self.kind == "dropped" else self._model(piece, "Ġ")
        if piece[-1] in _MARKS:  # the word before the mark may be known
            if not piece[:-1].lstrip("\n").isalpha():
                return None
            if piece[-1] not in self.marks:
                self.marks[piece[-1]] = self._model(piece[-1], "")
            return self[piece[:-1]] + self.marks[piece[-1]]
        line = piece[0] == "\n"
        word = piece[line:]
        if not word.isalpha() or max(word) >= _LATIN_END:
            return None
        if self.kind == "dropped":
            word = "".join(map(str.lower, word))
            if not (word.isalpha() and unicodedata.is_normalized("NFC", word)):
                return None
            ids = self._model(word, "")
        else:
            ids = (self._model("", "Ċ") if line else b"") + self._model(word, "" if line else "Ġ")
        return ids

    def __missing__(self, piece: str) -> bytes:
        if self.short and piece[-1] in _MARKS:  # made of its word, which is kept: a piece less in the cache
            ids = self._short(piece)
            if ids is not None:
                return ids
        ids = self.older.get(piece)
        if ids is None and self.short:
            ids = self._short(piece)
        if ids is None:
            ids = self.whole(self._spaced(piece))
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def text(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.whole(text)
        if self.kind == "dropped":
            pieces = text.replace("\n", " ").split(" ")
            return b"".join(map(self.__getitem__, filter(None, pieces)))
        if self.kind == "kept" and not _ODD.search(text):
            first, *rest = text.replace("\n", " \n").split(" ")
            return self.whole(first) + b"".join(map(self.__getitem__, rest))
        return self.whole(text)


#: Bytes of text encoded together.
BLOCK = 4 << 20
#: Bytes that are or begin blanks other than space and new line: such texts are looked at one by one.
_SUSPECT = np.zeros(256, dtype=bool)
_SUSPECT[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _plain_rows(pieces: Pieces, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts split into pieces at single blanks."""
    n = len(column)
    if pieces.kind == "whole":
        return np.zeros(n, dtype=bool)
    plain = np.ones(n, dtype=bool)
    for a in pieces.added:
        plain &= ~np.asarray(pc.match_substring(column, a).to_numpy(zero_copy_only=False), dtype=bool)
    if pieces.kind == "kept":
        blank = (data == 32) | (data == 10)
        odd = _SUSPECT[data]
        odd[1:] |= blank[1:] & blank[:-1]
        rows = np.flatnonzero(np.diff(offsets) > 0)
        odd[offsets[:-1][rows]] |= blank[offsets[:-1][rows]]
        odd[offsets[1:][rows] - 1] |= blank[offsets[1:][rows] - 1]
        seen = np.zeros(n, dtype=bool)
        seen[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        for k in np.flatnonzero(seen & plain).tolist():
            plain[k] = not _ODD.search(column[k].as_py())
    return plain


def _gather(held: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the numbered pieces one after the other, and each piece's length."""
    ids = np.frombuffer(b"".join(held), dtype="<u4")
    lens = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
    at = np.cumsum(lens) - lens
    size = lens[which]
    place = np.repeat(at[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return ids[place], size


def encode_column(path: str, column) -> Iterator[np.ndarray]:
    """The ids of each text of an Arrow column, in order, as unsigned 32-bit integers (null: none)."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    pieces = _LOADED[path]
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    every = text_buffer(column)[1]
    for i, j in blocks(every, BLOCK):
        part = pc.fill_null(column.slice(i, j - i).cast(pa.large_string()), "")
        data, offsets = text_buffer(part)
        plain = _plain_rows(pieces, part, data, offsets) & (np.diff(offsets) > 0)
        split = pc.split_pattern(pc.replace_substring(part.filter(pa.array(plain)), "\n", " " if pieces.kind == "dropped" else " \n"), " ")
        words = split.flatten().dictionary_encode()
        which = np.asarray(words.indices).astype(np.int64)
        ends = np.asarray(split.offsets, dtype=np.int64)
        ends = ends - ends[0]
        held = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # strings made in one go
        if pieces.kind == "kept":  # a text's first piece has no blank before it
            first, number = np.unique(which[ends[:-1]], return_inverse=True)
            rest = np.ones(len(which), dtype=bool)
            rest[ends[:-1]] = False
            later = np.zeros(len(held), dtype=bool)
            later[which[rest]] = True
            known = [pieces[w] if on else b"" for w, on in zip(held, later.tolist(), strict=True)]
            which[ends[:-1]] = len(known) + number
            known += [pieces.whole(held[k]) for k in first.tolist()]
        else:
            known = [pieces[w] if w else b"" for w in held]
        ids, size = _gather(known, which)
        at = np.concatenate(([0], np.cumsum(size)))[ends]
        k = 0
        for row, fine in enumerate(plain.tolist()):
            if fine:
                yield ids[at[k]:at[k + 1]]
                k += 1
            else:
                text = part[row].as_py()
                yield np.frombuffer(pieces.text(text), "<u4") if text else np.zeros(0, "<u4")
        del split, words, held, known, which, ids
        pa.default_memory_pool().release_unused()


def encode_text(path: str, text: str | None) -> bytes:
    """Ids of ``text`` as little-endian unsigned 32-bit integers (null: none)."""
    if not text:
        return b""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path].text(text)
