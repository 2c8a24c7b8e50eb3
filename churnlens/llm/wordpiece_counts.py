"""Token counts of greedy longest-match word pieces, by a linear automaton.

A trie over the vocabulary (one root for pieces that begin a word, one for those
that continue it) has failure links: where a state has no edge for the next byte,
its longest pieces are popped and the match goes on from the link.  Only how many
pieces a link pops is kept, so a word's count takes time linear in its length and
no piece is built.  A word that the vocabulary cannot cover counts as one token.

Words are runs of ASCII letters (A-Z as a-z), digits and bytes from 0x80 on;
every other byte but the six ASCII blanks is a word by itself.  Each distinct word
of a block is matched once, all words side by side in numpy.

Null and empty texts have no words and no tokens.  Every row is counted by itself;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import ALNUM, NOT_BLANK, blocks, text_buffer, word_hashes, word_spans

PART_BYTES = 4 << 20
#: Longer words are matched one by one.
SIDE_BY_SIDE = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BEGIN, GO_ON, NONE = 0, 1, -1


class Automaton:
    """Edges as sorted ``state << 8 | byte`` with their targets; link and popped count of each state."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        edges: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[], []]
        token = [False, False]
        for root, pieces in ((BEGIN, initial), (GO_ON, continuing)):
            for piece in pieces:
                s = root
                for c in piece:
                    t = edges.get(s << 8 | c)
                    if t is None:
                        t = edges[s << 8 | c] = len(children)
                        children[s].append((c, t))
                        children.append([])
                        token.append(False)
                    s = t
                token[s] = token[s] or s > GO_ON
        link, pops = [NONE] * len(children), [0] * len(children)
        todo = deque((BEGIN, GO_ON))  # by depth: links of shorter states are known
        while todo:
            u = todo.popleft()
            for c, v in children[u]:
                todo.append(v)
                if token[v]:
                    link[v], pops[v] = GO_ON, 1
                    continue
                z, popped = link[u], pops[u]
                while z != NONE and z << 8 | c not in edges:
                    popped += pops[z]
                    z = link[z]
                if z != NONE:
                    link[v], pops[v] = edges[z << 8 | c], popped
        self.keys = np.array(sorted(edges), dtype=np.int64)
        self.targets = np.array([edges[k] for k in self.keys.tolist()], dtype=np.int64)
        self.link, self.pops = np.array(link, dtype=np.int64), np.array(pops, dtype=np.int64)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:end]; a word that cannot be covered has one."""
        out = np.zeros(len(starts), dtype=np.int64)
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        long = int((size > SIDE_BY_SIDE).sum())
        for w in order[:long].tolist():
            out[w] = self._one(data[starts[w]:ends[w]])
        order = order[long:]
        state, dead = np.full(len(starts), BEGIN, dtype=np.int64), np.zeros(len(starts), dtype=bool)
        for t in range(int(size[order].max(initial=0))):
            live = order[:int(np.searchsorted(-size[order], -t, "left"))]  # longer than t
            live = live[~dead[live]]
            byte = data[starts[live] + t].astype(np.int64)
            while len(live):
                key = state[live] << 8 | byte
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                ok = self.keys[at] == key
                state[live[ok]] = self.targets[at[ok]]
                live, byte = self._pop(live[~ok], state, out, dead, byte[~ok])
        live = order[~dead[order]]
        live = live[state[live] != GO_ON]
        while len(live):
            live, _ = self._pop(live, state, out, dead, live)
            live = live[state[live] != GO_ON]
        out[dead] = 1
        return out

    def _pop(self, words, state, out, dead, other):
        """Follow the words' links; those without one are dead.  Returns the others."""
        out[words] += self.pops[state[words]]
        state[words] = self.link[state[words]]
        stuck = state[words] == NONE
        dead[words[stuck]] = True
        return words[~stuck], other[~stuck]

    def _one(self, word: np.ndarray) -> int:
        if not hasattr(self, "_edges"):
            self._edges = dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True))
            self._links, self._popped = self.link.tolist(), self.pops.tolist()
        s, n = BEGIN, 0
        for c in word.tolist():
            while (t := self._edges.get(s << 8 | c)) is None:
                n += self._popped[s]
                s = self._links[s]
                if s == NONE:
                    return 1
            s = t
        while s != GO_ON:
            n += self._popped[s]
            s = self._links[s]
            if s == NONE:
                return 1
        return n


def byte_pieces(path: str) -> set[bytes]:
    """The byte strings of a byte-level vocabulary of the tokenizers library, marks of word ends taken off."""
    from tokenizers import Tokenizer

    from churnlens.llm.tokens import _byte_letters

    back = {chr(c): b for b, c in _byte_letters().items()}
    t = Tokenizer.from_file(path)
    special = {x.content for x in t.get_added_tokens_decoder().values()}
    words = (w.removesuffix("</w>") for w in t.get_vocab(with_added_tokens=False) if w not in special)
    return {bytes(back[c] for c in w) for w in words if w}


def count_column(column, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text."""
    data, offsets = text_buffer(column)
    marks = NOT_BLANK & ~ALNUM
    single = np.zeros(256, dtype=np.int64)
    every = np.arange(256, dtype=np.uint8)
    single[marks] = automaton.count(every, np.flatnonzero(marks), np.flatnonzero(marks) + 1)
    n_words, n_tokens = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)

    def by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(values)))
        return c[first[1:]] - c[first[:-1]]

    for i, j in blocks(offsets, PART_BYTES):
        part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        starts, ends, first = word_spans(part, at, ALNUM)
        _, one, which = np.unique(word_hashes(part, starts, ends), return_index=True, return_inverse=True)
        counts = automaton.count(_LOWER[part], starts[one], ends[one])
        n_words[i:j] = np.diff(first) + by_row(marks[part], at)
        n_tokens[i:j] = by_row(counts[which], first) + by_row(single[part], at)
    return n_words, n_tokens


def token_counts(docs: DataFrame, initial: Iterable[bytes], continuing: Iterable[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens.  The automaton, as large as the vocabulary, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(initial, continuing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, tokens = count_column(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
