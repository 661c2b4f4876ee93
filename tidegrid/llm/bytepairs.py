"""Byte-pair encoding by a deterministic automaton that is compiled from the merges.

The automaton reads tokens and accepts exactly the token sequences that the merges produce. It begins with one state that
every byte leads back to. Each merge (u, v) -> w, in order, is built in as a gadget: the state behind u is copied without
its arc v, all arcs u are turned to the copy, and every state with an arc u gets an arc w to where u v led. As all arcs
of one token lead to one state, the state behind a token is the chain of copies made for it; what is left of such a chain
is one entry per merge, so 50,000 merges compile to tables of 50,000 entries. A text is encoded by walking the byte trie
of the tokens along the arcs that the automaton has; exactly one path spells each prefix of a word, and its labels are
the ids. Arcs once looked up stay in a table.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np

NEVER = 1 << 60


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id of a rank file: a base64 token and its rank in each line."""
    rows = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    ranked = {int(rank): base64.b64decode(token) for token, rank in rows}
    return [ranked[i] for i in range(len(ranked))]


def merges_of(tokens: list[bytes]) -> list[tuple[int, int, int]]:
    """The merge (u, v, w) that makes each token of several bytes, in order of rank."""
    rank = {t: i for i, t in enumerate(tokens)}
    out = []
    for w, token in enumerate(tokens):
        if len(token) == 1:
            continue
        parts = [rank[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: r if (r := rank.get(tokens[parts[i]] + tokens[parts[i + 1]], NEVER)) < w else NEVER)
            parts[best : best + 2] = [rank[tokens[parts[best]] + tokens[parts[best + 1]]]]
        out.append((parts[0], parts[1], w))
    return out


class TokenAutomaton:
    """The compiled automaton of a vocabulary: ``tokens`` by id and ``merges`` in order."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]):
        self.tokens = tokens
        self.left = [-1] * len(tokens)
        self.right = [-1] * len(tokens)
        self.born = [-1] * len(tokens)  # the merge that brought the token's arcs
        self.cut: dict[tuple[int, int], int] = {}  # (u, v): the merge that took arc v from the state behind u
        self.live = [len(t) == 1 for t in tokens]
        for step, (u, v, w) in enumerate(merges):
            self.gadget(step, u, v, w)
        self.arcs: dict[tuple[int, int], bool] = {}
        self.trie: dict = {}
        for i, token in enumerate(tokens):
            if self.live[i]:
                node = self.trie
                for byte in token:
                    node = node.setdefault(byte, {})
                node[-1] = i
        self.whole = {t: i for i, t in enumerate(tokens) if self.live[i]}

    def gadget(self, step: int, u: int, v: int, w: int) -> None:
        """Builds merge ``step`` in. A merge whose parts can no longer meet leaves the automaton as it is."""
        if self.live[u] and self.live[v] and self.has_arc(u, v, step - 1):
            self.cut[u, v] = step
            self.left[w], self.right[w], self.born[w], self.live[w] = u, v, step, True

    def has_arc(self, t: int, x: int, upto: int = NEVER) -> bool:
        """Whether the state behind ``t``, as it was after merge ``upto``, has an arc ``x``."""
        while True:
            if self.cut.get((t, x), NEVER + 1) <= upto:
                return False
            if self.born[x] > self.born[t]:  # x came to this state because it had the arc of its left part then
                upto = min(upto, self.born[x])
                x = self.left[x]
            elif self.born[t] >= 0:  # the state behind t began as the one behind its right part
                if t == x:
                    upto = min(upto, self.born[x])
                    x = self.left[x]
                else:
                    upto = min(upto, self.born[t] - 1)
                    t = self.right[t]
            else:
                return True

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        if (one := self.whole.get(word)) is not None:
            return [one]
        n, arcs, trie = len(word), self.arcs, self.trie
        label, came = [-1] * (n + 1), [0] * (n + 1)
        for at in range(n):
            here, node = label[at], trie
            for end in range(at + 1, n + 1):
                node = node.get(word[end - 1])
                if node is None:
                    break
                t = node.get(-1)
                if t is None or label[end] >= 0:
                    continue
                if here >= 0:
                    arc = arcs.get((here, t))
                    if arc is None:
                        arc = arcs[here, t] = self.has_arc(here, t)
                    if not arc:
                        continue
                label[end], came[end] = t, at
        out, at = [], n
        while at:
            out.append(label[at])
            at = came[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the labels of a path spell."""
        return b"".join(self.tokens[i] for i in ids)


class BatchEncoder:
    """Encodes Arrow string columns: words are cut for the whole column, each distinct word is encoded once."""

    #: The tables of known words and of arcs asked for are emptied when they hold so many; that costs time only.
    MOST_WORDS = 1_000_000
    MOST_ARCS = 500_000

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.size = np.zeros(1 << 12, dtype=np.int32)
        self.first = np.zeros(1 << 12, dtype=np.int64)
        self.pool = np.zeros(1 << 14, dtype=np.int32)
        self.used = 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The table's number of each word; new words are encoded and added."""
        index = self.index
        if len(index) > self.MOST_WORDS:
            self.clear()
            index = self.index
        if len(self.automaton.arcs) > self.MOST_ARCS:
            self.automaton.arcs.clear()
        out = np.empty(len(words), dtype=np.int64)
        for k, word in enumerate(words):
            i = index.get(word)
            if i is None:
                ids = self.automaton.encode(word)
                i = index[word] = len(index)
                while i >= len(self.size):
                    self.size, self.first = np.resize(self.size, 2 * len(self.size)), np.resize(self.first, 2 * len(self.first))
                while self.used + len(ids) > len(self.pool):
                    self.pool = np.resize(self.pool, 2 * len(self.pool))
                self.size[i], self.first[i] = len(ids), self.used
                self.pool[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
            out[k] = i
        return out

    def _slices(self, column):
        from .words import encode_words, gpt_word_starts, text_slices

        for offsets, raw, buffer in text_slices(column):
            starts = gpt_word_starts(raw, offsets)
            coded = encode_words(starts, len(raw), buffer)
            table = self.numbers(coded.dictionary.to_pylist())
            yield np.searchsorted(starts, offsets), table[coded.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, dtype=np.int64)

    def counts(self, column) -> np.ndarray:
        """The number of ids of each text."""
        out = []
        for bounds, words in self._slices(column):
            total = np.concatenate([[0], np.cumsum(self.size[words], dtype=np.int64)])
            out.append(total[bounds[1:]] - total[bounds[:-1]])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def encode(self, column):
        """A list<int32> array with the ids of each text; null and empty texts give empty lists."""
        import pyarrow as pa

        ids, sizes = [], []
        for bounds, words in self._slices(column):
            size = self.size[words].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(self.first[words] - total[:-1], size) + np.arange(total[-1])
            ids.append(self.pool[at])
            sizes.append(total[bounds[1:]] - total[bounds[:-1]])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)))


def split_words(text: str) -> list[str]:
    """The pre-split words of one text by the public pattern itself: the plain form that tests hold the fast one against."""
    import regex

    return regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text)


_encoders: dict[str, BatchEncoder] = {}


def encoder(key: str, shared) -> BatchEncoder:
    """This worker's encoder of the broadcast vocabulary (tokens, merges) of file ``key``, compiled once."""
    if key not in _encoders:
        _encoders[key] = BatchEncoder(TokenAutomaton(*shared.value))
    return _encoders[key]
