"""Operator 1: word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes (and an end-of-word symbol where the vocabulary marks word ends). Each
node holds a failure link and the number of pieces that following it pops, both computed once, breadth
first, so that one left-to-right pass over a word counts its greedy longest-match pieces without building
them and without ever stepping back.

Words: maximal runs of ASCII letters and digits and of all bytes above 0x7F; every other ASCII character that
is not white space is a word of its own. The text is lower-cased first unless ``lower`` is false.

Defined results: null and empty texts have 0 words and 0 tokens; a word that no sequence of pieces spells
counts as one unknown token; repeated rows are each counted; other columns of the input pass by untouched.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vec import distinct_spans, row_of, slices, text_buffer

END = 256
#: So many words or fewer are walked one by one.
FEW = 8


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str, word_end: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file (JSON of the tokenizers library) as symbols."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    alphabet, pieces = byte_alphabet(), []
    for token in model["model"]["vocab"]:
        if token in special:
            continue
        body, end = (token[: -len(word_end)], (END,)) if token.endswith(word_end) else (token, ())
        if all(c in alphabet for c in body) and (body or end):
            pieces.append((*(alphabet[c] for c in body), *end))
    return pieces


@dataclass
class Automaton:
    """keys, targets: sorted edges, key = node * 257 + symbol. fail: -1 where there is none. pops: pieces popped by
    the failure link. close: pieces popped when the word ends at the node, -1 where it can't end there."""

    keys: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    pops: np.ndarray
    close: np.ndarray
    inner: int
    ends: bool

    @classmethod
    def build(cls, initial: list[tuple[int, ...]], inner: list[tuple[int, ...]] | None = None) -> Automaton:
        """initial: pieces that may start a word; inner: those that may continue one (None: the same ones)."""
        children: list[dict[int, int]] = [{}]
        final: set[int] = set()

        def insert(root: int, piece: tuple[int, ...]) -> None:
            node = root
            for s in piece:
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                node = children[node][s]
            final.add(node)

        for piece in initial:
            insert(0, piece)
        ends = any(p[-1] == END for p in initial)
        if ends:
            insert(0, (END,))  # a piece without the mark may close a word; the mark alone is no token
        start = 0
        if inner is not None:
            start = len(children)
            children.append({})
            for piece in [*inner, (END,)] if ends else inner:
                insert(start, piece)
        fail, pops = [-1] * len(children), [0] * len(children)
        level = [(root, s, child) for root in {0, start} for s, child in children[root].items()]
        while level:
            following = []
            for parent, s, node in level:
                if node in final:
                    fail[node], pops[node] = start, int(not (s == END and parent in (0, start)))
                else:
                    at, n = fail[parent], pops[parent]
                    while at >= 0 and s not in children[at]:
                        n += pops[at]
                        at = fail[at]
                    if at >= 0:
                        fail[node], pops[node] = children[at][s], n
                following += [(node, t, child) for t, child in children[node].items()]
            level = following
        close = [-1] * len(children)
        for node in range(len(children)):
            at, n = node, 0
            while at not in (0, start) and at >= 0:
                n += pops[at]
                at = fail[at]
            close[node] = n if at >= 0 else -1
        edges = sorted((node * 257 + s, child) for node, own in enumerate(children) for s, child in own.items())
        keys, targets = np.array(edges, np.int64).reshape(-1, 2).T.copy()
        return cls(keys, targets, np.array(fail), np.array(pops), np.array(close), start, ends)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state * 257 + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.targets[at]

    def walk(self, symbols: list[int], state: int, count: int) -> tuple[int, int, bool]:
        """State, pieces and whether the word is lost after these last symbols of one word."""
        seen: dict[int, int] = {}  # target of each edge met, -1 for none
        for s in [*symbols, END] if self.ends else symbols:
            while True:
                key = state * 257 + s
                if key not in seen:
                    at = min(int(np.searchsorted(self.keys, key)), len(self.keys) - 1)
                    seen[key] = int(self.targets[at]) if self.keys[at] == key else -1
                if seen[key] >= 0:
                    state = seen[key]
                    break
                count += int(self.pops[state])
                state = int(self.fail[state])
                if state < 0:
                    return 0, count, True
        return state, count, False

    def lengths(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Pieces of each word buf[start:stop], 0 for one that can't be spelled. All words advance together."""
        n = np.zeros(len(start), np.int64)
        order = np.argsort(start - stop, kind="stable")  # longest first: words that go on are a prefix
        size = (stop - start)[order] + self.ends
        first, state = start[order], np.zeros(len(start), np.int64)
        count, dead = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
        for j in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -j, "left"))
            if j >= 64 and live <= FEW:
                for w in np.flatnonzero(~dead[:live]).tolist():
                    state[w], count[w], dead[w] = self.walk(buf[first[w] + j : stop[order[w]]].tolist(), int(state[w]), int(count[w]))
                break
            symbol = buf[np.minimum(first[:live] + j, len(buf) - 1)].astype(np.int64)
            if self.ends:
                symbol[size[:live] - 1 == j] = END
            todo = np.flatnonzero(~dead[:live])
            while len(todo):
                ok, target = self.step(state[todo], symbol[todo])
                state[todo[ok]] = target[ok]
                todo = todo[~ok]
                count[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
                lost = state[todo] < 0
                dead[todo[lost]] = True
                todo = todo[~lost]
        state[dead] = 0
        close = self.close[state]
        n[order] = np.where(dead | (close < 0), 0, count + close)
        return n


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x00, 0x20), 0x7F]] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words; control characters count as white space."""
    kind = np.where(_WORD[buf], 1, np.where(_SPACE[buf], 0, 2)).astype(np.uint8)
    begin = kind > 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    same = np.zeros(len(buf), bool)
    same[1:] = (kind[1:] == 1) & (kind[:-1] == 1) & ~edge[1:-1]
    start = np.flatnonzero(begin & ~same)
    last = np.ones(len(buf), bool)
    last[:-1] = ~same[1:]
    return start, np.flatnonzero(begin & last) + 1


def count_texts(automaton: Automaton, texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, tokens and unknown words of each text. Each distinct word of the batch is run once."""
    if lower:
        texts = pa.array([None if t is None else t.lower() for t in texts.to_pylist()], pa.large_string())
    buf, off = text_buffer(texts)
    start, stop = words(buf, off)
    first, inverse = distinct_spans(buf, start, stop)
    lengths = automaton.lengths(buf, start[first], stop[first])[inverse]
    row, n = row_of(start, off), len(texts)
    unknown = lengths == 0
    return np.bincount(row, minlength=n), np.bincount(row, np.where(unknown, 1, lengths), n).astype(np.int64), np.bincount(row, unknown, n).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lower: bool = True, word_end: str = "</w>") -> DataFrame:
    """Per row: id, n_words, n_tokens, n_unknown of the whole text. vocabulary: path of the vocabulary file, read
    on the driver; its automaton (a few MB, fixed by the vocabulary) goes to the workers with the code."""
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton.build(load_vocabulary(vocabulary, word_end)))

    def kernel(batches):
        for batch in slices(batches, "text"):
            counts = count_texts(automaton.value, batch.column(1), lower)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
    return out.withColumnRenamed("doc_id", id_col)
