"""Operator 8: SentencePiece encoding and decoding with seeded merge-dropout.

A text is cut into units that no piece of the vocabulary can cross: a run of spaces with the characters up to the
next space, line breaks on their own. In a unit every pair of neighbouring symbols whose join is a piece is a
candidate merge. Candidates are processed best score first, leftmost first among equals; a candidate (its
unit, where it starts, where its two symbols meet and where it ends) whose keyed hash falls below the dropout rate
is skipped for good. The key is the seed with the hash of the row's id (of its text where that is null), the place of
the unit in the text and the unit, so that each occurrence of a word is segmented anew and reruns agree. With rate 0
the segmentation is the model's own.

Distinct units of a batch are merged once without dropout. An occurrence none of whose merges is dropped takes those
pieces; any other is merged on its own.

Characters outside the vocabulary become byte pieces, as do the three bytes of a literal U+2581 (the mark for a
space), so that decoding restores every text exactly.

Two routes give the same pieces: units of up to ``SHORT`` symbols are merged together, one step of all agendas at
a time, as arrays; longer ones one by one with a heap.

Defined results: null and empty texts have no pieces; repeated rows with one id get one segmentation, unless ``round_col`` differs; other
columns of the input pass by untouched.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches
from .vec import SpanHash, distinct_spans, mix64, ragged, row_of, slices

SHORT = 48
_NONE = np.iinfo(np.int32).max
_FREE = np.iinfo(np.int64).min
_MARK = "▁"


@dataclass
class PieceModel:
    pieces: list[str]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 6 byte
    scores: list[float]
    prefix: bool  # a space is put before each text

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge models with byte pieces and without normalization are lossless")
        return cls([p.piece for p in model.pieces], [p.type for p in model.pieces], [p.score for p in model.pieces], spec.add_dummy_prefix)


class Coder:
    def __init__(self, model: PieceModel, rate: float, seed: int, variants: int = 0):
        """variants: without effect, each occurrence of a unit has a key of its own."""
        self.prefix, self.rate, self.seed = model.prefix, int(rate * 2.0**64) if rate < 1 else 2**64 - 1, seed
        self.byte_id = np.zeros(256, np.int32)
        self.ids: dict[str, int] = {}
        self.raw: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if kind == 6:
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            else:
                self.raw.append(b"" if kind in (2, 3) else piece.replace(_MARK, " ").encode())
                if kind == 1:
                    self.ids[piece] = i
        if any(_MARK in p.strip(_MARK) or p.rstrip(_MARK) not in (p, "") or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses units")
        size = np.array([len(r) for r in self.raw], np.int64)
        self.spelled = np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(size) - size, size  # bytes of all pieces, first and number of each
        order = sorted(self.ids, key=lambda p: (-model.scores[self.ids[p]], self.ids[p]))
        # pieces of one score are equals: then the leftmost goes first
        self.rank, last, n = {}, None, -1
        for p in order:
            if model.scores[self.ids[p]] != last:
                last, n = model.scores[self.ids[p]], n + 1
            self.rank[p] = n
        # joins: (left id, right id) -> (rank, joined id), in a hash table with linear probing; the last entry stands for none
        found = {(self.ids[p[:k]], self.ids[p[k:]]): (self.rank[p], self.ids[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        keys = np.array([a << 32 | b for a, b in found], np.int64)
        values = np.array(list(found.values()), np.int32).reshape(-1, 2)
        self.bits = (4 * len(keys) + 1).bit_length()
        self.keys = np.full(1 << self.bits, _FREE)
        entry = np.full(1 << self.bits, len(keys))
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[at] == _FREE)
            at_free, which = np.unique(at[free], return_index=True)
            self.keys[at_free], entry[at_free] = keys[left[free[which]]], left[free[which]]
            rest = np.ones(len(left), bool)
            rest[free[which]] = False
            at, left = self.after(at[rest]), left[rest]
        entry = np.append(entry, len(keys))
        self.ranks, self.joined = np.append(values[:, 0], np.int32(_NONE))[entry], np.append(values[:, 1], np.int32(-1))[entry]
        self.one = {c: i for c, i in self.ids.items() if len(c) == 1 and c != _MARK}
        top = max(map(ord, self.one)) + 1
        self.of_char = np.full(max(top, 256), -1, np.int32)
        for c, i in self.one.items():
            self.of_char[ord(c)] = i
        self.of_char[32] = self.ids[_MARK]

    def dropped(self, unit: np.ndarray, start: np.ndarray, mid: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """unit: key of the occurrence."""
        return mix64(unit ^ self.merge_key(start, mid, stop)) < np.uint64(self.rate)

    def merge_key(self, start: np.ndarray, mid: np.ndarray, stop: np.ndarray) -> np.ndarray:
        where = (start.astype(np.uint64) << np.uint64(42)) | (mid.astype(np.uint64) << np.uint64(21)) | stop.astype(np.uint64)
        return mix64(where + np.uint64(self.seed))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def after(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank and joined piece of each pair, _NONE and -1 where the two have none."""
        key = (left.astype(np.int64) << 32 | right).ravel()
        at = self.slot(key)
        got = self.keys[at]
        other = np.flatnonzero((got != key) & (got != _FREE))
        while len(other):
            at[other] = self.after(at[other])
            got[other] = self.keys[at[other]]
            other = other[(got[other] != key[other]) & (got[other] != _FREE)]
        at[got != key] = len(self.keys)
        return self.ranks[at].reshape(left.shape), self.joined[at].reshape(left.shape)

    def symbols(self, chars: np.ndarray) -> np.ndarray:
        """Piece of each code point, -1 where it has none."""
        return np.where(chars < len(self.of_char), self.of_char[np.minimum(chars, len(self.of_char) - 1)], -1)

    def together(self, ids: np.ndarray, size: np.ndarray, unit: np.ndarray | None, made: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge the units in the rows of ids (padded with -2), one step of every agenda at a time; without unit nothing is
        dropped. The merges are added to made: rows, keys.

        Returns ids and starts (in symbols), -2 beyond each unit's pieces, and the numbers of pieces.
        """
        drop = unit is not None
        unit = unit if drop else np.zeros(len(ids), np.uint64)
        n, width = ids.shape
        count = size.copy()
        # symbol k of a row lies between edge k and edge k + 1; pieces and ranks have columns beside them, so that one index serves all
        ids = np.concatenate([ids.astype(np.int32), np.full((n, 1), -2, np.int32)], axis=1)
        edge = np.broadcast_to(np.arange(width + 1, dtype=np.int32), ids.shape).copy()
        out_ids, out_edge, out_count = np.full((n, width), -2, np.int32), edge[:, :-1].copy(), count.copy()
        rank = np.full(ids.shape, _NONE, np.int32)
        rank[:, :-1] = self.join(ids[:, :-1], ids[:, 1:])[0]
        if drop:
            r, c = np.nonzero(rank < _NONE)
            gone = self.dropped(unit[r], edge[r, c], edge[r, c + 1], edge[r, c + 2])
            rank[r[gone], c[gone]] = _NONE
        rows = np.arange(n)
        while len(rows):
            i, best = np.arange(len(rows)), rank.argmin(1)
            done = rank[i, best] == _NONE
            if done.any():
                w, of, done = ids.shape[1] - 1, rows[done], np.flatnonzero(done)
                out_ids[of, :w], out_edge[of, :w], out_count[of] = ids[done, :w], edge[done, :w], count[done]
                go = np.delete(i, done)
                if not len(go):
                    break
                rows, best, ids, edge, rank, count, unit = (a[go] for a in (rows, best, ids, edge, rank, count, unit))
                i = i[: len(go)]
            new = self.join(ids[i, best], ids[i, best + 1])[1]
            if made is not None:
                made.append((rows, self.merge_key(edge[i, best], edge[i, best + 1], edge[i, best + 2])))
            # close the gap at best + 1; the two pairs at the join follow below
            col = np.arange(ids.shape[1] - 1)
            source = col + (col > best[:, None])
            source += (i * ids.shape[1])[:, None]
            ids, edge, rank = (a.ravel()[source] for a in (ids, edge, rank))
            ids[i, best] = new
            count = count - 1
            for at, ok in ((best - 1, best >= 1), (best, best + 2 < edge.shape[1])):
                k, a = i[ok], at[ok]
                if len(k):
                    p = self.join(ids[k, a], ids[k, a + 1])[0]
                    if drop:
                        hit = np.flatnonzero(p < _NONE)
                        gone = hit[self.dropped(unit[k[hit]], edge[k[hit], a[hit]], edge[k[hit], a[hit] + 1], edge[k[hit], a[hit] + 2])]
                        p[gone] = _NONE
                    rank[k, a] = p
            rank[i[best + 2 >= edge.shape[1]], best[best + 2 >= edge.shape[1]]] = _NONE
        return out_ids, out_edge, out_count

    def alone(self, ids: list[int], unit: int) -> list[tuple[int, int]]:
        """(piece, first symbol) of one unit, by a heap."""
        n = len(ids)
        ids, stop = list(ids), list(range(1, n + 1))
        before, after, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        lookup = lambda a, b: (_NONE, -1) if a < 0 or b < 0 else self.pair(a, b)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                rank, joined = lookup(ids[i], ids[after[i]])
                if rank < _NONE:
                    heapq.heappush(heap, (rank, i, after[i], stop[after[i]], joined))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, end, joined = heapq.heappop(heap)
            if not (live[i] and live[j] and after[i] == j and stop[j] == end):
                continue
            one = lambda v: np.array([v], np.uint64)
            if self.dropped(one(unit), one(i), one(j), one(end))[0]:
                continue
            ids[i], stop[i], live[j], after[i] = joined, end, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [(ids[i], i) for i in range(n) if live[i]]

    @functools.lru_cache(maxsize=1 << 15)  # noqa: B019
    def pair(self, a: int, b: int) -> tuple[int, int]:
        rank, joined = self.join(np.array([a]), np.array([b]))
        return int(rank[0]), int(joined[0])

    def encode(self, texts: pa.Array, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts, and the n+1 offsets of the texts in them. variant: key of each text, 64 bits."""
        given = texts.to_pylist()
        put = " " if self.prefix else ""
        chars = np.frombuffer("".join([put + t if t else "" for t in given]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        off = np.concatenate([[0], np.cumsum([len(t) + len(put) if t else 0 for t in given])]).astype(np.int64)
        if not len(chars):
            return np.zeros(0, np.int32), off
        # a unit starts at a text's start, at a space after another character, and at and after a line break
        space, line = chars == 32, chars == 10
        begin = np.zeros(len(chars) + 1, bool)
        begin[:-1] = line
        begin[1:-1] |= (space[1:] & ~space[:-1]) | line[:-1]
        begin[off] = True
        start = np.flatnonzero(begin[:-1])
        stop = np.append(start[1:], len(chars))
        word = SpanHash(chars.astype(np.uint64) + np.uint64(1))(start, stop)
        size = stop - start
        text = row_of(start, off)
        key = mix64(word + mix64(variant.astype(np.int64).astype(np.uint64)[text] + (start - off[text]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        first, slot = distinct_spans(chars, start, stop, word)
        # a slot of the results for each distinct unit, and after them for each occurrence that is merged on its own
        slots = len(first) + (len(start) if self.rate else 0)
        pool, at, n = [], np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        total = 0

        def add(which: np.ndarray, ids: np.ndarray, where: np.ndarray, counts: np.ndarray) -> None:
            """ids: pieces of these units in turn, -1 for byte pieces of the character at where."""
            nonlocal total
            plain = ids >= 0
            width = np.ones(len(ids), np.int64)
            other = np.flatnonzero(~plain)
            codes = [chr(int(c)).encode("utf-8", "surrogatepass") for c in chars[where[other]]]
            width[other] = [len(b) for b in codes]
            end = np.cumsum(width)
            flat = np.empty(int(end[-1]) if len(end) else 0, np.int32)
            flat[(end - width)[plain]] = ids[plain]
            if len(other):
                flat[ragged((end - width)[other], width[other])] = self.byte_id[np.frombuffer(b"".join(codes), np.uint8)]
            bound = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])]
            at[which], n[which] = total + bound[:-1], np.diff(bound)
            pool.append(flat)
            total += len(flat)

        def merge(units: np.ndarray, to: np.ndarray, drop: bool, made: list | None = None) -> None:
            """Pieces of these units to these slots."""
            for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, SHORT)):
                group = np.flatnonzero((size[units] > low) & (size[units] <= min(high, SHORT)))
                for cut in range(0, len(group), 1 << 13):
                    which = group[cut : cut + (1 << 13)]
                    u = units[which]
                    ids = np.full((len(u), int(size[u].max())), -2, np.int32)
                    ids[np.arange(ids.shape[1]) < size[u][:, None]] = self.symbols(chars[ragged(start[u], size[u])])
                    steps: list = []
                    got, where, counts = self.together(ids, size[u], key[u] if drop else None, steps if made is not None else None)
                    if made is not None:
                        made.extend((to[which[rows]], keys) for rows, keys in steps)
                    used = np.arange(got.shape[1]) < counts[:, None]
                    add(to[which], got[used], (where + start[u][:, None])[used], counts)
            for k in np.flatnonzero(size[units] > SHORT):
                u = units[k]
                parts = self.alone(self.symbols(chars[start[u] : start[u] + size[u]]).tolist(), int(key[u]))
                add(to[[k]], np.array([p for p, _ in parts]), np.array([s for _, s in parts]) + start[u], np.array([len(parts)]))

        made: list = []
        plain = np.flatnonzero(size[first] <= SHORT) if self.rate else np.arange(len(first))
        merge(first[plain], plain, False, made if self.rate else None)
        if self.rate:
            again = size > SHORT
            if made:
                of, merges = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
                merges = merges[np.argsort(of, kind="stable")]
                many = np.bincount(of, minlength=len(first))
                begins = (np.cumsum(many) - many)[slot]
                for cut in range(0, len(slot), 1 << 17):
                    some = slice(cut, cut + (1 << 17))
                    count = many[slot[some]]
                    owner = np.repeat(np.arange(cut, cut + len(count)), count)
                    again[owner[mix64(key[owner] ^ merges[ragged(begins[some], count)]) < np.uint64(self.rate)]] = True
            again = np.flatnonzero(again)
            slot[again] = len(first) + np.arange(len(again))
            merge(again, slot[again], True)
        pool_ = np.concatenate(pool)
        lengths = n[slot]
        where = np.concatenate([[0], np.cumsum(lengths)])
        unit_at = np.searchsorted(np.flatnonzero(begin[:-1]), off)
        return pool_[ragged(at[slot], lengths)], where[unit_at]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.spelled[0][ragged(self.spelled[1][ids], self.spelled[2][ids])].tobytes()
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


_CODERS: dict[tuple, Coder] = {}


def _coder(docs: DataFrame, model: str, rate: float, seed: int):
    loaded = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model))  # fixed by the vocabulary file

    def get() -> Coder:
        # a worker builds its tables once
        key = (model, rate, seed)
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = Coder(loaded.value, rate, seed)
        return _CODERS[key]

    return get


def encode(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", round_col: str | None = None) -> DataFrame:
    """id, pieces (array of ids) of the whole text of each row. round_col: tells rows of one id apart in the key of dropout."""
    return _run(docs, model, rate, seed, id_col, text_col, round_col, "pieces array<int>", lambda coder, texts, ids, off: [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))])


def digests(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", round_col: str | None = None) -> DataFrame:
    """id, n_pieces, pieces_sha256 (of the ids as little-endian 32-bit), decoded_sha256 (of the decoded text) and
    lossless (the decoded text is the input) of each row."""
    import hashlib

    def out(coder, texts, ids, off):
        cut = [ids[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        back = [coder.decode(c) for c in cut]
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        return [pa.array(np.diff(off), pa.int64()), sha(c.astype("<i4").tobytes() for c in cut), sha(b.encode("utf-8", "surrogatepass") for b in back), pa.array([b == (t or "") for b, t in zip(back, texts.to_pylist(), strict=True)], pa.bool_())]

    return _run(docs, model, rate, seed, id_col, text_col, round_col, "n_pieces bigint, pieces_sha256 string, decoded_sha256 string, lossless boolean", out)


def _run(docs, model, rate, seed, id_col, text_col, round_col, schema, out):
    get = _coder(docs, model, rate, seed)
    names = [x.split()[0] for x in schema.split(", ")]

    def kernel(batches):
        coder = get()
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column(1)
            ids, off = coder.encode(texts, batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out(coder, texts, ids, off)], names=["id", *names])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    variant = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(""), F.col(text_col))).otherwise(F.xxhash64(F.col(id_col)))
    variant = F.xxhash64(variant, F.col(round_col)) if round_col else variant
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), variant.alias("variant"))
    return map_batches(rows, kernel, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """id, text of each row's pieces; no pieces, or null, give an empty text."""
    get = _coder(rows, model, 0.0, 0)

    def kernel(batches):
        coder = get()
        for batch in batches:
            texts = [coder.decode(np.array(p or [], np.int64)) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = rows.select(id_col).schema[0].dataType.simpleString()
    return map_batches(rows.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces")), kernel, f"id {kind}, text string").withColumnRenamed("id", id_col)
