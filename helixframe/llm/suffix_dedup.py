"""Operator 4: suffix-array dedup by the difference-cover algorithm.

A byte goes where it is covered by a string of ``length`` bytes that also starts anywhere else (``ANY``), in a row with another
id (``OTHER``), or at an earlier place (``LATER``, which leaves the first occurrence; places are ordered by id, text hash and
offset). ``SHARED`` is the cheap side of ``OTHER``: only whole runs (step 2) that stand in a row with another id. Strings are compared inside texts only and judged on the input.

A suffix array over all bytes of a large corpus is sorted many times over to tell apart suffixes of which most
share nothing with any other, so the order is only built where two strings can be equal:

1. Each start of a string is keyed by the least hash among the ``GRAM``-byte grams of its string; equal strings have
   equal keys. Neighbouring starts with one key are a run. Where a key's gram occurs once, nothing in its run is repeated.
2. Runs that agree in all of their bytes are one class: it stands for all of them from here on.
3. The starts of one run of each class are lined up at the gram and cut into pieces of ``COARSE`` starts. The bytes that all
   strings of a piece have in common are its core; equal pieces are one kind, and a core of one kind ends there. One piece of
   every kind that is left is cut into pieces of ``PIECE`` starts, and these are sifted alike.
4. Kinds that share a core and differ beside it are written as symbols: bytes left of the core, one symbol for the
   core, bytes right of it. Their suffixes are ordered by the difference-cover algorithm as Spark sorts (:func:`order`):
   sampled triples (positions 1 and 2 modulo 3) are sorted and named, the strings of names are ordered by recursion, and
   the remaining suffixes, keyed by their first symbol and the order of the suffix behind it, are sorted in. Since the kinds
   are lined up at their core, equal strings start at equal positions, and only suffixes of one core and position have to be
   told apart; the core and the position therefore lead every sort key.
5. Neighbours in that order whose first ``PIECE`` symbols agree, byte by byte, are equal strings.

Sorts deal ties over the tasks by the kind, so groups of any size are spread. Classes, kinds and cores are told apart by 124
bits of hashes from prime fields.

Defined results: null and empty texts have no bytes; repeated rows are documents of their own, which repeat each other (but
have one place and one id for ``LATER`` and ``OTHER``); rows with a null id take part like others, and come first.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, partitions, release, stored, temporary
from .sieve import passes, sieve
from .vec import SpanHash, anchor_runs, byte_grams, mix64, ragged, row_of, slices, sliding_min, text_buffer

GRAM, COARSE, PIECE = 32, 128, 16
ANY, OTHER, LATER, SHARED = "any", "other", "later", "shared"
#: Of all places of a class or kind: their number, least and largest id, first place.
KNOWN = ["n", "low", "high", "first"]
#: Bytes of the strings of the contract, of a passage of some fifty short words, and of the strings whose runs show passages.
LENGTH, PASSAGE, SHOWN = 400, 200, 96
#: Bits of the sketch of repeated keys, as a power of two; keys that a task holds before they are sent.
SKETCH, HELD = 26, 1 << 19

_U = np.uint64


class Strings:
    """The runs of a batch's strings of one length."""

    def __init__(self, batch: pa.RecordBatch, length: int, other: Strings | None = None):
        self.length, self.batch = length, batch
        if other is None:
            self.buf, self.off = text_buffer(batch.column(1))
            self.grams = byte_grams(self.buf, GRAM)
        else:
            self.buf, self.off, self.grams = other.buf, other.off, other.grams
            if "h" in other.__dict__:
                self.h = other.h
        self.reach = length - GRAM
        self.least = sliding_min(self.grams, self.reach + 1)
        self.gram, self.lo, self.hi = anchor_runs(self.grams, self.off, length, GRAM, self.least)
        self.key = mix64(self.gram + _U(length))
        self.row = row_of(self.lo, self.off)

    @functools.cached_property
    def least_at(self) -> np.ndarray:
        """Places that are the least of some string."""
        peak = ~sliding_min(np.pad(~self.least, self.reach, constant_values=np.iinfo(_U).max), self.reach + 1)
        return np.flatnonzero(self.grams == peak) if len(self.least) else np.zeros(0, np.int64)

    @functools.cached_property
    def h(self) -> SpanHash:
        return SpanHash(self.buf.astype(_U) + _U(1), narrow=True)

    def places(self, some=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Every place of its gram in each of these runs, and the run's number."""
        lo, hi = self.lo[some], self.hi[some]
        first = np.searchsorted(self.least_at, lo)
        count = np.searchsorted(self.least_at, hi + self.reach) - first
        place, run = self.least_at[ragged(first, count)], np.repeat(np.arange(len(lo)), count)
        found = self.grams[place] == self.gram[some][run]
        return place[found], run[found]

    def whole(self, some) -> np.ndarray:
        return self.all_whole[some] if "all_whole" in self.__dict__ else self.h(self.lo[some], self.hi[some] - 1 + self.length)

    @functools.cached_property
    def all_whole(self) -> np.ndarray:
        return self.h(self.lo, self.hi - 1 + self.length)

    @functools.cached_property
    def wholes(self) -> np.ndarray:
        """A key of each run by all of its bytes."""
        return mix64(self.key ^ self.all_whole)

    @functools.cached_property
    def names(self) -> np.ndarray:
        """A name of each run by its key, text, id and place."""
        of_row = mix64(self.batch.column(2).to_numpy().view(_U) + mix64(self.batch.column(0).fill_null(-1).to_numpy().view(_U)))
        return mix64(self.key ^ mix64(of_row[self.row] + (self.lo - self.off[self.row]).astype(_U)))

    def coarse(self, some: np.ndarray) -> dict[str, np.ndarray]:
        """Pieces of ``COARSE`` starts of these runs: run, at (first start, in the buffer), v0, v1 (first and last start that the
        piece has; every start lies in one piece of one run), base (of the piece's places), name."""
        lo, hi = self.lo[some], self.hi[some]
        # a start belongs to the first place of its gram in its string
        place, run = self.places(some)
        before = np.full(len(place), -1, np.int64)
        before[1:] = np.where(run[1:] == run[:-1], place[:-1], -1)
        first, stop = np.maximum(lo[run], before + 1), np.minimum(hi[run], place + 1)
        ok = first < stop
        place, run, first, stop = place[ok], run[ok], first[ok], stop[ok]
        base = place - self.reach
        q0, q1 = (first - base) // COARSE, (stop - 1 - base) // COARSE
        each = np.repeat(np.arange(len(place)), q1 - q0 + 1)
        at = base[each] + ragged(q0, q1 - q0 + 1) * COARSE
        run = np.flatnonzero(some)[run[each]]
        # places apart by a multiple of COARSE have pieces that begin alike
        name = mix64(mix64(self.names[run] + (at - self.lo[run]).astype(_U)) + (base[each] - self.lo[run]).astype(_U))
        return {"run": run, "at": at, "v0": np.maximum(0, first[each] - at), "v1": np.minimum(COARSE - 1, stop[each] - 1 - at), "base": base[each], "name": name}

    def hashes(self, p: dict[str, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
        """core and piece of pieces of ``size`` starts."""
        at, v0, v1 = p["at"], p["v0"], p["v1"]
        core = mix64(self.h(at + size - 1, at + self.length) ^ mix64(self.key[p["run"]] + (at - p["base"]).astype(_U)))
        left, right = self.h(at + v0, at + size - 1), self.h(at + self.length, at + v1 + self.length)
        return core, mix64(mix64(left + _U(3)) ^ mix64(right * _U(5) + v0.astype(_U) * _U(1024) + v1.astype(_U)))

    def fine(self, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The pieces cut to ``PIECE`` starts; rel: first start, counted from that of the piece they are of."""
        j0, j1 = p["v0"] // PIECE, p["v1"] // PIECE
        of, j = np.repeat(np.arange(len(j0)), j1 - j0 + 1), ragged(j0, j1 - j0 + 1)
        out = {k: v[of] for k, v in p.items()}
        rel = j * PIECE
        return out | {"rel": rel, "at": out["at"] + rel, "v0": np.maximum(0, out["v0"] - rel), "v1": np.minimum(PIECE - 1, out["v1"] - rel)}


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _of_batches(lengths: tuple[int, ...], columns: str, rows, texts=None):
    """A mapInArrow kernel that yields rows(strings, number of the length) of every slice and length. texts: sieve of the texts
    that matter."""
    names = [c.split()[0] for c in columns.split(", ")]

    def some(batches):
        for batch in batches:
            yield batch if texts is None else batch.filter(pa.array(passes(texts.value, batch.column(2).to_numpy().view(_U))))

    def kernel(batches):
        for batch in slices(some(batches), "text", 1 << 17):
            strings = None
            for w, length in enumerate(lengths):
                strings = Strings(batch, length, strings)
                yield pa.RecordBatch.from_arrays(rows(strings, w), names=names)

    return kernel


def _repeated(texts: DataFrame, wanted: tuple[tuple[int, str], ...]):
    """As :func:`sieve`, the set of keys whose gram occurs more than once in the runs; where only whole runs matter, of keys that
    several runs have. Keys travel in bytes, one row for those of a task's stretch that lie in one part of the sketch; each
    part of the sketch is put together from its rows, one after another."""
    spark = texts.sparkSession
    deep = min(SKETCH - 6, (4 * partitions(spark)).bit_length())

    def packed(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, many = _summed(np.concatenate(keys), np.concatenate(counts))
        edge = np.searchsorted(key >> _U(64 - deep), np.arange((1 << deep) + 1, dtype=_U))
        some = np.flatnonzero(edge[1:] > edge[:-1])
        edge = np.append(edge[some], len(key)).astype(np.int32)
        binary = lambda values, size: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((edge * np.int32(size)).tobytes()), pa.py_buffer(values.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), binary(key, 8), binary(many, 1)], names=["part", "keys", "many"])

    def kernel(batches):
        keys, counts, n = [], [], 0
        for batch in slices(batches, "text", 1 << 17):
            strings = None
            for length, how in wanted:
                s = strings = Strings(batch, length, strings)
                key, at = np.unique(s.wholes if how == SHARED else s.key, return_inverse=True)
                keys.append(key)
                counts.append(np.minimum(np.bincount(at if how == SHARED else at[s.places()[1]], minlength=len(key)), 2).astype(np.uint8))
                n += len(key)
            if n >= HELD:
                yield packed(keys, counts)
                keys, counts, n = [], [], 0
        if n:
            yield packed(keys, counts)

    def sketched(batches):
        last, keys, counts = None, [], []

        def done():
            key, many = _summed(np.concatenate(keys), np.concatenate(counts))
            bits = np.zeros(1 << (SKETCH - deep), np.uint8)
            bits[(key[many > 1] >> _U(64 - SKETCH)).astype(np.int64) & (len(bits) - 1)] = 1
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, some, many in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part != last and keys:
                    yield done()
                    keys, counts = [], []
                last = part
                keys.append(np.frombuffer(some.as_py(), _U))
                counts.append(np.frombuffer(many.as_py(), np.uint8))
        if keys:
            yield done()

    rows = map_batches(texts, kernel, "part int, keys binary, many binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros(1 << (SKETCH - 6), _U)
    for r in map_batches(rows, sketched, "part int, bits binary").collect():
        size = len(out) >> deep
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.bits, _U)
    return spark.sparkContext.broadcast(out)


def _summed(key: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and their counts (2: or more)."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.minimum(np.add.reduceat(many[order].astype(np.int32), first), 2).astype(np.uint8) if len(key) else many


def _runs(texts: DataFrame, wanted: tuple[tuple[int, str], ...], bitmap) -> DataFrame:
    """Runs whose key (see :func:`_repeated`) passes: whole: hash of the run's bytes, name: of its own, lo: first start, n: starts,
    places: of the key's gram (name and places 0 where only whole runs matter)."""
    lengths = tuple(length for length, _ in wanted)

    def rows(s, w):
        shared = wanted[w][1] == SHARED
        some = passes(bitmap.value, s.wholes if shared else s.key)
        row, n = pa.array(s.row[some]), int(some.sum())
        places = np.zeros(n, np.int32) if shared else np.bincount(s.places(some)[1], minlength=n).astype(np.int32)
        name = np.zeros(n, np.int64) if shared else s.names[some]
        return [pa.array(np.full(n, w, np.int32)), _long(s.key[some]), _long(s.whole(some)), _long(name), s.batch.column(0).take(row), s.batch.column(2).take(row), pa.array((s.lo - s.off[s.row])[some]), pa.array((s.hi - s.lo)[some].astype(np.int32)), pa.array(places)]

    schema = "w int, key bigint, whole bigint, name bigint, doc_id bigint, row bigint, lo bigint, n int, places int"
    return map_batches(texts, _of_batches(lengths, schema, rows), schema)


def _coarse_pieces(texts: DataFrame, lengths: tuple[int, ...], bitmap, rows_of) -> DataFrame:
    """Coarse pieces of the runs whose name passes, as their text's hash does; rel: first start, counted from the run's; part: the piece's own name."""

    def rows(s, w):
        p = s.coarse(passes(bitmap.value, s.names))
        core, piece = s.hashes(p, COARSE)
        return [_long(core), _long(piece), _long(s.names[p["run"]]), _long(p["name"]), pa.array(p["at"] - s.lo[p["run"]]), pa.array(p["v0"].astype(np.int32)), pa.array(p["v1"].astype(np.int32))]

    schema = "core bigint, piece bigint, name bigint, part bigint, rel bigint, v0 int, v1 int"
    return map_batches(texts, _of_batches(lengths, schema, rows, rows_of), schema)


def _fine_pieces(texts: DataFrame, lengths: tuple[int, ...], runs, parts, rows_of) -> DataFrame:
    """Fine pieces of the coarse ones whose run's and own name pass, as their text's hash does; rel: first start, counted from the coarse one's."""

    def rows(s, w):
        p = s.coarse(passes(runs.value, s.names))
        some = passes(parts.value, p["name"])
        p = s.fine({k: v[some] for k, v in p.items()})
        core, piece = s.hashes(p, PIECE)
        sides = []
        for start, size in ((p["at"] + p["v0"], PIECE - 1 - p["v0"]), (p["at"] + s.length, p["v1"])):
            end = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            sides.append(pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(end.tobytes()), pa.py_buffer(s.buf[ragged(start, size)].tobytes())]))
        return [_long(core), _long(piece), _long(p["name"]), pa.array(p["rel"].astype(np.int32)), pa.array(p["v0"].astype(np.int32)), pa.array(p["v1"].astype(np.int32)), *sides]

    schema = "core bigint, piece bigint, part bigint, rel int, v0 int, v1 int, left binary, right binary"
    return map_batches(texts, _of_batches(lengths, schema, rows, rows_of), schema)


def ranked(rows: DataFrame, by: list[str], label: str, equal: list[str] | None = None) -> DataFrame:
    """The rows, sorted by the columns ``by`` over all tasks, with part and k: the place, in its task, of the row's run of equal
    values in the columns ``equal`` (by default ``by``). Ties are dealt over the tasks by u."""
    equal = equal or by
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def kernel(batches):
        from pyspark import TaskContext

        part, last, k = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            now = []
            for name in equal:
                col = batch.column(batch.schema.get_field_index(name))
                if pa.types.is_binary(col.type):
                    col = col.dictionary_encode()
                    now.append(col.dictionary[col.indices[-1].as_py()].as_py())
                    head = col.dictionary[col.indices[0].as_py()].as_py()
                    values = col.indices.to_numpy()
                else:
                    values = col.to_numpy()
                    now.append(int(values[-1]))
                    head = int(values[0])
                new[1:] |= values[1:] != values[:-1]
                new[0] |= last is None or head != last[len(now) - 1]
            place = k + np.cumsum(new)
            k, last = int(place[-1]), now
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(new), part, np.int32)), pa.array(place.astype(np.int64))], names=[*batch.schema.names, "part", "k"])

    keys = [*by, "u"]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return stored(map_batches(dealt, kernel, f"{schema}, part int, k bigint"), label)


def joints(placed: DataFrame, by: list[str]) -> list[tuple[int, int, bool]]:
    """Of every task in turn: its number, its distinct values, and whether its first equal the last of the one before."""
    at = F.struct(*by)
    edges = placed.groupBy("part").agg(F.max("k").alias("n"), F.min_by(at, "k").alias("first"), F.max_by(at, "k").alias("last")).orderBy("part").collect()
    return [(r.part, r.n, i > 0 and r.first == edges[i - 1].last) for i, r in enumerate(edges)]


def named(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """u, p, name of the rows: equal where the columns ``by`` are, and in their order."""
    placed = ranked(rows, by, label)
    offsets, total = [], 0
    for part, n, joined in joints(placed, by):
        offsets.append((part, total - joined))
        total += n - joined
    # a row for each task
    offsets = rows.sparkSession.createDataFrame(offsets, "part int, off bigint")
    return placed.join(F.broadcast(offsets), "part").select("u", "p", (F.col("k") + F.col("off")).alias("name"))


def _row_arrays(names: DataFrame, positions: list[int], width: int) -> DataFrame:
    """u, s: array of the names, that of position p at its place in ``positions``; 0 where there is none."""
    got = names.groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct("p", "name"))).alias("m"))
    place = {p: i for i, p in enumerate(positions)}
    of = {i: p for p, i in place.items()}
    return got.select("u", F.array(*(F.coalesce(F.element_at("m", F.lit(of[i])), F.lit(0).cast("bigint")) if i in of else F.lit(0).cast("bigint") for i in range(width))).alias("s"))


def order(strings: DataFrame, width: int, need: list[int], depth: int, label: str = "order") -> DataFrame:
    """u, r: the order of the suffixes at the positions ``need`` of each string among those at the same position of other
    strings of its core; equal where they agree in ``depth`` symbols at least, or to the end.

    strings: core, u (unique), s: array of ``width`` symbols.
    """
    if depth <= 1:
        return strings.select("u", F.array(*(F.get("s", F.lit(x)) for x in need)).alias("r"))
    symbol = lambda x: F.get("s", F.lit(x)) if x < width else F.lit(0).cast("bigint")
    # the sampled suffixes that decide: those needed, and those behind the others
    sample = sorted({x if x % 3 else x + 1 for x in need})
    triples = sorted({p + 3 * j for p in sample for j in range(-(-depth // 3)) if p + 3 * j < width or not j})
    places = [*(p for p in triples if p % 3 == 1), *(p for p in triples if p % 3 == 2)]
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), symbol(p).alias("a"), symbol(p + 1).alias("b"), symbol(p + 2).alias("c")) for p in triples)))
    rows = strings.select("core", "u", each.alias("e")).select("core", "u", "e.*")
    names = stored(_row_arrays(named(rows, ["core", "p", "a", "b", "c"], f"{label}-triples"), places, len(places)), f"{label}-names")
    reduced = strings.select("core", "u").join(names, "u")
    below = order(reduced, len(places), [places.index(p) for p in sample], -(-depth // 3), f"{label}-{len(places)}")
    at = {p: F.get("r", F.lit(i)) for i, p in enumerate(sample)}
    met = stored(strings.join(below, "u"), f"{label}-below")
    rest = [x for x in need if x % 3 == 0]
    if not rest:
        return met.select("u", F.array(*(at[x] for x in need)).alias("r"))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("p"), symbol(x).alias("a"), at[x + 1].alias("b")) for x in rest)))
    others = named(met.select("core", "u", each.alias("e")).select("core", "u", "e.*"), ["core", "p", "a", "b"], f"{label}-rest")
    others = _row_arrays(others, rest, len(rest)).select("u", F.col("s").alias("q"))
    full = met.join(others, "u")
    return full.select("u", F.array(*(at[x] if x % 3 else F.get("q", F.lit(rest.index(x))) for x in need)).alias("r"))


def _symbols(kinds: DataFrame) -> DataFrame:
    """core, u, s: triples of bytes around the core as numbers, which need no sort to be named: those at 1, 4, ... of the
    2 * PIECE - 1 symbols, then those at 2, 5, ..."""
    width = 2 * PIECE - 1
    places = [*range(1, width, 3), *range(2, width, 3)]

    def kernel(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            s = np.zeros((n, width + 3), np.int64)
            s[:, PIECE - 1] = 257
            grid = np.arange(width + 3)
            v0, v1 = col["v0"].to_numpy(), col["v1"].to_numpy()
            for name, inside in (("left", (grid >= v0[:, None]) & (grid < PIECE - 1)), ("right", (grid >= PIECE) & (grid < (PIECE + v1)[:, None]))):
                s[inside] = np.frombuffer(b"".join(col[name].to_pylist()), np.uint8).astype(np.int64) + 1
            triple = (s[:, :-2] << 18) | (s[:, 1:-1] << 9) | s[:, 2:]
            out = np.concatenate([triple[:, places], s[:, : PIECE]], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * out.shape[1], out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([col["core"], col["u"], lists], names=["core", "u", "s"])

    return map_batches(kinds.select("core", "u", "v0", "v1", "left", "right"), kernel, "core bigint, u bigint, s array<bigint>")


def equal_strings(kinds: DataFrame) -> DataFrame:
    """u, t, and n, low, high, first of all kinds that hold the string at start t: sums and extremes over them, first moved
    by t, mine: that of the kind itself. Kinds: core, u, v0, v1, left, right, n, and low, high, first if they matter."""
    known = [c for c in KNOWN if c in kinds.columns]
    symbols = stored(_symbols(kinds), "symbols")
    width = 2 * PIECE - 1
    places = [*range(1, width, 3), *range(2, width, 3)]
    sample = sorted({t if t % 3 else t + 1 for t in range(PIECE)})
    with temporary(kinds.sparkSession):
        below = stored(order(symbols, len(places), [places.index(p) for p in sample], -(-PIECE // 3)), "below", True)
    # all suffixes by first symbol (of the rest) and order behind it
    own = {p: F.get("r", F.lit(i)) for i, p in enumerate(sample)}
    byte = lambda t: F.get("s", F.lit(len(places) + t))
    zero = F.lit(0).cast("bigint")
    each = F.array(*(F.struct(F.lit(t).alias("p"), (zero if t % 3 else byte(t)).alias("a"), (own[t] if t % 3 else own[t + 1]).alias("b")) for t in range(PIECE)))
    suffixes = symbols.join(below, "u").select("u", each.alias("each"))
    sides = kinds.select("u", "core", "v0", "v1", "left", "right", *known).join(suffixes, "u")
    rows = sides.select("*", F.explode("each").alias("e")).select("*", "e.*").where("p between v0 and v1")
    string = F.concat(F.expr("substring(left, p - v0 + 1)"), F.expr("substring(right, 1, p)"))
    own = [_moved("first", F.col("p")).alias(c) if c == "first" else c for c in known]
    rows = stored(rows.select("core", "u", "p", "a", "b", string.alias("string"), *own), "suffixes")
    # neighbours may differ further on: equal are those whose own symbols are
    equal = ["core", "p", "string"]
    placed = ranked(rows, ["core", "p", "a", "b"], "suffix-order", equal)
    total = _totals(known)
    classes = stored(placed.groupBy("part", "k").agg(*total), "string-classes")
    # classes that go on in the next task: at most one a task
    group, across = 0, []
    before = None
    for part, n, joined in joints(placed, equal):
        if joined:
            across += [] if across and across[-1][:2] == before else [(*before, group)]
            across.append((part, 1, across[-1][2]))
        group += 1
        before = (part, n)
    same = F.broadcast(rows.sparkSession.createDataFrame(across, "part int, k bigint, joint int"))
    spread = classes.join(same, ["part", "k"])
    summed = spread.groupBy("joint").agg(*total)
    whole = spread.select("part", "k", "joint").join(summed, "joint").drop("joint")
    classes = classes.join(same, ["part", "k"], "left_anti").unionByName(whole)
    mine = placed.select("part", "k", "u", F.col("p").alias("t"), *[F.col(c).alias("mine") for c in known if c == "first"])
    return mine.join(classes.where("n > 1"), ["part", "k"])


def _totals(known: list[str]) -> list[Column]:
    """Sums and extremes of these columns."""
    how = {"n": F.sum, "low": F.min, "high": F.max, "first": F.min}
    return [how[c](c).alias(c) for c in known]


def _texts_of(rows: DataFrame):
    return sieve(rows.select("row"), "row", 25)


def _sifted(rows, label: str, *sieves) -> DataFrame:
    """rows(*sieves), stored; the sieves, of which every machine has a copy on its disk, go."""
    out = stored(rows(*sieves), label)
    for bitmap in sieves:
        bitmap.destroy()
    return out


def _by_length(wanted: tuple[tuple[int, str], ...], of: Callable[[str], Column]) -> Column:
    """of(how) for the number w of the length that is cut into pieces."""
    found = [(w, of(how)) for w, (_, how) in enumerate(wanted) if how != SHARED]
    out = found[0][1] if found else F.lit(False)
    for w, value in found[1:]:
        out = F.when(F.col("w") == w, value).otherwise(out)
    return out


def _hit(wanted: tuple[tuple[int, str], ...], place: Column, n: str = "n") -> Column:
    """Whether a string at this place is repeated, by what is known of all places that hold it."""
    return _by_length(wanted, lambda how: F.col(n) > 1 if how == ANY else F.col("low") < F.col("high") if how == OTHER else F.col("first") < place)


def _moved(place: str, by: Column) -> Column:
    return F.struct(F.col(f"{place}.doc_id").alias("doc_id"), F.col(f"{place}.row").alias("row"), (F.col(f"{place}.at") + by).alias("at"))


def repeated_starts(docs: DataFrame, wanted: tuple[tuple[int, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), spans: array of (w, at, n, mask): of the wanted length w, starts at + t, t < n, are
    repeated where bit t of mask is set, all of them where it is null."""
    spark, lengths = docs.sparkSession, tuple(length for length, _ in wanted)
    if min((length for length, how in wanted if how != SHARED), default=GRAM + COARSE) < GRAM + COARSE:
        raise ValueError(f"strings of fewer than {GRAM + COARSE} bytes can't be cut into pieces")
    # what is known of all places of a class or kind: what no length asks for isn't carried along, nor aggregated by sorts
    ways = {how for _, how in wanted}
    known = ["n", *(("low", "high") if OTHER in ways else ()), *(("first",) if LATER in ways else ())]
    total = _totals([c for c in known if c != "first"])
    open_w = [w for w, (_, how) in enumerate(wanted) if how != SHARED]
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("row"))
    found = _sifted(lambda bitmap: _runs(texts, wanted, bitmap), "runs", _repeated(texts, wanted))
    runs = found.where(F.col("w").isin(open_w))
    # classes of equal runs, and one of each that stands for them; an id that is null is one of its own, before all others
    place = F.struct("doc_id", "row", F.col("lo").alias("at"))
    ids = [F.min(F.struct("doc_id")).alias("low"), F.max(F.struct("doc_id")).alias("high")] if OTHER in ways else []

    def head(first: Column, name: str, *more: str) -> list[Column]:
        """name and more of the first row, or of any where no length asks for the first."""
        if LATER in ways:
            return [F.min(F.struct(first.alias("first"), name, *more)).alias("head")]
        return [F.min(name).alias(name), *(F.min_by(c, name).alias(c) for c in more)]

    def headed(rows: DataFrame, *names: str) -> DataFrame:
        if LATER not in ways:
            return rows
        own = {c: F.col(f"head.{c}") for c in ("first", *names)} | {"row": F.col("head.first.row")}
        return rows.withColumns(own).drop("head")

    def moved(rows: DataFrame) -> DataFrame:
        return rows.withColumn("at", _moved("first", F.col("rel"))).drop("first") if LATER in ways else rows

    at = ["at"] if LATER in ways else []
    classes = runs.groupBy("w", "key", "whole").agg(F.count("*").alias("n"), F.first("places").alias("places"), *head(place, "name", *([] if at else ["row"])), *ids)
    classes = stored(headed(classes, "name"), "classes")
    open_ = classes.groupBy("key").agg(F.sum("places").alias("places")).where("places > 1").select("key")
    release(spark)
    reps = stored(classes.join(open_, "key").select("w", "key", "whole", "name", "row", *known), "open-classes")
    # kinds of coarse pieces of one run of each class; strings that are too short to be cut aren't read again
    long = tuple(length for length, how in wanted if how != SHARED)
    cut_up = lambda *sieves: moved(_coarse_pieces(texts, long, *sieves).join(reps.drop("key", "whole"), "name"))
    pieces = _sifted(cut_up, "pieces", sieve(reps, "name"), _texts_of(reps))
    kinds = pieces.groupBy("core", "piece").agg(F.first("w").alias("w"), *total, *(head(F.col("at"), "name", "part") if at else head(F.lit(None), "part", "name", "row")))
    kinds = headed(stored(kinds, "kinds"), "name", "part")
    undone = F.max(_by_length(wanted, lambda how: F.col("n") == 1 if how == ANY else F.col("low") == F.col("high") if how == OTHER else F.lit(True)))
    several = kinds.groupBy("core").agg(F.count("*").alias("ways"), undone.alias("undone")).where("ways > 1 and undone").select("core")
    beside = kinds.join(several, "core").select("w", F.col("core").alias("of_core"), F.col("piece").alias("of_piece"), "name", "part", "row", *known)
    beside = stored(beside, "open-kinds")
    release(spark)
    # kinds of fine pieces of one piece of each kind
    cut_up = lambda *sieves: moved(_fine_pieces(texts, long, *sieves).join(beside.drop("name", "row"), "part"))
    fine = _sifted(cut_up, "fine-pieces", sieve(beside, "name", 25), sieve(beside, "part", 25), _texts_of(beside))
    # pieces of one kind have one body
    small = fine.groupBy("core", "piece", "v0", "v1", "left", "right").agg(F.first("w").alias("w"), *total, *(F.min(c).alias("first") for c in at))
    small = stored(small.withColumn("u", F.monotonically_increasing_id()), "fine-kinds")
    several = small.groupBy("core").agg(F.count("*").alias("ways")).where("ways > 1").select("core")
    left = stored(small.join(several, "core"), "left")
    release(spark)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("t"))
    with temporary(spark):
        equal = equal_strings(left.drop("piece", "w"))
        equal = equal.join(left.select("u", "w"), "u") if len(open_w) > 1 else equal
        equal = equal.where(_hit(wanted, F.col("mine")))
        masks = stored(equal.select("u", bit.alias("bit")).groupBy("u").agg(F.bit_or("bit").alias("mask")), "masks", True)
    # back: of a fine piece all starts if its own kind says so, else those of the kind's mask
    null = F.lit(None).cast("bigint")
    span = lambda at, n, mask: F.struct(at.cast("bigint").alias("at"), n.cast("int").alias("n"), mask.alias("mask"))
    v0, many = F.col("v0"), F.col("v1") - F.col("v0") + 1
    verdicts = small.join(masks, "u", "left").where("n > 1 or mask <> 0").select("core", "piece", "mask", *known)
    judged = fine.select("of_core", "of_piece", "core", "piece", "w", "rel", "v0", "v1", *at).join(verdicts, ["core", "piece"])
    judged = judged.select("of_core", "of_piece", F.when(_hit(wanted, F.col("at")), span(F.col("rel") + v0, many, null)).when(F.col("mask") != 0, span(F.col("rel"), F.lit(PIECE), F.col("mask"))).alias("span"))
    parts = judged.where("span is not null").groupBy(F.col("of_core").alias("core"), F.col("of_piece").alias("piece")).agg(F.collect_list("span").alias("parts"))
    shifted = lambda by: F.transform("parts", lambda x: F.struct((x["at"] + by).alias("at"), x["n"].alias("n"), x["mask"].alias("mask")))
    # of a coarse piece
    verdicts = stored(kinds.join(parts, ["core", "piece"], "left").where("n > 1 or parts is not null").select("core", "piece", "parts", *known), "kind-verdicts")
    judged = pieces.select("core", "piece", "w", "name", "rel", "v0", "v1", *at).join(verdicts, ["core", "piece"])
    judged = judged.select("name", F.when(_hit(wanted, F.col("at")), F.array(span(F.col("rel") + v0, many, null))).otherwise(shifted(F.col("rel"))).alias("parts")).where("parts is not null")
    parts = judged.groupBy("name").agg(F.flatten(F.collect_list("parts")).alias("parts")).join(reps.select("name", "key", "whole"), "name").drop("name")
    # of a run
    verdicts = classes.join(parts, ["key", "whole"], "left").where("parts is not null or n > 1").select("key", "whole", "parts", F.col("n").alias("m"), *known[1:])
    verdicts = stored(verdicts, "verdicts")
    met = runs.drop("places", "name").join(verdicts, ["key", "whole"])
    whole = span(F.col("lo"), F.col("n"), null)
    met = met.select("doc_id", "row", "w", F.when(_hit(wanted, place, "m"), F.array(whole)).otherwise(shifted(F.col("lo"))).alias("spans")).where("spans is not null")
    if SHARED in ways:
        # whole runs need no more than their ids
        shown = found.where(~F.col("w").isin(open_w))
        several = shown.groupBy("key", "whole").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("none"))
        several = several.where("low < high or none and low is not null").select("key", "whole")
        met = met.unionByName(shown.join(several, ["key", "whole"]).select("doc_id", "row", "w", F.array(whole).alias("spans")))
    named_ = F.transform("spans", lambda x: F.struct(F.col("w").alias("w"), x["at"].alias("at"), x["n"].alias("n"), x["mask"].alias("mask")))
    return met.select("doc_id", "row", named_.alias("spans")).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(n_bytes: int, spans: pa.Scalar, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Which bytes the strings at the repeated starts cover, for each length."""
    w, at, n, mask = (spans.values.field(c) for c in ("w", "at", "n", "mask"))
    w, at, n, null = w.to_numpy(), at.to_numpy(), n.to_numpy(), mask.is_null().to_numpy(zero_copy_only=False)
    bits = mask.fill_null(0).to_numpy()
    out = []
    for k, length in enumerate(lengths):
        edge = np.zeros(n_bytes + 1, np.int64)
        own = null & (w == k)
        np.add.at(edge, at[own], 1)
        np.add.at(edge, at[own] + n[own] - 1 + length, -1)
        own = ~null & (w == k)
        t = np.arange(PIECE)
        start = (at[own, None] + t)[(t < n[own, None]) & ((bits[own, None] >> t) & 1 == 1)]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        out.append(np.cumsum(edge)[:n_bytes] > 0)
    return out


def _marked(docs: DataFrame, wanted: tuple[tuple[int, str], ...], id_col: str, text_col: str) -> DataFrame:
    """All columns of docs and __sd_spans; only texts that have some are shuffled."""
    with temporary(docs.sparkSession):
        spans = stored(repeated_starts(docs, wanted, id_col, text_col), "spans", True)
    spans = spans.withColumnsRenamed({"doc_id": "__sd_id", "row": "__sd_row", "spans": "__sd_spans"})
    bitmap = sieve(spans.select("__sd_row"), "__sd_row")
    keyed = docs.withColumn("__sd_key", F.xxhash64(F.col(f"`{text_col}`")))

    def chosen(wish: bool):
        def kernel(batches):
            for batch in batches:
                yield batch.filter(pa.array(passes(bitmap.value, batch.column(batch.num_columns - 1).to_numpy().view(_U)) == wish))

        return map_batches(keyed, kernel, keyed.schema)

    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col("__sd_id")) & (F.col("__sd_key") == F.col("__sd_row"))
    hit = chosen(True).join(spans, same, "left").drop("__sd_id", "__sd_row")
    return hit.unionByName(chosen(False), allowMissingColumns=True).drop("__sd_key")


def dedup(docs: DataFrame, wanted: tuple[tuple[int, str], ...] = ((LENGTH, ANY), (SHOWN, SHARED)), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id; n_bytes, and by the first of the wanted lengths n_removed, n_spans, kept_sha256; n_passage: bytes that
    the second covers, if there is one (by default: runs of strings of ``SHOWN`` bytes that stand in another document too, which
    tells passages of some fifty words without the full price of a shorter length)."""
    lengths = tuple(length for length, _ in wanted)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    joined = _marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), wanted, "id", "text")

    def digests(batches):
        for batch in slices(batches, "text", 1 << 20):
            buf, off = text_buffer(batch.column(1))
            spans, out = batch.column(2), []
            for i in range(batch.num_rows):
                own = buf[off[i] : off[i + 1]]
                gone = covered(len(own), spans[i], lengths) if spans[i].is_valid else [np.zeros(len(own), bool)] * len(lengths)
                out.append((len(own), int(gone[0].sum()), int((np.diff(gone[0].astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(own[~gone[0]].tobytes()).hexdigest(), int(gone[-1].sum())))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3]), pa.array(columns[4], pa.int64())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"])

    out = map_batches(joined, digests, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage bigint").withColumnRenamed("id", id_col)
    return out if len(wanted) > 1 else out.drop("n_passage")


def dedup_texts(docs: DataFrame, length: int = PASSAGE, which: str = LATER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, the text cut (bytes of a character that was cut through go with it), and n_chars of it."""
    joined = _marked(docs, ((length, which),), id_col, text_col)

    def texts(batches):
        for batch in slices(batches, text_col, 1 << 20):
            at = batch.schema.get_field_index(text_col)
            buf, off = text_buffer(batch.column(at))
            spans, cut = batch.column(batch.num_columns - 1), []
            for i, valid in enumerate(batch.column(at).is_valid().to_pylist()):
                own = buf[off[i] : off[i + 1]]
                if spans[i].is_valid:
                    own = own[~covered(len(own), spans[i], (length,))[0]]
                cut.append(own.tobytes().decode("utf-8", "ignore") if valid else None)
            columns = [pa.array(cut, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = map_batches(joined, texts, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
