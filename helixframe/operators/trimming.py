"""Read trimming (P2, P3, P5-P8, P13). Alignments of adapters run as array kernels over all reads of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table entry is errors * _ERROR - score, so that the least entry has the fewest errors, then the best score.
_ERROR = 1 << 12


def _letters(text: str) -> np.ndarray:
    """Code points, ASCII letters in upper case."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    return np.where((x >= 97) & (x <= 122), x - 32, x)


def adapter_cut(reads: list[str], adapter: str, least_overlap: int = 1, rate: float = 0.1, parity: str | None = None) -> np.ndarray:
    """Length of each read before the 3' adapter. Semiglobal alignment, match +1, mismatch -1, indel -2 (parity "3.2":
    the same places, chosen by most matches, then fewest errors). A match of aligned adapter length n counts if n is at least
    the overlap and its errors at most rate * n.

    An alignment of the whole adapter with at most k errors holds one of k + 1 pieces of the adapter unchanged. So the table is
    filled around the places of these pieces and at the read's end only. Entries of at most k errors depend on such entries alone, which
    reach back m + k letters; those that have as many letters of their stretch before them equal the whole table's."""
    m = len(adapter)
    allowed = int(rate * m)
    reach, pieces = m + allowed + 1, _pieces(adapter, allowed)
    which, begin, end = [], [], []  # stretches: their read, and where they are in it
    for k, r in enumerate(reads):
        spans = [(t - o - allowed - reach, t - o + m + allowed) for t, o in _places(r, pieces)] if allowed < m else [(0, len(r))]
        upto = None
        for lo, hi in sorted([*spans, (len(r) - 2 * reach, len(r))]):
            lo, hi = max(lo, 0), min(hi, len(r))
            if upto is not None and lo <= upto:
                end[-1] = upto = max(upto, hi)
            else:
                which.append(k)
                begin.append(lo)
                end.append(hi)
                upto = hi
    entry, origin, last, column, stop = _table([reads[k][lo:hi] for k, lo, hi in zip(which, begin, end, strict=True)], adapter, allowed)
    of = np.repeat(np.arange(len(which)), np.diff(stop, prepend=0))
    lo = np.array(begin, np.int64)
    errors = (entry + _ERROR // 2) // _ERROR
    whole = (column > 0) & (errors <= allowed) & ((column >= reach) | (lo[of] == 0))
    found = np.flatnonzero(whole) if m >= least_overlap else np.zeros(0, np.int64)
    first = np.searchsorted(np.array(which), np.arange(len(reads) + 1))
    bounds = np.searchsorted(found, np.concatenate([[0], stop])[first])
    out = np.array([len(r) for r in reads], np.int64)
    for k in range(len(reads)):
        best: tuple[int, int, int, int] | None = None  # score, errors, start, length
        matches = ((int(errors[j]) * _ERROR - int(entry[j]), int(errors[j]), int(origin[j] + lo[of[j]]), m) for j in found[bounds[k] : bounds[k + 1]])
        tail = first[k + 1] - 1
        for s, e, at, length in _with_end(matches, last[:, :, tail], int(lo[tail]), least_overlap, rate, m):
            if best is None:
                best = (s, e, at, length)
            elif parity == "3.2":
                if (length - e, -e) > (best[3] - best[1], -best[1]):
                    best = (s, e, at, length)
            elif s > best[0] and (at <= best[2] + m // 2 or length > best[3]):
                best = (s, e, at, length)
            if best[1] == 0 and best[3] == m:
                break
        if best is not None:
            out[k] = best[2]
    return out


def _pieces(adapter: str, allowed: int) -> list[tuple[bytes, int]]:
    """allowed + 1 pieces of the adapter as they are looked for, and where they begin; a letter each at least."""
    n = min(allowed + 1, len(adapter))
    bounds = [len(adapter) * i // n for i in range(n + 1)] if n else []
    return [(_upper(adapter[lo:hi]), lo) for lo, hi in zip(bounds, bounds[1:])]


def _upper(text: str) -> bytes:
    """UTF-8, ASCII letters in upper case."""
    return text.encode("utf-8", "surrogatepass").upper()


def _places(read: str, pieces: list[tuple[bytes, int]]) -> list[tuple[int, int]]:
    """Code point at which each piece stands in the read, wherever it does, and where the piece begins in the adapter."""
    text, out = _upper(read), []
    plain = len(text) == len(read)
    for piece, o in pieces:
        at = text.find(piece)
        seen = done = 0  # bytes, and code points in them
        while at >= 0:
            if plain:
                done = at
            else:
                done += len(text[seen:at].decode("utf-8", "surrogatepass"))
                seen = at
            out.append((done, o))
            at = text.find(piece, at + 1)
    return out


def _table(reads: list[str], adapter: str, allowed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Last row of the table: entry and origin of each column; both, at each read's end, of every row; column of its read; where reads
    stop.

    The table's rows are adapter prefixes, its columns the letters of all reads one after another (a column before each read's
    first); a row is filled for all columns at once. Gaps in the adapter run along the row: a gap costs an error, so that as many
    passes as errors are allowed settle every entry that can count."""
    a, x = _letters(adapter), [_letters(r) for r in reads]
    m, size = len(a), np.array([len(v) for v in x], np.int64)
    stop = np.cumsum(size + 1)
    start = stop - size - 1
    letters = np.full(int(stop[-1]) if len(stop) else 0, -1, np.int32)
    inside = np.ones(len(letters), bool)
    inside[start] = False
    letters[inside] = np.concatenate(x) if len(x) else letters[:0]
    column = np.arange(len(letters)) - np.repeat(start, size + 1)
    entry, origin = np.zeros(len(letters), np.int64), column.copy()
    last = np.zeros((m + 1, 2, len(reads)), np.int64)
    shift = lambda v: np.concatenate([v[:1], v[:-1]])
    for i in range(1, m + 1):
        diagonal, same = shift(entry), inside & (letters == a[i - 1])
        above = entry + _ERROR + 2
        new = np.where(same, diagonal - 1, diagonal + _ERROR + 1)
        source = shift(origin)
        up = ~same & (above < new)
        new, source = np.where(up, above, new), np.where(up, origin, source)
        new[~inside], source[~inside], up[~inside] = i * (_ERROR + 2), 0, False
        free = inside & ~same
        for _ in range(allowed + 1):
            left = shift(new) + _ERROR + 2
            better = free & ((left < new) | ((left == new) & up))
            if not better.any():
                break
            source = np.where(better, shift(source), source)
            new, up = np.where(better, left, new), up & ~better
        entry, origin = new, source
        last[i, 0], last[i, 1] = entry[stop - 1], origin[stop - 1]
    return entry, origin, last, column, stop


def _with_end(whole: Iterator[tuple], last: np.ndarray, begin: int, least_overlap: int, rate: float, m: int) -> Iterator[tuple[int, int, int, int]]:
    """Alignments of the whole adapter by where they end, then those of its prefixes at the read's end, whose stretch begins at ``begin``."""
    yield from whole
    for i in range(max(1, least_overlap), m + 1):
        entry, at = int(last[i, 0]), int(last[i, 1])
        e = (entry + _ERROR // 2) // _ERROR
        if e <= int(rate * i):
            yield e * _ERROR - entry, e, begin + at, i


def adapter_cuts(adapter: str, **how):
    """Column function: :func:`adapter_cut` of each read, some millions of letters at a time."""

    @F.pandas_udf("int")
    def cuts(reads: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in reads:
            out = pd.Series(pd.NA, index=batch.index, dtype="Int32")
            known = batch.dropna()
            block = known.str.len().cumsum() // (1 << 21)
            for _, part in known.groupby(block):
                out.loc[part.index] = adapter_cut(part.tolist(), adapter, **how)
            yield out

    return cuts


def quality_kept(qual: str, cutoff: int) -> int:
    """As :func:`helixframe.functions.sequences.quality_cut`, of a string. From the end, stretches that grow are read until the sum
    falls below 0."""
    n, done, before, best, cut, step = len(qual), 0, 0, 0, 0, 64
    while done < n:
        part = qual[max(0, n - done - step) : n - done]
        x = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)[::-1].astype(np.int64)
        total = before + np.cumsum(cutoff + 33 - x)
        below = np.flatnonzero(total < 0)
        on = total[: below[0]] if len(below) else total
        if len(on) and on.max() > best:
            best, cut = int(on.max()), done + int(on.argmax()) + 1
        if len(below):
            break
        done, before, step = done + len(part), int(total[-1]), min(2 * step, 1 << 16)
    return n - cut


def quality_cuts(cutoff: int):
    """Column function: :func:`quality_kept` of each string of qualities."""

    @F.pandas_udf("int")
    def cuts(quals: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in quals:
            yield batch.map(lambda q: quality_kept(q, cutoff), na_action="ignore").astype("Int32")

    return cuts


def pair_cuts(adapter: str, adapter2: str, cutoff: int):
    """Column function of seq, qual, seq2, qual2: lengths n, n2 of the mates after quality and adapter, in one pass over a batch."""

    def mate(seq: pd.Series, qual: pd.Series, a: str) -> pd.Series:
        out, at, part, letters = np.zeros(len(seq), np.int32), [], [], 0
        for i, (r, q) in enumerate(zip(seq, qual, strict=True)):
            if isinstance(r, str):
                at.append(i)
                part.append(r[: quality_kept(q, cutoff) if isinstance(q, str) else 0])
                letters += len(part[-1])
            if letters >= 1 << 21 or i + 1 == len(seq):
                out[at] = adapter_cut(part, a)
                at, part, letters = [], [], 0
        return pd.Series(out, dtype="Int32").where(seq.notna().to_numpy())

    @F.pandas_udf("n int, n2 int")
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for seq, qual, seq2, qual2 in batches:
            yield pd.DataFrame({"n": mate(seq, qual, adapter), "n2": mate(seq2, qual2, adapter2)})

    return cuts.asNondeterministic()  # else Spark calls it once for the rows and once more for the filter on them


def trim_pairs(reads: DataFrame, adapter: str, adapter2: str | None = None, cutoff: int = 20, least: int = 20, five_prime: bool = False) -> DataFrame:
    """Quality, then adapter, then length; a mate that is too short drops the pair. reads: name, seq, qual, seq2, qual2."""
    out, mates = reads, (("seq", "qual", "n"), ("seq2", "qual2", "n2"))
    if five_prime:
        for seq, qual, _ in mates:
            start = F.length(seq) - quality_cuts(cutoff)(F.reverse(qual))  # P5
            out = out.withColumn("_s", start).withColumn(seq, F.expr(f"substring({seq}, _s + 1)")).withColumn(qual, F.expr(f"substring({qual}, _s + 1)")).drop("_s")
    out = out.withColumn("_cuts", pair_cuts(adapter, adapter2 or adapter, cutoff)("seq", "qual", "seq2", "qual2"))
    for seq, qual, n in mates:
        out = out.withColumn(seq, F.expr(f"substring({seq}, 1, _cuts.{n})")).withColumn(qual, F.expr(f"substring({qual}, 1, _cuts.{n})"))
    return out.drop("_cuts").where(F.least(F.length("seq"), F.length("seq2")) >= least)


def find_adapter(adapter: str, most: int = 0):
    """0-based place of the adapter in the read with at most ``most`` mismatches, -1 for none; the first best place."""
    a = np.frombuffer(adapter.encode("utf-32-le"), np.uint32)

    @F.pandas_udf("int")
    def places(reads: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def place(r: str) -> int:
            x = np.frombuffer(r.encode("utf-32-le"), np.uint32)
            if len(x) < len(a):
                return -1
            miss = (np.lib.stride_tricks.sliding_window_view(x, len(a)) != a).sum(1)
            k = int(miss.argmin())
            return k if miss[k] <= most else -1

        for batch in reads:
            yield batch.map({r: place(r) for r in batch.dropna().unique()}).astype("Int32")

    return places


def anchored_slice(seq: Column, adapter_at: Column, adapter_length: int, anchor: int, offset: int, length: int) -> Column:
    """``length`` letters from an anchor: 0 read start, 1 read end, 2 adapter start, 3 adapter end; null without adapter."""
    base = {0: F.lit(0), 1: F.length(seq), 2: adapter_at, 3: adapter_at + adapter_length}[anchor]
    return F.when(F.lit(anchor < 2) | (adapter_at >= 0), F.substring(seq, (base + offset + 1).cast("int"), F.lit(length)))


def mismatches(aligns: DataFrame) -> DataFrame:
    """NM and MD of alignments without gaps in their blocks. aligns: read_bases, ref_bases (of the aligned stretch)."""
    pairs = F.zip_with(F.split("read_bases", ""), F.split("ref_bases", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("nm"), F.lit("").alias("md"))
    step = lambda s, x: F.when(x["a"] == x["b"], F.struct((s["run"] + 1).alias("run"), s["nm"].alias("nm"), s["md"].alias("md"))).otherwise(F.struct(F.lit(0).alias("run"), (s["nm"] + 1).alias("nm"), F.concat(s["md"], s["run"].cast("string"), x["b"]).alias("md")))
    return aligns.withColumn("_x", F.aggregate(pairs, zero, step)).withColumn("nm", F.col("_x.nm")).withColumn("md", F.concat(F.col("_x.md"), F.col("_x.run").cast("string"))).drop("_x")
