"""Operator 2: language identification by a byte convolutional network.

Text is lower-cased (ASCII), cut into windows of ``WINDOW`` bytes and padded with spaces. Each byte has a learnt
vector; filters 2, 3 and 4 bytes wide run over every position of a window, are max-pooled over it, and feed a
softmax over the learnt languages. A text's distribution is the mean over all of its windows, weighted by their
bytes, so whole texts count and memory per step is fixed.

The network is trained here, in numpy, on a bounded sample: at most ``sample_rows`` labelled rows (drawn by a hash
of the row, so that reruns agree, with equal chances for the languages) and ``windows_per_row`` windows of each.

Defined results: a text that is null or has no letter gets ``und`` with score 0; with no labelled row to learn
from, every text does; a null id is never learnt from and not held out; repeated rows get equal results; labels
and sources are never inputs of a prediction; further columns of the input play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_batches
from .vec import ragged, slices, text_buffer

WINDOW = 256
WIDTHS, DEPTH, FILTERS = (2, 3, 4), 4, 16
SPAN = max(WIDTHS)
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True


@dataclass
class ByteConvNet:
    languages: list[str]
    vectors: np.ndarray  # 256 x DEPTH
    kernel: np.ndarray  # SPAN * DEPTH x filters, zero beyond a filter's width
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> ByteConvNet:
        rng, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(languages, f(256, DEPTH, scale=0.7), f(SPAN * DEPTH, n, scale=0.35) * cls.reach(), np.zeros(n, np.float32), f(n, len(languages), scale=0.2), np.zeros(len(languages), np.float32))

    @staticmethod
    def reach() -> np.ndarray:
        """1 where a filter has weights: its first width bytes."""
        width = np.repeat(WIDTHS, FILTERS)
        return (np.repeat(np.arange(SPAN), DEPTH)[:, None] < width).astype(np.float32)

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """The vectors of the SPAN bytes at each position: windows x positions x SPAN * DEPTH."""
        x = self.vectors[windows]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), SPAN * DEPTH, axis=1)
        return view[:, ::DEPTH]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.ascontiguousarray(self.patches(windows))
        return p, (p.reshape(-1, p.shape[2]) @ self.kernel).reshape(len(windows), -1, self.kernel.shape[1])

    def head(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(top + self.bias, 0)
        z = hidden @ self.weights + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return hidden, z / z.sum(1, keepdims=True)

    def predict(self, windows: np.ndarray, block: int = 128) -> np.ndarray:
        out = np.zeros((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), block):
            out[i : i + block] = self.head(self.pooled(windows[i : i + block])[1].max(1))[1]
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> ByteConvNet:
        rng, mask, step = np.random.default_rng(seed), self.reach(), 0
        slots = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in ("vectors", "kernel", "bias", "weights", "offset")}
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x, y = windows[pick], labels[pick]
                p, response = self.pooled(x)
                where = response.argmax(1)
                hidden, prob = self.head(np.take_along_axis(response, where[:, None], 1)[:, 0])
                dz = prob.copy()
                dz[np.arange(len(y)), y] -= 1
                dz /= len(y)
                dh = (dz @ self.weights.T) * (hidden > 0)
                patch = p[np.arange(len(y))[:, None], where]  # batch x filters x SPAN * DEPTH
                dpatch = (dh[:, :, None] * (self.kernel * mask).T).reshape(len(y), -1, SPAN, DEPTH)
                bytes_at = x[np.arange(len(y))[:, None, None], where[:, :, None] + np.arange(SPAN)]
                dv = np.stack([np.bincount(bytes_at.ravel(), dpatch[..., d].ravel(), 256) for d in range(DEPTH)], 1).astype(np.float32)
                grads = {"vectors": dv, "kernel": np.einsum("bf,bfk->kf", dh, patch) * mask, "bias": dh.sum(0), "weights": hidden.T @ dz, "offset": dz.sum(0)}
                step += 1
                pace = rate * (1 - 0.8 * epoch / epochs)
                for k, g in grads.items():
                    m, v = slots[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    getattr(self, k)[...] -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def cut_windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each row, padded; the rows they belong to; their bytes."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    nth = ragged(np.zeros(len(n), np.int64), n)
    start = offsets[:-1][row] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[1:][row] - start)
    out = np.full((len(row), WINDOW), 32, np.uint8)
    at = np.arange(WINDOW) < length[:, None]
    out[at] = _LOWER[buf[ragged(start, length)]]
    return out, row, length


def has_letter(texts: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_ = np.concatenate([[0], np.cumsum(_ASCII_LETTER[_LOWER[buf]])])
    found = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return found


def predict_texts(net: ByteConvNet | None, texts: pa.Array, over_chance: float = 0.0) -> tuple[list[str], np.ndarray]:
    buf, off = text_buffer(texts)
    found = has_letter(texts, buf, off)
    if net is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total = np.zeros((len(texts), len(net.languages)))
    # a long text's windows are taken a block at a time
    sizes = np.diff(off)
    for i in range(len(texts)):
        if sizes[i] > 1 << 22:
            for at in range(int(off[i]), int(off[i + 1]), 1 << 22):
                stop = min(at + (1 << 22), int(off[i + 1]))
                w, _, n = cut_windows(buf[at:stop], np.array([0, stop - at]))
                total[i] += (net.predict(w) * n[:, None]).sum(0)
    short = np.where(sizes > 1 << 22, 0, sizes)
    w, row, n = cut_windows(buf[ragged(off[:-1], short)], np.concatenate([[0], np.cumsum(short)]))
    p = net.predict(w) * n[:, None]
    for k in range(p.shape[1]):
        total[:, k] += np.bincount(row, p[:, k], len(texts))
    share = total / np.maximum(sizes, 1)[:, None]
    best = share.argmax(1)
    score = np.where(found, np.clip(share.max(1), 0, 1), 0.0)
    known = found & (score * len(net.languages) >= over_chance)
    return [net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = 1500, windows_per_row: int = 4, epochs: int = 6, seed: int = 7) -> ByteConvNet | None:
    """Train on at most sample_rows of the rows, drawn evenly from the languages (the most frequent ones, should there be more
    languages than that)."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(sample_rows).collect()
    if not counts:
        return None
    many = F.create_map(*[F.lit(x) for r in counts for x in (r[0], float(r[1]))])
    h = row_hash(id_col, text_col)
    chance = (F.pmod(h, F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    drawn = rows.select(h.alias("h"), (-F.log(chance) * many[F.col(lang_col)]).alias("turn")).where("turn is not null").orderBy("turn", "h").limit(sample_rows)
    chosen = [r.h for r in drawn.collect()]
    raw = F.encode(F.col(text_col), "UTF-8")
    start = [F.pmod(F.xxhash64(F.lit(k), h), F.greatest(F.lit(1), F.octet_length(text_col) - WINDOW + 1)).cast("int") + 1 for k in range(windows_per_row)]
    got = rows.where(h.isin(chosen)).select(F.col(lang_col).alias("lang"), h.alias("h"), F.array(*[F.substring(raw, s, F.lit(WINDOW)) for s in start]).alias("w")).dropDuplicates(["h"]).collect()
    got.sort(key=lambda r: r.h)
    languages = sorted({r.lang for r in got})
    texts = [bytes(w) for r in got for w in dict.fromkeys(map(bytes, r.w))]
    labels = np.array([languages.index(r.lang) for r in got for _ in dict.fromkeys(map(bytes, r.w))])
    windows, _, _ = cut_windows(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    return ByteConvNet.fresh(languages, seed).train(windows, labels, epochs, 64, 0.01, seed)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", over_chance: float = 0.0, **how) -> DataFrame:
    """Every row of docs with its columns, held_out, lang_pred and score, which take the place of columns of docs by these
    names. labelled: the rows to learn from; by default those of docs that aren't held out. over_chance: texts whose score is below so many times that of an even distribution
    over the languages are unknown too."""
    if labelled is None:
        labelled = docs.where(~held_out(id_col))
    net = fit(labelled, id_col, text_col, lang_col, **how)
    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], held_out(id_col).alias("held_out"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few tens of KB, whatever the input

    def kernel(batches):
        for batch in slices(batches, text_col, 1 << 20):
            names, score = predict_texts(shared.value, batch.column(batch.schema.get_field_index(text_col)), over_chance)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return map_batches(rows, kernel, schema)
