"""Operators on single texts: token counts, language, fingerprints, licences, pieces."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from . import cases

SF = "/root/testdata/sf0.001"
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.corpus(), cases.SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def test_token_counts_match_greedy(spark, docs, empty):
    from helixframe.llm import token_counts as op

    pieces = {*op.load_vocabulary(VOCABULARY), (op.END,)}

    def greedy(word):
        w, i, n = (*word, op.END), 0, 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in pieces), None)
            if j is None:
                return 0
            n += w[i:j] != (op.END,)
            i = j
        return n

    got = sorted((r.doc_id or -1, r.n_words, r.n_tokens) for r in op.token_counts(docs, VOCABULARY).collect())
    want = []
    for r in docs.collect():
        ws = re.findall(rb"[a-zA-Z0-9\x80-\xff]+|[^\x00-\x20\x7f]", (r.text or "").lower().encode())
        want.append((r.doc_id or -1, len(ws), sum(greedy(w) or 1 for w in ws)))
    assert got == sorted(want)
    assert op.token_counts(empty, VOCABULARY).count() == 0


def test_automaton_with_continuation_pieces():
    from helixframe.llm.token_counts import Automaton

    spell = lambda *xs: [tuple(x.encode()) for x in xs]
    a = Automaton.build(spell("ab", "abc", "a"), spell("b", "cd", "c", "d"))
    words = [b"abcd", b"ab", b"abd", b"x", b"abx", b"acd"]
    buf = np.frombuffer(b"".join(words), np.uint8)
    stop = np.cumsum([len(w) for w in words])
    assert a.lengths(buf, stop - [len(w) for w in words], stop).tolist() == [2, 1, 2, 0, 0, 2]


def test_language_held_out(spark, docs, empty):
    from helixframe.llm import language_id as op

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op.identify(table)
    r = found.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.97 and 0 <= r.lo <= r.hi <= 1
    odd = {x.doc_id: x for x in op.identify(docs.where("doc_id is not null")).collect()}
    for x in odd.values():
        assert (x.lang_pred == op.UNKNOWN) == (not any(c.isalpha() for c in x.text or ""))
    assert op.identify(empty).count() == 0
    assert {x.lang_pred for x in op.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {op.UNKNOWN}


def test_language_ignores_held_out_rows(spark):
    from helixframe.llm import language_id as op

    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    poisoned = table.withColumn("lang", F.when(op.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a = op.identify(table).select("doc_id", "lang_pred", F.round("score", 5).alias("s"))
    b = op.identify(poisoned).select("doc_id", "lang_pred", F.round("score", 5).alias("s"))
    assert a.exceptAll(b).count() == 0


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, docs, empty):
    import hashlib

    from helixframe.llm import fingerprints as op

    got = op.edited_likeness(docs).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    want, errors = [], []
    for i, (some, k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][2]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        want.append((k if some else None, len(t), hashlib.sha256(e.encode()).hexdigest(), jaccard(shingle_set(t), shingle_set(e)), jaccard(shingle_set(t), shingle_set(nxt))))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    have = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key)
    for a, b in zip(sorted(want, key=key), have, strict=True):
        assert a[:3] == b[:3]
        errors += [abs(a[3] - b[3]), abs(a[4] - b[4])]
        assert all(0 <= x <= 1 for x in b[3:])
    assert max(errors) < 0.25 and np.mean(errors) < 0.05
    prints = {}
    for r in op.fingerprints(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).join(docs.select("doc_id", "text"), "doc_id").collect():
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    by_text = {}
    for r in docs.where("doc_id is not null and doc_id <> 7").collect():
        by_text.setdefault(r.text or "", set()).update(prints[r.doc_id])
    assert all(len(v) == 1 for v in by_text.values())
    assert op.edited_likeness(empty).count() == 0
    one = docs.where("doc_id = 11")
    assert op.edited_likeness(one).first().near_next == 1.0


def test_optimal_densification_matches_probing():
    from helixframe.llm import fingerprints as op

    # the closed form (j - b) / a mod BINS is the number of the probe that hits bin j
    for i in (0, 1, 100, 256):
        a, b, inverse = op._A[i], op._B[i], op._A_INVERSE[i]
        for t in (0, 1, 55):
            assert ((a * t + b) % op.BINS - b) * inverse % op.BINS == t


def test_licenses(spark, docs, empty):
    from helixframe.llm import license_scan as op
    from helixframe.llm.license_rules import BASE, rules

    table = rules()
    assert len(table) > 200 and all(any(s in k for s in op.stems()) for _, _, _, k, _ in table)
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files; GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version. SPDX-License-Identifier: MIT"
    extra = spark.createDataFrame([(900, text), (901, "mit license mit license MIT-LICENSE"), (902, "x" * 5000 + " apache license")], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(extra)

    def brute(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        n = " " + " ".join(w) + " "
        found = [(n[: m.start()].count(" ") - 1, n[: m.end()].count(" "), i, label, p, c) for i, (label, p, c, k, x) in enumerate(table) if k in n for m in re.finditer(f"(?<= )(?:{x})(?= )", n)]
        beats = lambda e, d: e[0] <= d[0] and d[1] <= e[1] and (e[4] > d[4] or e[4] == d[4] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[2] < d[2]))
        keep = [d for d in found if d[2] < len(BASE) or not any(beats(e, d) for e in found)]
        base = [i for _, p in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        return (len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({d[3] for d in keep if d[2] < len(BASE)})), ",".join(sorted({d[3] for d in keep})))

    texts = [brute(r.text) + (r.doc_id or -1,) for r in every.collect()]
    got = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.doc_id or -1) for r in op.summary(every).collect()]
    none = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(none, got)) == sorted(map(none, texts))
    assert all(0 <= r.score <= 1 for r in op.summary(every).collect())
    assert op.summary(empty).count() == 0


def test_pieces_match_the_model_and_round_trip(spark, docs, empty):
    import sentencepiece

    from helixframe.llm import merge_dropout as op

    ref = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = op.PieceModel.load(PIECES)
    texts = pa.array([r.text for r in docs.collect()] + ["  two  spaces ", "tab\tnew\n\n x", "x" * 300 + " " + "ab" * 100, " ", "\n", " lead", "a b"])
    plain, mixed = op.Coder(model, 0.0, 1, 4), op.Coder(model, 0.1, 1, 4)
    zero = np.zeros(len(texts), int)
    ids, off = plain.encode(texts, zero)
    for i, t in enumerate(texts.to_pylist()):
        own = ids[off[i] : off[i + 1]]
        assert plain.decode(own) == (t or "")
        if t and "▁" not in t:
            assert own.tolist() == ref.encode(t)
    many = [mixed.encode(texts, zero + v) for v in (0, 1, 1)]
    for ids, off in many:
        assert all(mixed.decode(ids[off[i] : off[i + 1]]) == (t or "") for i, t in enumerate(texts.to_pylist()))
    assert many[1][0].tolist() == many[2][0].tolist() and many[0][0].tolist() != many[1][0].tolist()
    out = op.digests(docs, PIECES).collect()
    assert len(out) == docs.count() and all(r.lossless for r in out)
    assert op.decode(op.encode(docs, PIECES), PIECES).exceptAll(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).count() == 0
    assert op.digests(empty, PIECES).count() == 0


def test_heap_and_arrays_agree(monkeypatch):
    from helixframe.llm import merge_dropout as op

    coder = op.Coder(op.PieceModel.load(PIECES), 0.2, 9, 4)
    texts = pa.array([r[1] for r in cases.corpus(5, 12)])
    v = np.arange(len(texts)) % 4
    a, _ = coder.encode(texts, v)
    monkeypatch.setattr(op, "SHORT", 0)
    b, _ = coder.encode(texts, v)
    assert a.tolist() == b.tolist()


def test_joins_are_found_in_any_table(monkeypatch):
    """Pairs are looked up by hash: every join of the model, and nothing for others, however many share a place; equal ranks go leftmost first."""
    from helixframe.llm import merge_dropout as op

    model = op.PieceModel(["▁", "a", "b", "aa", "ab", "aab", "ba"], [1] * 7, [0.0, 0.0, 0.0, -1.0, -1.0, -2.0, -3.0], True)
    want = {(1, 1): (1, 3), (1, 2): (1, 4), (1, 4): (2, 5), (3, 2): (2, 5), (2, 1): (3, 6)}
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(op.Coder, "slot", lambda self, key: np.zeros(key.shape, np.int64) + (1 << self.bits) - 2)
        coder = op.Coder(model, 0.0, 1)
        left, right = (x.astype(np.int32) for x in np.meshgrid(np.arange(-2, 7), np.arange(-2, 7), indexing="ij"))
        rank, joined = coder.join(left, right)
        assert {(int(a), int(b)): (int(r), int(j)) for a, b, r, j in zip(left.ravel(), right.ravel(), rank.ravel(), joined.ravel(), strict=True) if j >= 0} == want
        assert ((joined >= 0) == (rank < op._NONE)).all()
        ids, start, n = coder.together(np.array([[1, 1, 2, 1], [2, 1, 1, -2], [1, -2, -2, -2]]), np.array([4, 3, 1]), None)
        assert [(i[:k].tolist(), s[:k].tolist()) for i, s, k in zip(ids, start, n, strict=True)] == [([5, 1], [0, 3]), ([2, 3], [0, 1]), ([1], [0])]
        assert coder.decode(np.array([0, 5, 6])) == "aabba"


def test_every_occurrence_is_cut_anew(spark):
    from helixframe.llm import merge_dropout as op

    rows = spark.createDataFrame([(i, " segmentation" * 20) for i in range(40)], "doc_id bigint, text string")
    model = op.PieceModel.load(PIECES)
    seen, first = set(), set()
    for r in op.encode(rows, PIECES, rate=0.3).collect():
        words = " ".join(model.pieces[p] for p in r.pieces).split("▁")
        seen |= set(words)
        first.add(tuple(words))
    assert len(first) == 40 and len(seen) > 20


def test_rounds_of_the_mix_are_cut_differently(spark):
    import corpus_pipeline as pipe

    text = "the same words of one document are taken twice " * 5
    docs = spark.createDataFrame([(1, text, "en", "a", len(text))] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    one, two = [list(r.pieces) for r in pipe.pieces(spark, docs, "").collect()]
    assert one != two


def thue_morse(n: int) -> tuple[str, str]:
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse_stay_apart(spark):
    from helixframe.llm import merge_dropout, token_counts
    from helixframe.llm.vec import SpanHash, distinct_spans

    rows = [(i, t) for n in (512, 1024, 2048, 4096) for i, t in enumerate(thue_morse(n))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert all(r.lossless for r in merge_dropout.digests(docs, PIECES, rate=0.0).collect())
    one = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs.where("length(text) = 1024"), VOCABULARY).collect()}
    for i, t in enumerate(thue_morse(1024)):
        alone = token_counts.token_counts(spark.createDataFrame([(i, t)], "doc_id bigint, text string"), VOCABULARY)
        assert alone.first().n_tokens == one[i]
    buf = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    stop = np.cumsum([len(t) for _, t in rows])
    start = stop - [len(t) for _, t in rows]
    assert len(set(SpanHash(buf.astype(np.uint64) + np.uint64(1), narrow=True)(start, stop).tolist())) == len(rows)
    first, slot = distinct_spans(buf, np.concatenate([start, start]), np.concatenate([stop, stop]))
    assert sorted(first.tolist()) == list(range(8)) and slot[:8].tolist() == slot[8:].tolist()


def test_spans_of_one_hash_are_told_apart(monkeypatch):
    from helixframe.llm import vec

    monkeypatch.setattr(vec.SpanHash, "__call__", lambda self, start, stop: np.zeros(len(start), np.uint64))
    buf = np.frombuffer(b"aabbabaab", np.uint8)
    start, stop = np.array([0, 2, 4, 6, 0, 3, 8]), np.array([2, 4, 6, 8, 1, 4, 9])
    first, slot = vec.distinct_spans(buf, start, stop)
    content = [buf[a:b].tobytes() for a, b in zip(start, stop)]
    assert [content[first[s]] for s in slot] == content and len(first) == len(set(content))


def test_very_long_word(spark):
    from helixframe.llm import token_counts as op

    text = "qzxj" * 50_000
    long, short = op.token_counts(spark.createDataFrame([(1, text), (2, text[:400])], "doc_id bigint, text string"), VOCABULARY).orderBy("doc_id").collect()
    assert long.n_words == 1 and abs(long.n_tokens / short.n_tokens - 500) < 20


def test_licenses_of_many_matches(spark):
    """Thousands of detections: more than a block, nested, and in time that grows with them."""
    import time

    from helixframe.llm import license_scan as op

    text = lambda k: " ".join(["Licensed under the Apache License, Version 2.0 or the MIT License;"] * k)
    took = {}
    for k in (10, 500, 2000):
        start = time.time()
        r = op.summary(spark.createDataFrame([(k, text(k))], "doc_id bigint, text string")).first()
        took[k] = time.time() - start
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (12 * k, 2 * k, 3, 12 * k - 2, "apache,mit")
        # the base phrases and the longest wording of each place
        assert r.n_detections == 3 * k and r.labels == "apache,apache-2.0,mit"
    assert took[2000] - took[10] < 8 * max(took[500] - took[10], 2.0)


def test_very_long_texts_stay_whole(spark):
    """Texts above the slice size, against the same words in a short text."""
    from helixframe.llm import fingerprints, language_id, license_scan, merge_dropout

    long = "the quick brown fox jumps over the lazy dog " * 120_000 + "mit license"
    rows = spark.createDataFrame([(1, long), (2, "the quick brown fox jumps over the lazy dog " * 3), (3, None)], "doc_id bigint, text string")
    labelled = spark.createDataFrame([(i, t, g) for i in range(40) for t, g in (("the dog and the fox over there", "en"), ("der hund und der fuchs sind dort", "de"))], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(rows.withColumn("lang", F.lit("xx")), labelled).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "en" and got[3].lang_pred == language_id.UNKNOWN
    scanned = license_scan.summary(rows.where("doc_id = 1")).first()
    assert (scanned.n_words, scanned.first_word, scanned.labels) == (120_000 * 9 + 2, 120_000 * 9, "mit")
    assert merge_dropout.digests(rows.where("doc_id = 1"), PIECES).first().lossless
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(rows).collect()}
    assert prints[1] and prints[3] == ""
