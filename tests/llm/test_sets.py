"""Operators on sets of rows: dedup, mixing, similarity joins, and the pipeline, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import cases
from .test_texts import jaccard, shingle_set


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.corpus(), cases.SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def long_corpus(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages, rows = [text(600), text(450), text(401)], []
    for i in range(40):
        p = r.choice(passages)
        q = p[r.randrange(60) : len(p) - r.randrange(60)]
        if r.random() < 0.3:
            k = r.randrange(len(q))
            q = q[:k] + "Z" + q[k + 1 :]
        rows.append((i, text(r.randrange(300)) + q + text(r.randrange(300))))
    rows += [(100, ""), (101, None), (102, "ab" * 900), (103, "abc " * 300), (104, "xab" * 500 + "ab" * 300), (None, passages[0]), (105, "q" * 399), (106, "q" * 399), (107, "q" * 400), (108, passages[0]), (108, passages[0] + "tail"), (109, "y" * 900 + text(50)), (110, text(700)), (110, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def repeated_bytes(raw, length, how):
    """raw: (id, bytes, text hash). Which bytes of each a repeated string covers, by brute force."""
    found = collections.defaultdict(list)
    for k, x, h in raw:
        for i in range(len(x) - length + 1):
            found[x[i : i + length]].append((k is not None, k or 0, h, i))
    out = []
    for k, x, h in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            all_ = found[x[i : i + length]]
            if {"any": len(all_) > 1, "other": len({a[:2] for a in all_}) > 1, "later": min(all_) < (k is not None, k or 0, h, i)}[how]:
                gone[i : i + length] = True
        out.append(gone)
    return out


def suffix_rows(table):
    return [(r.doc_id, (r.text or "").encode(), r.h) for r in table.withColumn("h", F.xxhash64("text")).collect()]


def test_suffix_dedup(spark):
    from helixframe.llm import suffix_dedup as op

    table = long_corpus(spark)
    raw, want = suffix_rows(table), []
    for (k, x, _), gone, passage in zip(raw, repeated_bytes(raw, 400, "any"), repeated_bytes(raw, 200, "other"), strict=True):
        want.append((-1 if k is None else k, len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest(), int(passage.sum())))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage) for r in op.dedup(table, ((400, op.ANY), (200, op.OTHER))).collect()]
    assert sorted(got) == sorted(want)
    # whole runs only, so never more than the strings themselves cover, and most of every long passage
    shown = {r.doc_id: r.n_passage for r in op.dedup(table).where("doc_id < 40").collect()}
    every = {k: int(g.sum()) for (k, _, _), g in zip(raw, repeated_bytes(raw, op.SHOWN, "other"), strict=True) if k is not None and k < 40}
    assert all(0 < shown[k] <= every[k] for k in shown) and sum(shown.values()) > 0.6 * sum(every.values())


def test_suffix_dedup_leaves_the_first(spark):
    from helixframe.llm import suffix_dedup as op

    table = long_corpus(spark).withColumns({"n_chars": F.length("text"), "row": F.lit("x"), "key": F.lit(1)})
    raw = suffix_rows(table)
    want = [(-1 if k is None else k, np.frombuffer(x, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")) for (k, x, _), gone in zip(raw, repeated_bytes(raw, 200, "later"), strict=True)]
    out = op.dedup_texts(table)
    rows = out.collect()
    assert out.columns == table.columns and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in rows) == sorted(want)


def test_suffix_order(spark):
    from helixframe.llm import suffix_dedup as op

    rng = np.random.default_rng(1)
    width, depth = 31, 16
    rows = [(int(i % 2), i, rng.integers(1, 3, width).tolist()) for i in range(60)]
    rows += [(0, 100 + i, [1] * width) for i in range(20)] + [(0, 200 + i, [1] * 14 + [2] + [1] * i + [3] * (16 - i)) for i in range(16)]
    need = list(range(16))
    strings = spark.createDataFrame(rows, "core bigint, u bigint, s array<bigint>")
    got = {r.u: r.r for r in op.order(strings, width, need, depth).collect()}
    for x in need:
        for core in (0, 1):
            mine = sorted((got[u][x], s[x : x + depth], u) for c, u, s in rows if c == core)
            assert [m[1] for m in mine] == sorted(m[1] for m in mine)
            for a, b in zip(mine[:-1], mine[1:], strict=True):
                assert a[0] != b[0] or a[1] == b[1]


def test_group_over_many_tasks(spark):
    """One class of strings that fills several tasks, beside others."""
    from helixframe.llm import suffix_dedup as op

    r = random.Random(2)
    line = "".join(r.choice("abcdefgh ") for _ in range(420))
    rows = [(i, f"{i:05d}" + "".join(r.choice("xyz") for _ in range(25)) + line + f"{i * 7919 % 99991:05d}" + "".join(r.choice("uvw") for _ in range(30))) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    raw = suffix_rows(table)
    want = {k: int(g.sum()) for (k, _, _), g in zip(raw, repeated_bytes(raw, 400, "any"), strict=True)}
    assert {r.doc_id: r.n_removed for r in op.dedup(table).collect()} == want


def test_suffix_dedup_tells_confusable_strings_apart(spark):
    from helixframe.llm import suffix_dedup as op

    from .test_texts import thue_morse

    one, two = thue_morse(2048)
    table = spark.createDataFrame([(1, one), (2, two.replace("a", "c"))], "doc_id bigint, text string")
    raw = suffix_rows(table)
    assert sorted((r.doc_id, r.n_removed) for r in op.dedup(table).collect()) == [(k, int(g.sum())) for (k, _, _), g in zip(raw, repeated_bytes(raw, 400, "any"), strict=True)]


def test_pieces_have_names_of_their_own():
    """Where a gram comes again after a multiple of COARSE bytes, pieces of two of its places begin at one byte."""
    import random

    import pyarrow as pa

    from helixframe.llm import suffix_dedup as op

    r = random.Random(5)
    block = "".join(r.choice("abcdefgh") for _ in range(op.COARSE))
    s = op.Strings(pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([block * 9, block * 5 + "x" * 700]), pa.array([3, 4])], names=["doc_id", "text", "row"]), 400)
    p = s.coarse(np.ones(len(s.lo), bool))
    assert len(set(zip(p["run"].tolist(), p["at"].tolist(), strict=True))) < len(p["at"]) == len(set(p["name"].tolist()))


def test_suffix_dedup_where_sieves_let_everything_through(spark, monkeypatch):
    """As over many keys: short strings that only show passages have no pieces, though their names pass."""
    from helixframe.llm import suffix_dedup as op

    table = long_corpus(spark).where("doc_id < 12")
    want = sorted(op.dedup(table).collect())
    full = np.full(1 << 20, ~np.uint64(0))
    monkeypatch.setattr(op, "sieve", lambda *_: spark.sparkContext.broadcast(full))
    assert sorted(op.dedup(table).collect()) == want


def test_repeated_keys_travel_in_bytes(spark, monkeypatch):
    """The sketch holds exactly the keys of which there is more than one, by places or by whole runs, over all tasks."""
    import pyarrow as pa

    from helixframe.llm import suffix_dedup as op
    from helixframe.llm.sieve import passes

    monkeypatch.setattr(op, "HELD", 64)
    texts = [t for _, t, *_ in cases.corpus()]
    wanted = ((200, op.ANY), (96, op.SHARED))
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())], names=["doc_id", "text", "row"])
    long = op.Strings(batch, 200)
    shown = op.Strings(batch, 96, long)
    keys, n = np.unique(np.concatenate([long.key[long.places()[1]], shown.wholes]), return_counts=True)
    bits = np.zeros(1 << op.SKETCH, bool)
    bits[(keys[n > 1] >> np.uint64(64 - op.SKETCH)).astype(np.int64)] = True
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, row bigint").repartition(5)
    got = op._repeated(rows, wanted).value
    assert 0 < bits.sum() < len(keys)
    assert (np.unpackbits(got.view(np.uint8), bitorder="little") == bits).all()
    assert passes(got, keys[n > 1]).all()
    assert not op._repeated(rows.limit(0), wanted).value.any()


def test_stored_tables_join_by_hash(spark):
    """Tables are written under the setting that lets Spark join by hash; the session's own is back afterwards."""
    from helixframe.llm import frames

    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before, seen = spark.conf.get(name), []
    rows = spark.range(20).select("id", (F.col("id") % 7).alias("k"))

    class Writer:
        def parquet(self, path):
            seen.append(spark.conf.get(name))
            rows.write.parquet(path)

    class Frame:
        sparkSession, schema, write = spark, rows.schema, Writer()

    assert frames.stored(Frame(), "joined").count() == 20
    assert seen == [frames.HASHED] and spark.conf.get(name) == before


def test_debruijn_dedup(spark, docs, empty):
    from helixframe.llm import debruijn_dedup as op

    extra = [(-5, "a b c d e f g h i j k l m n o p q"), (-4, "x a b c d e f g h i j k l m n o p q y"), (2000, "b c d e f g h i j k l m n zz b c d e f g h i j k l m n"), (2003, " ".join(["w"] * 60)), (2004, " ".join(["w"] * 30)), (2005, "v " * 12), (2006, "v " * 12)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in table.collect()]
    least = {}
    for k, w in rows:
        for i in range(len(w) - 12):
            if k is not None:
                least[tuple(w[i : i + 13])] = min(k, least.get(tuple(w[i : i + 13]), k))
    want = []
    for k, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if k is not None and least[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        want.append((-99 if k is None else k, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    got = [(-99 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op.dedup(table).collect()]
    assert sorted(got) == sorted(want)
    assert op.dedup(empty).count() == 0


def fill(sizes: dict, share=1.5):
    order = sorted((k for k in sizes if k is not None), key=lambda k: k) + ([None] if None in sizes else [])
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while len(full) < len(sizes):
        level = (total - sum(2 * sizes[k] for k in full)) / sum(w[k] for k in sizes if k not in full)
        more = {k for k in sizes if k not in full and level * w[k] > 2 * sizes[k]}
        if not more:
            return {k: 2 * sizes[k] if k in full else level * w[k] for k in sizes}
        full |= more
    return {k: 2.0 * v for k, v in sizes.items()}


def test_source_mix(spark, docs, empty):
    from helixframe.llm import source_mix as op

    out = op.taken(docs).collect()
    again = op.taken(docs)
    assert sorted(map(str, out)) == sorted(map(str, again.collect()))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    want = fill(dict(sizes))
    aims = {r.source: r for r in op.targets(docs.select("source", op.words_in(F.col("text")).alias("size"))).collect()}
    for k, v in want.items():
        assert aims[k].source_size == sizes[k] and abs(aims[k].target - v) < 1e-6 * max(1, v)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    assert sorted(r.size for r in out) == sorted(words(r.text) for r in docs.collect())
    by = collections.Counter()
    for r in out:
        by[r.source_size] += r.taken
    for k, v in want.items():
        assert abs(by[sizes[k]] - v) <= max(5, 0.02 * v)
    assert op.taken(empty).count() == 0
    mixed = op.mixed_texts(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    kept = op.taken(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert mixed.columns == docs.columns and mixed.select(F.sum(op.words_in(F.col("text")))).first()[0] == kept.agg(F.sum("taken")).first()[0]


def test_pivot_index(spark):
    from helixframe.llm import pivot_index as op

    rng = np.random.default_rng(0)
    rows, unit = [], lambda v: v / np.linalg.norm(v)
    for i in range(150):
        base = unit(rng.standard_normal(16))
        rows.append((len(rows), base.astype(np.float32).tolist(), i % 3))
        for _ in range(rng.integers(0, 4)):
            c = rng.uniform(0.9, 0.99)
            z = rng.standard_normal(16)
            z = unit(z - z @ base * base)
            rows.append((len(rows), (c * base + (1 - c * c) ** 0.5 * z).astype(np.float32).tolist(), i % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(5)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, rows[0][1], None), (n + 4, rows[0][1][:8], 0), (n + 5, [], 0), (n + 6, [*rows[0][1][:15], None], 0), (n + 7, [float("inf")] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    out = {r.vec_id: r for r in op.near_duplicates(table.withColumn("first", F.lit(1)), block=32).collect()}
    assert len(out) == len(rows)
    links = {i: set() for i in range(len(rows))}
    x = np.array([r[1] for r in rows[:n]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    for i in range(n):
        links[i] = {j for j in range(n) if j != i and near[i, j] and rows[i][2] == rows[j][2]}
    total, found = sum(map(len, links.values())), sum(r.n_links for r in out.values())
    assert found >= 0.9 * total and all(out[i].n_links <= len(links[i]) for i in links)
    assert found == total  # at this size nothing is missed
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert out[i].component_id == min(seen) and out[i].kept == (min(seen) == i)
    assert op.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.33, 0.5, 1.0])
def test_pivot_index_dense_group(spark, share):
    from helixframe.llm import pivot_index as op

    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    n, hot, dim = 1200, int(1200 * share), 64
    centre = unit(rng.standard_normal((1, dim)))
    off = rng.standard_normal((hot, dim))
    shell = 0.955**0.5 * centre + 0.045**0.5 * unit(off - (off @ centre.T) * centre)
    x = np.vstack([shell, unit(rng.standard_normal((n - hot, dim)))]) if hot < n else shell
    total = int((x @ x.T >= 0.93).sum()) - n
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    found = op.near_duplicates(table).agg(F.sum("n_links")).first()[0]
    assert 0.99 * total <= found <= total


def test_pivot_index_lengths_and_few_rows(spark):
    from helixframe.llm import pivot_index as op

    rng = np.random.default_rng(6)
    rows, want = [], {}
    for width, n in ((16, 40), (9, 20), (5, 1)):
        for base in rng.standard_normal((n, width)):
            for k in range(2):
                want[len(rows)] = len(rows) - k
                rows.append((len(rows), (base + 0.01 * k * rng.standard_normal(width)).tolist(), 0))
    for some in (rows, rows[:2]):
        out = op.near_duplicates(spark.createDataFrame(some, "vec_id bigint, embedding array<double>, label int")).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {r[0]: (1, want[r[0]]) for r in some}


def test_jaccard_forest(spark, docs, empty):
    from helixframe.llm import jaccard_forest as op

    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = {r.doc_id: r for r in op.near_duplicates(table, block=3).collect()}
    sets = {r.doc_id: shingle_set(r.text) for r in table.collect()}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8} for i in sets}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (len(links[i]), min(seen), min(seen) == i)
    assert op.near_duplicates(docs).count() == docs.count()
    assert op.near_duplicates(empty).count() == 0


def test_prefixes_are_shortened_until_the_recall_is_reached(spark):
    """Pairs well above the threshold need no shortening; pairs right at it do. Recall is held against all pairs."""
    from helixframe.llm import jaccard_forest as op

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))

    def pairs(changed, n=150, size=204):
        rows = []
        for i in range(n):
            one = [word() for _ in range(size)]
            two = list(one)
            for k in range(changed):
                two[10 + k * 8] = word()
            rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
        return spark.createDataFrame(rows, "doc_id bigint, text string")

    depths = {}
    for changed in (1, 4):
        table = pairs(changed)
        keys = op.signatures(table, "doc_id", "text").select(F.col("doc_id").alias("first"), "trees")
        _, depths[changed] = op.candidates(keys, 0.8, 0.9995, 512)
        sets = {x.doc_id: shingle_set(x.text) for x in table.collect()}
        want = {i for i in sets if i % 2 == 0 and jaccard(sets[i], sets[i + 1]) >= 0.8}
        found = {x.doc_id for x in op.near_duplicates(table).where("n_links > 0 and doc_id % 2 = 0").collect()}
        assert found <= want and len(found) >= 0.999 * len(want)
    assert depths[1][-1][0] > depths[4][-1][0]
    assert all(b >= 0.9995 for *_, (_, b) in depths.values())
    assert all(a[0] == b[0] + 1 for d in depths.values() for a, b in zip(d[:-1], d[1:], strict=True))


def test_jaccard_recall_on_documents(spark):
    from helixframe.llm import jaccard_forest as op

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {x.doc_id: shingle_set(x.text) for x in table.collect()}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    near = {tuple(sorted((i, j))) for ids in holders.values() if len(ids) > 1 for i in ids for j in ids if i < j}
    links = collections.Counter()
    for i, j in near:
        if jaccard(sets[i], sets[j]) >= 0.8:
            links[i] += 1
            links[j] += 1
    got = {x.doc_id: x.n_links for x in op.near_duplicates(table).collect()}
    assert all(got[i] <= links[i] for i in got) and sum(got.values()) >= 0.999 * sum(links.values())


def test_hubs_are_joined_apart(spark, monkeypatch):
    from helixframe.llm import components as op

    monkeypatch.setattr(op, "HUBS", 4)
    edges = [(0, i) for i in range(1, 80)] + [(100 + i, 200) for i in range(50)] + [(300, 301)]
    got = {x.node: x.component for x in op.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(80)} | {100 + i: 100 for i in range(50)} | {200: 100, 300: 300, 301: 300}


def test_components(spark):
    from helixframe.llm.components import components

    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_pipeline_on_small_corpus(spark, docs):
    import corpus_pipeline as pipe

    now = docs
    for name, stage in pipe.STAGES:
        now = stage(spark, now, "").cache()
        if name != pipe.STAGES[-1][0]:
            assert now.columns == pipe.COLUMNS
        assert now.count() > 0
    assert {"doc_id", "pieces", "n_pieces"} == set(now.columns)
    assert now.where("doc_id is null and n_pieces = 0").count() == 0


def test_pipeline_stages_against_brute_force(spark, docs):
    import corpus_pipeline as pipe

    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select(*pipe.COLUMNS)
    kept = {r.doc_id: r.text for r in pipe.language(spark, table, "").collect()}
    assert all(any(c.isalpha() for c in t or "") for t in kept.values())
    near = {r.doc_id for r in pipe.near_duplicates(spark, table, "").collect()}
    sets = {r.doc_id: shingle_set(r.text) for r in table.collect()}
    assert all(jaccard(sets[i], sets[j]) < 0.8 for i in near for j in near if i < j and sets[i] and sets[j])
    assert all(i in near or any(sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8 for j in sets if j < i) for i in sets)
    passages = table.unionByName(long_corpus(spark).where("doc_id < 100").select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("a").alias("source"), F.length("text").cast("bigint").alias("n_chars")))
    raw = suffix_rows(passages)
    want = {k: np.frombuffer(x, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for (k, x, _), gone in zip(raw, repeated_bytes(raw, 200, "later"), strict=True)}
    assert {r.doc_id: r.text or "" for r in pipe.substrings(spark, passages, "").collect()} == want
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    mixed, had = collections.Counter(), {r.doc_id: words(r.text) for r in table.collect()}
    for r in pipe.mixing(spark, table, "").collect():
        assert words(r.text) and words(r.text) == had[r.doc_id][: len(words(r.text))] or set(words(r.text)) <= set(had[r.doc_id])
        mixed[r.source] += len(words(r.text))
    sizes = collections.Counter()
    for r in table.collect():
        sizes[r.source] += len(had[r.doc_id])
    assert all(abs(mixed[k] - v) <= max(5, 0.02 * v) for k, v in fill(dict(sizes)).items())


def test_kernels_return_what_they_freed():
    """Workers that wait for a task count towards an executor's memory: after a kernel's end little of what it took is left."""
    from helixframe.llm import frames

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    pins = []

    def kernel(batches):
        for batch in batches:
            held = []
            for _ in range(4000):
                held.append(np.ones(1 << 13))
                # what is left in between keeps the heap from shrinking by itself
                pins.append(np.ones(1 << 8))
            yield batch + len(held)

    before = resident()
    assert list(frames.lean(kernel)(iter([1, 2]))) == [4001, 4002]
    assert resident() - before < 64


def test_powers_are_kept_and_no_more_than_needed(monkeypatch):
    """Hashes of a batch's bytes, words and shingles need tables of different lengths in turn; a worker keeps one."""
    from helixframe.llm import vec

    monkeypatch.setattr(vec, "_TABLES", [])
    table = vec.powers((1 << 20) + 1)
    assert vec.powers(1000) is table and vec.powers((1 << 20) + 1) is table
    assert sum(p.nbytes for pair in table for p in pair) < 20 << 20
    assert all(int(p[k]) * int(q[k]) % vec._PRIME == 1 for p, q in table for k in (0, 1, 65535, 65536, 1 << 20))
    assert len(vec.powers(vec.KEPT + 1)[0][0]) > vec.KEPT and vec.powers(5) is table


def test_kernels_on_groups_return_what_they_freed(spark, monkeypatch):
    from helixframe.llm import blocks, frames

    seen = []
    monkeypatch.setattr(frames, "lean", lambda kernel: seen.append(kernel) or kernel)
    table = spark.range(8).selectExpr("id % 2 as g", "id")
    kernel = lambda t: t.combine_chunks().to_batches()[0]
    assert blocks.run_groups(table, kernel, "g bigint, id bigint").count() == 8
    assert blocks.run_packs(table, "g", kernel, "g bigint, id bigint", 2).count() == 8
    assert len(seen) == 2


def test_executors_collect_their_memory_between_steps(spark):
    """Not only the driver: the heap of a large step stays with the executors for good otherwise."""
    from helixframe.llm import frames

    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = beans()
    frames.release(spark)
    # here the driver is the executor: its own collection, and that of a task at least
    assert beans() >= before + 2


def test_pipeline_on_nothing_and_on_clashing_columns(spark, docs):
    import corpus_pipeline as pipe

    for table in (docs.limit(0), docs.select(*pipe.COLUMNS).withColumns({c: F.lit("x") for c in ("held_out", "score", "lang_pred", "spans", "first", "key", "row")}).where("doc_id < 12")):
        n = table.count()
        for name, stage in pipe.STAGES:
            out = stage(spark, table, "")
            assert out.columns == (["doc_id", "pieces", "n_pieces"] if name == "pieces" else pipe.COLUMNS)
            assert out.count() <= 2 * n, name


def test_texts_that_stand_out_in_no_language(spark):
    from helixframe.llm import language_id as op

    labelled = spark.createDataFrame([(i, t, g) for i in range(40) for t, g in (("the dog and the fox over there", "en"), ("der hund und der fuchs sind dort", "de"))], "doc_id bigint, text string, lang string")
    rows = labelled.limit(4)
    assert {r.lang_pred for r in op.identify(rows, labelled, over_chance=1.2).collect()} <= {"en", "de"}
    assert {r.lang_pred for r in op.identify(rows, labelled, over_chance=2.1).collect()} == {op.UNKNOWN}
