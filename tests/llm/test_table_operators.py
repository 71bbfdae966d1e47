"""Mixing, Jaccard join, nearest neighbours, the pipeline: brute force on small tables, hot groups and edge cases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulens.llm import ann, bpe, common, jaccard, mixing
from tabulens.llm.common import SLICE_BYTES, cut


def text(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rnd.randint(0, 300)) for _ in range(n))


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    rnd = random.Random(1)
    sources = ["b", "a", None, "hot", "é"]
    rows = [(i, text(rnd, rnd.randint(0, 40)), "hot" if i % 2 else rnd.choice(sources)) for i in range(300)] + [(300, None, "a"), (301, "", "void"), (7, "same row", "a"), (7, "same row", "a"), (None, "no id", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    mixed = mixing.mix(df, block_words=8)
    got = mixing.taken(mixed).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
    want = targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    again = mixing.taken(mixing.mix(df.repartition(7), block_words=8)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_is_even(spark):
    rows = [(i, "w " * 50, f"s{i % 5}") for i in range(200)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=10)
    order = [r.sid for r in mixed.fragments.select("slot", "sid").distinct().orderBy("slot").collect()]
    share = collections.Counter(order)
    for k in range(100, len(order), 100):
        seen = collections.Counter(order[:k])
        assert all(abs(seen[s] - share[s] * k / len(order)) < 12 for s in share)


def test_mixed_documents(spark):
    rows = [(i, f"w{i} " * 30, f"s{i % 4}", 0) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = mixing.mixed_documents(df).collect()
    per = collections.Counter()
    for r in out:
        assert r.n_chars == len(r.text) and set(r.text.split()) == {f"w{r.doc_id}"}
        per[r.source] += len(r.text.split())
    want = targets({f"s{k}": 600 for k in range(4)})
    assert all(abs(per[s] - want[s]) <= 1 for s in want)
    empty = df.limit(0)
    assert mixing.mixed_documents(empty).count() == 0 and mixing.taken(mixing.mix(empty)).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [(key, len(s), least[find(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_rows():
    rnd = random.Random(3)
    rows = [(i, text(rnd, rnd.randint(1, 150))) for i in range(60)]
    passage = text(rnd, 60)
    rows += [(100 + i, passage + " " + text(rnd, rnd.randint(10, 60))) for i in range(60)]
    base = text(rnd, 120).split()
    for i in range(80):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randint(0, 9999)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, rows[5][1].upper()) for i in range(20)]
    return rows + [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "One  two"), (5, rows[5][1]), (None, rows[7][1]), (405, "漢 字 a b c d"), (406, "漢 字 a b c d")]


@pytest.mark.parametrize("buckets", [1 << 22, 64])
def test_jaccard_against_brute_force(spark, monkeypatch, buckets):
    monkeypatch.setattr(jaccard, "BUCKETS", buckets)
    monkeypatch.setattr(jaccard, "BLOCK", 16 * jaccard.BLOCK_LEAST)
    monkeypatch.setattr(jaccard, "TASK_PAIRS", 5)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(0))
    got = jaccard.jaccard_join(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows)))


def test_near_duplicates_leave_one_of_each(spark):
    rows = near_rows()
    rows += [(500, "five words stand here twice now")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    kept = [(r.doc_id, r.text) for r in jaccard.without_near_duplicates(df).collect()]
    found = brute_components(rows)
    want = {(c, n) for (_, n, c), (_, t) in zip(found, rows, strict=True) if n}
    assert len([k for k in kept if (k[1] or "").split()]) == len({c for c, _ in want})
    assert sum(1 for k in kept if not (k[1] or "").split()) == 3
    assert jaccard.without_near_duplicates(df.limit(0)).count() == 0


def test_shingles_are_those_of_the_words(monkeypatch):
    rnd = random.Random(3)
    blanks = [" ", "\n", "\t", "\v", "\f", "\r", "  ", " \r\n"]
    batch = ["", " \n ", "One", "a b c d", "A b C d e", "\u00c4b \u00e4b \u00a0 \u2003x", "x" * 500, "y " * 400, "z" * 300 + " " + "z" * 301]
    batch += ["".join(rnd.choice("abAB\u00e9") * rnd.randint(1, 3) + rnd.choice(blanks) for _ in range(rnd.randint(0, 60))) for _ in range(200)]

    def plain(t):
        words = t.encode().lower().split()
        k = min(jaccard.SHINGLE, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()

    whole = jaccard.shingle_sets(batch)
    monkeypatch.setattr(jaccard, "PIECE", 64)  # texts, and words longer than a piece, are cut in pieces
    monkeypatch.setattr(jaccard, "UP", jaccard.UP[:128])
    pieces, alone = jaccard.shingle_sets(batch), [jaccard.shingle_sets([t])[0] for t in batch]
    names = {}
    for t, *found in zip(batch, whole, pieces, alone, strict=True):
        assert all(f.tolist() == found[0].tolist() for f in found)
        assert len(found[0]) == len(plain(t)) and (np.diff(found[0].astype(object)) > 0).all()
        names |= {s: None for s in plain(t)}
    assert len(set(np.concatenate(whole).tolist())) == len(names)
    assert jaccard.shingle_sets([]) == []


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(400, 900), replace=False)) for _ in range(2))
        if rng.random() < 0.5:
            b = np.sort(np.concatenate([a[: int(len(a) * rng.uniform(0.7, 1))], pool[:5]]))
            b = np.unique(b)
        sa, sb = jaccard.signature(a), jaccard.signature(b)
        m = min(len(sa), len(sb))
        fold = lambda s, m=m: np.bitwise_or.reduce(s.reshape(-1, m), axis=0)
        if jaccard.similar(a, b):
            assert jaccard.may_link(fold(sa), len(a), fold(sb)[None], np.array([len(b)]))[0]


def vectors(n=1500, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, 16))
    x[n // 3 : n // 2] = x[0]
    return x


def test_nearest_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "TILE", 128)
    monkeypatch.setattr(ann, "PART_ROWS", 200)
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, None] + [0.0] * 14), (5080, [1.0, 2.0]), (None, [1.0] * 16), (5100, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, len(x), 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -np.round(s, 9)))[:20]
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(abs(score - float(x[q] @ x[v])) < 1e-9 for _, v, score in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hits / (20 * len(got)) >= 0.9


def test_nearest_neighbours_of_small_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    rnd = random.Random(8)
    docs = [(i, text(rnd, rnd.randint(30, 90)) + (" mail x@y.com" if i % 5 == 0 else ""), ["en", None][i % 9 == 0], f"s{i % 3}", 0) for i in range(90)]
    docs += [(200 + i, docs[i][1], "en", "s0", 0) for i in range(10)] + [(300, None, "en", "s1", 0), (301, "123 456", "en", "s1", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, "")
        assert sorted(out.columns) == sorted(df.columns), name
        df = cut(out, "test", lasting=True)
        if name == "language_id":
            assert df.where("doc_id >= 300").count() == 0 and df.where("doc_id < 90").count() == 90 and df.where("lang is null").count() == 0
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in df.collect()) == list(range(90))
        if name == "personal_data":
            assert df.where("text like '%@%'").count() == 0 and df.where("text like '%[email]%'").count() == 18
    last = cp.STAGES[-1][1](spark, df, "").collect()
    assert last and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    assert len({r.doc_id for r in last}) > 50
    nothing = spark.createDataFrame([], df.schema)
    for _, stage in cp.STAGES:
        nothing = cut(stage(spark, nothing, ""), "test", lasting=True)
        assert nothing.count() == 0


def test_search_keys_are_never_written_with_the_nodes(spark, monkeypatch):
    """Keys are a quarter of all shingles: they are shuffled once, by tile, and stand in no table; copies still are one node."""
    written = []
    monkeypatch.setattr(jaccard, "cut", lambda df, name, cut=jaccard.cut: (written.append((name, df.columns)), cut(df, name))[1])
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "other words stand alone here"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert written and not any("keys" in columns for _, columns in written)


def test_tables_of_bpe_leave_the_workers(spark):
    """Workers stay for the stages that follow; the vocabulary's tables must not stay in them."""
    df = spark.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"))
    assert bpe.encode_and_decode(df, bpe.default_path()).where(F.size("ids") == 3).count() == 40

    def held(batches):
        import gc

        rows = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"rows": [rows], "tables": [sum(type(x).__name__ == "BacktrackingBPE" for x in gc.get_objects())]})

    found = df.mapInArrow(held, "rows long, tables long").collect()
    assert sum(r.rows for r in found) == 40 and sum(r.tables for r in found) == 0


def test_batches_of_texts_are_bounded(spark, monkeypatch):
    """A batch has SLICE_BYTES of rows at most, in op7 and in what the stages of the pipeline leave to be computed."""
    import corpus_pipeline as cp

    limit, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(jaccard, "cut", lambda df, name, cut=jaccard.cut: (seen.append(spark.conf.get(limit, None)), cut(df, name))[1])
    monkeypatch.setattr(cp, "_done_with", [])
    df = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 500).alias("text"), F.lit("en").alias("lang"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    try:
        spark.conf.unset(limit)
        assert jaccard.jaccard_join(df.limit(50)).where("component_id = 0").count() == 50
        assert seen and set(seen) == {str(SLICE_BYTES)} and spark.conf.get(limit, None) is None
        cp.STAGES[0][1](spark, df, "")
        found = df.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in found) == 4000 and max(r.bytes for r in found) <= 1.01 * SLICE_BYTES  # with the marks of nulls
        spark.conf.set(limit, 1 << 20)  # a user's limit stays
        with common.small_batches(spark):
            assert spark.conf.get(limit) == str(1 << 20)
        assert spark.conf.get(limit) == str(1 << 20)
    finally:
        spark.conf.unset(limit)


def test_keys_of_one_node_alone_are_not_grouped(spark, monkeypatch):
    """Tiles of one node, the most of them, go before rows are grouped by tile and node, also where copies repeat the node."""
    plans = []
    monkeypatch.setattr(jaccard, "cut", lambda df, name, cut=jaccard.cut: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), cut(df, name))[1])
    nodes = spark.createDataFrame([(1, 8, [1 << 40, 2 << 40, 3 << 40]), (1, 8, [1 << 40, 2 << 40, 3 << 40]), (2, 8, [2 << 40, 4 << 40, 4 << 40])], "id long, n long, keys array<long>")
    got = {(r.tile, r.id, r.m) for r in jaccard.tiled(nodes).collect()}
    assert got == {((2 << 40) >> 24, 1, 2), ((2 << 40) >> 24, 2, 2)}
    plan = dict(plans)["jaccard-members"]  # from the last step up to the first
    assert re.search(r"Aggregate \[tile.*Filter[^\n]*>= least.*Window", plan, re.S)
