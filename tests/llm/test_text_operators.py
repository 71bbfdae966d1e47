"""Quality rules, licences, toxicity, language, BPE, personal data, LM scores: edge cases and brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulens.llm import bpe, language, licences, lm, pii, quality, toxicity
from tabulens.llm.common import bounded_sample, cut

EDGES = [None, "", "   \n\t", "a", "word " * 30_000, "x" * 5_000, "a b c a b c a b c", "ünï códe 漢字 \U0001f600\x1c\x85", "line one\nline two\nline one\n\n"]


@pytest.fixture(scope="module")
def edges(spark):
    """Edge texts, each twice, with a null id and columns whose names clash with the operators'."""
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "x") for i, t in enumerate(EDGES * 2)] + [(None, "null id", None, None, 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, key string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(5)
    parts = {"en": ["th", "er", "on", "an", "re", "he", "in"], "de": ["sch", "ein", "ung", "ich", "ver", "ge"], "es": ["ción", "ado", "mente", "as", "os"]}
    return [(i, lang, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(20, 120))) + ".") for i in range(150) for lang in [["en", "de", "es"][i % 3]]]


def test_quality_against_brute_force(spark, edges):
    def brute(t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        hit = set()
        for k in range(len(words) - 2):
            if wins[tuple(words[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    got = quality.score_quality(edges).collect()
    assert len(got) == 2 * len(EDGES) + 1
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(EDGES[r.doc_id % len(EDGES)])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)


def test_quality_bands_reject_both_ends(spark, prose):
    good = " ".join(t for _, lang, t in prose if lang == "en")
    rnd = random.Random(1)
    noise = " ".join("".join(chr(rnd.randint(0x21, 0x7E)) for _ in range(9)) for _ in range(2000))
    drone = " ".join(f"item {i % 7} of the long list again" for i in range(2000))
    df = spark.createDataFrame(list(enumerate([good, noise, drone])), "doc_id long, text string")
    assert [r.in_band for r in quality.score_quality(df).orderBy("doc_id").collect()] == [True, False, False]


def test_quality_bands_follow_the_corpus(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    common = [word() for _ in range(1500)]
    lines = [" ".join(rnd.choice(common) for _ in range(12)) for _ in range(3)]
    prose = [" ".join(rnd.choice(common) for _ in range(700)) for _ in range(60)]
    dull = [" ".join(x for _ in range(29) for x in (*rnd.choice(lines).split(), *(rnd.choice(common) for _ in range(12)))) for _ in range(3)]
    tail = [" ".join(rnd.choice(common) for _ in range(690)) + " " + " ".join(rnd.choice(lines) for _ in range(45)) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(prose + dull + tail)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score_quality(df).collect()}
    assert all(r.n_chunks == -(-r.n_bytes // quality.CHUNK_BYTES) for r in got.values())
    passing = [i for i in range(60, 66) if not got[i].base_failed]
    assert len(passing) >= 3 and not any(got[i].kept for i in passing)
    assert sum(got[i].kept for i in range(60)) >= 54


def test_bpe_is_exact(spark, edges):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    theirs, ours = Tokenizer.from_file(path), bpe.load(path)
    rnd = random.Random(2)
    samples = [t or "" for t in EDGES] + ["<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "it's  we'll\r\n\t 12345 ...  "]
    samples += ["".join(rnd.choice("aabcdehilnorst  '\n.0é漢") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    for t in samples:
        assert np.frombuffer(ours.encode(t), np.int32).tolist() == theirs.encode(t, add_special_tokens=False).ids, t
    for token in random.Random(3).sample(sorted(theirs.get_vocab()), 500):
        text = theirs.decode([theirs.token_to_id(token)])
        assert np.frombuffer(ours.encode(text), np.int32).tolist() == theirs.encode(text, add_special_tokens=False).ids
    done = bpe.encode_and_decode(edges, path).collect()
    for r in done:
        if r.doc_id is not None:
            assert r.decoded == (EDGES[r.doc_id % len(EDGES)] or "")
            assert list(r.ids) == theirs.encode(r.decoded, add_special_tokens=False).ids


def test_language_on_held_out_rows(spark, prose, edges, empty):
    df = spark.createDataFrame(prose, "doc_id long, lang string, text string")
    model = language.fit(df, F.col("doc_id") % 4 != 0)
    got = language.identify(df, model).where("doc_id % 4 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert not any(r.rejected for r in got)
    strange = {r.doc_id: r for r in language.identify(edges.select("doc_id", "text"), model).collect()}
    for i in (0, 1, 2):
        assert strange[i].lang_pred == "und" and strange[i].score == 0 and strange[i].rejected
    assert all(0 <= r.score <= 1 for r in strange.values())
    assert language.fit(empty) is None and language.identify(empty.select("doc_id", "text"), None).count() == 0


def test_language_rejection_is_calibrated(spark, prose):
    rnd = random.Random(2)
    noise = ["".join(rnd.choice("qxzjwkvy ") for _ in range(300)) for _ in range(20)]
    rows = [(i, t, lang) for i, lang, t in prose]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert not model.predict([t for _, _, t in prose])[3].any() and model.predict(noise)[3].all()
    lone = language.fit(spark.createDataFrame([(1, "the only text of all", "en")], "doc_id long, text string, lang string"))
    assert lone.predict(["the only text"])[0] == ["en"]


def test_samples_hold_different_rows(spark):
    same = [(i % 3, f"text {i % 3}", "a") for i in range(3000)] + [(None, f"null {i}", "b") for i in range(500)] + [(7, "copies", "c")] * 400
    df = spark.createDataFrame(same, "doc_id long, text string, lang string")
    for strata, want in (("lang", {"a": 3, "b": 40, "c": 1}), (None, None)):
        found = [tuple(r) for r in bounded_sample(df, strata, ["doc_id", "text"], 40).collect()]
        again = [tuple(r) for r in bounded_sample(df.repartition(7), strata, ["doc_id", "text"], 40).collect()]
        assert sorted(map(str, found)) == sorted(map(str, again)) and len(set(found)) == len(found)
        assert len(found) == 40 if want is None else collections.Counter(r[2] for r in found) == want


def test_kneser_ney_sums_to_one():
    grams, _ = language.Folding("abc").grams(["abc abca cab", "bca b c"])
    probs, weights, unseen = language.kneser_ney(grams)
    seen = {int(c): p for c, p in zip(*probs[0], strict=True)}
    assert sum(seen.values()) + unseen * ((1 << language.BITS) - len(seen)) == pytest.approx(1.0)


def crc(x):
    return zlib.crc32(str(x).encode())


def test_lm_base_is_exact_and_model_is_proper(spark, prose, edges, empty):
    rows = [(i, t) for i, _, t in prose] + [(1000 + i, t) for i, t in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_texts(df, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()}
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    counts = collections.Counter(w for i, ws in words.items() if crc(i) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        assert got[i].n_tokens == len(ws) and got[i].n_known == sum(counts[w] > 0 for w in ws) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert got[i].score < 0
    assert lm.score_texts(empty, F.lit(True)).count() == 0
    # Null and repeated ids, repeated rows, clashing columns: a row in, a row out, equal texts with equal scores.
    found = collections.defaultdict(set)
    rows = lm.score_texts(edges, F.col("score") == 1).collect()
    for r in rows:
        found[r.doc_id if r.doc_id is None else r.doc_id % len(EDGES)].add((r.n_tokens, r.score))
    assert len(rows) == 2 * len(EDGES) + 1 and all(len(x) == 1 for x in found.values())
    assert found[0] == found[1]  # a null text is the empty text


def test_lm_blocks_close_within_a_partition():
    batch = pa.RecordBatch.from_pydict({"key": list(range(50)), "text": ["abcdefghij" * 5] * 50, "train": [True] * 50})
    whole, parts = (list(lm.blocks(iter([batch.slice(k, 5) for k in range(0, 50, 5)]), size)) for size in (1 << 20, 600))
    assert len(whole) == 1 and len(parts) == 4
    keys = [k for b in parts for blob in b.column("blob").to_pylist() for x in lm.opened(blob) for k in x.column("key").to_pylist()]
    assert keys == list(range(50))


def test_lm_lists_merge_early_to_the_same_counts():
    rnd = np.random.default_rng(3)
    lists = [lm.distinct(rnd.integers(0, 400, 300).astype(np.uint64)) for _ in range(9)]
    blobs = [lm.packed(lm.steps(codes), counts) for codes, counts in lists]
    want = collections.Counter()
    for codes, counts in lists:
        want.update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    for rows in (1, 500, 1 << 22):
        codes, counts = lm.gathered(iter(blobs), rows)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == want and (np.diff(codes.astype(np.int64)) > 0).all()


def plain_context_tree(learned, scored):
    """log10 probabilities of the texts scored, by recursion over dictionaries."""
    grams = lambda t: [(t.encode().lower() + b"\xff", i) for i in range(len(t.encode()) + 1)]
    pad = b"\xff" * lm.DEPTH

    def split(data, i):
        return tuple((pad + data)[i : i + lm.DEPTH][::-1]), data[i]

    nodes = collections.defaultdict(lambda: [0, 0])
    for data, i in (g for t in learned for g in grams(t)):
        ctx, byte = split(data, i)
        for k in range(lm.DEPTH + 1):
            for j in range(8):
                nodes[ctx[:k], 1 << j | byte >> (8 - j)][byte >> (7 - j) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below = collections.defaultdict(list)
    for ctx, q in nodes:
        if ctx:
            below[ctx[:-1], q].append((ctx, q))
    known = {}

    def weighted(node):
        if node not in known:
            own = kt(*nodes[node])
            known[node] = own if len(node[0]) == lm.DEPTH else np.logaddexp(own, sum(map(weighted, below[node]))) - math.log(2)
        return known[node]

    def one(ctx, q, k=0):
        a, b = nodes.get((ctx[:k], q), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if k == lm.DEPTH or not sum(nodes.get((ctx[: k + 1], q), [0, 0])):
            return own
        stop = 1 / (1 + math.exp(sum(map(weighted, below[ctx[:k], q])) - kt(a, b)))
        return stop * own + (1 - stop) * one(ctx, q, k + 1)

    def bits(ctx, byte):
        return sum(math.log10(p if byte >> (7 - j) & 1 else 1 - p) for j in range(8) for p in [one(ctx, 1 << j | byte >> (8 - j))])

    return [sum(bits(*split(*g)) for g in grams(t)) for t in scored]


def test_context_tree_against_plain_recursion(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("abcaB \xe9") for _ in range(rnd.randint(0, 60)))) for i in range(40)] + [(40, "ab" * 200), (41, "ab" * 200), (42, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_context_tree([t or "" for i, t in rows if i % 10], [t or "" for _, t in rows])
    base = None
    # one shard; many shards and blocks; lists sent on by nodes of the exchange, over three levels
    for shard, block, rows_held, fan in ((lm.SHARD_BYTES, lm.BLOCK_BYTES, lm.MERGE_ROWS, lm.FAN), (100, 300, 50, 64), (100, 300, 50, 3)):
        found = lm.score_texts(df, F.col("doc_id") % 10 != 0, block_bytes=block, shard_bytes=shard, merge_rows=rows_held, fan=fan).collect()
        got = {r.doc_id: r.score for r in found}
        assert [got[i] for i, _ in rows] == pytest.approx(want, rel=1e-5)
        own = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found)
        assert own == (base := base or own)
    nothing = {r.doc_id: r.score for r in lm.score_texts(df, F.lit(False)).collect()}
    assert nothing[42] == pytest.approx(8 * math.log10(0.5), rel=2e-5)


def test_lm_lists_grow_with_blocks_not_with_blocks_times_shards(spark):
    assert [lm.Route(1, n, 4).levels for n in (1, 4, 5, 16, 17, 64, 65)] == [1, 1, 2, 2, 3, 3, 4]
    rnd = random.Random(8)
    text = lambda: "".join(rnd.choice("abcdefghij ") for _ in range(100))
    counts = []
    for n in (60, 240):
        df = spark.createDataFrame([(i, text(), True) for i in range(n)], "key long, text string, train boolean").repartition(n // 4)
        held = cut(df.mapInArrow(lambda batches: lm.blocks(batches, 400), "block string, blob binary"), "test-blocks")
        route = lm.Route(held.count(), n, 4)
        lists = [lm.gram_lists(held, route)]
        for level in range(1, route.levels):
            lists.append(lm.grams_sent_on(lists[-1], route, level, 1000))
        rows = [x.count() for x in lists]
        assert rows[0] <= 4 * route.blocks and all(r <= 4 * (route.blocks + n) for r in rows)
        # Every shard gets its own n-grams, and all of them.
        sent = lists[-1].collect()
        assert {r["shard"] for r in sent} <= set(range(n)) and max(collections.Counter(r["shard"] for r in sent).values()) <= 4
        grams = {c for r in sent for c in np.cumsum(lm.unpacked(r.blob, *lm.LIST)[0], dtype=np.uint64).tolist()}
        assert grams == {c for b in held.collect() for c in lm.distinct_grams(b.blob)[0].tolist()}
        counts.append(sum(rows) / n / route.levels)
    assert counts[1] <= 1.5 * counts[0]


@pytest.mark.parametrize("fan", [256, 2])
def test_lm_blocks_list_their_grams_once_for_both_visits(spark, fan):
    df = spark.createDataFrame([(i, f"some text {i} " * 5, i % 3 > 0) for i in range(40)], "key long, text string, train boolean")
    held = cut(df.mapInArrow(lambda batches: lm.blocks(batches, 400), "block string, blob binary"), "test-blocks")
    answers = lm.gram_values(held, lm.Route(held.count(), 4, fan))
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FlatMapCoGroupsInArrow" in plan  # the listing is behind us
    assert fan < 4 or plan.count("Exchange hashpartitioning(shard") == 1  # and so is the shuffle of lists; carried coefficients take the other
    assert {r.block for r in answers.collect()} == {r.block for r in held.collect()}


def test_context_tree_packs_what_it_sends():
    codes = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, np.uint64))
    assert (np.cumsum(lm.unpacked(lm.packed(lm.steps(codes), codes), np.uint64, np.uint64)[0], dtype=np.uint64) == codes).all()
    found, n = lm.symbols([b"abc", b""])
    assert n.tolist() == [4, 1] and [hex(c) for c in found.tolist()] == ["0xffffffffffffff61", "0x61ffffffffffff62", "0x6261ffffffffff63", "0x636261ffffffffff", "0xffffffffffffffff"]


def test_longer_contexts_are_learned(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):  # the byte after "-----" repeats the one six bytes back
        rows.append((i, "".join(f"{c}-----{c}" for c in (rnd.choice("abcdefgh\xe9") for _ in range(40)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_texts(df, F.col("doc_id") % 10 != 0).collect()}
    held = [i for i in got if i % 10 == 0]
    # 40 choices of 9 letters, log10(9) each, and little for all that follows from them
    assert sum(got[i].score for i in held) / len(held) > -1.25 * 40 * math.log10(9)
    size = len(rows[0][1].encode()) + 1
    assert got[0].bits_per_byte == pytest.approx(-got[0].score / math.log10(2) / size)


PII = ["mail a.b+c@x-y.example.com, a@b, x@y.com@z.org, 1.2.3.4 300.1.1.1 01.002.3.255.7", "card 4111 1111 1111 1111 and 4111-1111-1111-1112; +1 (555) 010-9999 +12 3", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ssn 123-45-6789', "@" * 50 + "a" * 5_000 + "@", "9" * 5_000, None]


def base_brute(t):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    double = lambda s: sum(int(c) if k % 2 == 0 else (int(c) * 2) // 10 + (int(c) * 2) % 10 for k, c in enumerate(reversed(s)))
    fits = {"email": lambda s: True, "ip": lambda s: all(int(p) < 256 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and double(digits(s)) % 10 == 0, "phone": lambda s: 9 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in pats.items() for m in re.finditer(p, t or "") if fits[k](m[0])]


def test_personal_data(spark, edges, empty):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for i, t in enumerate(PII):
        assert [tuple(s) for s in got[i].base_spans] == base_brute(t)
    assert {s.kind for s in got[2].all_spans} == {"secret", "ssn"}
    rnd = random.Random(6)
    for _ in range(300):
        t = "".join(rnd.choice("a1.@+-( )29x\n") for _ in range(60))
        assert sorted(pii.base_spans(t)) == sorted(base_brute(t))
    masked = {r.doc_id: r.text for r in pii.masked_documents(df.withColumn("extra", F.lit(1))).collect()}
    assert masked[2].startswith('token = "[secret]" ssn [ssn]') and masked[5] is None
    assert pii.find_personal_data(edges).count() == 2 * len(EDGES) + 1 and pii.find_personal_data(empty).count() == 0


def test_long_secrets_are_found_and_masked(spark):
    rnd = random.Random(10)
    secrets = ["".join(rnd.choice("ABCDEFGHabcdefgh0123456789_-") for _ in range(n)) for n in (64, 512, 513, 683, 5000)]
    df = spark.createDataFrame([(i, f'token = "{s}" end') for i, s in enumerate(secrets)], "doc_id long, text string")
    assert [pii.candidates(r.text) for r in df.orderBy("doc_id").collect()] == [[("secret", 9, 9 + len(s))] for s in secrets]
    assert {r.text for r in pii.masked_documents(df).collect()} == {'token = "[secret]" end'}


def test_many_spans_stay_linear_and_right(spark, monkeypatch):
    """Base spans, candidates and masks of long lists of contacts against plain scans of all pairs of spans; a text of 30 000 contacts takes seconds."""
    rnd = random.Random(12)
    pieces = ["ann@mail.example", "10.2.3.4", "+44 20 7946 0958", "4111 1111 1111 1111", "(555) 234-7890", "123-45-6789", "Dr Anna Berg", "key=abcdEFGH0123456789ijkl", "plain", "@", "+", "7"]
    rows = [(i, "".join(rnd.choice(pieces) + rnd.choice([" ", "", "\n", ", "]) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    monkeypatch.setattr(pii, "classifier", lambda rows: {(k, p) for k, p, _ in rows if k != "ssn"})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    masks = {r.doc_id: r.text for r in pii.masked_documents(df).collect()}
    for i, t in rows:
        want = [tuple(s) for s in got[i].base_spans]
        taken = [(a, b) for _, a, b in want]
        last = 0
        for kind, a, b in sorted(pii.candidates(t), key=lambda s: s[1]):
            if kind != "ssn" and a >= last and not any(a < y and x < b for x, y in taken):
                want.append((kind, a, b))
                last = b
        assert [tuple(s) for s in got[i].all_spans] == sorted(want, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        marks, at = {}, 0
        for a, b, kind in sorted((a, b, k) for k, a, b in want):
            if a >= at:
                marks[a] = kind
            at = max(at, b)
        inside = {k for _, a, b in want for k in range(a, b)}
        assert masks[i] == "".join(f"[{marks[k]}]" if k in marks else "" if k in inside else c for k, c in enumerate(t))
    long = spark.createDataFrame([(1, ", ".join(f"a{k}@mail.example (555) 234-{k % 10000:04d}" for k in range(30_000)))], "doc_id long, text string")
    start = time.monotonic()
    assert pii.masked_documents(long).first().text.count("[email]") == 30_000
    assert time.monotonic() - start < 60


def test_overlapping_spans_are_masked_whole(spark, monkeypatch):
    df = spark.createDataFrame([(1, "pay 4111 1111 1111 1111@mail.example.com now"), (2, "Dr Anna4abcdefghij1234567890 end")], "doc_id long, text string")
    monkeypatch.setattr(pii, "classifier", lambda rows: {(k, p) for k, p, _ in rows})
    got = {r.doc_id: r.all_spans for r in pii.find_personal_data(df).collect()}
    assert len(pii.candidates(df.where("doc_id = 2").first().text)) == 2 and len(got[2]) == 1
    assert pii.masked_documents(df).where("doc_id = 1").first().text == "pay [card] now"


def test_masking_takes_one_python_worker_a_task(spark, monkeypatch):
    """Two functions in one task would take two workers, which stay and then hold the tables of later stages twice."""
    monkeypatch.setattr(pii, "classifier", lambda rows: {(k, p) for k, p, _ in rows})
    df = spark.createDataFrame([(1, "key=abcdEFGH0123456789ijkl to ann@mail.example"), (2, None)], "doc_id long, text string")
    masks = pii.masked_documents(df)
    assert masks._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: r.text for r in masks.collect()} == {1: "[secret] to [email]", 2: None}


def test_accepted_patterns_do_not_depend_on_the_size_of_the_corpus():
    rnd = random.Random(9)
    for _ in range(20):
        own = {"".join(rnd.choice("-0+") for _ in range(4)) + f"{rnd.randint(0, 9)}{rnd.randint(0, 3)}{rnd.randint(0, 9)}": int(10 ** rnd.uniform(4, 6)) for _ in range(12)}
        sets = [pii.classifier([("secret", p, n * times) for p, n in own.items()]) for times in (1, 300)]
        assert sets[0] == sets[1]


def test_toxicity_learns_and_reads_clauses(spark, edges, empty):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an"]) for _ in range(3))
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [word() for _ in range(60)] + (["zorg" + word() for _ in range(4)] if toxic and i % 8 else ["you", "idiot"] if toxic else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(400) if i % 5 == 0]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.95
    plain = model.scores(["you are an idiot", "he said that you are an idiot", "", "the sky is blue"])
    assert plain[0] > plain[3] == plain[2]
    assert toxicity.score_toxicity(edges, model).count() == 2 * len(EDGES) + 1
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_licences(spark, prose, edges, empty):
    notes = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "the driver must hold a valid license to drive"]
    df = spark.createDataFrame([(i, t) for i, _, t in prose] + [(1000 + i, prose[i][2] + "\n" + n) for i, n in enumerate(notes)], "doc_id long, text string")
    scanner = licences.fit(df)
    got = {r.doc_id: [h.family for h in r.found] for r in licences.scan_licences(df, scanner).collect()}
    assert [got[1000 + i] for i in range(5)] == [["MIT"], ["Apache-2.0"], ["GPL"], ["CC-BY-NC"], []]
    assert not any(got[i] for i, _, _ in prose)
    assert licences.scan_licences(edges, scanner).count() == 2 * len(EDGES) + 1
    assert licences.scan_licences(empty, licences.fit(empty)).count() == 0


def test_wrapped_licences():
    import textwrap

    scanner = licences.Scanner(["the road to the river was long and the people of the town went home early"] * 5)
    cue = re.compile("|".join(sorted({c[:3] for c in scanner.cues}))).search
    texts = {
        "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    }
    for family, text in texts.items():
        for width in (40, 72, 80):
            lines = ["The road was long.", "", *textwrap.wrap(text, width), "", "The town slept."]
            found = scanner.notices(lines, cue)
            assert [x[2] for x in found if x[2] != "unknown"] == [family], (family, width, found)
    both = scanner.notices([*textwrap.wrap(texts["ISC"], 72), "Released under the MIT License."], cue)
    assert {"ISC", "MIT"} <= {x[2] for x in both}


def test_digest_matches_its_definition(spark):
    df = spark.createDataFrame([([("email", 3, 10), ("ip", 11, 18)],), ([],)], "s array<struct<kind:string,start:int,end:int>>")
    got = [r[0] for r in df.select(F.sha2(pii.digest("s"), 256)).collect()]
    assert got == [hashlib.sha256(b"email:3:10,ip:11:18").hexdigest(), hashlib.sha256(b"").hexdigest()]


def test_bpe_decodes_bounded_slices(monkeypatch):
    """A worker's memory doesn't follow the batch: slices of a megabyte, and a bounded memory of pairs."""
    import pyarrow as pa

    from tabulens.llm import bpe
    from tabulens.llm.common import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 100_000] * 8)], ["text"])
    assert [p.num_rows for p in slices([batch], "text", bpe.DECODED_BYTES)] and max(p.num_rows for p in slices([batch], "text", bpe.DECODED_BYTES)) <= 3
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 10)
    coder = bpe.BacktrackingBPE(bpe.default_path())
    plain = bpe.load(bpe.default_path())
    assert coder.encode("unrememberable differentiation of pairs") == plain.encode("unrememberable differentiation of pairs") and len(coder.compatible) <= 10
