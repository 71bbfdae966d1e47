"""Substring dedup: automata against plain sets of sequences, and whole results against brute force."""

import hashlib
import random

import pytest

from tabulens.llm import substrings


def brute(rows, window):
    """n_words, n_removed, kept of each row."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        for a in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[a : a + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for a in range(len(words) - window + 1):
            if i is not None and first[tuple(words[a : a + window])] < i:
                gone |= set(range(a, a + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def test_automaton_against_sets():
    rnd = random.Random(1)
    for _ in range(300):
        alphabet, window = rnd.choice(["ab", "abc", "abcdef"]), rnd.randint(1, 5)
        docs = sorted((rnd.randint(0, 6), [rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))]) for _ in range(rnd.randint(1, 5)))
        machine = substrings.SuffixAutomaton()
        for doc, words in docs:
            machine.insert(words, doc)
        assert len(machine.next) <= 2 * sum(len(w) for _, w in docs) + 1
        first = {}
        for doc, words in docs:
            for a in range(len(words) - window + 1):
                first.setdefault(tuple(words[a : a + window]), doc)
        asked, doc = [rnd.choice(alphabet + "z") for _ in range(40)], rnd.randint(0, 7)
        want = [a + window for a in range(len(asked) - window + 1) if first.get(tuple(asked[a : a + window]), doc) < doc]
        assert list(machine.covered(asked, doc, window)) == want


def test_windows_of_a_batch():
    rnd = random.Random(2)
    batch = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(30)] + ["", " \n", "a"]
    by_print, by_anchor = {}, {}
    for text, (n, anchors, prints) in zip(batch, substrings.windowed(batch, 6, 3), strict=True):
        words = text.split()
        assert n == len(words) and len(anchors) == len(prints) == max(0, n - 5)
        for a, (x, y) in enumerate(zip(anchors.tolist(), prints.tolist(), strict=True)):
            key = tuple(words[a : a + 6])
            assert by_print.setdefault(key, y) == y and by_anchor.setdefault(key, x) == x
    assert len(set(by_print.values())) == len(by_print)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé漢") for _ in range(3))
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(rnd.randint(0, 150))] for _ in range(25)]
    out = []
    for i in range(160):
        words = list(rnd.choice(base)) if rnd.random() < 0.5 else [word() for _ in range(rnd.randint(0, 80))]
        if rnd.random() < 0.5 and words:
            words[rnd.randrange(len(words))] = word()
        if rnd.random() < 0.6:
            at = rnd.randint(0, len(words))
            words[at:at] = passage[rnd.randint(0, 5) : rnd.randint(20, 40)]
        out.append((rnd.randint(0, 400), rnd.choice([" ", "\n", " \t\r\n", "\x0b"]).join(words)))
    edge = [None, "", " \n\t", "short", "rep " * 300, "rep " * 290, "nbsp\xa0word " * 30, "x\x1cy\x85z " * 40, "a b c d e f " * 2000]
    return out + [(500 + i, t) for i, t in enumerate(edge * 2)] + [(None, out[0][1]), (None, " ".join(passage))] + out[:3] + [(out[5][0], out[9][1])]


@pytest.mark.parametrize("window,gram,shard_words,query_words", [(12, 4, 1 << 17, 1 << 20), (12, 4, 60, 200), (5, 5, 25, 1000), (50, 16, 1 << 17, 1 << 20)])
def test_against_brute_force(spark, rows, window, gram, shard_words, query_words):
    df = spark.createDataFrame([(i, t, 1, "a", 2, 3) for i, t in rows], "doc_id long, text string, id int, words string, t1 int, start int").repartition(5)
    got = substrings.without_repeats(df, window=window, gram=gram, shard_words=shard_words, query_words=query_words)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    want = brute(rows, window)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    hashed = substrings.digests(df, window=window, gram=gram, shard_words=shard_words, query_words=query_words)
    assert sorted((tuple(r) for r in hashed.collect()), key=str) == sorted(((*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want), key=str)


def test_reference_holds_a_passage_once(spark):
    """A passage of many documents is in the reference once, so shards don't grow with its documents."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(12))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string").select("id", *substrings.text_marks("text"), "text")
    known = substrings.distinct_texts(docs, 50, 16)
    some = substrings.candidates(docs, known)
    windows = substrings.repeated_windows(some, 50, 16)
    assert windows.where("id = first").count() == 11
    assert windows.count() == 11 * 300


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.without_repeats(none).count() == 0 and substrings.digests(none).count() == 0
