"""Fill-in-middle: the batch kernel against plain string code, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tabulens.llm import infill

EDGES = [None, "", "\n", "\n\n\n", "a", "one\ntwo\n", "one\ntwo\nthree", "é\n漢字\n\U0001f600\r\n", "holds <P> here\nx", "<S>", "a<M>\n", "almost <P", "<\nP>", "P><S\n<", "x" * 50_000 + "\n" + "y\n" * 20_000, "\0\n\x85 \n"]


def brute(doc_id, text, fim_rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    texts = EDGES + ["".join(rnd.choice("ab\n<>PSMé漢") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, "k", "o", i) for i, t in enumerate(texts)] + [(3, texts[3], "k", "o", 3), (None, "no id\nhere\n", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, output string, n int")


@pytest.mark.parametrize("rates", [(100, 50), (40, 0), (0, 50)])
def test_against_strings(docs, rates):
    got = infill.restored(infill.fill_in_middle(docs, fim_rate=rates[0], spm_rate=rates[1])).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(got) == docs.count()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, texts[r.doc_id], *rates)
        assert r.restored == (texts[r.doc_id] or "")


def test_restoring_keeps_other_columns(docs):
    done = infill.fill_in_middle(docs).withColumn("row", F.lit(1)).withColumn("key", F.lit(2))
    got = infill.restored(done, name="text")
    assert got.columns == [*done.columns, "text"]
    assert {(r["row"], r["key"]) for r in got.collect()} == {(1, 2)}


def test_small_slices_and_offsets(docs, monkeypatch):
    """Rows of one batch are cut into slices, whose buffers start behind other rows' bytes."""
    import pyarrow as pa

    texts = [t or "" for t in EDGES]
    whole = pa.array(texts)
    for a, b in ((0, 5), (3, 9), (7, len(texts))):
        data, edges = infill.utf8(whole[a:b])
        assert [data[x:y].tobytes().decode() for x, y in zip(edges, edges[1:], strict=False)] == texts[a:b]
        assert infill.utf8(pa.array([None, "a"])[0:1])[1].tolist() == [0, 0]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restored(infill.fill_in_middle(none)).count() == 0
