"""Substring dedup (op12): spans of WINDOW or more words that a document of smaller id holds already are removed.

A document loses each word that lies in a window of WINDOW words which also starts in a document of smaller id. Suffix
automata of reference shards decide: documents stream through a shard's automaton, which gives the longest suffix of
what was read that the shard holds, and the first document that holds it. A shard has a bounded number of words, and
so has its automaton; each group of documents gets a copy of the automata it needs, not of all:

1. Texts that are equal count once, under their smallest id; the others are whole copies.
2. Every window has an anchor, the least hash of the GRAM-word sequences in it, so equal windows have equal anchors. An
   anchor is told off about every twentieth word. Only windows whose anchor occurs in different texts are looked at again.
3. The fingerprints of these windows give the first document of each one that is repeated. The passages which are first
   occurrences of repeated windows are the reference: every repeated passage is in it about once, however many
   documents have it. It is dealt to shards by first document, and documents go to the shards of their windows' first ones.
4. In each shard, cut into groups of about QUERY_WORDS words of documents, passages are inserted in the order of
   ids, so that each state knows its first document, and the documents stream through. Words are compared as such;
   fingerprints only propose.

Nothing grows with the number of documents that share a passage but the work on their own words. A reference passage
longer than a shard is worked on in overlapping pieces.

Defined results: a null text has no words; a document with a null id keeps all words and no other document is held
against it; rows with equal ids don't count as repetitions of each other, whatever their texts; repeated rows get equal
results; other columns are ignored, whatever their names; texts of any length are read whole. Texts are told apart by
128 bits of hashes, and two different repeated windows with the same 64-bit fingerprint could hide one of the two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import cut, remove, slices, table, texts, with_fields, written
from tabulens.llm.jaccard import mixed, powers, text_marks, word_hashes

#: Words of a window, and of the sequences of which the least hash is its anchor.
WINDOW, GRAM = 50, 16
#: Words of a reference shard, and of the passages that stream through one copy of its automaton.
SHARD_WORDS, QUERY_WORDS = 1 << 17, 1 << 20

STEP = 0xD6E8FEB86659FD93
SPACES = bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))


def sequences(h: np.ndarray, k: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The hash of each k values of h that follow each other."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: len(h) - k + 1]) if len(h) >= k else np.empty(0, np.uint64)


def sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k values of x that follow each other, by doubling."""
    size = 1
    while 2 * size <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (k - size)], x[k - size :])


def windowed(batch: list[str], window: int, gram: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per text: its number of words, and the anchor and the fingerprint of each window."""
    data = [t.encode().translate(SPACES) for t in batch]
    places, h = word_hashes(b"".join(part for d in data for part in (d, b" ")))
    edges = np.searchsorted(places, np.cumsum([0, *(len(d) + 1 for d in data)])).tolist()
    if len(h) < window:
        return [(b - a, np.empty(0, np.int64), np.empty(0, np.int64)) for a, b in zip(edges, edges[1:], strict=False)]
    up, down = powers(STEP, len(h)), powers(pow(STEP, -1, 1 << 64), len(h))
    anchors = sliding_least(sequences(h, gram, up, down), window - gram + 1).view(np.int64)
    prints = sequences(h, window, up, down).view(np.int64)
    cuts = [(b - a, a, max(a, b - window + 1)) for a, b in zip(edges, edges[1:], strict=False)]
    return [(n, anchors[a:b], prints[a:b]) for n, a, b in cuts]


def runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers in a sorted array."""
    edges = np.flatnonzero(np.diff(at) > 1)
    for a, b in zip([0, *(edges + 1).tolist()], [*edges.tolist(), len(at) - 1], strict=True):
        yield int(at[a]), int(at[b])


class SuffixAutomaton:
    """The suffix automaton of several word sequences, each of a document; sequences come in the order of ids."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [None]

    def insert(self, words: list, doc: int) -> None:
        nxt, link, size, first = self.next, self.link, self.size, self.first
        last = 0
        for w in words:
            p, q = last, nxt[last].get(w)
            if q is not None and size[q] == size[p] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                size.append(size[p] + 1)
                first.append(doc)
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                last = cur
                if p < 0:
                    continue
                q = nxt[p][w]
                if size[q] == size[p] + 1:
                    link[cur] = q
                    continue
            # q stands for longer sequences too: split off those up to size[p] + 1, whose first document is q's.
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            first.append(first[q])
            link[q] = clone
            if last != p and size[last] > size[p]:
                link[last] = clone
            else:
                last = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]

    def covered(self, words: list, doc: int, window: int) -> Iterator[int]:
        """Ends (exclusive) of the windows that a sequence of a smaller document holds, by matching statistics."""
        nxt, link, size, first = self.next, self.link, self.size, self.first
        state, length = 0, 0
        for end, w in enumerate(words, 1):
            while state and w not in nxt[state]:
                state = link[state]
                length = size[state]
            if w in nxt[state]:
                state = nxt[state][w]
                length += 1
            if length >= window:
                while size[link[state]] >= window:
                    state = link[state]
                length = min(length, size[state])
                if first[state] < doc:
                    yield end


def distinct_texts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Each text of `window` words or more: t1, t2, its smallest id, and the anchors of its windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = windowed(texts(part, "text"), window, gram)
            rows = pa.array([i for i, x in enumerate(found) if len(x[1])], pa.int64())
            anchors = [np.unique(x[1][np.concatenate([[True], x[1][1:] != x[1][:-1]])]) for x in found if len(x[1])]
            ends = np.cumsum([0, *map(len, anchors)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(anchors) if anchors else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in ("id", "t1", "t2")), lists], ["id", "t1", "t2", "anchors"])

    long = docs.where(F.col("id").isNotNull()).select("id", "t1", "t2", "text").mapInArrow(run, with_fields(docs.select("id", "t1", "t2"), "anchors array<long>"))
    return cut(long, "anchors").groupBy("t1", "t2").agg(F.min("id").alias("id"), F.first("anchors").alias("anchors"))


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The texts some of whose anchors occur in other texts too: id, t1, t2, text, anchors (those alone)."""
    spread = known.select("t1", "t2", "id", F.explode("anchors").alias("anchor"))
    shared = spread.groupBy("anchor").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).where("a <> b").select("anchor")
    held = spread.join(shared, "anchor").groupBy("id", "t1", "t2").agg(F.collect_list("anchor").alias("anchors"))
    return docs.select("id", "t1", "t2", "text").join(held, ["id", "t1", "t2"])


def repeated_windows(some: DataFrame, window: int, gram: int) -> DataFrame:
    """id, t1, at, first: each window of candidates whose fingerprint is in documents of different ids, and the least of these."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            at, rows, prints = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            lists = part.column("anchors")
            for i, (_, anchors, fingerprints) in enumerate(windowed(texts(part, "text"), window, gram)):
                hit = np.flatnonzero(np.isin(anchors, lists[i].values.to_numpy()))
                at.append(hit)
                rows.append(np.full(len(hit), i))
                prints.append(fingerprints[hit])
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("t1").take(rows), pa.array(np.concatenate(prints)), pa.array(np.concatenate(at).astype(np.int32))], ["id", "t1", "print", "at"])

    windows = cut(some.mapInArrow(run, with_fields(some.select("id", "t1"), "print long, at int")), "windows")
    first = windows.groupBy("print").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    return windows.join(first, "print").select("id", "t1", "at", "first")


def passages(some: DataFrame, windows: DataFrame, window: int, shards: int) -> DataFrame:
    """The runs of repeated windows in each text: shard, query (or reference), id, t1, start, n_words and words."""
    shard = F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int")
    lists = windows.groupBy("id", "t1").agg(F.collect_list(F.struct(shard.alias("shard"), (F.col("first") < F.col("id")).alias("query"), "at")).alias("windows"))
    joined = some.select("id", "t1", "text").join(lists, ["id", "t1"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out: list[tuple] = []
            rows = []
            for i, text in enumerate(texts(part, "text")):
                words, of = text.encode().split(), part.column("windows")[i].values
                place, query, at = (of.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                kind = 2 * place.astype(np.int64) + query
                for k in np.unique(kind).tolist():
                    for a, b in runs(np.unique(at[kind == k])):
                        rows.append(i)
                        out.append((k // 2, bool(k % 2), a, b + window - a, b" ".join(words[a : b + window])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id").take(taken), part.column("t1").take(taken), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "t1", "shard", "query", "start", "n_words", "words"])

    return joined.mapInArrow(run, with_fields(joined.select("id", "t1"), "shard int, query boolean, start long, n_words long, words binary"))


def pieces(held: list[tuple[int, list]], limit: int, window: int) -> Iterator[list[tuple[int, list]]]:
    """Reference passages in lists of about `limit` words; longer ones in pieces that overlap by a window less a word."""
    out, total = [], 0
    for doc, words in held:
        for a in range(0, max(1, len(words) - window + 1), limit):
            some = words[a : a + limit + window - 1]
            if out and total + len(some) > limit + window:
                yield out
                out, total = [], 0
            out.append((doc, some))
            total += len(some)
    if out:
        yield out


def matched(found: DataFrame, window: int, shard_words: int, query_words: int) -> DataFrame:
    """id, t1 and spans [start, end) of words that the automata of the shards find in smaller documents."""
    loads = found.where("query").groupBy("shard").agg(F.ceil(F.sum("n_words") / query_words).cast("int").alias("groups"))
    dealt = found.join(loads, "shard")
    own = F.array(F.pmod(F.xxhash64("id", "t1"), F.col("groups")).cast("int"))
    dealt = dealt.withColumn("group", F.explode(F.when(F.col("query"), own).otherwise(F.sequence(F.lit(0), F.col("groups") - 1)))).drop("groups", "n_words")

    def run(group: pa.Table) -> pa.Table:
        query = group.column("query").to_numpy()
        reference = group.filter(pa.array(~query)).select(["id", "words"]).to_pylist()
        reference = sorted(((r["id"], r["words"]) for r in reference), key=lambda r: r[0])
        asked = group.filter(pa.array(query))
        documents, starts = asked.column("id").to_pylist(), asked.column("start").to_pylist()
        hits: list[list[int]] = [[] for _ in documents]
        for some in pieces([(doc, words.split()) for doc, words in reference], shard_words, window):
            automaton = SuffixAutomaton()
            for doc, words in some:
                automaton.insert(words, doc)
            for i, words in enumerate(asked.column("words")):
                if documents[i] > some[0][0]:
                    hits[i].extend(automaton.covered(words.as_py().split(), documents[i], window))
        rows, spans = [], []
        for i, ends in enumerate(hits):
            last = None
            for a, b in runs(np.unique(np.array(ends))) if ends else ():
                a, b = starts[i] + a - window, starts[i] + b
                if last is not None and a <= last:
                    spans[-1] = (spans[-1][0], b)
                else:
                    rows.append(i)
                    spans.append((a, b))
                last = b
        taken = asked.select(["id", "t1"]).take(pa.array(rows, pa.int64()))
        return taken.append_column("start", pa.array([a for a, _ in spans], pa.int64())).append_column("end", pa.array([b for _, b in spans], pa.int64()))

    return dealt.groupBy("shard", "group").applyInArrow(run, with_fields(found.select("id", "t1"), "start long, end long"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, query_words: int = QUERY_WORDS) -> tuple[DataFrame, DataFrame]:
    """What docs (id, t1, t2, text) lose: id, t1, t2, copy (all words go) and spans of words; and the candidate texts (id, t1, t2, text), which hold all of those with spans."""
    spark, start = docs.sparkSession, len(written)
    known = cut(distinct_texts(docs, window, gram), "texts")
    remove(spark, written[start:-1])
    some = cut(candidates(docs, known).dropDuplicates(["id", "t1", "t2"]), "candidates")
    start = len(written)
    windows = cut(repeated_windows(some, window, gram), "repeated")
    remove(spark, written[start:-1])
    reference = windows.where("id = first").count()
    found = cut(passages(some, windows, window, max(1, -(-reference // shard_words))), "passages")
    remove(spark, written[start:-1])
    spans = matched(found, window, shard_words, query_words).groupBy("id", "t1").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    least = known.select("t1", "t2", F.col("id").alias("least"))
    rows = docs.where("id is not null").select("id", "t1", "t2").distinct().join(least, ["t1", "t2"]).join(spans, ["id", "t1"], "left")
    losses = rows.select("id", "t1", "t2", (F.col("id") > F.col("least")).alias("copy"), "spans").where("copy or spans is not null")
    return cut(losses, "losses"), some.drop("anchors")


def kept_words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys of rows (text, copy, spans), n_words, n_removed, and kept, the words outside the spans joined by one space."""
    packed = rows.select(F.struct(*keys).alias("keys"), "text", "copy", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts, removed, kept = [], [], []
            copies, lists = part.column("copy").to_pylist(), part.column("spans").to_pylist()
            for text, copy, spans in zip(texts(part, "text"), copies, lists, strict=True):
                words = text.encode().split()
                left, at = [], 0
                for s in () if copy else spans or ():
                    left += words[at : s["start"]]
                    at = max(at, s["end"])
                left += [] if copy else words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([part.column("keys"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["keys", "n_words", "n_removed", "kept"])

    return packed.mapInArrow(run, with_fields(packed.select("keys"), "n_words long, n_removed long, kept string")).select("keys.*", "n_words", "n_removed", "kept")


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.select("id", *text_marks("text"), "text")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """Per row: id_col, n_words, n_removed, and kept, its remaining words joined by one space; limits as in repeated_spans()."""
    source = prepared(docs, id_col, text_col)
    losses, _ = repeated_spans(source, **limits)
    return kept_words(source.join(losses, ["id", "t1", "t2"], "left"), ["id"]).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """without_repeats() with the SHA-256 of kept for its text; only texts that lose some words are shuffled, the others are digested where they are read."""
    source = prepared(docs, id_col, text_col)
    losses, some = repeated_spans(source, **limits)
    joined = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    n = F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("long")
    whole = source.select("id", "t1", "t2", n.alias("n_words"), F.sha2(joined, 256).alias("sha"))
    partly = kept_words(some.join(losses.where("not copy"), ["id", "t1", "t2"]), ["id", "t1", "t2"])
    lost = partly.select("id", "t1", "t2", F.col("n_removed").alias("lost"), F.sha2("kept", 256).alias("left_sha"))
    lost = lost.unionByName(losses.where("copy").select("id", "t1", "t2", F.lit(None).cast("long").alias("lost"), F.sha2(F.lit(""), 256).alias("left_sha")))
    both = whole.join(lost, ["id", "t1", "t2"], "left")
    removed = F.when(F.col("left_sha").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("lost", "n_words"))
    return both.select(F.col("id").alias(id_col), "n_words", removed.alias("n_removed"), F.coalesce("left_sha", "sha").alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: All windows by the MD5 of their words, and for each word the latest start of a repeated window up to it.
SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), g as (
  select r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from d)
), f as (
  select h, min(doc_id) as first from g group by h
), b as (
  select g.r, g.i from g join f on f.h = g.h where f.first < g.doc_id
), p as (
  select r, unnest(range(1, len(w) + 1)) as j, unnest(w) as word from d
), l as (
  select p.r, p.j, p.word, max(b.i) over (partition by p.r order by p.j) as latest from p left join b on b.r = p.r and b.i = p.j
), k as (
  select r, count(*) as n, string_agg(word, ' ' order by j) as kept from l where latest is null or latest < j - 49 group by r
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join k on k.r = d.r
"""
