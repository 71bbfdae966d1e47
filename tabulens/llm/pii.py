"""Personal data by weak supervision (op8).

Four base kinds - email, ip, card, phone - are found by fixed rules and always kept. Further kinds - local phone
numbers, secrets, social security numbers, bank accounts, named persons - start as candidates, on which labelers vote
for, against or not at all: a format or checksum labeler, a gazetteer, the words before the span, and the span's shape.
Candidates with equal votes and classes form a pattern. Expectation maximisation over the counts of all patterns
estimates each labeler's reliability by kind, and a logistic span classifier, which also reads the span's size, share of
digits and different characters, is trained on the resulting posteriors and decides by pattern. The patterns are a
bounded set (some thousands at most), whatever the input, so this happens on the driver.

Defined results: offsets are code points, end exclusive; a null text is the empty text, without spans; an accepted
candidate that overlaps a base span or an earlier accepted one is left out. Counts are those of the base spans. Rows are
independent but for the patterns' counts; repeated rows get equal spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import cut, slices, table, texts, with_fields

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "secret", "ssn", "iban", "name")
ACCEPT = 0.5
#: Characters before a span in which its context is looked for.
CONTEXT = 32

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# A match that could begin inside a run of digits could begin at the run's start, so the look-behind only saves time.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}").finditer
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
DIGITS = re.compile(r"[0-9]+").finditer
ANY_DIGIT = re.compile(r"[0-9]").search

LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])").match
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])").match
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])").match
TITLE = re.compile(r"\b(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Sra?|Mme)\.? ([A-Z]\w+(?: [A-Z]\w+)?)").finditer
TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Sr", "Mme")
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")

#: Whole words, except that other letters than a-z may stand beside them, as in `api_key`.
CUES = {
    kind: re.compile(rf"(?<![a-z])(?:{'|'.join(words.split())})(?![a-z])").search
    for kind, words in {
        "local_phone": "call tel phone telephone mobile cell fax contact",
        "secret": "token tokens key keys apikey secret secrets password passwd pwd bearer auth authorization",
        "ssn": "ssn social security tax",
        "iban": "iban account bank konto cuenta compte",
        "name": "name named by contact dear from to",
    }.items()
}
FIRST_NAMES = frozenset("james john robert michael david william mary patricia jennifer linda elizabeth anna maria peter paul thomas hans karl jean marie pierre jose carlos juan sofia lucia laura martin daniel".split())


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN(text, at + 1)):
            end = free = m.end()
            yield start, end
        else:
            free = at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if ANY_DIGIT(text):
        found += [("ip", *m.span()) for m in IP(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in CARD(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE(text) if 9 <= sum(map(str.isdecimal, m[0])) <= 15]
    return found


def entropy(s: str) -> float:
    return -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values())


def votes(kind: str, text: str, start: int, end: int) -> str:
    """The labelers' votes, as + for, - against, 0 none: format, gazetteer, context, shape; then what only the classifier reads: classes of size, of the share of digits, and of different characters."""
    span = text[start:end]
    before = text[max(0, start - CONTEXT) : start].lower()
    after = text[end : end + 1]
    context = "+" if CUES[kind](before) else "0"
    alone = (not start or not text[start - 1].isalnum()) and not after.isalnum()
    if kind == "local_phone":
        form = "+" if span[:1] == "(" or span.count("-") == 2 else "0"
        gazetteer = "-" if span.strip("(")[0] in "01" else "+"
    elif kind == "secret":
        form = "+" if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|gh[pousr]|xox[bap])[-_][A-Za-z0-9_-]+|AKIA[0-9A-Z]{16}", span) else "0"
        gazetteer = "+" if re.search(r"[=:]\s*[\"']?$", before) else "0"
        alone = alone and entropy(span) >= 3.0
    elif kind == "ssn":
        form = "-" if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else "+"
        gazetteer = "0"
    elif kind == "iban":
        plain = span.replace(" ", "")
        form = "+" if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else "-"
        gazetteer = "+" if 15 <= len(plain) <= 34 else "-"
    else:
        form = "+" if " " in span else "0"
        gazetteer = "+" if span.split()[0].lower() in FIRST_NAMES else "0"
    return f"{form}{gazetteer}{context}{'+' if alone else '-'}{min(9, len(span) // 8)}{round(3 * sum(map(str.isdecimal, span)) / len(span))}{min(9, len(set(span)) // 4)}"


def candidates(text: str) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    if ANY_DIGIT(text):
        done = 0
        for m in DIGITS(text):
            if (start := m.start()) < done:
                continue
            for kind, match, at in (("ssn", SSN, start), ("local_phone", LOCAL_PHONE, start - (text[start - 1 : start] == "(")), ("iban", IBAN, start - 2)):
                if at >= 0 and (hit := match(text, at)):
                    found.append((kind, at, hit.end()))
                    done = hit.end()
                    break
            else:
                left, right = start, m.end()
                while left > done and text[left - 1] in TOKEN:
                    left -= 1
                while right < len(text) and text[right] in TOKEN:
                    right += 1
                done = right
                if right - left >= 20 and not text[left:right].isdecimal():
                    found.append(("secret", left, right))
    if any(t in text for t in TITLES):
        found += [("name", *m.span(1)) for m in TITLE(text)]
    return found


def union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends, in order, of the disjoint stretches that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def meets(stretches: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether a to b has a character in common with one of the stretches."""
    starts, ends = stretches
    k = bisect_right(ends, a)
    return k < len(ends) and starts[k] < b


def found_spans(docs: DataFrame) -> DataFrame:
    """(key, base, more) for docs (key, text): base spans (kind, start, end), candidates (kind, start, end, pattern)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    more = pa.struct([*span, ("pattern", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            base, extra = [], []
            for t in texts(part, "text"):
                own = sorted(base_spans(t), key=lambda s: (KINDS.index(s[0]), s[1]))
                taken, rest = union([(a, b) for _, a, b in own]), []
                for kind, a, b in sorted(candidates(t), key=lambda s: s[1]):
                    if not meets(taken, a, b):
                        rest.append({"kind": kind, "start": a, "end": b, "pattern": votes(kind, t, a, b)})
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                extra.append(rest)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(base, pa.list_(span)), pa.array(extra, pa.list_(more))], ["key", "base", "more"])

    return docs.mapInArrow(run, with_fields(docs.select("key"), "base array<struct<kind:string,start:int,end:int>>, more array<struct<kind:string,start:int,end:int,pattern:string>>"))


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 50) -> np.ndarray:
    """Posterior of each pattern (votes, count) by expectation maximisation; a labeler's chances of each vote depend on the truth."""
    votes = np.array([["-0+".index(v) for v in p[:4]] for p, _ in patterns])
    count = np.array([n for _, n in patterns], float)
    start = np.array([[0.10, 0.30, 0.60], [0.45, 0.40, 0.15]])  # chances of -, 0, + for true and for false spans
    table = np.repeat(start[:, None, :], votes.shape[1], axis=1)
    share = 0.5
    post = np.full(len(votes), 0.5)
    for _ in range(rounds):
        logs = np.log(table)[:, np.arange(votes.shape[1]), votes].sum(axis=2)
        post = 1 / (1 + np.exp(np.clip(logs[1] + np.log(1 - share) - logs[0] - np.log(share), -50, 50)))
        for truth, weight in ((0, post * count), (1, (1 - post) * count)):
            for j in range(votes.shape[1]):
                seen = np.bincount(votes[:, j], weight, 3) + 20 * start[truth]
                table[truth, j] = seen / seen.sum()
        share = float(np.clip(((post * count).sum() + 5) / (count.sum() + 10), 0.05, 0.95))
    return post


def classifier(rows: list[tuple[str, str, int]]) -> set[tuple[str, str]]:
    """The (kind, pattern)s to accept, for all patterns (kind, pattern, count)."""
    accepted = set()
    for kind in KINDS[len(BASE) :]:
        own = sorted((p, n) for k, p, n in rows if k == kind)
        if not own:
            continue
        post = reliabilities(own)
        x = np.array([[1.0, *("-0+".index(v) - 1 for v in p[:4]), int(p[4]) / 9, int(p[5]) / 3, int(p[6]) / 9] for p, _ in own])
        weight = np.array([n for _, n in own], float)
        weight /= weight.sum() / len(weight)
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (weight * (p - post)) + 0.05 * w)
        accepted |= {(kind, pattern) for (pattern, _), s in zip(own, 1 / (1 + np.exp(-x @ w)), strict=True) if s > ACCEPT}
    return accepted


def every_span(base: list[dict], more: list[dict], accepted: set[tuple[str, str]]) -> list[dict]:
    """The base spans and, of the candidates with accepted patterns, those that begin after the one kept before them; linear in a text's spans."""
    every, at = list(base), 0
    for m in more:  # in order of start
        if (m["kind"], m["pattern"]) in accepted and m["start"] >= at:
            at = m["end"]
            every.append({"kind": m["kind"], "start": m["start"], "end": at})
    return sorted(every, key=lambda s: (KINDS.index(s["kind"]), s["start"], s["end"]))


def spans_of(part: pa.RecordBatch, accepted: set[tuple[str, str]]) -> list[list[dict]]:
    """All spans of each row of a batch of (base, more)."""
    return [every_span(b, m, accepted) for b, m in zip(part.column("base").to_pylist(), part.column("more").to_pylist(), strict=True)]


def settled(found: DataFrame, accepted: set[tuple[str, str]]) -> DataFrame:
    """(key, base, every): the base spans and all spans of a text."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("base"), pa.array(spans_of(part, accepted), pa.list_(span))], ["key", "base", "every"])

    return found.mapInArrow(run, with_fields(found.select("key", "base"), "every array<struct<kind:string,start:int,end:int>>"))


def spans_and_patterns(source: DataFrame) -> tuple[DataFrame, set[tuple[str, str]]]:
    """The spans found in source (key, text), written as a table, and the patterns to accept."""
    found = cut(found_spans(source), "pii-spans")
    counted = found.select(F.explode("more").alias("m")).groupBy("m.kind", "m.pattern").count().collect()
    return found, classifier([(r["kind"], r["pattern"], r["count"]) for r in counted])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, base_spans and all_spans, arrays of (kind, start, end) in the order of KINDS, then start."""
    found = settled(*spans_and_patterns(docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))))
    return found.select(F.col("key").alias(id_col), F.col("base").alias("base_spans"), F.col("every").alias("all_spans"))


def digest(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str, spans: list[dict]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of the first."""
    out, at = [], 0
    for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets, overlapping ones as one of the first's kind; the columns stay, n_chars follows the text."""
    names = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("key"), F.col(text_col).cast("string").alias("text"))
    found, accepted = spans_and_patterns(row)
    found = found.select("key", F.col(f"key.`{text_col}`").cast("string").alias("text"), "base", "more")

    # Spans are settled and masked by one function: with two a task holds two workers, and all of them stay for later stages.
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = [t if t is None else masked(t, s) for t, s in zip(part.column("text").to_pylist(), spans_of(part, accepted), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.string())], ["key", "masked"])

    with_text = found.mapInArrow(run, with_fields(found.select("key"), "masked string"))
    return with_text.select(*(F.col("masked").alias(c) if c == text_col else F.length("masked").cast("long").alias(c) if c == "n_chars" else F.col(f"key.`{c}`").alias(c) for c in names))


def _same(kind: str):
    return lambda x: x == F.lit(kind)


def query(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _same(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(digest("base_spans"), 256).alias("base_sha256"), digest("all_spans").alias("spans"))
