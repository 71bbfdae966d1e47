"""Toxicity by a weighted finite-state pattern grammar (op4).

A clause is a string of symbols: insult, stem (an inflected insult), threat, target, negation, report, quote, other.
Small transducers run over it - one remembers a negation's scope, one reported speech and quotes, one whether a person
is addressed - and their composition marks every insult and threat with the state it was met in. A document is scored
by the counts of such marked matches, not of words, in a logistic model.

The lexicons start from short seed lists and grow by words and stems whose presence in labelled training documents
tells the labels apart beyond chance. The model's weights are fitted on the same documents, pulled towards PRIOR, which
says that negated or reported matches mean little. Both use a bounded sample: SAMPLE_DOCS labelled rows of each class
of at most SAMPLE_CHARS characters, in hash order of their ids, weighted back to the classes' sizes. Every row is then
scored over its whole text.

Defined results: a null or empty text has no matches and gets the score of such a text. Without labels the prior
weights hold. Rows are scored on their own; repeated rows get equal scores; a null id is never held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import bounded_sample, id_remainder, slices, table, texts

SAMPLE_DOCS, SAMPLE_CHARS = 3_000, 30_000
#: A word or stem joins the lexicon beyond this many standard errors of its log odds, if at least so many toxic rows, and
#: such a share of them, have it; of stems that contain each other the one with the highest lower bound stays.
LEAST_ERRORS, LEAST_DOCS, LEAST_SHARE = 2.25, 6, 0.02
STEM_CHARS = range(3, 11)

SEEDS = {
    "insult": "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash imbecile vermin cretin halfwit lowlife scumbag",
    "threat": "kill hurt destroy beat stab shoot strangle punish bury burn hunt",
    "target": "you your youre he she they him her them these those people everyone du ihr sie tu vous tú usted ustedes vosotros",
    "negation": "not no never none nobody neither nor without isnt arent dont doesnt didnt wont cant nicht kein keine pas jamais nunca",
    "report": "said says say told wrote writes claimed claims called reported quoted quotes according allegedly sagte schrieb dit selon dijo según",
}

#: Kinds of matches, and the prior of their weights: (insult or stem or threat, aimed, negated, reported).
EVENTS = [(kind, aimed, negated, reported) for kind in ("insult", "stem", "threat") for aimed in (0, 1) for negated in (0, 1) for reported in (0, 1)]
BIAS = -4.0


def prior(event: tuple) -> float:
    kind, aimed, negated, reported = event
    base = {"insult": 5.0, "stem": 2.5, "threat": 0.5}[kind] + (0.5 if aimed else 0) + (3.0 if aimed and kind == "threat" else 0)
    return base * (0.6 if negated else 1) * (0.6 if reported else 1)


PRIOR = np.array([BIAS, *map(prior, EVENTS), 0.5, 2.0])

WORDS = re.compile(r"[^\W\d_]+").findall
CLAUSES = re.compile(r"[.!?;:\n|]+").split
SYMBOLS = re.compile(r"[^\W\d_]+|[\"“”«»]").findall


class Transducer:
    """States, from 0; step(state, symbol) gives the next state, and mark(state) what a match met in it gets."""

    def __init__(self, step, mark):
        self.step, self.mark = step, mark

    def __matmul__(self, other: Transducer) -> Transducer:
        """Both side by side on one input; states and marks are pairs."""
        return Transducer(lambda s, x: (self.step(s[0], x), other.step(s[1], x)), lambda s: (*self.mark(s[0]), *other.mark(s[1])))


#: A negation reaches over the next three words.
NEGATED = Transducer(lambda s, x: 4 if x == "negation" else max(0, s - 1), lambda s: (int(s > 0),))
#: Speech is reported after a verb of saying, and inside quotes.
REPORTED = Transducer(lambda s, x: s ^ 2 if x == "quote" else s | 1 if x == "report" else s, lambda s: (int(s > 0),))
#: A person is addressed up to four words before a match.
AIMED = Transducer(lambda s, x: 5 if x == "target" else max(0, s - 1), lambda s: (int(s > 0),))

GRAMMAR = AIMED @ (NEGATED @ REPORTED)
START = (0, (0, 0))


class Lexicon:
    """Symbols of words; stems match longer words that begin with them."""

    def __init__(self, words: dict[str, str], stems: list[str]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems})
        self.known: dict[str, str] = {}

    def __reduce__(self):
        return Lexicon, (self.words, self.stems)

    def symbol(self, word: str) -> str:
        found = self.known.get(word)
        if found is None:
            found = self.words.get(word) or ("stem" if any(n < len(word) and word[:n] in self._stems for n in self.lengths) else "other")
            if len(self.known) > 400_000:
                self.known.clear()
            if len(word) <= 40:
                self.known[word] = found
        return found

    @property
    def _stems(self) -> set[str]:
        if not hasattr(self, "_set"):
            self._set = set(self.stems)
        return self._set

    def features(self, text: str) -> np.ndarray:
        """Log counts of the matches by event; the different inflected words of the most frequent stem, plain and, as long
        texts meet some by chance, discounted by the number of different words."""
        out = np.zeros(len(PRIOR))
        out[0] = 1.0
        low = text.lower()
        words = set(WORDS(low))
        hits = {w for w in words if self.symbol(w) in ("insult", "stem", "threat")}
        if not hits:
            return out
        counts: Counter = Counter()
        for clause in CLAUSES(low):
            tokens = SYMBOLS(clause)
            if hits.isdisjoint(tokens):
                continue
            state = START
            for k, token in enumerate(tokens):
                x = self.symbol(token) if token[0].isalpha() else "quote"
                if x in ("insult", "stem", "threat"):
                    aimed, negated, reported = GRAMMAR.mark(state)
                    aimed = aimed or any(self.symbol(t) == "target" for t in tokens[k + 1 : k + 3])
                    counts[x, int(aimed), negated, reported] += 1
                state = GRAMMAR.step(state, x)
        out[1:-2] = [np.log1p(counts[e]) for e in EVENTS]
        heads = Counter(next((w[:n] for n in self.lengths if n < len(w) and w[:n] in self._stems), "") for w in hits if self.symbol(w) == "stem")
        most = max(heads.values(), default=0)
        out[-2:] = min(most, 8), min(most, 8) * 150 / (150 + len(words))
        return out


def learned(rows: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """Words, and stems of several words of a text, that tell toxic rows from the others."""
    seen = {0: Counter(), 1: Counter()}
    size = Counter(y for _, y in rows)
    least = max(LEAST_DOCS, LEAST_SHARE * size[1])
    for text, y in rows:
        words = {w for w in WORDS(text.lower()) if len(w) <= 30}
        heads = Counter(w[:n] for w in words for n in STEM_CHARS if n < len(w))
        seen[y].update(words)
        seen[y].update(f"{h}*" for h, k in heads.items() if k >= 2)
    scored = {}
    for w, k in seen[1].items():
        c = seen[0][w]
        if k >= least:
            odds = np.log((k + 0.5) / (size[1] + 1)) - np.log((c + 0.5) / (size[0] + 1))
            error = np.sqrt(1 / (k + 0.5) + 1 / (c + 0.5))
            if odds > 2.0 and odds > LEAST_ERRORS * error:
                scored[w] = odds - 2 * error
    stems: list[str] = []
    for w in sorted((w for w in scored if w[-1] == "*"), key=lambda w: (-scored[w], w)):
        stem = w[:-1]
        if not any(stem.startswith(s) or s.startswith(stem) for s in stems):
            stems.append(stem)
    words = [w for w in scored if w[-1] != "*" and not any(w.startswith(s) for s in stems)]
    return sorted(words), sorted(stems)


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 0.3) -> np.ndarray:
    """Logistic weights by Newton steps, with a Gaussian prior around PRIOR."""
    w = PRIOR.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + strength * (w - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, rows: list[tuple[str, int]], sizes: dict[int, int]):
        """rows: text and label, in a fixed order; sizes: labelled rows of each class in all."""
        words, stems = learned(rows) if rows else ([], [])
        symbols = {w: kind for kind, ws in SEEDS.items() for w in ws.split()}
        self.lexicon = Lexicon({w: "insult" for w in words} | symbols, stems)
        self.weights = PRIOR
        if rows and len(sizes) == 2:
            y = np.array([label for _, label in rows])
            held = Counter(y.tolist())
            weight = np.array([sizes[k] / held[k] for k in y.tolist()])
            self.weights = fit_weights(np.stack([self.lexicon.features(t) for t, _ in rows]), y, weight * len(y) / weight.sum())

    def scores(self, batch: list[str]) -> np.ndarray:
        x = np.stack([self.lexicon.features(t) for t in batch])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    chosen = bounded_sample(marked, "label", ["key"], SAMPLE_DOCS)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "key")
    rows = bounded_sample(rows, "label", ["key", "text"], SAMPLE_DOCS).collect()  # an id may have many rows
    return Model([(r.text, r.label) for r in sorted(rows, key=lambda r: (str(r.key), r.text, r.label))], sizes)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, score and predicted."""
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    shared = source.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            score = pa.array(shared.value.scores(texts(part, "text")), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column("key"), score], ["key", "score"])

    kind = source.schema["key"].dataType.simpleString()
    found = source.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", id_col)
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(id_remainder("doc_id", 5) != 0))
    held = (id_remainder("doc_id", 5) == 0).alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held, "score", "predicted")
