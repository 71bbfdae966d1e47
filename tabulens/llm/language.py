"""Language identification (op5).

One interpolated Kneser-Ney character model per language. A text is lower-cased and folded to letters, with one
boundary symbol for each run of anything else; up to five symbols pack into 60 bits, and the models' probabilities
stand beside the sorted hashes of these n-grams. A text gets the language of least cross-entropy per symbol. It is
rejected where that entropy lies far above what texts of the language reach, in units of its spread for texts of that
length. Both spread and limit are calibrated on rows that the models have not seen: the spread is that of the language's
own rows, between texts and between symbols; the limit lies midway between the largest excess of its own rows and what
rows of other languages reach (all but FOREIGN of them), but no lower than MARGIN times the former.

The models are fitted on a bounded sample: SAMPLE_DOCS rows per language, each of at most SAMPLE_CHARS characters,
in hash order of their ids. Every row is then scored over its whole text.

Defined results: a null text, an empty one or one without letters is `und`, rejected, score 0. Ties go to the first
language by code point. Without any labelled row every text is `und`. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import bounded_sample, id_remainder, slices, table, texts, with_fields

ORDER, BITS = 5, 12
ALPHABET = (1 << BITS) - 2  # besides 0, the boundary, and the last symbol, any other letter
SAMPLE_DOCS, SAMPLE_CHARS = 500, 20_000
#: Every fifth sampled row calibrates the rejection and trains nothing.
CALIBRATION = 5
#: Share of other languages' calibration rows that may lie below the limit's upper end; least room above a language's own rows.
FOREIGN, MARGIN = 0.05, 1.5


def mixed(code: np.ndarray) -> np.ndarray:
    """A 64-bit mix that maps different codes to different hashes."""
    x = code.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


class Folding:
    """Characters to symbols."""

    def __init__(self, letters: str):
        self.letters = letters
        self._table: np.ndarray | None = None

    def __reduce__(self):
        return Folding, (self.letters,)

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            place = {c: i + 1 for i, c in enumerate(self.letters)}
            other = (1 << BITS) - 1
            self._table = np.array([place.get(c.lower(), other) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)], np.uint16)
        return self._table

    def grams(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The packed n-gram that ends at each symbol of each text, text after text; the symbols of each text.

        A text begins after a row of boundaries, and a run of boundaries counts once.
        """
        sizes = np.array([len(t) for t in batch], np.int64)
        sym = self.table[points("".join(batch))]
        doc = np.repeat(np.arange(len(batch)), sizes)
        before = np.concatenate([[0], sym[:-1]]) if len(sym) else sym
        first = np.zeros(len(sym), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        kept = (sym != 0) | ((before != 0) & ~first)
        sym, doc = sym[kept], doc[kept]
        out = np.zeros(len(sym) + len(batch) * (ORDER - 1), np.uint64)
        at = np.arange(len(sym)) + (doc + 1) * (ORDER - 1)
        out[at] = sym
        code = np.zeros(len(sym), np.uint64)
        for k in range(ORDER):
            code |= out[at - k] << np.uint64(BITS * k)
        return code, np.bincount(doc, minlength=len(batch))


def low(code: np.ndarray, k: int) -> np.ndarray:
    return code & np.uint64((1 << (BITS * k)) - 1)


class Sorted:
    """Values of several languages beside one sorted array of hashes."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]], absent: float):
        keys = np.unique(np.concatenate([mixed(codes) for codes, _ in found]))
        self.keys, self.values = keys, np.full((len(keys) + 1, len(found)), absent, np.float32)
        for j, (codes, values) in enumerate(found):
            self.values[np.searchsorted(keys, mixed(codes)), j] = values

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        wanted = mixed(codes)
        at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        return self.values[np.where(self.keys[at] == wanted, at, len(self.keys))]


def kneser_ney(grams: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]], float]:
    """Interpolated probabilities of the n-grams of orders 1 to ORDER; back-off weights of the contexts of orders 2 to ORDER; the probability of a symbol never seen."""
    levels = [np.unique(grams, return_counts=True)]
    for k in range(ORDER - 1, 0, -1):  # lower orders count the different symbols that stand before
        levels.insert(0, np.unique(low(levels[0][0], k), return_counts=True))
    probs: list[tuple[np.ndarray, np.ndarray]] = []
    weights: list[tuple[np.ndarray, np.ndarray]] = []
    unseen = 0.0
    for k, (codes, counts) in enumerate(levels, 1):
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.5
        contexts, place = np.unique(codes >> np.uint64(BITS), return_inverse=True)
        total = np.bincount(place, counts)
        weight = discount * np.bincount(place) / total
        if k == 1:
            unseen = float(weight[0]) / (1 << BITS)
            lower = np.full(len(codes), 1.0 / (1 << BITS))
        else:
            lower = probs[-1][1][np.searchsorted(probs[-1][0], low(codes, k - 1))]
            weights.append((contexts, weight))
        probs.append((codes, (counts - discount) / total[place] + weight[place] * lower))
    return probs, weights, unseen


class LanguageModel:
    """Models of all languages, and the limits of rejection."""

    def __init__(self, rows: list[tuple[str, str]]):
        """rows: language and text, in a fixed order."""
        rows = [(lang, t) for lang, t in rows if any(map(str.isalpha, t))]  # the JVM's letters are not all Python's
        self.langs = sorted({lang for lang, _ in rows})
        seen: dict[str, int] = {}
        for _, text in rows:
            for c in text.lower():
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
        self.folding = Folding("".join(sorted(sorted(seen, key=lambda c: (-seen[c], c))[: ALPHABET - 1])))
        by = {lang: [t for x, t in rows if x == lang] for lang in self.langs}
        held = {lang: [t for i, t in enumerate(ts) if i % CALIBRATION == CALIBRATION - 1] for lang, ts in by.items()}
        fitted = [kneser_ney(g) for lang in self.langs if len(g := self.folding.grams([t for i, t in enumerate(by[lang]) if i % CALIBRATION != CALIBRATION - 1 or len(by[lang]) < CALIBRATION])[0])]
        self.unseen = np.array([u for _, _, u in fitted], np.float32)
        self.probs = [Sorted([p[k] for p, _, _ in fitted], np.nan) for k in range(ORDER)]
        self.weights = [Sorted([w[k] for _, w, _ in fitted], 1.0) for k in range(ORDER - 1)]
        held = {lang: held[lang] or by[lang] for lang in self.langs}
        self.limits = np.array([self._limit([t for x in self.langs if x != lang for t in held[x]], held[lang], j) for j, lang in enumerate(self.langs)])

    def _limit(self, foreign: list[str], own: list[str], j: int) -> tuple[float, float, float, float]:
        """For language j: the usual cross-entropy of its own texts, its variance between texts and of single symbols, and the limit of the excess in units of the spread."""
        found = []
        for batch in (own, foreign):
            sums, squares, n = self._sums(batch)
            some = n >= 20
            found.append((sums[some, j], squares[some, j], n[some]))
        (sums, squares, n), (other, _, n_other) = found
        if not len(n):
            return 4.0, 1.0, 9.0, 8.0
        usual, symbol = float(np.median(sums / n)), float(squares.sum() / n.sum() - (sums.sum() / n.sum()) ** 2)
        between = max(0.01, float(np.mean((sums / n - usual) ** 2) - symbol * np.mean(1 / n)))
        most = max(1.0, float(((sums / n - usual) / np.sqrt(between + symbol / n)).max()))
        least = float(np.quantile((other / n_other - usual) / np.sqrt(between + symbol / n_other), FOREIGN)) if len(n_other) else 0.0
        return usual, between, symbol, max(MARGIN * most, (most + least) / 2)

    def bits(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths of the texts by language, and their numbers of symbols."""
        out, _, n = self._sums(batch, squares=False)
        return out, n

    def _sums(self, batch: list[str], squares: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums, by text and language, of the symbols' code lengths and of their squares; the texts' numbers of symbols."""
        grams, n = self.folding.grams(batch)
        out, square = (np.zeros((len(batch), len(self.langs))) for _ in range(2))
        if len(grams):
            place, codes = pd.factorize(grams)
            p = self.probs[0][low(codes, 1)]
            p = np.where(np.isnan(p), self.unseen, p)
            for k in range(2, ORDER + 1):
                own = self.probs[k - 1][low(codes, k)]
                p = np.where(np.isnan(own), p * self.weights[k - 2][low(codes, k) >> np.uint64(BITS)], own)
            cost = -np.log2(p)
            full = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            for j in range(len(self.langs)):
                own = cost[place, j].astype(np.float64)
                out[full, j] = np.add.reduceat(own, starts)
                if squares:
                    square[full, j] = np.add.reduceat(own * own, starts)
        return out, square, n

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per symbol, and whether it is rejected, of each text."""
        bits, n = self.bits(batch)
        rate = bits / np.maximum(n, 1)[:, None]
        best = rate.argmin(axis=1)
        least = rate[np.arange(len(batch)), best]
        share = np.exp2(-(rate - least[:, None]) * np.minimum(n, 200)[:, None])
        score = np.where(n > 0, 1 / share.sum(axis=1), 0.0)
        usual, between, symbol, limit = self.limits[best].T
        rejected = (n == 0) | (least > usual + limit * np.sqrt(between + symbol / np.maximum(n, 1)))
        return ["und" if not k else self.langs[b] for b, k in zip(best, n, strict=True)], score, least, rejected


def fit(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on a bounded sample of the rows that train admits; None where no row has a language and letters."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.length(text_col) <= SAMPLE_CHARS))
    rows = (rows if train is None else rows.where(train)).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = bounded_sample(rows, "lang", ["key", "text"], SAMPLE_DOCS).collect()
    found.sort(key=lambda r: (r.lang, str(r.key), r.text))
    return LanguageModel([(r.lang, r.text) for r in found]) if any(map(str.isalpha, "".join(r.text for r in found))) else None


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, and lang_pred, score, bits_per_symbol and rejected; docs must not have these columns."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    names = [text_col, *(c for c in docs.columns if c != text_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, text_col, 1 << 20):
            batch = texts(part, text_col)
            if own is None:
                k = len(batch)
                found = ["und"] * k, np.zeros(k), np.zeros(k), np.ones(k, bool)
            else:
                found = own.predict(batch)
            kinds = pa.string(), pa.float64(), pa.float64(), pa.bool_()
            columns = [*part.columns, *(pa.array(v, k) for v, k in zip(found, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "lang_pred", "score", "bits_per_symbol", "rejected"])

    own = docs.select(*(F.col(f"`{c}`") for c in names))
    return own.mapInArrow(run, with_fields(own, "lang_pred string, score double, bits_per_symbol double, rejected boolean"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, id_remainder("doc_id", 4) != 2)
    held = (id_remainder("doc_id", 4) == 2).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score", "bits_per_symbol", "rejected")
