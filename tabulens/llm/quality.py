"""Quality rules with compression bands (op2).

Each whole document and each of its chunks, the last and shorter one included, is compressed with zstandard.
Repetitive text compresses better than the corpus's prose and encoded or random text worse, so a ratio outside the band
for the document's length rejects it; so does a document more than CHUNK_SHARE of whose bytes are in chunks that leave
their band.

The bands are calibrated on the corpus: of the different texts that pass the base rules, each class of lengths (half an
octave) has the quartiles of its ratios, whole texts and chunks apart, and its band reaches FENCE times their distance
beyond them, within the widest band of BANDS. A class of fewer than LEAST_PIECES ratios has that widest band.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Rows are independent but for
the bands; repeated rows get equal results and count once for the bands; extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import cut, slices, table, texts

#: From this many bytes on, a text's compressed size over its size lies between low and high at the widest.
BANDS = (
    (0, 0.0, 9.0),
    (200, 0.36, 0.95),
    (500, 0.34, 0.85),
    (1_000, 0.32, 0.78),
    (4_000, 0.30, 0.74),
    (16_000, 0.26, 0.72),
    (64_000, 0.20, 0.72),
    (1_000_000, 0.15, 0.72),
)
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE = 4096, (0.28, 0.78), 0.25
FENCE, LEAST_FENCE, LEAST_PIECES = 1.5, 0.01, 20
#: Classes of lengths, half an octave each; a text has less than 2**31 bytes.
CLASSES = 64
LEVEL = 3

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, zstd_ratio double, n_chunks long, chunk_ratios array<double>"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, n)
    pairs = w[:-1] * len(number) + w[1:]
    if len(number) > 1 << 20:  # keys of three numbers would overflow
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(number) + w[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str, compress) -> tuple:
    data = text.encode()
    words = data.split()
    seen: set[str] = set()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")] if "\n" in text else ()
    seen.update(lines)
    whole = len(compress(data)) / len(data) if data else 0.0
    chunks = [data[k : k + CHUNK_BYTES] for k in range(0, len(data), CHUNK_BYTES)]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(seen),
        repeated_words(words),
        len(data),
        whole,
        len(chunks),
        [len(compress(c)) / len(c) for c in chunks] if len(chunks) > 1 else [whole] * len(chunks),
    )


def length_class(size: Column) -> Column:
    return F.floor(2 * F.log2(F.greatest(size, F.lit(1)))).cast("int")


def chunk_size(n_bytes: Column, k: Column) -> Column:
    return F.least(F.lit(CHUNK_BYTES), n_bytes - CHUNK_BYTES * k)


def widest(cls: int, chunk: bool) -> tuple[float, float]:
    """The band of a class that has too few ratios of its own."""
    size = 2 ** (cls / 2)
    return CHUNK_BAND if chunk and size >= CHUNK_BYTES else next((low, high) for start, low, high in reversed(BANDS) if size >= start)


def calibrated(measured: DataFrame) -> dict[bool, list[tuple[float, float]]]:
    """The bands of all classes, by whether they are for chunks, from rows (h, n_bytes, zstd_ratio, n_chunks, chunk_ratios, base_failed)."""
    passed = measured.where(~F.col("base_failed"))
    whole = passed.select("h", F.lit(-1).alias("k"), F.col("n_bytes").alias("size"), F.col("zstd_ratio").alias("ratio"))
    parts = passed.where(F.col("n_chunks") > 1).select("h", "n_bytes", F.posexplode("chunk_ratios").alias("k", "ratio"))
    parts = parts.select("h", "k", chunk_size(F.col("n_bytes"), F.col("k")).alias("size"), "ratio")
    pieces = whole.unionByName(parts).distinct()  # copies count once
    quartiles = F.percentile_approx("ratio", [0.25, 0.75], 10_000).alias("q")
    rows = pieces.groupBy((F.col("k") >= 0).alias("chunk"), length_class(F.col("size")).alias("cls")).agg(F.count("*").alias("n"), quartiles).collect()
    bands = {chunk: [widest(c, chunk) for c in range(CLASSES)] for chunk in (False, True)}
    for r in rows:
        if r["n"] >= LEAST_PIECES:
            (low, high), (q1, q3) = bands[r["chunk"]][r["cls"]], r["q"]
            reach = max(FENCE * (q3 - q1), LEAST_FENCE)
            bands[r["chunk"]][r["cls"]] = max(low, q1 - reach), min(high, q3 + reach)
    return bands


def inside(ratio: Column, size: Column, bands: list[tuple[float, float]]) -> Column:
    low, high = (F.element_at(F.array(*map(F.lit, x)), length_class(size) + 1) for x in zip(*bands, strict=True))
    return ratio.between(low, high)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, the base measures, zstd_ratio, counts of chunks, base_failed, in_band, and kept."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("key"), text.alias("text"), F.xxhash64(text).alias("h"))
    names = [x.split()[0] for x in OUT.split(", ")]
    own = {"zstd_ratio": pa.float64(), "chunk_ratios": pa.list_(pa.float64())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for part in slices(batches, "text"):
            columns = zip(*(measure(t, compress) for t in texts(part, "text")), strict=True)
            kinds = [own.get(n, pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("h"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "h", *names])

    kind = source.schema["key"].dataType.simpleString()
    found = source.mapInArrow(run, f"key {kind}, h long, {OUT}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = cut(found.withColumn("base_failed", failed), "quality-measures")
    bands = calibrated(found)
    whole = inside(F.col("zstd_ratio"), F.col("n_bytes"), bands[False])
    sized = F.transform("chunk_ratios", lambda r, k: F.struct(r.alias("ratio"), chunk_size(F.col("n_bytes"), k).alias("size")))
    odd = F.filter(sized, lambda c: ~F.when(F.col("n_chunks") > 1, inside(c["ratio"], c["size"], bands[True])).otherwise(whole))
    odd_bytes = F.aggregate(F.transform("odd", lambda c: c["size"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        found.withColumn("odd", odd)
        .withColumn("n_odd_chunks", F.size("odd").cast("long"))
        .withColumn("in_band", whole & (odd_bytes <= CHUNK_SHARE * F.col("n_bytes")))
        .withColumn("kept", ~F.col("base_failed") & F.col("in_band"))
        .select(F.col("key").alias(id_col), *names[:-1], "n_odd_chunks", "base_failed", "in_band", "kept")
    )


def query(spark, sf_dir: str) -> DataFrame:
    done = score_quality(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return done.select(*first, *(c for c in done.columns if c not in first))
