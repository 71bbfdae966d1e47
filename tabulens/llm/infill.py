"""Fill-in-middle transformation (op11).

A text is cut into line units ([^\\n]*\\n or the rest), two of its unit boundaries are picked by hashes of its id, and
the parts are written out in prefix-suffix-middle or suffix-prefix-middle order with sentinels before each.

One numpy kernel works on the UTF-8 buffer of a whole Arrow batch, without a loop over its rows: a lookup table gives
each byte's class; a unit starts where the byte before is a line end or where a document starts; sums of these marks,
less their value at each document's start, number a document's units; one searchsorted over the sums finds the cuts of
all rows; and one gather writes all outputs. Restoring reads the sentinels of the outputs and gathers the parts back.

Defined results: a null text is the empty text; an empty text, and one that holds a sentinel itself, stays plain, with
null part sizes; a null id is hashed as empty text, so such rows are cut alike; rows are independent, so repeated rows
give equal results and ties don't occur; other columns pass unchanged whatever their names (the kernel takes ids and
texts only, and results get the names asked for, which must not be the id's). A text of any length is one unit of work:
a slice holds about SLICE_BYTES of text or a single longer text, at some 30 bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import slices, table, with_fields

#: The sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Of 100 documents, those that are transformed; of 100 of these, those written suffix first.
FIM_RATE, SPM_RATE = 100, 50

#: Classes of a byte: first byte of a code point, line end, bracket that opens a sentinel, one that closes it, its letter.
FIRST, NEWLINE, OPEN, CLOSE, LETTER = 1, 2, 4, 8, 16
CLASS = np.zeros(256, np.uint8)
CLASS[:0x80] = CLASS[0xC0:] = FIRST
CLASS[ord("\n")] |= NEWLINE
CLASS[ord("<")] |= OPEN
CLASS[ord(">")] |= CLOSE
CLASS[[ord(s[1]) for s in SENTINELS]] |= LETTER

MARKS = np.frombuffer("".join(SENTINELS).encode(), np.uint8)
SIZE = len(SENTINELS[0])


def hash_parts(id_col: str, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the hex SHA-256 of seed:id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's edges in them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    size = int(edges[-1] - edges[0])
    return np.frombuffer(data, np.uint8, size, int(edges[0])) if size else np.empty(0, np.uint8), edges - edges[0]


def sentinels(kinds: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sentinels lie within a row, and in which row; kinds are the bytes' classes."""
    at = np.flatnonzero((kinds[:-2] & OPEN > 0) & (kinds[1:-1] & LETTER > 0) & (kinds[2:] & CLOSE > 0)) if len(kinds) > 2 else np.empty(0, np.int64)
    row = np.searchsorted(edges, at, "right") - 1
    inside = at + SIZE <= edges[row + 1]
    return at[inside], row[inside]


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces data[starts[i]:starts[i] + sizes[i]] one after another."""
    ends = np.cumsum(sizes)
    where = np.repeat(starts - (ends - sizes), sizes)
    where += np.arange(len(where))
    return data[where]


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def transform(column: pa.Array, h: list[np.ndarray], fim_rate: int, spm_rate: int) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    data, edges = utf8(column)
    kinds = CLASS[data]
    starts_unit = np.zeros(len(data) + 1, bool)
    starts_unit[1:] = kinds & NEWLINE > 0
    starts_unit[edges[:-1]] = True
    starts_unit = starts_unit[:-1]
    # Unit and code point counts before each byte, over the batch; a row's own are those less their value at its start.
    units = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts_unit, out=units[1:])
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kinds & FIRST, out=points[1:])
    before = units[edges]
    n = before[1:] - before[:-1]

    marked = np.zeros(len(n), bool)
    marked[sentinels(kinds, edges)[1]] = True
    plain = (n == 0) | marked | (h[2] % 100 >= fim_rate)
    spm = h[3] % 100 < spm_rate
    first, second = h[0] % (n + 1), h[1] % (n + 1)

    def place(unit: np.ndarray) -> np.ndarray:
        """The byte at which a row's unit of this number starts, or at which the row ends."""
        return np.minimum(np.searchsorted(units, before[:-1] + unit + 1) - 1, edges[1:])

    low, high = place(np.minimum(first, second)), place(np.maximum(first, second))
    begin, end = edges[:-1], edges[1:]
    mark = len(data) + SIZE * np.arange(3)
    parts = [(mark[0], begin, low), (mark[1], high, end), (mark[2], low, high)]
    starts, sizes = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
    for order, rows in (((0, 1, 2), ~plain & ~spm), ((1, 0, 2), ~plain & spm)):
        for slot, k in enumerate(order):
            sign, a, b = parts[k]
            starts[rows, 2 * slot], sizes[rows, 2 * slot] = sign, SIZE
            starts[rows, 2 * slot + 1], sizes[rows, 2 * slot + 1] = a[rows], (b - a)[rows]
    starts[plain, 0], sizes[plain, 0] = begin[plain], (end - begin)[plain]
    out = gathered(np.concatenate([data, MARKS]), starts.ravel(), sizes.ravel())
    count = lambda a, b: pa.array(points[b] - points[a], mask=plain)
    forms = pa.DictionaryArray.from_arrays(pa.array(np.where(plain, 0, np.where(spm, 2, 1)).astype(np.int32)), ["plain", "psm", "spm"]).cast(pa.string())
    return {"n": pa.array(n), "form": forms, "prefix_chars": count(begin, low), "middle_chars": count(low, high), "output": strings(out, sizes.sum(axis=1))}


def restore(column: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that outputs of these forms came from; null or plain outputs are their own."""
    data, edges = utf8(column)
    at, row = sentinels(CLASS[data], edges)
    made = np.asarray(forms.fill_null("plain").to_pylist(), object)
    plain = made == "plain"
    at = at[~plain[row]].reshape(-1, 3) if len(at) else np.empty((0, 3), np.int64)
    rows = np.flatnonzero(~plain)
    starts, sizes = np.zeros((len(plain), 3), np.int64), np.zeros((len(plain), 3), np.int64)
    starts[plain, 0], sizes[plain, 0] = edges[:-1][plain], np.diff(edges)[plain]
    ends = np.column_stack([at[:, 1:], edges[1:][rows]]) if len(rows) else at
    # Places of prefix, middle and suffix among an output's three parts.
    order = np.where((made[rows] == "psm")[:, None], [[0, 2, 1]], [[1, 2, 0]])
    starts[rows] = np.take_along_axis(at + SIZE, order, 1)
    sizes[rows] = np.take_along_axis(ends - at - SIZE, order, 1)
    return strings(gathered(data, starts.ravel(), sizes.ravel()), sizes.sum(axis=1))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """Per row: id_col, n (units), form (plain, psm or spm), prefix_chars, middle_chars, and output, the text in that form."""
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), *hash_parts(id_col, seed))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            h = [part.column(f"h{i}").to_numpy() for i in range(1, 5)]
            done = transform(part.column("text"), h, fim_rate, spm_rate)
            yield pa.RecordBatch.from_arrays([part.column("key"), *done.values()], ["key", *done])

    fields = "n long, form string, prefix_chars long, middle_chars long, output string"
    return source.mapInArrow(run, with_fields(source.select("key"), fields)).withColumnRenamed("key", id_col)


def restored(rows: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """rows with one more column, the text rebuilt from the output and the form alone."""
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(output_col).alias("output"), F.col(form_col).alias("form"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "output"):
            yield pa.RecordBatch.from_arrays([part.column("row"), restore(part.column("output"), part.column("form"))], ["row", "restored"])

    done = packed.mapInArrow(run, with_fields(packed.select("row"), "restored string"))
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in rows.columns), F.col("restored").alias(name))


def query(spark, sf_dir: str) -> DataFrame:
    done = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The same cuts by lists of lines; the restored text is the text itself.
SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as x from documents
), h as (
  select *, len(u) as n, cast('0x' || substr(x, 1, 8) as ubigint) as h1, cast('0x' || substr(x, 9, 8) as ubigint) as h2, cast('0x' || substr(x, 25, 8) as ubigint) as h4 from d
), c as (
  select *, cast(least(h1 % (n + 1), h2 % (n + 1)) as bigint) as a, cast(greatest(h1 % (n + 1), h2 % (n + 1)) as bigint) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from h
), p as (
  select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p
"""
