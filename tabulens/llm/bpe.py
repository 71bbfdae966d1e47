"""BPE encoding and decoding (op6).

Encoding is the backtracking method: an Aho-Corasick automaton over the vocabulary gives the longest token at each
offset, a pair-compatibility table says whether two neighbours survive the merges side by side, and the encoder walks
forward, falling back to shorter tokens where a pair is not compatible. Offsets that proved dead are remembered, so
each is tried once and the work is linear in the text. Decoding gathers bytes through an offset table.

Defined results: a null text is the empty text; the empty text has no ids; the strings of added tokens in a text
become their ids; texts of any length are encoded whole. Rows are independent, so repeated rows and ties don't matter.
"""

from __future__ import annotations

import functools
import json
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import slices, table, texts, with_fields

TOKENIZER = "byte_bpe_50k.json"

#: Fixed value: the pattern that byte-level BPE vocabularies of this family split text with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces that a worker remembers, and the longest of them.
CACHE_PIECES, CACHE_CHARS = 300_000, 40
#: Pairs of tokens whose compatibility a worker remembers (some 150 bytes each).
CACHE_PAIRS = 300_000
#: Bytes of text that are decoded at a time: the table of their bytes' places takes 16 times as much.
DECODED_BYTES = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class BacktrackingBPE:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer or a prefix space is supported")
        to_byte = {c: chr(b) for b, c in enumerate(byte_chars())}
        raw = lambda s: "".join(map(to_byte.__getitem__, s))  # noqa: E731  bytes as Latin-1 characters
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]

        # Inside, tokens are numbered in the order in which merges form them.
        names = [chr(b) for b in range(256)]
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        place = {s: i for i, s in enumerate(names)}
        ids = [vocab[byte_chars()[b]] for b in range(256)]
        for left, right in merges:
            a, b, whole = place[raw(left)], place[raw(right)], raw(left + right)
            if whole in place:
                self.joined.setdefault((a, b), place[whole])
                continue
            place[whole] = self.joined[a, b] = len(names)
            names.append(whole)
            self.halves.append((a, b))
            ids.append(vocab[left + right])
        self.ids, self.sizes = ids, [len(s) for s in names]
        self.shorter = [next((place[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in place), -1) for s in names]
        self.machine = ahocorasick.Automaton()
        for i, s in enumerate(names):
            self.machine.add_word(s, (i, len(s)))
        self.machine.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}

        added = spec.get("added_tokens") or []
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        self.added = {t["content"]: np.array([t["id"]], np.int32).tobytes() for t in added}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}

        # The offset table: the bytes of id i are buffer[start[i]:start[i] + length[i]].
        n = max([*ids, *(t["id"] for t in added)]) + 1
        by_id = {ids[i]: s.encode("latin-1") for i, s in enumerate(names)} | {t["id"]: t["content"].encode() for t in added}
        strings = [by_id.get(i, b"") for i in range(n)]
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.buffer = np.frombuffer(b"".join(strings), np.uint8)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side.

        The one formed later is undone again and again; if the inner neighbours would have joined before it formed,
        the pair can't stand. At equal rank the left merge comes first.
        """
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        x, y, before, ok = a, b, sys.maxsize, True
        while ok:
            ok = self.joined.get((x, y), before) >= before
            if x < 256 and y < 256:
                break
            if x > y:
                before, x = x, self.halves[x][1]
            else:
                before, y = y + 1, self.halves[y][0]
        if len(self.compatible) < CACHE_PAIRS:
            self.compatible[a, b] = ok
        return ok

    def encode_piece(self, raw: str) -> list[int]:
        """Tokens (in merge order) of one piece, given as Latin-1 characters."""
        longest = [0] * len(raw)
        for end, (token, size) in self.machine.iter(raw):  # ends ascend, so the longest of an offset comes last
            longest[end - size + 1] = token
        sizes, shorter, fits = self.sizes, self.shorter, self.fits
        out: list[int] = []
        dead: set[int] = set()
        at, n, token = 0, len(raw), longest[0]
        while True:
            end = at + sizes[token]
            if end not in dead and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]

    def _missed(self, piece: str) -> bytes:
        ids = self.ids
        packed = np.array([ids[t] for t in self.encode_piece(piece.encode().decode("latin-1"))], np.int32).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit integers."""
        if self.added_split is not None and any(t in text for t in self.added):
            return b"".join(self.added[p] if p in self.added else self._plain(p) for p in self.added_split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known, missed = self.cache.get, self._missed
        return b"".join([known(p) or missed(p) for p in self.pieces(text)])

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """Texts of the id runs ids[edges[i]:edges[i + 1]]; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        where = np.repeat(self.start[ids] - (ends - sizes), sizes)
        where += np.arange(len(where))
        data = self.buffer[where].tobytes()
        at = np.concatenate([[0], ends])[edges].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


@functools.lru_cache(maxsize=4)
def load(path: str) -> BacktrackingBPE:
    """The vocabulary at path, for use outside of Spark's workers."""
    return BacktrackingBPE(path)


class Tokenizer:
    """The vocabulary at path, which a worker reads when it first encodes with it.

    It is a broadcast's value: workers stay for the stages that follow, and Spark takes a broadcast, and with it the tables
    and the remembered pieces, from a worker whose next task doesn't use it.
    """

    def __init__(self, path: str):
        self.path = path

    def __reduce__(self):
        return Tokenizer, (self.path,)

    @functools.cached_property
    def bpe(self) -> BacktrackingBPE:
        return BacktrackingBPE(self.path)


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, ids (array of int) of the whole text, and decoded, the text that these ids give back."""
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(tokenizer))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value.bpe
        for part in slices(batches, "text", DECODED_BYTES):
            packed = [bpe.encode(t) for t in texts(part, "text")]
            ids = np.frombuffer(b"".join(packed), np.int32)
            edges = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("key"), lists, pa.array(bpe.decode(ids, edges), pa.string())], ["key", "ids", "decoded"])

    return source.mapInArrow(run, with_fields(source.select("key"), "ids array<int>, decoded string")).withColumnRenamed("key", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    done = encode_and_decode(table(spark, sf_dir, "documents"), default_path())
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
