"""Language-model scoring by context-tree weighting (op9).

A text's bytes (A-Z lowered, one end mark after them) are each decomposed into eight binary decisions. Every decision
has a context tree over the DEPTH bytes before it; all depths are mixed by the weights that the Krichevsky-Trofimov
block probabilities of the training texts give them. The code length of a byte is then a function of the DEPTH + 1
bytes that end there, so the model is a table of such n-grams, built and looked up with shuffles, never broadcast:

1. Texts are packed in blocks of about BLOCK_BYTES. A block lists its distinct n-grams with their counts in training
   texts, sorted, packed and dealt to shards by a hash of their HEAD latest context bytes, and its distinct tokens, by
   a hash of theirs. The lists of n-grams are kept by shard, for both visits to it; those that a block needs to score its
   texts follow from the block alone and are made anew there.
   A block sends at most FAN lists: where there are more shards, a list goes to a range of shards, and a node of the
   exchange merges those of about FAN blocks and sends at most FAN lists on, until a list has one shard (Route). So
   the number of lists is that of blocks times FAN times the levels, and grows with the input times its logarithm.
2. A shard merges what all blocks sent it. It holds whole subtrees, which settle the depths from HEAD down. The nodes of
   depth HEAD go, packed, to groups by their two latest bytes, which settle the depths from two to HEAD; depths 0 and 1
   have at most 65 792 nodes, which Spark sums and all tasks share. On the way back each node of depth HEAD gets the
   linear function that the depths above it make of its chance.
3. A second visit to the shards answers each block with the log probabilities of its n-grams (to 16 bits behind the
   leading one), in the order in which it sent them; a shard of tokens answers with counts. The block scores its texts.

What is shuffled are the distinct n-grams of each block, at about two bytes on the way there and three on the way back,
and its distinct tokens: they grow with the input. There is a shard for each SHARD_BYTES of text. Answers go back the
way the lists came. A node that the training texts never reached passes its decision to the node above it.

Defined results: a null text is the empty text, whose only token and symbol is the end. The base score and the model
read all training texts. Without training texts every count is 0 and each decision has probability one half. Rows are
scored on their own; repeated rows get equal results; a null id is a training row.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import cut, id_remainder, shared_dir, slices, table, texts

#: An n-gram of DEPTH context bytes and the symbol fills a 64-bit number.
DEPTH, HEAD = 7, 4
BLOCK_BYTES, SHARD_BYTES = 14 << 20, 8 << 20
#: Bytes of text that are listed, and that are looked up, at a time.
SLICE_BYTES, LOOKUP_BYTES = 1 << 19, 1 << 19
#: Lists that a block, or a node of the exchange, sends at most.
FAN = 256
#: Passes in which a block lists its n-grams; each holds its share of them.
PASSES = 3
#: Groups of the nodes of depth HEAD.
MIDDLE = 64
#: N-grams that a shard gathers before it merges them.
MERGE_ROWS = 1 << 22
#: No byte of UTF-8; it stands before and after a text.
END = 0xFF
#: The end as a token; no word can be empty.
END_TOKEN = b""

PAYLOAD, GRAM, TOKEN, ANSWER = 0, 1, 2, 3
#: steps and counts of a list of n-grams.
LIST = (np.uint64, np.int64)
#: key, total, ones and weighted log probability of nodes.
NODES = (np.uint64, np.int64, np.int64, np.float64)


@dataclass(frozen=True)
class Route:
    """The way of lists from blocks to shards: at level k a list is for a range of fan**(levels - k) shards, its region, and
    the lists of about fan**k blocks, a chunk, are merged in a region. At the last level a region is a shard."""

    blocks: int
    shards: int
    fan: int

    @property
    def levels(self) -> int:
        found = 1
        while self.fan**found < self.shards:
            found += 1
        return found

    def width(self, level: int) -> int:
        return self.fan ** (self.levels - level)

    def chunk(self, block: str) -> int:
        """The chunk of a block at the first level; at the next one it is that divided by fan."""
        return zlib.crc32(block.encode()) % -(-self.blocks // self.fan) if self.levels > 1 else 0


#: A list: the region and chunk that it goes to, the block or node that it comes from.
LISTED = "shard int, chunk int, block string, kind byte, blob binary"


def listed(shards: list[int], chunk: int, block: str, kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(shards)
    return pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int32()), "chunk": pa.array([chunk] * n, pa.int32()), "block": pa.array([block] * n, pa.string()), "kind": pa.array([kind] * n, pa.int8()), "blob": pa.array(blobs, pa.binary())})


def node_name(shard: int, chunk: int) -> str:
    return f"{shard}.{chunk}"


def to_nodes(answers: DataFrame) -> DataFrame:
    """Answers (block, shard, blob) to nodes as rows of LISTED for the region and chunk of their node; part: the region that answers."""
    place = F.split("block", "[.]")
    return answers.select(place[0].cast("int").alias("shard"), place[1].cast("int").alias("chunk"), "block", F.lit(ANSWER).cast("byte").alias("kind"), "blob", F.col("shard").alias("part"))


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length as bytes, like bytes of all values side by side, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays that packed() was given, of these kinds."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(data) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


def steps(codes: np.ndarray) -> np.ndarray:
    """Sorted codes as differences, which pack better."""
    return np.diff(codes, prepend=np.uint64(0))


def symbols(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code of the n-gram that ends at each symbol of each text, text after text; the symbols of each text.

    A code has the latest context byte on top, older ones below it, and the symbol at the bottom.
    """
    pad = bytes([END]) * DEPTH
    x = bytes(8) + b"".join([part for t in batch for part in (pad, t, pad[:1])])
    n = np.array([len(t) + 1 for t in batch])
    inside = np.ones(len(x) - 8, bool)
    starts = np.cumsum(n + DEPTH) - n - DEPTH
    for k in range(DEPTH):
        inside[starts + k] = False
    windows = np.ndarray((len(x) - 8,), "<u8", x, 1, (1,))[inside]  # the eight bytes up to each one, the last on top
    older = np.uint64(8 * (8 - DEPTH))
    return ((windows << np.uint64(8)) >> older) << np.uint64(8) | windows >> np.uint64(56), n


def merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and the sums of their counts."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, int)
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def by_region(codes: np.ndarray, route: Route, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted codes: their places, in the order of region, then code; the regions that have any, and where each one's end."""
    if not len(codes):
        return (np.empty(0, np.int64),) * 3
    head = codes >> np.uint64(8 * (DEPTH + 1 - HEAD))
    starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    sizes = np.diff(starts, append=len(codes))
    shard = (((head[starts] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(route.shards)).astype(np.int64)
    region = shard // route.width(level)
    order = np.argsort(region, kind="stable")
    region, starts, own = region[order], starts[order], sizes[order]
    last = np.flatnonzero(np.concatenate([region[1:] != region[:-1], [True]]))
    return np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(len(codes)), region[last], np.cumsum(own)[last]


def gram_parts(codes: np.ndarray, counts: np.ndarray, route: Route, level: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Regions of a level, and the lists of n-grams and counts for them, some at a time."""
    order, regions, ends = by_region(codes, route, level)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for a in range(0, len(regions), 256):
        own = [order[i:j] for i, j in zip(starts[a : a + 256], ends[a : a + 256], strict=True)]
        yield regions[a : a + 256].tolist(), [packed(steps(codes[x]), counts[x].astype(np.int64)) for x in own]


def normal(text: str) -> bytes:
    """The text's bytes with A-Z lowered."""
    return text.encode().lower()


def blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """(block, blob) for batches of (key, text, train): the rows of a block of about block_bytes, compressed."""

    def closed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema) as out:
            for part in parts:
                out.write_batch(part)
        blob = zstandard.ZstdCompressor(level=5).compress(sink.getvalue())
        return pa.RecordBatch.from_pydict({"block": [uuid.uuid4().hex], "blob": pa.array([blob], pa.binary())})

    parts, size = [], 0
    for part in slices(batches, "text", SLICE_BYTES):
        parts.append(part)
        size += part.column("text").nbytes
        if size >= block_bytes:
            yield closed(parts)
            parts, size = [], 0
    if parts:
        yield closed(parts)


def opened(blob: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of a block, some texts at a time."""
    return iter(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)))


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, and how often they occur; sorts codes in place."""
    codes.sort()
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
    return codes[starts], np.diff(starts, append=len(codes))


def distinct_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of a block, and their counts in training texts; in PASSES by the latest context byte, to hold a share of them at a time."""
    seen = {True: np.zeros(256, np.int64), False: np.zeros(256, np.int64)}
    parts = []
    for part in opened(blob):
        train = part.column("train").to_numpy(zero_copy_only=False)
        batch = [normal(t) for t in texts(part, "text")]
        parts.append((batch, train))
        for own, n in seen.items():
            some = [t for t, learned in zip(batch, train.tolist(), strict=True) if learned == own]
            n += np.bincount(np.frombuffer(b"".join(some), np.uint8), minlength=256)
            n[END] += len(some)
    total = np.cumsum(seen[True] + seen[False])
    bounds = sorted({0, 256, *(int(np.searchsorted(total, total[-1] * k // PASSES)) + 1 for k in range(1, PASSES))})
    codes, counts = [], []
    for low, high in zip(bounds, bounds[1:], strict=False):
        every, at = {own: np.empty(int(n[low:high].sum()), np.uint64) for own, n in seen.items()}, {True: 0, False: 0}
        wanted = np.zeros(256, bool)
        wanted[low:high] = True
        for batch, train in parts:
            own_codes, n = symbols(batch)
            inside = wanted[(own_codes >> np.uint64(8 * DEPTH)).astype(np.uint8)]
            own_codes, learned = own_codes[inside], np.repeat(train, n)[inside]
            for own, some in ((True, own_codes[learned]), (False, own_codes[~learned])):
                every[own][at[own] : at[own] + len(some)] = some
                at[own] += len(some)
        learned, times = distinct(every.pop(True))
        found = distinct(np.concatenate([learned, distinct(every.pop(False))[0]]))[0]
        count = np.zeros(len(found), np.uint32)
        count[np.searchsorted(found, learned)] = times
        codes.append(found)
        counts.append(count)
    return np.concatenate(codes), np.concatenate(counts)


def kept_by_region(lists: DataFrame, *keys: str) -> DataFrame:
    """The lists, each region in one partition, written to the shared folder: both visits to a region read them there, so a block lists its n-grams once for both."""
    spark = lists.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # A checkpoint of an adaptive plan forgets how its rows are dealt, and each visit would shuffle them again.
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return lists.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def gram_lists(held: DataFrame, route: Route) -> DataFrame:
    """LISTED: the n-grams, as steps, that each block sends to each region of the first level, and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                for regions, blobs in gram_parts(*distinct_grams(blob), route, 1):
                    yield listed(regions, route.chunk(name), name, GRAM, blobs)

    return held.mapInArrow(run, LISTED)


def grams_sent_on(lists: DataFrame, route: Route, level: int, merge_rows: int) -> DataFrame:
    """LISTED: the lists that nodes of a level, each a region and chunk, make for the regions of the next one."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, chunk = (k.as_py() for k in key)
        found = gathered((x for b in batches for x in b.column("blob").to_pylist()), merge_rows)
        for regions, blobs in gram_parts(*found, route, level + 1):
            yield listed(regions, chunk // route.fan, node_name(region, chunk), GRAM, blobs)

    return lists.groupBy("shard", "chunk").applyInArrow(run, LISTED)


def gram_answers(lists: DataFrame, answers: DataFrame, route: Route, level: int, merge_rows: int) -> DataFrame:
    """(block, shard, blob): what nodes of a level answer the lists that they got, from the answers to theirs."""

    def run(own: pa.Table, below: pa.Table) -> pa.Table:
        below = below.sort_by("part")
        blobs = own.column("blob").to_pylist()
        codes, _ = gathered(blobs, merge_rows)
        value = np.empty((3, len(codes)), np.uint8)
        order = by_region(codes, route, level + 1)[0]
        value[:, order] = np.concatenate([unpacked(b, np.uint8, np.uint8, np.uint8) for b in below.column("blob").to_pylist()], axis=1)
        return answered(own, codes, value)

    both = lists.groupBy("shard", "chunk").cogroup(to_nodes(answers).groupBy("shard", "chunk"))
    return both.applyInArrow(run, "block string, shard int, blob binary")


def answered(lists: pa.Table, codes: np.ndarray, value: np.ndarray) -> pa.Table:
    """(block, shard, blob) for lists of n-grams among the sorted codes, whose values are three rows of bytes."""
    found = [packed(*value[:, np.searchsorted(codes, np.cumsum(unpacked(b, *LIST)[0], dtype=np.uint64))]) for b in lists.column("blob").to_pylist()]
    return pa.table({"block": lists.column("block"), "shard": lists.column("shard"), "blob": pa.array(found, pa.binary())})


def counted_tokens(blob: bytes) -> Counter:
    """The distinct tokens of a block, and their counts in training texts."""
    seen: Counter = Counter()
    for part in opened(blob):
        for t, train in zip(texts(part, "text"), part.column("train").to_pylist(), strict=True):
            words = normal(t).split()
            if train:
                seen.update(words)
                seen[END_TOKEN] += 1
            else:
                for w in {END_TOKEN, *words}:
                    seen[w] += 0
    return seen


def packed_tokens(counts: dict[bytes, int], words: list[bytes]) -> bytes:
    """Words and their counts, compressed; a token holds no blank, so blanks join them."""
    joined = b" ".join(words)
    values = np.array([counts[w] for w in words], np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(joined).to_bytes(8, "little") + joined + values)


def unpacked_tokens(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    end = 8 + int.from_bytes(data[:8], "little")
    planes = np.frombuffer(data, np.uint8, offset=end).reshape(8, -1)
    return data[8:end].split(b" "), np.ascontiguousarray(planes.T).view(np.int64).ravel()


def token_parts(counts: dict[bytes, int], route: Route, level: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Regions of a level, and the lists of tokens for them, some at a time."""
    own: dict[int, list[bytes]] = {}
    for w in sorted(counts):
        own.setdefault(zlib.crc32(w) % route.shards // route.width(level), []).append(w)
    regions = list(own)
    for a in range(0, len(regions), 256):
        yield regions[a : a + 256], [packed_tokens(counts, own[r]) for r in regions[a : a + 256]]


def summed_tokens(blobs: Iterable[bytes]) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for blob in blobs:
        words, counts = unpacked_tokens(blob)
        for w, k in zip(words, counts.tolist(), strict=True):
            total[w] = total.get(w, 0) + k
    return total


def token_counts(held: DataFrame, route: Route) -> tuple[DataFrame, int, int]:
    """(block, shard, blob): the tokens that a block has of a region, and their counts in all training texts; the number of
    tokens and of distinct ones in the training texts."""

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                for regions, blobs in token_parts(counted_tokens(blob), route, 1):
                    yield listed(regions, route.chunk(name), name, TOKEN, blobs)

    def sent_on(level: int):
        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            region, chunk = (k.as_py() for k in key)
            total = summed_tokens(x for b in batches for x in b.column("blob").to_pylist())
            for regions, blobs in token_parts(total, route, level + 1):
                yield listed(regions, chunk // route.fan, node_name(region, chunk), TOKEN, blobs)

        return run

    def filled(own: pa.Table, total: dict[bytes, int], facts: bool) -> pa.Table:
        blobs = [packed_tokens(total, unpacked_tokens(x)[0]) for x in own.column("blob").to_pylist()]
        tokens, kinds = np.zeros(len(blobs), np.int64), np.zeros(len(blobs), np.int64)
        if facts:
            tokens[0], kinds[0] = sum(total.values()), sum(map(bool, total.values()))
        return pa.table([own.column("block"), own.column("shard"), pa.array(blobs, pa.binary()), pa.array(tokens), pa.array(kinds)], names=["block", "shard", "blob", "tokens", "kinds"])

    def at_shard(group: pa.Table) -> pa.Table:
        return filled(group, summed_tokens(group.column("blob").to_pylist()), True)

    def at_node(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        below = group.filter(pa.array(kind == ANSWER))
        return filled(group.filter(pa.array(kind == TOKEN)), summed_tokens(below.column("blob").to_pylist()), False)

    kinds = "block string, shard int, blob binary, tokens long, kinds long"
    sent = [held.mapInArrow(lists, LISTED)]
    for level in range(1, route.levels):
        sent.append(cut(sent[-1].groupBy("shard", "chunk").applyInArrow(sent_on(level), LISTED), "ctw-token-lists"))
    found = cut(sent[-1].groupBy("shard").applyInArrow(at_shard, kinds), "ctw-tokens")
    facts = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "kinds"))).first()
    answers = found.select("block", "shard", "blob")
    for level in range(route.levels - 1, 0, -1):
        both = sent[level - 1].withColumn("part", F.lit(None).cast("int")).unionByName(to_nodes(answers))
        answers = both.groupBy("shard", "chunk").applyInArrow(at_node, kinds).select("block", "shard", "blob")
    return answers, facts["tokens"], facts["kinds"]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x >= 0.5, by Stirling's series past 8."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        small = x < 8
        shift[small] += np.log(x[small])
        x[small] += 1
    inverse = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - inverse * (1 / 360 - inverse / 1260)) / x - shift


#: log_gamma of n + 1/2 and of n + 1 for small n.
HALVES, WHOLES = log_gamma(np.arange(4096) + 0.5), log_gamma(np.arange(4096) + 1.0)


def looked_up(n: np.ndarray, of: np.ndarray, shift: float) -> np.ndarray:
    out = of.take(n, mode="clip")
    if n.size and n.max() >= len(of):
        large = n >= len(of)
        out[large] = log_gamma(n[large] + shift)
    return out


def block_probability(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    return looked_up(a, HALVES, 0.5) + looked_up(b, HALVES, 0.5) - looked_up(a + b, WHOLES, 1.0) - np.log(np.pi)


def mixed_with(deeper: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted log probability of nodes, given the sum over their children; the weight of stopping there."""
    own = block_probability(a, b)
    less = np.exp(-np.abs(deeper - own))
    return np.maximum(own, deeper) + np.log((1 + less) / 2), np.where(deeper > own, less, 1.0) / (1 + less)


def lifted(deepest: tuple, depth: int, top: int) -> dict[int, tuple]:
    """Levels from depth up to top, each (keys, place, total, ones, stop, weighted); a key is context, latest byte on top, then node."""
    levels = {depth: deepest}
    for k in range(depth - 1, top - 1, -1):
        below, place, total, b, _, value = levels[k + 1]
        keys, at = np.unique((below >> 16) << 8 | below & 0xFF, return_inverse=True)
        total, b = np.bincount(at, total, len(keys)), np.bincount(at, b, len(keys))
        weighted, stop = mixed_with(np.bincount(at, value, len(keys)), total - b, b)
        levels[k] = keys, at[place], total, b, stop, weighted
    return levels


def coefficients(levels: dict[int, tuple], depth: int, upper: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """a and b for each node of depth, such that the chance x of a one there is a + b * x after all depths above; levels: from depth up to two."""
    keys, _, total, *_ = levels[depth]
    latest, node = (keys >> (8 * depth)).astype(np.int64), (keys & 0xFF).astype(np.int64)
    fixed, share, reached = np.zeros(len(keys)), np.ones(len(keys)), total > 0
    for k in range(depth - 1, -1, -1):
        if k >= 2:
            _, place, total, b, stop, _ = levels[k]
            total, b, stop = total[place], b[place], stop[place]
        else:
            total, b, stop = (x[latest if k else 0, node] for x in upper[k])
        own = (b + 0.5) / (total + 1.0)
        fixed = np.where(reached, stop * own + (1 - stop) * fixed, own)
        share = np.where(reached, (1 - stop) * share, 0.0)
        reached = total > 0
    return fixed, share


class Subtree:
    """The n-grams of whole subtrees from depth top down, and what follows for one bit of the symbol at a time.

    At each depth the pairs of context and symbol are sorted, so the nodes of a bit, which are contexts with the bits of
    the symbol before it, are runs of them.
    """

    def __init__(self, codes: np.ndarray, cnt: np.ndarray, top: int = HEAD):
        """codes: sorted and distinct."""
        self.top, self.pairs, self.cnt, self.up = top, {DEPTH: codes}, {DEPTH: cnt.astype(np.int64)}, {}
        for k in range(DEPTH - 1, top - 1, -1):
            below = self.pairs[k + 1]
            pairs, up = np.unique((below >> 16) << 8 | below & 0xFF, return_inverse=True)
            self.pairs[k], self.up[k + 1] = pairs, up.astype(np.int32)
            self.cnt[k] = np.bincount(up, self.cnt[k + 1], len(pairs)).astype(np.int64)

    def levels(self, j: int) -> dict[int, tuple]:
        """Of bit j, from DEPTH to top: the first pair of each node, the node of each pair, total, ones, stop weight and weighted log probability of each node."""
        out: dict[int, tuple] = {}
        for k in range(DEPTH, self.top - 1, -1):
            prefix = self.pairs[k] >> np.uint64(8 - j)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            first, run = np.flatnonzero(new), (np.cumsum(new) - 1).astype(np.int32)
            total = np.add.reduceat(self.cnt[k], first)
            ones = np.add.reduceat(np.where(self.pairs[k] & np.uint64(1 << (7 - j)), self.cnt[k], 0), first)
            if k == DEPTH:
                weighted, stop = block_probability(total - ones, ones), np.ones(len(first))
            else:
                below, deeper = out[k + 1][0], out[k + 1][5]
                weighted, stop = mixed_with(np.bincount(run[self.up[k + 1][below]], deeper, len(first)), total - ones, ones)
            out[k] = first, run, total, ones, stop, weighted
        return out

    def keys(self, j: int, pairs: np.ndarray) -> np.ndarray:
        """Contexts with the node of bit j below them."""
        return (pairs >> 8) << 8 | np.uint64(1 << j) | (pairs & 0xFF) >> np.uint64(8 - j)

    def heads(self) -> list[np.ndarray]:
        """key, total, ones and weighted log probability of each node of depth top."""
        found = []
        for j in range(8):
            first, _, total, ones, _, weighted = self.levels(j)[self.top]
            found.append((self.keys(j, self.pairs[self.top][first]), total, ones, weighted))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def carried(self, keys: np.ndarray, fixed: np.ndarray, share: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's byte, given the coefficients of the nodes of depth top, by sorted key."""
        out = np.zeros(len(self.pairs[DEPTH]))
        for j in range(8):
            levels, place = self.levels(j), np.arange(len(out), dtype=np.int32)
            one, reached = None, None
            for k in range(DEPTH, self.top - 1, -1):
                _, run, total, ones, stop, _ = levels[k]
                way = run[place]
                own = ((ones + 0.5) / (total + 1.0))[way]
                if one is not None:
                    stop = stop[way]
                    own = np.where(reached, stop * own + (1 - stop) * one, own)
                one, reached = own, (total > 0)[way]
                place = self.up[k][place] if k > self.top else place
            first = levels[self.top][0]
            at = np.searchsorted(keys, self.keys(j, self.pairs[self.top][first]))[way]
            one = fixed[at] + share[at] * one
            bit = (self.pairs[DEPTH] & np.uint64(1 << (7 - j))) > 0
            out += np.log10(np.where(bit, one, 1 - one))
        return out


def upper_levels(rows: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Totals, ones and stop weights of depths 0 and 1, from rows (context byte, node, total, ones, sum of the weighted log probabilities of depth 2)."""
    total, ones, deeper = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        total[r.latest, r.node], ones[r.latest, r.node], deeper[r.latest, r.node] = r.total, r.ones, r.weighted
    weighted, stop = mixed_with(deeper, total - ones, ones)
    weighted[total == 0] = 0.0
    top, top_ones = total.sum(axis=0, keepdims=True), ones.sum(axis=0, keepdims=True)
    return [(top, top_ones, mixed_with(weighted.sum(axis=0, keepdims=True), top - top_ones, top_ones)[1]), (total, ones, stop)]


def gathered(blobs: Iterable[bytes], merge_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of packed lists, and the sums of their counts; merged whenever merge_rows are held."""
    codes, counts, held = [], [], 0
    for blob in blobs:
        own, cnt = unpacked(blob, *LIST)
        codes.append(np.cumsum(own, dtype=np.uint64))
        counts.append(cnt)
        held += len(own)
        if held >= merge_rows:
            found = merged(np.concatenate(codes), np.concatenate(counts))
            codes, counts, held = [found[0]], [found[1]], 0
    return merged(np.concatenate(codes), np.concatenate(counts))


def middle_group(keys: np.ndarray) -> np.ndarray:
    """The group of nodes of depth HEAD, by their two latest bytes."""
    return ((keys >> np.uint64(8 * (HEAD - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(MIDDLE)


def gram_values(held: DataFrame, route: Route, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """(block, shard, blob): the log10 probabilities of a block's n-grams, in the order in which it sent them."""
    sent = [kept_by_region(gram_lists(held, route), *(["shard", "chunk"] if route.levels > 1 else ["shard"]))]
    for level in range(1, route.levels):
        sent.append(cut(grams_sent_on(sent[-1], route, level, merge_rows), "ctw-lists"))

    def heads_of(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = Subtree(*gathered((x for b in batches for x in b.column("blob").to_pylist()), merge_rows)).heads()
        order = np.lexsort((nodes[0], group := middle_group(nodes[0])))
        nodes, cuts = [x[order] for x in nodes], np.bincount(group.astype(np.int64), minlength=MIDDLE)
        ends = np.cumsum(cuts)
        full = np.flatnonzero(cuts)
        own = [[x[ends[m] - cuts[m] : ends[m]] for x in nodes] for m in full]
        blobs = [packed(steps(k), total, ones, weighted) for k, total, ones, weighted in own]
        shard = [key[0].as_py()] * len(full)
        yield pa.RecordBatch.from_pydict({"middle": pa.array(full, pa.int32()), "shard": pa.array(shard, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    heads = cut(sent[-1].groupBy("shard").applyInArrow(heads_of, "middle int, shard int, blob binary"), "ctw-heads")

    def middle(blobs: list[bytes]) -> tuple[dict[int, tuple], np.ndarray, list[int]]:
        """The levels from HEAD to two, the order that sorts the nodes of the blobs, and the number of nodes of each blob."""
        parts = [unpacked(b, *NODES) for b in blobs]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        order = np.argsort(keys)
        total, ones, weighted = (np.concatenate([p[k] for p in parts])[order] for k in (1, 2, 3))
        return lifted((keys[order], np.arange(len(keys)), total, ones, np.ones(len(keys)), weighted), HEAD, 2), order, [len(p[0]) for p in parts]

    def depth_two(group: pa.Table) -> pa.Table:
        keys, _, total, b, _, weighted = middle(group.column("blob").to_pylist())[0][2]
        return pa.table({"latest": pa.array((keys >> 16).astype(np.int32)), "node": pa.array((keys & 0xFF).astype(np.int32)), "total": total, "ones": b, "weighted": weighted})

    nodes = heads.groupBy("middle").applyInArrow(depth_two, "latest int, node int, total double, ones double, weighted double")
    upper = upper_levels(nodes.groupBy("latest", "node").agg(*(F.sum(c).alias(c) for c in ("total", "ones", "weighted"))).collect())

    def carry(group: pa.Table) -> pa.Table:
        levels, order, sizes = middle(group.column("blob").to_pylist())
        found = levels[HEAD][0], *coefficients(levels, HEAD, upper)
        keys, fixed, share = (np.empty_like(x) for x in found)
        for out, x in zip((keys, fixed, share), found, strict=True):
            out[order] = x
        ends = np.cumsum(sizes)
        blobs = [packed(steps(keys[e - n : e]), fixed[e - n : e], share[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
        return pa.table({"shard": group.column("shard"), "blob": pa.array(blobs, pa.binary())})

    carried = heads.groupBy("middle").applyInArrow(carry, "shard int, blob binary")

    def values(own: pa.Table, above: pa.Table) -> pa.Table:
        parts = [unpacked(b, np.uint64, np.float64, np.float64) for b in above.column("blob").to_pylist()]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        order = np.argsort(keys)
        codes, cnt = gathered(own.column("blob").to_pylist(), merge_rows)
        value = Subtree(codes, cnt).carried(keys[order], *(np.concatenate([p[k] for p in parts])[order] for k in (1, 2)))
        return answered(own, codes, rounded(value))

    answers = sent[-1].groupBy("shard").cogroup(carried.groupBy("shard")).applyInArrow(values, "block string, shard int, blob binary")
    for level in range(route.levels - 1, 0, -1):
        answers = gram_answers(sent[level - 1], answers, route, level, merge_rows)
    return answers


def rounded(values: np.ndarray) -> np.ndarray:
    """Three rows of bytes, the upper ones of each value as a 32-bit number, rounded to 16 bits behind the leading one."""
    bits = values.astype("<f4").view(np.uint32) + np.uint32(0x80)
    return np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 4)[:, 1:].T)


def restored(blob: bytes) -> np.ndarray:
    """The values of packed(*rounded(values))."""
    planes = unpacked(blob, np.uint8, np.uint8, np.uint8)
    bits = np.zeros((len(planes[0]), 4), np.uint8)
    for k, plane in enumerate(planes, 1):
        bits[:, k] = plane
    return bits.view("<f4").ravel()


def score_block(group: pa.Table, route: Route) -> pa.Table:
    """Scores of the texts of one block, from its rows (block, kind, shard, blob): its texts, and the answers of all regions."""
    kind, shard = group.column("kind").to_numpy(), group.column("shard").to_numpy()

    def blobs(k: int) -> list[bytes]:
        own = group.filter(pa.array(kind == k)).take(pa.array(np.argsort(shard[kind == k])))
        return own.column("blob").to_pylist()

    (payload,) = blobs(PAYLOAD)
    known_codes = distinct_grams(payload)[0]
    grams = np.empty(len(known_codes), np.float32)
    grams[by_region(known_codes, route, 1)[0]] = np.concatenate([restored(b) for b in blobs(GRAM)])

    known: dict[bytes, float] = {}
    for words, counts in map(unpacked_tokens, blobs(TOKEN)):
        known.update(zip(words, np.log10(counts + 0.1).tolist(), strict=True))
    unknown, end = float(np.log10(0.1)), known[END_TOKEN]
    keys, rows = [], []
    for batch in opened(payload):
        for part in slices([batch], "text", LOOKUP_BYTES):
            own = [normal(t) for t in texts(part, "text")]
            codes, n = symbols(own)
            order = np.argsort(codes)
            codes = codes[order]
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            bits = np.empty(len(codes))
            bits[order] = np.repeat(grams[np.searchsorted(known_codes, codes[starts])], np.diff(starts, append=len(codes)))
            model = np.add.reduceat(bits, np.cumsum(n) - n)
            keys.append(part.column("key"))
            for data, score, size in zip(own, model.tolist(), n.tolist(), strict=True):
                got = list(map(known.__getitem__, data.split()))
                got.append(end)
                rows.append((len(got), len(got) - got.count(unknown), sum(got), score, size))
    columns = zip(*rows, strict=True)
    kinds = pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()
    return pa.table([pa.chunked_array(keys), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["key", "n_tokens", "n_known", "raw", "score", "n_symbols"])


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, merge_rows: int = MERGE_ROWS, fan: int = FAN) -> DataFrame:
    """Per row: id_col, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (the end mark is a byte). The rows that train admits are learned from; all are scored.

    Texts go into blocks of about block_bytes, n-grams to shards of about shard_bytes of text, and a shard merges its lists
    whenever it holds merge_rows n-grams; a block or node sends at most fan lists. The scores don't depend on these.
    """
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    held = cut(source.mapInArrow(lambda batches: blocks(batches, block_bytes), "block string, blob binary"), "ctw-blocks")
    route = Route(max(1, held.count()), max(1, -(-size // shard_bytes)), fan)
    tokens, n, v = token_counts(held, route)

    def of_kind(df: DataFrame, kind: int, shard: Column) -> DataFrame:
        return df.select("block", F.lit(kind).cast("byte").alias("kind"), shard.cast("int").alias("shard"), "blob")

    rows = of_kind(held, PAYLOAD, F.lit(0)).unionByName(of_kind(gram_values(held, route, merge_rows), GRAM, F.col("shard"))).unionByName(of_kind(tokens, TOKEN, F.col("shard")))
    kind = source.schema["key"].dataType.simpleString()
    found = rows.groupBy("block").applyInArrow(lambda t: score_block(t, route), f"key {kind}, n_tokens long, n_known long, raw double, score double, n_symbols long")
    base = F.col("raw") - F.col("n_tokens") * float(np.log10(n + 0.1 * (v + 1)))
    bits = F.col("score") * (-1 / float(np.log10(2))) / F.col("n_symbols")
    return found.select(F.col("key").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def query(spark, sf_dir: str) -> DataFrame:
    remainder = id_remainder("doc_id", 10)
    scored = score_texts(table(spark, sf_dir, "documents"), remainder != 0)
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
