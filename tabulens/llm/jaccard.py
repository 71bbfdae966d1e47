"""N-gram Jaccard join (op7): documents linked where their word shingle sets have Jaccard similarity of 0.75 or more.

1. Each whole text gives its set of 64-bit shingle hashes. Documents with equal sets collapse into one node, so copies
   cost nothing further. A node's id is the set's 64-bit fingerprint, so keys and signatures go where they are needed
   without a table of nodes that holds them. Each task also counts its shingles in BUCKETS hash buckets; the sums, as powers of two, give
   every shingle a class of frequency in a table of BUCKETS bytes that all tasks share, whatever the input.
2. A node's search keys are its first n // 4 + 1 shingles in the order of class, then hash: under any order that all
   nodes share, two linked sets have one of these in common, and this one puts common passages last. The nodes that
   share a key form a tile, in which they are dealt by bands of like sizes; linked sets are in one band or in adjacent ones.
   What precedes the first key that two sets share is in one of them alone, so a key's place bounds the sizes of the sets
   that it can link its own set with (reach). A tile keeps the members that such a bound admits to another one.
3. Each band of a tile has its smallest node as its pivot. Pivots are compared with the other members and with the next
   band's pivot (pairs grow with the members, not with their square), and the links' components are found by
   alternating stars.
4. In tiles whose members are still in several components, the members outside the largest one are compared with
   PIVOTS members of it, chosen by hash.
5. Tiles that are split even then are compared in blocks of nodes of one band. The members of the tile's largest
   component aren't compared with each other, nor are members of any one component.

A comparison first bounds the overlap by bit counts of hashed bitmaps: every bit of one signature that the other lacks
is at least one element that it lacks. Only for pairs that pass are the texts read again, and their sorted hash arrays
intersected exactly.

Nothing is collected on the driver but counts and the table of classes. A group of copies is one node; the comparisons of a
hot pivot or tile are dealt to many tasks, of at most TASK_PAIRS pairs in the last step.

Defined results: a null text, or one without words, has the empty set, is linked with nothing and is its own component;
fewer words than SHINGLE give one shingle of them all. Rows with the same doc_id are linked by it as well only if their
sets are; a null doc_id never names a component, except where all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import cut, slices, small_batches, table, texts

SHINGLE = 5
#: Least similarity: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Hash buckets in which shingles are counted, and the parts in which the counts are summed.
BUCKETS, CHUNKS = 1 << 22, 64
#: Upper bits of a key that name its tile.
TILE_BITS = 40
#: Sizes of a band differ by less than this factor; it must be above 100 / PERCENT.
BAND = 1.34
#: A block holds nodes of this weight in all; a node weighs its set's size, and BLOCK_LEAST at least.
BLOCK, BLOCK_LEAST = 1 << 22, 2_048
#: Rows of blocks that are compared in one task, on average, at once.
BIN_ROWS = 8_192
#: Members of a split tile's largest component that the others are compared with first.
PIVOTS = 8
#: Pairs that one task intersects, and elements of their sets in all.
TASK_PAIRS, TASK_ELEMENTS = 4_096, 1 << 23
#: Tasks that a hot pivot's pairs are dealt to.
DEALS = 32
#: Nodes up to which their texts are picked by a broadcast of their ids (32 bytes each); more are picked by a shuffle.
BROADCAST_NODES = 200_000
#: Least bits of a signature; it has the power of two from twice the set's size on. Signatures of sets that can be
#: linked differ by a factor of two at most, and the halves of the longer one are joined before they are compared.
LEAST_BITS = 256

FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes with A-Z lowered, and white space as blanks.
PLAIN = bytes(32 if c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words are hashed as polynomials over the values of their bytes, modulo 2**64, some PIECE bytes of text at a time.
STEP, PIECE = 0x9E3779B97F4A7C15, 1 << 18
VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


UP, DOWN = powers(STEP, 2 * PIECE), powers(pow(STEP, -1, 1 << 64), 2 * PIECE)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The place and the hash of each word of data, whose words stand between blanks; data ends with one."""
    places, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(data):
        end = data.find(b" ", at + PIECE - 1) + 1 or len(data)
        x = np.frombuffer(data, np.uint8, end - at, at)
        up, down = (UP, DOWN) if len(x) <= len(UP) else (powers(STEP, len(x)), powers(pow(STEP, -1, 1 << 64), len(x)))
        blank = np.ones(len(x) + 1, bool)
        np.equal(x, 32, out=blank[1:])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(VALUES[x] * up[: len(x)], out=sums[1:])
        places.append(starts + at)
        hashes.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(places), np.concatenate(hashes)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k words that follow each other."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mixed(out * FACTORS[j] + h[j : j + n])
    return out


def shingle_sets(batch: list[str]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    data = [t.encode().translate(PLAIN) for t in batch]
    places, h = word_hashes(b"".join(part for d in data for part in (d, b" ")))
    edges = np.searchsorted(places, np.cumsum([0, *(len(d) + 1 for d in data)])).tolist()
    full, out = windows(h, SHINGLE), []
    for a, b in zip(edges, edges[1:], strict=False):
        s = np.sort(full[a : b - SHINGLE + 1] if b - a >= SHINGLE else windows(h[a:b], b - a)[: b - a])
        new = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=new[1:])
        out.append(s[new])
    return out


def list_column(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int64()))


def fingerprint(hashes: np.ndarray) -> list[int]:
    """Two numbers that tell sets apart; the first one alone names a node."""
    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64).tolist()


def signature(hashes: np.ndarray) -> np.ndarray:
    size = max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else LEAST_BITS
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> np.uint64(7)) & np.uint64(size - 1)] = 1
    return np.packbits(bits).view(np.uint64)


def folded(column: pa.ChunkedArray) -> np.ndarray:
    """The signatures of a column as rows of one matrix, all joined down to the shortest."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy().view(np.uint64)
    size = lists.value_lengths().to_numpy()
    start, least = np.cumsum(size) - size, int(size.min())
    out = np.zeros((len(size), least), np.uint64)
    for k in range(int(size.max()) // least):
        rows = np.flatnonzero(size > k * least)
        out[rows] |= flat[start[rows][:, None] + k * least + np.arange(least)]
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)) or not len(a):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def may_link(sig: np.ndarray, n: int, sigs: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """Which of the sets (signatures sigs, sizes ns) may be linked with one, by the bound of bit counts."""
    most = np.minimum(n - np.bitwise_count(sig & ~sigs).sum(axis=1, dtype=np.int64), ns - np.bitwise_count(sigs & ~sig).sum(axis=1, dtype=np.int64))
    return 100 * most >= PERCENT * (n + ns - most)


def bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The hash bucket of each shingle, by its upper bits."""
    return (hashes >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def shingled(docs: DataFrame) -> DataFrame:
    """For docs (key, t1, t2, text): (key, t1, t2, f1, f2, n), the set's fingerprint and size; and a task's counts of shingles by bucket, as rows (chunk, load) without any of these."""
    kind = docs.schema["key"].dataType.simpleString()
    schema = pa.schema([*(pa.field(c, pa.int64()) for c in ("t1", "t2", "f1", "f2", "n")), pa.field("chunk", pa.int32()), pa.field("load", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, key_kind = None, None
        for part in slices(batches, "text"):
            load = np.zeros(BUCKETS, np.int64) if load is None else load
            key_kind = part.column("key").type
            sets = shingle_sets(texts(part, "text"))
            np.add.at(load, bucket(np.concatenate(sets), BUCKETS), 1)
            f1, f2 = zip(*map(fingerprint, sets), strict=True)
            named = {"key": part.column("key"), "t1": part.column("t1"), "t2": part.column("t2"), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "n": pa.array(list(map(len, sets)), pa.int64())}
            yield pa.RecordBatch.from_pydict(named | {c: pa.nulls(part.num_rows, schema.field(c).type) for c in ("chunk", "load")})
        if load is not None:
            squeeze = zstandard.ZstdCompressor(level=1).compress
            blobs = [squeeze(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes()) for x in np.split(load, CHUNKS)]
            none = {"key": pa.nulls(CHUNKS, key_kind)} | {c: pa.nulls(CHUNKS, pa.int64()) for c in ("t1", "t2", "f1", "f2", "n")}
            yield pa.RecordBatch.from_pydict(none | {"chunk": pa.array(range(CHUNKS), pa.int32()), "load": pa.array(blobs, pa.binary())})

    return docs.mapInArrow(run, f"key {kind}, t1 long, t2 long, f1 long, f2 long, n long, chunk int, load binary")


def frequency_classes(loads: DataFrame) -> np.ndarray:
    """The class of each bucket, the power of two of its count, from rows (chunk, load)."""

    def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        total = np.zeros(BUCKETS // CHUNKS, np.int64)
        for batch in batches:
            for blob in batch.column("load").to_pylist():
                total += np.frombuffer(expand(blob), np.uint32)
        classes = np.ceil(np.log2(total + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()), "classes": pa.array([classes.tobytes()], pa.binary())})

    out = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.uint8)
    for r in loads.groupBy("chunk").applyInArrow(summed, "chunk int, classes binary").collect():
        out[r.chunk] = np.frombuffer(r.classes, np.uint8)
    return out.ravel()


def of_sets(docs: DataFrame, name: str, found) -> DataFrame:
    """(id, n, name) for docs (text): the set's fingerprint, size and the array that found makes of it; sets without
    shingles are left out, and a task gives each set once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text"):
            rows = {}
            for s in shingle_sets(texts(part, "text")):
                if len(s) and (own := fingerprint(s)[0]) not in seen:
                    seen.add(own)
                    rows[own] = len(s), found(s).view(np.int64)
            if rows:
                n, arrays = zip(*rows.values(), strict=True)
                yield pa.RecordBatch.from_pydict({"id": pa.array(list(rows), pa.int64()), "n": pa.array(n, pa.int64()), name: list_column(arrays)})

    return docs.select("text").mapInArrow(run, f"id long, n long, {name} array<long>")


def keyed(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """(id, n, keys) of the sets of docs (text): their search keys, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # BUCKETS bytes
    return of_sets(docs, "keys", lambda s: s[np.argsort(shared.value[bucket(s, len(shared.value))], kind="stable")[: len(s) // 4 + 1]])


def signed(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, sig) of the sets in members, for docs (text): their signatures."""
    ids = cut(members.select("id").distinct(), "jaccard-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids
    return of_sets(docs, "sig", signature).join(side, "id", "left_semi").select("id", "sig").dropDuplicates(["id"])


def node_sets(rows: DataFrame) -> DataFrame:
    """(id, n, hashes) for rows (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(texts(part, "text"))
            yield pa.RecordBatch.from_pydict(
                {"id": part.column("id"), "n": pa.array([len(s) for s in sets], pa.int64()), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())}
            )

    return rows.select("id", "text").mapInArrow(run, "id long, n long, hashes binary")


def close(a: str, b: str):
    return (PERCENT * F.col(a) <= 100 * F.col(b)) & (PERCENT * F.col(b) <= 100 * F.col(a))


def band(n: str):
    return F.floor(F.log(F.col(n)) / float(np.log(BAND))).cast("int")


def tiled(nodes: DataFrame) -> DataFrame:
    """(tile, id, band, m) of the tiles with m > 1 members, for nodes (id, n, keys), which may repeat; of tiles with the same members, the least alone.

    Sets of sizes x and y are linked if they share 3 / 7 * (x + y) elements. If the first shared key has the place i in the
    order of the first set (j in the other's), they share x - i at most, so y <= (4 * x - 7 * i) / 3, the reach of that set,
    and x <= the other's reach. The smaller of two linked sets thus reaches its own size. A member stays in a tile if it
    reaches the size of the least member that does.
    """
    by_place = nodes.select(F.posexplode("keys").alias("place", "tile"), "id", F.col("n").cast("int").alias("n"))
    reach = F.floor((100 * F.col("n").cast("long") - (100 + PERCENT) * F.col("place")) / F.lit(PERCENT)).cast("int")
    of_tile = Window.partitionBy("tile")
    least = F.min(F.when(F.col("reach") >= F.col("n"), F.col("n"))).over(of_tile)
    # Keys are dealt by tile once, by TILE_BITS of them; keys alike in these share a tile, in which a node has its longest reach.
    tile = F.shiftrightunsigned("tile", 64 - TILE_BITS).alias("tile")
    dealt = by_place.select(tile, "id", "n", reach.alias("reach")).repartition("tile")
    # Most tiles have one node: these go before the rows of a node in a tile are joined, so that a task holds its rows once.
    several = dealt.select("*", least.alias("least"), F.min("id").over(of_tile).alias("x"), F.max("id").over(of_tile).alias("y")).where("x <> y and reach >= least")
    rows = several.groupBy("tile", "id").agg(F.max("n").alias("n")).select("tile", "id", band("n").alias("band"))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "id")).over(of_tile).alias(name) for seed, name in ((1, "x1"), (2, "x2"))]
    shared = cut(rows.select("*", F.count("*").over(of_tile).alias("m"), *marks).where("m > 1"), "jaccard-members")
    kept = shared.groupBy("m", "x1", "x2").agg(F.min("tile").alias("tile"))
    return cut(shared.join(kept.select("tile"), "tile", "left_semi").select("tile", "id", "band", "m"), "jaccard-tiles")


def star_pairs(members: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a < b, of pivots and members, and of the pivots of adjacent bands."""
    rows = members.withColumn("pivot", F.min("id").over(Window.partitionBy("tile", "band")))
    heads = members.groupBy("tile", "band").agg(F.min("id").alias("id"))
    last = Window.partitionBy("tile").orderBy("band")
    bridges = heads.withColumn("pivot", F.when(F.lag("band").over(last) == F.col("band") - 1, F.lag("id").over(last))).where("pivot is not null")
    return ordered(rows.select("pivot", "id").unionByName(bridges.select("pivot", "id")))


def ordered(pairs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a < b, of rows (pivot, id)."""
    return pairs.where("id <> pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()


def by_component(split: DataFrame) -> DataFrame:
    """split, and minor: whether a row is outside the largest component of its tile."""
    largest = split.groupBy("tile", "component").count().groupBy("tile").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    return split.join(largest, "tile").withColumn("minor", F.col("component") != F.col("largest")).drop("largest")


def further_pairs(split: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of the members outside a tile's largest component and PIVOTS members of it."""
    rows = by_component(split)
    chosen = [F.min_by("id", F.xxhash64(F.lit(seed), "id")) for seed in range(PIVOTS)]
    pivots = rows.where(~F.col("minor")).groupBy("tile").agg(F.array_distinct(F.array(*chosen)).alias("pivots"))
    return ordered(rows.where("minor").join(pivots, "tile").select(F.explode("pivots").alias("pivot"), "id"))


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that pass the bound of bit counts."""

    def named(x: str) -> DataFrame:
        return nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    # A hot pivot's pairs are dealt to several tasks before its signature joins them.
    pairs = cut(pairs.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(DEALS))), "jaccard-tried")
    pairs = pairs.join(pairs.select("a", "deal").distinct().join(named("a"), "a"), ["a", "deal"]).join(named("b"), "b")

    def fold(x: str, y: str):
        half = F.size(f"sig_{y}")
        joined = F.zip_with(F.slice(f"sig_{x}", F.lit(1), half), F.slice(f"sig_{x}", half + 1, half), lambda p, q: p.bitwiseOR(q))
        return F.when(F.size(f"sig_{x}") > half, joined).otherwise(F.col(f"sig_{x}"))

    pairs = pairs.where(close("n_a", "n_b")).withColumns({"sig_a": fold("a", "b"), "sig_b": fold("b", "a")})

    def held(x: str, y: str):
        lacked = F.aggregate(F.zip_with(f"sig_{x}", f"sig_{y}", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda acc, v: acc + v)
        return F.col(f"n_{x}") - lacked

    most = F.least(held("a", "b"), held("b", "a"))
    return cut(pairs.where(100 * most >= PERCENT * (F.col("n_a") + F.col("n_b") - most)).select("a", "b"), "jaccard-pairs")


def pick_sets(ids: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """(id, n, hashes) of the nodes in ids, from the text of each node's smallest row."""
    picked = cut(nodes.join(ids.distinct(), "id", "left_semi").select("id", F.col("rep.key").alias("k"), F.col("rep.t1").alias("t1"), F.col("rep.t2").alias("t2")), "jaccard-picked")
    side = F.broadcast(picked) if picked.count() <= BROADCAST_NODES else picked
    own = source.join(side, (source["t1"] == side["t1"]) & (source["t2"] == side["t2"]) & source["key"].eqNullSafe(side["k"])).select("id", "text")
    return cut(node_sets(own).dropDuplicates(["id"]), "jaccard-sets")


def exact_links(pairs: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """The linked ones of the distinct pairs (a, b)."""
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    return cut(verified(pairs, pick_sets(ids, nodes, source)), "jaccard-links")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of the distinct pairs (a, b); the members b of one a are dealt to several tasks."""
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(64))), F.lit(1 << 40)))
    kinds = "a long, deal long, b long, hashes binary"
    left = dealt.select("a", "deal").distinct().join(sets.withColumnRenamed("id", "a"), "a").withColumn("b", F.lit(None).cast("long"))
    right = dealt.join(sets.withColumnRenamed("id", "b"), "b")
    names = [x.split()[0] for x in kinds.split(", ")]
    both = left.select(*names).unionByName(right.select(*names)).repartition("deal").sortWithinPartitions("deal", "a", F.col("b").asc_nulls_first())

    names_read = "a", "b", "deal", "hashes"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            found = []
            for a, b, deal, hashes in zip(*(batch.column(c).to_pylist() for c in names_read), strict=True):
                if b is None:
                    head = a, deal, np.frombuffer(hashes, np.uint64)
                    continue
                if head is None or head[:2] != (a, deal):
                    raise ValueError("a member without its pivot")
                if similar(head[2], np.frombuffer(hashes, np.uint64)):
                    found.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the nodes in links (a, b): the smallest id that each reaches, by alternating large and small stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state
        ways = edges.union(edges.select("v", "u"))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct(), "stars")


def still_split(members: DataFrame, found: DataFrame) -> DataFrame:
    """The rows, with their component, of the tiles whose members are in several components; two members alone have been compared."""
    named = members.where("m > 2").drop("m").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = named.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("tile")
    return named.join(split, "tile", "left_semi")


def block_pairs(split: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task, a, b): distinct pairs of different components that share a tile and pass the bound of bit counts; the pairs of
    a task are few, and a pair that shares several tiles is in one of them.
    """
    rows = cut(by_component(split).join(nodes.select("id", "n"), "id"), "jaccard-minor")
    parts = rows.groupBy("tile", "minor", "band").agg(F.ceil(F.sum(F.greatest("n", F.lit(BLOCK_LEAST))) / BLOCK).alias("parts"))
    rows = rows.join(parts, ["tile", "minor", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    rows = cut(rows, "jaccard-parts")
    blocks = parts.select("tile", "minor", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    # Blocks of the largest component don't meet each other; two others meet once.
    x, y = (blocks.select("tile", *(F.col(c).alias(f"{side}_{c}") for c in ("minor", "band", "part"))) for side in ("x", "y"))
    later = F.struct("y_band", "y_part") >= F.struct(F.col("x_band").alias("y_band"), F.col("x_part").alias("y_part"))
    meet = x.where("x_minor").join(y, "tile").where((F.abs(F.col("x_band") - F.col("y_band")) <= 1) & (~F.col("y_minor") | later))
    group = ["tile", "x_band", "x_part", "y_minor", "y_band", "y_part"]
    same = F.col("y_minor") & (F.col("x_band") == F.col("y_band")) & (F.col("x_part") == F.col("y_part"))
    meet = meet.withColumn("meet", F.xxhash64(*group)).withColumn("same", same)

    def side(name: str) -> DataFrame:
        keys = [F.col(f"{name}_{c}").alias(c) for c in ("minor", "band", "part")]
        own = meet.select("tile", *keys, "meet", "same")
        return rows.join(own, ["tile", "minor", "band", "part"]).select("meet", "same", F.lit(name == "x").alias("left"), "id", "component")

    spread = side("x").unionByName(side("y")).join(nodes.select("id", "n", "sig"), "id")
    bins = max(1, 2 * split.count() // BIN_ROWS)
    spread = spread.withColumn("bin", F.pmod("meet", F.lit(bins)))

    def compared(t: pa.Table) -> Iterator[tuple[int, int, int]]:
        """The pairs of one meeting of two blocks, and the elements of their sets."""
        ids, ns, comp, left = (t.column(c).to_numpy() for c in ("id", "n", "component", "left"))
        sigs, right, same = folded(t.column("sig")), np.flatnonzero(~left), t.column("same")[0].as_py()
        for x in np.flatnonzero(left):
            rest = right[(comp[right] != comp[x]) & (100 * ns[right] >= PERCENT * ns[x]) & (PERCENT * ns[right] <= 100 * ns[x])]
            rest = rest[ids[rest] > ids[x]] if same else rest
            if len(rest):
                hit = rest[may_link(sigs[x], ns[x], sigs[rest], ns[rest])]
                yield from zip(np.minimum(ids[hit], ids[x]).tolist(), np.maximum(ids[hit], ids[x]).tolist(), (ns[hit] + ns[x]).tolist(), strict=True)

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("meet").to_numpy(), kind="stable"))).combine_chunks()
        meets, name = t.column("meet").to_numpy(), t.column("bin")[0].as_py()
        edges = [0, *(np.flatnonzero(meets[1:] != meets[:-1]) + 1).tolist(), len(meets)]
        found = {pair for a, b in zip(edges, edges[1:], strict=False) for pair in compared(t.slice(a, b - a))}
        a, b, elements = zip(*sorted(found), strict=True) if found else ((), (), ())
        tasks = [f"{name} {k // TASK_PAIRS} {e // TASK_ELEMENTS}" for k, e in enumerate(np.cumsum(elements, dtype=np.int64).tolist())]
        return pa.table({"task": pa.array(tasks, pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = spread.groupBy("bin").applyInArrow(run, "task string, a long, b long")
    return cut(found.groupBy("a", "b").agg(F.min("task").alias("task")), "jaccard-pairs")


def block_links(pairs: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """Links among the pairs (task, a, b) that give the same components as all of them: a pair that links found earlier
    in its task connect is not compared. Each set comes once a task."""
    pairs = cut(pairs, "jaccard-pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    ends = pairs.select("task", F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = ends.join(pick_sets(ends.select("id"), nodes, source).select("id", "hashes"), "id")
    none = F.lit(None).cast("long")
    rows = sets.select("task", "id", "hashes", none.alias("a"), none.alias("b")).unionByName(pairs.select("task", none.alias("id"), F.lit(None).cast("binary").alias("hashes"), "a", "b"))

    def run(t: pa.Table) -> pa.Table:
        own = {k: np.frombuffer(h, np.uint64) for k, h in zip(t.column("id").to_pylist(), t.column("hashes").to_pylist(), strict=True) if k is not None}
        up = {k: k for k in own}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        found = []
        for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
            if a is not None and (x := top(a)) != (y := top(b)) and similar(own[a], own[b]):
                up[x] = y
                found.append((a, b))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return cut(rows.groupBy("task").applyInArrow(run, "a long, b long"), "jaccard-links")


def text_marks(text_col: str) -> list:
    """Two hashes of a text; rows with equal id and marks are equal in both."""
    return [F.xxhash64(F.lit(seed), F.col(text_col)).alias(name) for seed, name in ((3, "t1"), (5, "t2"))]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key (its id), t1, t2, n (the set's size), component (null for the empty set) and component_id."""
    with small_batches(docs.sparkSession):
        return _classes(docs, id_col, text_col)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("key"), *text_marks(text_col), F.col(text_col).cast("string").alias("text"))
    every = cut(shingled(source), "jaccard-rows")
    rows = every.where("chunk is null").drop("chunk", "load")
    order = frequency_classes(every.where("chunk is not null").select("chunk", "load"))

    # One node for each set; its text is that of its smallest row.
    nodes = rows.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("key", "t1", "t2")).alias("rep"), F.min("key").alias("least"), F.first("n").alias("n"))
    nodes = cut(nodes.withColumn("id", F.col("f1")), "jaccard-nodes")

    members = tiled(keyed(source, order))
    shared = cut(nodes.select("id", "n", "rep").join(signed(source, members), "id"), "jaccard-shared")
    tried = bounded(star_pairs(members), shared)
    links = exact_links(tried, shared, source)
    split = cut(still_split(members, components(links)), "jaccard-split")
    more = bounded(further_pairs(split).join(tried, ["a", "b"], "left_anti"), shared)
    links, tried = links.union(exact_links(more, shared, source)), tried.union(more)
    split = cut(still_split(members, components(links)), "jaccard-split")
    links = links.union(block_links(block_pairs(split, shared).join(tried, ["a", "b"], "left_anti"), shared, source))
    found = components(links)

    named = nodes.join(found, "id", "left").select("f1", "f2", "least", F.coalesce("component", "id").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = named.join(smallest, "component").select("f1", "f2", "component", "component_id")
    out = rows.where("n > 0").join(by_set, ["f1", "f2"]).select("key", "t1", "t2", "n", "component", "component_id")
    return out.unionByName(rows.where("n = 0").select("key", "t1", "t2", "n", F.lit(None).cast("long").alias("component"), F.col("key").alias("component_id")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_shingles and component_id."""
    return classes(docs, id_col, text_col).select(F.col("key").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row, of smallest id, for each component; rows without words stay."""
    own = cut(classes(docs, id_col, text_col).where("n > 0").groupBy("component", "key", "t1", "t2").agg(F.count("*").alias("copies")), "classes")
    least = own.groupBy("component").agg(F.min(F.struct(F.col("key").isNull(), "key", "t1", "t2")).alias("least"))
    joined = own.join(least, "component")
    stays = F.col("key").eqNullSafe(F.col("least.key")) & (F.col("t1") == F.col("least.t1")) & (F.col("t2") == F.col("least.t2"))
    gone = cut(joined.where(~stays).select("key", "t1", "t2"), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("id"), *text_marks(text_col))
    left = marked.join(side, (marked["t1"] == side["t1"]) & (marked["t2"] == side["t2"]) & marked["id"].eqNullSafe(side["key"]), "left_anti")
    # Rows that repeat in full are told apart by nothing; one of them stays.
    again = cut(joined.where(stays & (F.col("copies") > 1)).select("key", "t1", "t2"), "repeated")
    if not again.isEmpty():
        same = (left["t1"] == again["t1"]) & (left["t2"] == again["t2"]) & left["id"].eqNullSafe(again["key"])
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["id", "t1", "t2"]))
    return left.select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
