"""Conversation structure repair (op13).

Conversations are repaired by the cheapest edits after which their role initials read (s?(ua)+)?: Keep (0), Rerole to user
or assistant (1), Delete (2; blank and repeated turns must go), Insert an empty user or assistant turn (5). A truncated
turn that stays costs 5 more. Of equally cheap edits, those whose initials are ASCII-least are taken.

1. Turns are classified: role initial, and the first fault of blank, duplicate, truncated. Only slim rows are shuffled, once
   by conversation, role and a hash of the text (earlier copies) and once by ranges of conversation and turn, so a
   conversation of any size is spread over tasks; each writes the codes of its part as a string, and a conversation joins
   its parts.
2. The distinct role/fault signatures are dealt to tasks by ranges and sorted there. Walked in this order they are a prefix
   trie of which only the path to the present signature is held. A node's dynamic-programming layer (for each state of the
   wanted form: least cost, rank of its edits' initials among those of the other states, way back) is computed once, however many
   signatures share the prefix; a signature's end reads the answer off the layers. Layers with the same differences
   of cost and the same ranks have the same successors, which are remembered.
3. A conversation's edits go to its turns by a secondary sort, and each conversation streams through one task, a turn at a
   time. The digest of a whole conversation is sequential, so it can't be split; all that is held is the edits.

Defined results: nulls of role and text are one space; rows of a null conversation are one conversation; null turns
come first; rows of one turn are ordered by role, then by the SHA-256 of their texts; repeated rows are turns of their own;
role initials other than s, u and a are never kept; conversations of which no row is left get zeros and empty results; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import cut, table, with_fields

#: Costs of edits and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns whose codes are one string, and rows of an output batch.
PART_TURNS, BATCH = 1 << 20, 4_096

#: A turn's code tells its role (s, u, a, other) and its first fault (none, blank, duplicate, truncated).
ROLES, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
CODES = "ABCDEFGHIJKLMNOP"
#: Its symbol in a signature: x where it must be deleted, else its role, in capitals where truncated.
SYMBOLS = "".join("x" if f in (1, 2) else r.upper() if f == 3 else r for r in "suao" for f in range(4))

#: States of the wanted form: nothing yet, after s, after u, after a. FREE is where a turn of the one free role leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
FREE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ACCEPTED = (START, AFTER_A)
NAMES = {AFTER_U: "user", AFTER_A: "assistant"}

#: A layer: for each state the cost above the layer's least one and the rank of its edits, or None.
Layer = tuple[tuple[int, int] | None, ...]
ROOT: Layer = ((0, 0), None, None, None)


def inserted(state: int) -> Iterator[tuple[int, int]]:
    """The states that none, one or two inserted turns lead to, and how many; more never pay."""
    for k in range(3):
        yield state, k
        state = FREE[state]


@functools.lru_cache(maxsize=1 << 16)
def advance(layer: Layer, symbol: str) -> tuple[Layer, int, tuple[tuple[int, str] | None, ...]]:
    """The layer after one more turn, how much its least cost grew, and each state's way back (state, edits).

    Edits of a layer end with the edit of its last turn, so of two different ones neither starts the other, and ranks
    decide ties whatever follows.
    """
    role, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    best: list[tuple[int, int, str, int] | None] = [None] * 4

    def offer(state: int, cost: int, rank: int, edits: str, back: int) -> None:
        if best[state] is None or (cost, rank, edits) < best[state][:3]:
            best[state] = (cost, rank, edits, back)

    for back, known in enumerate(layer):
        if known is None:
            continue
        for state, k in inserted(back):
            cost, rank, before = known[0] + INSERT * k, known[1], "I" * k
            offer(state, cost + DELETE, rank, before + "D", back)
            if role != "x":
                offer(FREE[state], cost + REROLE + more, rank, before + "R", back)
                if (state, role) in STEP:
                    offer(STEP[state, role], cost + KEEP + more, rank, before + "K", back)
    least = min(x[0] for x in best if x)
    ranks = {key: i for i, key in enumerate(sorted({x[1:3] for x in best if x}))}
    return tuple(x and (x[0] - least, ranks[x[1:3]]) for x in best), least, tuple(x and (x[3], x[2]) for x in best)


class TriePath:
    """The layers on the path from the root of the signature trie to one node."""

    def __init__(self) -> None:
        self.signature, self.layers, self.costs, self.computed = "", [(ROOT, 0, ())], [0], 0

    def answer(self, signature: str) -> tuple[int, str]:
        """Cost and edits' initials of a signature; signatures come in order, so shared prefixes stay on the path."""
        shared = len(os.path.commonprefix([self.signature, signature]))
        del self.layers[shared + 1 :], self.costs[shared + 1 :]
        for symbol in signature[shared:]:
            self.layers.append(advance(self.layers[-1][0], symbol))
            self.costs.append(self.costs[-1] + self.layers[-1][1])
            self.computed += 1
        self.signature = signature
        ends = [(known[0] + INSERT * k, known[1], "I" * k, back) for back, known in enumerate(self.layers[-1][0]) if known for state, k in inserted(back) if state in ACCEPTED]
        cost, _, last, state = min(ends)
        edits = [last]
        for _, _, ways in reversed(self.layers[1:]):
            state, some = ways[state]
            edits.append(some)
        return self.costs[-1] + cost, "".join(reversed(edits))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of each row, nulls of role and text as one space, and copies = 1."""
    space = F.lit(" ")
    return conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """turns() with one of twenty rows each dropped (copies 0), emptied, stripped of sentence ends, repeated (copies 2), or given the role user."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """Rows in the order of their turns: by turn, role and mark."""
    return rows.withColumn("mark", F.unhex(F.sha2("text", 256)))


def code(role: Column, fault: Column) -> Column:
    number = F.coalesce(F.nullif(F.instr(F.lit(ROLES), F.substring(role, 1, 1)), F.lit(0)), F.lit(4))
    number = F.when(F.length(role) == 0, F.lit(4)).otherwise(number)
    return F.substring(F.lit(CODES), 4 * (number - 1) + fault + 1, F.lit(1))


def coded(rows: DataFrame) -> DataFrame:
    """Slim rows conv_id, turn, role, mark and codes, one code for each copy of the row."""
    solid = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    blank, cut_off = solid == "", ~solid.rlike(r"[.!?]\z")
    slim = marked(rows).select("conv_id", "turn", "role", "mark", "copies", blank.alias("blank"), cut_off.alias("cut_off"))
    gone = slim.where("copies = 0").select("conv_id", F.lit(None).cast(slim.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("mark"), F.lit("").alias("codes"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "mark").orderBy(F.col("turn").asc_nulls_first())) > 1
    again = code(F.col("role"), F.when(F.col("blank"), F.lit(1)).otherwise(F.lit(2)))
    own = code(F.col("role"), F.when(F.col("blank"), F.lit(1)).when(F.col("seen"), F.lit(2)).when(F.col("cut_off"), F.lit(3)).otherwise(F.lit(0)))
    left = slim.where("copies > 0").withColumn("seen", seen)
    return left.select("conv_id", "turn", "role", "mark", F.concat(own, F.repeat(again, F.col("copies") - 1)).alias("codes")).unionByName(gone)


def parts(codes: DataFrame) -> DataFrame:
    """Parts of conversations: conv_id, place (sorts a conversation's parts), codes, and low, high and number of the turns in them."""
    order = ["conv_id", "turn", "role", "mark"]
    dealt = codes.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.col("turn").cast("long").alias("turn"), "codes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, kind, rows = TaskContext.get().partitionId(), 0, None, []
        conv, held, low, high, some = None, None, None, None, 0

        def part() -> tuple:
            return conv, (task << 32) + n, "".join(held), low, high, some

        def batch() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "place", "codes", "low", "high", "some"])

        for b in batches:
            kind = b.column("conv_id").type
            for c, turn, codes in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "codes")), strict=True):
                if held is None or c != conv or len(held) >= PART_TURNS:
                    if held is not None:
                        rows.append(part())
                        n += 1
                    conv, held, low, high, some = c, [], None, None, 0
                    if len(rows) >= BATCH:
                        yield batch()
                held.append(codes)
                if turn is not None and codes and turn != high:
                    low, high, some = turn if low is None else low, turn, some + 1
        if held is not None:
            rows.append(part())
            yield batch()

    return dealt.mapInArrow(run, with_fields(dealt.select("conv_id"), "place long, codes string, low long, high long, some long"))


def summaries(split: DataFrame) -> DataFrame:
    """Per conversation: its signature, gaps, and counts of faults and of illegal neighbours; its parts are few."""
    held = split.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "codes", "low", "high", "some"))).alias("parts"))
    held = held.withColumn("codes", F.array_join("parts.codes", ""))
    # A turn that ends one part may start the next one with turns; null turns come first, so those parts adjoin.
    twice = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last")),
        lambda s, p: F.struct((s["n"] + F.when(s["last"] == p["low"], 1).otherwise(0)).alias("n"), F.coalesce(p["high"], s["last"]).alias("last")),
        lambda s: s["n"],
    )
    gaps = F.array_max("parts.high") - F.array_min("parts.low") + 1 - F.aggregate("parts.some", F.lit(0).cast("long"), lambda a, x: a + x) + twice
    of = lambda fault: F.length(F.regexp_replace("codes", f"[^{CODES[fault::4]}]", "")).cast("long")
    roles = F.translate("codes", CODES, "".join(r * 4 for r in "suao"))
    # Pairs overlap, so those that start at odd and at even places are counted by a look-ahead.
    legal = F.length(F.regexp_replace(F.regexp_replace(roles, "s(?=u)|u(?=a)|a(?=u)", "+"), r"[^+]", ""))
    illegal = F.greatest(F.length(roles) - 1 - legal, F.lit(0)).cast("long")
    return held.select("conv_id", F.translate("codes", CODES, SYMBOLS).alias("signature"), F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), of(1).alias("blank"), of(2).alias("duplicate"), of(3).alias("truncated"), illegal.alias("illegal"))


def answers(signatures: DataFrame) -> DataFrame:
    """For distinct signatures: signature, cost and audit, by tries over sorted ranges of them."""
    dealt = signatures.select("signature").repartitionByRange("signature").sortWithinPartitions("signature")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = TriePath()
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                some = b.column("signature").slice(at, BATCH)
                found = [path.answer(s) for s in some.to_pylist()]
                yield pa.RecordBatch.from_arrays([some, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])

    return dealt.mapInArrow(run, "signature string, cost long, audit string")


def planned(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit, the edits' initials."""
    held = cut(summaries(parts(coded(rows))), "conversations")
    done = answers(held.select("signature").distinct())
    return held.join(done, "signature").drop("signature")


class Follower:
    """Applies a conversation's edits to its turns, one at a time."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def filled(self) -> Iterator[tuple[str, str, str]]:
        """Turns inserted here: role, text, edit."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = FREE[self.state]
            yield NAMES[self.state], "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.filled()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[self.state, role[0]]
            yield role, text, edit
        elif edit == "R":
            self.state = FREE[self.state]
            yield NAMES[self.state], text, edit


def applied(rows: DataFrame, plans: DataFrame, fields: str, each: Callable[[Iterator], Iterator[tuple]]) -> DataFrame:
    """plans' conversations, each given to `each` as an iterator of its repaired turns (role, text, edit), which is never held whole."""
    first = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), F.lit(None).cast("binary").alias("mark"))
    then = marked(rows.where("copies > 0")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies", "mark")
    dealt = first.unionByName(then).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "mark").select("conv_id", "kind", "role", "text", "copies")
    names = [f.strip().split()[0] for f in fields.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def read() -> Iterator[tuple]:
            for b in batches:
                kinds[:] = [b.column("conv_id").type]
                for at in range(0, b.num_rows, BATCH):
                    yield from zip(*(b.column(c).slice(at, BATCH).to_pylist() for c in ("conv_id", "kind", "role", "text", "copies")), strict=True)

        source = read()
        following = next(source, None)

        def repaired(audit: str) -> Iterator[tuple[str, str, str]]:
            nonlocal following
            edits = Follower(audit)
            following = next(source, None)
            while following is not None and following[1] == 1:
                for _ in range(following[4]):
                    yield from edits.turn(following[2], following[3])
                following = next(source, None)
            yield from edits.filled()

        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kinds[0]), *(pa.array(c, pa.int64() if isinstance(c[0], int) else pa.string()) for c in columns[1:])], ["conv_id", *names])

        while following is not None:
            conv = following[0]
            for row in each(repaired(following[3])):
                out.append((conv, *row))
                if len(out) >= BATCH:
                    yield batch()
        if out:
            yield batch()

    return dealt.mapInArrow(run, with_fields(dealt.select("conv_id"), fields))


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text and the edit that made the turn (K, R or I)."""
    return applied(rows, plans, "place long, role string, text string, edit string", lambda done: ((i, *x) for i, x in enumerate(done)))


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Per conversation the SHA-256 of its repaired turns, role:text, joined by line ends."""

    def each(done: Iterator[tuple[str, str, str]]) -> Iterator[tuple[str]]:
        sha, sep = hashlib.sha256(), ""
        for role, text, _ in done:
            sha.update(f"{sep}{role}:{text}".encode())
            sep = "\n"
        yield (sha.hexdigest(),)

    return applied(rows, plans, "repaired_sha256 string", each)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plans (planned) and the repaired turns of conversations as they are."""
    rows = turns(conversations)
    plans = cut(planned(rows), "plans")
    return plans, repaired_turns(rows, plans)


def query(spark, sf_dir: str) -> DataFrame:
    rows = damaged(turns(table(spark, sf_dir, "conversations")))
    plans = cut(planned(rows), "plans")
    hashes = digests(rows, plans).withColumnRenamed("conv_id", "_conv")
    return plans.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
