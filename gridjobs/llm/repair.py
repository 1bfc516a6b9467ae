"""Conversation structure repair by a persistent audit DP.

A conversation's rows are kept, given another role, deleted, or joined by inserted ones, at least cost, until the initials of
the roles read (s?(ua)+)?, that is nothing, or an optional system turn and pairs of user and assistant. The dynamic
program goes through the rows with four states: nothing yet, after the system turn, after a user, after an assistant.

The audit of a state is the string of its edits' initials, and of edits of equal cost the least audit counts. Audits share
their beginnings: each is a node that links to the node before it, with ancestors 1, 2, 4, ... steps back and a rolling hash of
the whole string. Two audits of equal cost are compared at the first letter after their longest common prefix, which a descent
over the ancestors finds by comparing hashes; a prefix whose hashes agree is then verified letter by letter, as far as the
nodes differ and were not verified before, and if a collision shows, its first differing letter decides. So hashes save
work and never decide.

Texts take no part in that: each row is its turn, role's initial and faults. The audits then meet the texts of their
conversations, sorted alike, and a second pass writes the repaired rows one at a time. A conversation needs memory for the
edits of its rows, not for its texts; its one hash takes its texts in order, so they pass through one task.

Defined results: nulls in turns, roles and texts are one space, in the key of the damage too; rows of a null conv_id are one
conversation. Rows stand by turn, nulls first, then by role and a key of the text that tells texts apart. A role's initial is its first character. A row counts as
a duplicate of an equal role and text earlier. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table

MODULUS, FACTOR = (1 << 61) - 1, 0x1F3D5B79A2C4E687 % ((1 << 61) - 1)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial in a state.
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an edit can give in a state, and the state after it.
GIVES = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
NEVER = 1 << 62
BLANK, DUPLICATE, CUT = 1, 2, 3


class Node:
    """The last letter of an audit; ``up[k]`` is the node 2 ** k letters before."""

    __slots__ = ("up", "letter", "depth", "hash", "same")

    def __init__(self, before: Node | None, letter: str):
        self.letter, self.same = letter, self
        if before is None:
            self.up, self.depth, self.hash = (), 0, 0
            return
        self.depth, self.hash = before.depth + 1, (before.hash * FACTOR + ord(letter)) % MODULUS
        up, k = [before], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)

    def back(self, steps: int) -> Node:
        node = self
        while steps:
            k = steps.bit_length() - 1
            node, steps = node.up[k], steps - (1 << k)
        return node

    def text(self) -> str:
        out, node = [], self
        while node.depth:
            out.append(node.letter)
            node = node.up[0]
        return "".join(reversed(out))


def verified(a: Node) -> Node:
    """The first of the nodes that were found to have the same string."""
    while a.same is not a:
        a.same = a.same.same
        a = a.same
    return a


def first_difference(a: Node, b: Node) -> tuple[str, str] | None:
    """The letters at the first place where two audits of equal length differ; None if they are equal."""
    x, y = a, b
    if a.hash != b.hash:
        for k in range(min(len(a.up), len(b.up)) - 1, -1, -1):
            if k < len(x.up) and x.up[k].hash != y.up[k].hash:
                x, y = x.up[k], y.up[k]
        found = (x.letter, y.letter)
        x, y = x.up[0], y.up[0]
    else:
        found = None
    # the prefixes whose hashes agree
    walked = []
    while verified(x) is not verified(y):
        if x.letter != y.letter:
            found, walked = (x.letter, y.letter), []  # a collision: the difference nearest to the start counts
        else:
            walked.append((x, y))
        x, y = x.up[0], y.up[0]
    for p, q in walked:
        verified(p).same = verified(q)
    return found


def before(a: Node, b: Node) -> bool:
    """Whether audit ``a`` is less than ``b``."""
    n = min(a.depth, b.depth)
    found = first_difference(a.back(a.depth - n), b.back(b.depth - n))
    return found[0] < found[1] if found else a.depth < b.depth


class Repair:
    """Best cost and audit of each state, row by row."""

    def __init__(self):
        root = Node(None, "")
        self.states: list[tuple[int, Node | None]] = [(0, root), (NEVER, None), (NEVER, None), (NEVER, None)]
        self.insert()

    @staticmethod
    def better(into: list, state: int, cost: int, node: Node, letter: str) -> bool:
        have, old = into[state]
        if cost > have:
            return False
        new = Node(node, letter)
        if cost < have or before(new, old):
            into[state] = (cost, new)
            return True
        return False

    def insert(self) -> None:
        """Rows inserted before the next one; each costs, so this ends."""
        changed = [s for s in range(4) if self.states[s][1] is not None]
        while changed:
            again = []
            for s in changed:
                cost, node = self.states[s]
                if self.better(self.states, GIVES[s][1], cost + INSERT, node, "I"):
                    again.append(GIVES[s][1])
            changed = again

    def row(self, initial: str, fault: int) -> None:
        after: list[tuple[int, Node | None]] = [(NEVER, None)] * 4
        more = TRUNCATED if fault == CUT else 0
        for s, (cost, node) in enumerate(self.states):
            if node is None:
                continue
            self.better(after, s, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            if (s, initial) in NEXT:
                self.better(after, NEXT[s, initial], cost + more, node, "K")
            self.better(after, GIVES[s][1], cost + REROLE + more, node, "R")
        # from the other states the same edits can follow at no more cost, so what costs more than these is never best
        sure = after[ASSISTANT][0]
        if after[SYSTEM][0] > sure:
            after[SYSTEM] = (NEVER, None)
        if after[NOTHING][0] > sure + DELETE:
            after[NOTHING] = (NEVER, None)
        self.states = after
        self.insert()

    def best(self) -> tuple[int, str]:
        (c, a), (d, b) = self.states[NOTHING], self.states[ASSISTANT]
        if a is None or d < c or (d == c and before(b, a)):
            c, a = d, b
        return c, a.text()


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the damage of each row's key."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    d = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.where("how <> 0").select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("times"))
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


#: Nulls come first.
ORDER = ["conv_id", "turn", "role", "text_key"]


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost and audit of the conversations of ``rows`` (conv_id, turn, role,
    text, text_key), which has one of each text's bytes only what tells texts apart and orders them."""
    solid = r"[^ \t-\r]"
    last = F.regexp_extract("text", rf"({solid})[ \t-\r]*\z", 1)
    narrow = rows.select("conv_id", "turn", "role", "text_key", (~F.col("text").rlike(solid)).alias("is_blank"), (~last.isin(".", "!", "?")).alias("is_cut"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []

        def close() -> None:
            if current is not None:
                cost, audit = repair.best()
                done.append((current[0], *counts, illegal, cost, audit))

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.string()], strict=True)], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

        for batch in stream:
            for conv, role, key, blank, cut in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text_key", "is_blank", "is_cut")), strict=True):
                if current is None or current[0] != conv:
                    close()
                    current, repair, seen, counts, illegal, previous = (conv,), Repair(), set(), [0, 0, 0], 0, None
                own = hashlib.blake2b(b"%d:" % len(role) + role.encode() + key, digest_size=16).digest()
                fault = BLANK if blank else DUPLICATE if own in seen else CUT if cut else 0
                seen.add(own)
                if fault:
                    counts[fault - 1] += 1
                illegal += previous is not None and previous + role[:1] not in ("su", "ua", "au")
                previous = role[:1]
                repair.row(role[:1], fault)
            if len(done) >= 1000:
                yield out()
                done = []
        close()
        if done:
            yield out()

    schema = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return narrow.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(run, schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: ``rows`` edited as the audits of ``found`` say, each conversation's audit first."""
    kinds = ("conv_id", "turn", "role", "text", "text_key", "audit")
    audit = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("text_key"), "audit", F.lit(0).alias("kind"))
    both = audit.unionByName(rows.withColumn("audit", F.lit(None).cast("string")).withColumn("kind", F.lit(1)).select(*kinds, "kind"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, open_ = [], None, False

        def put(role: str, text: str) -> None:
            nonlocal n
            digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            n, state[0] = n + 1, NEXT[state[0], role[:1]]

        def inserts() -> None:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                put(GIVES[state[0]][0], "")
                at += 1

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([y for _, y in done], pa.string())], ["conv_id", "repaired_sha256"])

        for batch in stream:
            for c, role, text, audit in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text", "audit")), strict=True):
                if audit is not None:
                    if open_:
                        done.append((conv, digest.hexdigest()))
                    conv, edits, at, n, state, digest, open_ = c, audit, 0, 0, [NOTHING], hashlib.sha256(), True
                    inserts()
                    continue
                edit, at = edits[at], at + 1
                if edit == "K":
                    put(role, text)
                elif edit == "R":
                    put(GIVES[state[0]][0], text)
                inserts()
            if len(done) >= 1000:
                yield out()
                done = []
        if open_:
            done.append((conv, digest.hexdigest()))
        if done:
            yield out()

    order = [ORDER[0], "kind", *ORDER[1:]]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "audit").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``rows``
    (conv_id, turn, role, text; no nulls in role and text)."""
    # texts are ordered and told apart by themselves; the first pass takes a digest for those that are long
    key = F.when(F.octet_length("text") <= 32, F.encode("text", "UTF-8")).otherwise(F.concat(F.encode(F.substring("text", 1, 8), "UTF-8"), F.unhex(F.sha2(F.col("text"), 256))))
    held = rows.withColumn("text_key", key)
    found = materialize(audits(held), "audits")
    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long")).alias("gaps"))
    # equal texts have equal keys, so both passes see the same order
    same = lambda df, name: df.withColumnRenamed("conv_id", name)
    met = found.join(same(turns, "t"), F.col("conv_id").eqNullSafe(F.col("t"))).drop("t").join(same(repaired(held, found), "r"), F.col("conv_id").eqNullSafe(F.col("r"))).drop("r")
    return met.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults and cheapest repair of each of ``conversations`` after damage; zeros where no row is left."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repairs(damaged(rows))
    every = rows.select(F.col("conv_id").alias("own")).distinct()
    met = every.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("own").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
