"""Conversation structure repair: cost layers of bitsets over grammar states, after Wu and Manber.

The roles of a conversation must read (s?(ua)+)? by initials: START, SYSTEM (after s), USER (after u), REPLY (after a),
of which START and REPLY accept. Layer d holds, for each place between turns, a bitset of the states from which the
rest can be repaired at cost d exactly; the layers grow until the wanted bits are set. A bitset has a group of four bits
for each state in which the turns may be left, so that one run serves all of them.

Conversations are cut in blocks of turns. Blocks are solved in parallel; between them only 16 costs a block are passed
on, so a conversation of any length costs linear time and its turns lie in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import SPACE_CHARS, prefix_sums, written

#: Turns of a block, and the costs of the edits; a truncated turn that stays costs TRUNCATED more.
BLOCK = 64
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, REPLY = range(4)
FAR = 1 << 60

#: The state after a turn's initial.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): REPLY, (REPLY, "u"): USER}
#: The only role that an edit can put in a state, by its initial.
WANTED = {START: "u", SYSTEM: "u", USER: "a", REPLY: "u"}
ROLES = {"u": "user", "a": "assistant"}
LOW = 0x1111  # the lowest bit of each group


def before(bits: int, initial: str) -> int:
    """The states from which a turn with this initial leads into bits."""
    if initial == "s":
        return bits >> SYSTEM & LOW
    if initial == "u":
        return (bits >> USER & LOW) * (1 << START | 1 << SYSTEM | 1 << REPLY)
    return (bits >> REPLY & LOW) << USER if initial == "a" else 0


def layers(turns: list[tuple[str, int]], leaving: dict[int, list[int]], wanted: int, most: int) -> list[list[int]]:
    """Layers 0, 1, ... of bitsets, one for each place before, between and after turns (initial, truncated).

    leaving: for a cost, the bits that are set after the last turn. Ends with the first layer by which all wanted bits
    have been set before the first turn, or at cost most.
    """
    n, out, met, d = len(turns), [], 0, 0
    while True:
        two, three = (out[d - 2] if d >= 2 else None), (out[d - 3] if d >= 3 else None)
        row = [0] * (n + 1)
        row[n] = leaving.get(d, 0)
        if two:
            row[n] |= before(two[n], "u") | before(two[n], "a")
        for j in range(n - 1, -1, -1):
            initial, cut = turns[j]
            stays = row[j + 1] if not cut else out[d - 1][j + 1] if d else 0
            bits = before(stays, initial)
            if d >= REROLE + cut:
                changed = out[d - REROLE - cut][j + 1]
                bits |= before(changed, "u") | before(changed, "a")
            if three:
                bits |= three[j + 1]
            if two:
                bits |= before(two[j], "u") | before(two[j], "a")
            row[j] = bits
        out.append(row)
        met |= row[0]
        if met & wanted == wanted or d >= most:
            return out
        d += 1


def crossing(turns: list[tuple[str, int]]) -> list[int]:
    """The least cost from each state before the turns to each state after them (by first state), FAR if there is no way."""
    found = layers(turns, {0: sum(1 << 5 * q for q in range(4))}, 0xFFFF, DELETE * len(turns) + 3 * INSERT)
    out = [FAR] * 16
    for d, row in enumerate(found):
        for s in range(4):
            for q in range(4):
                if out[4 * s + q] == FAR and row[0] >> (4 * q + s) & 1:
                    out[4 * s + q] = d
    return out


def least_audit(turns: list[tuple[str, int]], extra: list[int], after: list[int]) -> list[tuple[str, int, int]]:
    """For each state before the turns: the least cheapest audit, the state after them, and the cost up to the end.

    after: the least cost to the conversation's end from each state after the turns. extra[j]: turns that must be
    deleted before turn j, or after the last; deletions come as early as they can, as D sorts before the other edits.
    """
    base = min(after)
    leaving: dict[int, int] = {}
    for q, cost in enumerate(after):
        if cost < FAR:
            leaving[cost - base] = leaving.get(cost - base, 0) | 1 << q
    found = layers(turns, leaving, 0xF, DELETE * len(turns) + 3 * INSERT + max(leaving))
    forced = DELETE * sum(extra)
    out = []
    for s in range(4):
        left = cost = next((d for d, row in enumerate(found) if row[0] >> s & 1), FAR)
        audit, state, j = ["D" * extra[0]], s, 0
        while cost < FAR and (j < len(turns) or left != after[state] - base):
            d = left - DELETE
            if j < len(turns) and d >= 0 and found[d][j + 1] >> state & 1:
                step, left, j = "D", d, j + 1
            elif left >= INSERT and found[left - INSERT][j] >> NEXT[state, WANTED[state]] & 1:
                step, left, state = "I", left - INSERT, NEXT[state, WANTED[state]]
            else:
                initial, cut = turns[j]
                kept = NEXT.get((state, initial))
                if kept is not None and left >= cut and found[left - cut][j + 1] >> kept & 1:
                    step, left, state = "K", left - cut, kept
                else:
                    step, left, state = "R", left - REROLE - cut, NEXT[state, WANTED[state]]
                j += 1
            audit.append(step)
            if step != "I":
                audit.append("D" * extra[j])
        out.append(("".join(audit), state, cost + base + forced if cost < FAR else FAR))
    return out


def _parts(rows) -> tuple[list[tuple[str, int]], list[int]]:
    """The turns that may stay, and how many before each of them, and after the last, must be deleted."""
    turns, extra = [], [0]
    for r in rows:
        if r["stays"]:
            turns.append((r["initial"], int(r["truncated"])))
            extra.append(0)
        extra[-1] += int(r["n"]) - bool(r["stays"])
    return turns, extra


@F.pandas_udf(ArrayType(LongType()))
def _crossing(blocks: pd.Series) -> pd.Series:
    def one(rows) -> list[int]:
        turns, extra = _parts(rows)
        return [c + DELETE * sum(extra) if c < FAR else FAR for c in crossing(turns)]

    return blocks.map(one)


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _afterwards(conversations: pd.Series) -> pd.Series:
    """For each block in order, the least cost to the end from each state after it."""

    def one(costs) -> list[list[int]]:
        after, out = [0, FAR, FAR, 0], []
        for c in reversed(list(costs)):
            out.append(after)
            after = [min(min(int(c[4 * s + q]) + after[q] for q in range(4)), FAR) for s in range(4)]
        return out[::-1]

    return conversations.map(one)


@F.pandas_udf(ArrayType(StructType().add("audit", StringType()).add("state", IntegerType()).add("cost", LongType())))
def _audits(blocks: pd.Series, after: pd.Series) -> pd.Series:
    def one(rows, costs) -> list[dict]:
        return [dict(zip(("audit", "state", "cost"), way, strict=True)) for way in least_audit(*_parts(rows), [int(c) for c in costs])]

    return pd.Series([one(*x) for x in zip(blocks, after, strict=True)], blocks.index)


@F.pandas_udf(ArrayType(IntegerType()))
def _states(conversations: pd.Series) -> pd.Series:
    """The state before each block: that after the block before, from START."""

    def one(ways) -> list[int]:
        state, out = START, []
        for w in ways:
            out.append(state)
            state = int(w[state])
        return out

    return conversations.map(one)


@F.pandas_udf(ArrayType(StructType().add("pos", LongType()).add("k", IntegerType()).add("edit", StringType()).add("role", StringType())))
def _edits(blocks: pd.Series, audits: pd.Series, states: pd.Series) -> pd.Series:
    """The turns of the repaired conversation in order k: kept and re-roled ones with their row's place, inserted ones."""

    def one(rows, audit: str, state: int) -> list[dict]:
        out, at, copies = [], 0, 0  # of the row at hand, how many copies have been dealt with
        for k, step in enumerate(audit):
            if step in "IR":
                out.append({"pos": None if step == "I" else int(rows[at]["pos"]), "k": k, "edit": step, "role": ROLES[WANTED[state]]})
                state = NEXT[state, WANTED[state]]
            elif step == "K":
                out.append({"pos": int(rows[at]["pos"]), "k": k, "edit": step, "role": None})
                state = NEXT[state, rows[at]["initial"]]
            if step != "I":
                copies += 1
                if copies == rows[at]["n"]:
                    at, copies = at + 1, 0
        return out

    return pd.Series([one(*x) for x in zip(blocks, audits, states, strict=True)], blocks.index)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, joined by newlines; rows come in order, so one line is held at a time."""
    key, digest = None, None
    for batch in batches:
        keys, hashes = [], []
        for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    keys.append(key)
                    hashes.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n")
                digest.update(line.encode())
        yield pa.RecordBatch.from_pydict({"_conv": pa.array(keys, pa.string()), "repaired_sha256": pa.array(hashes, pa.string())})
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"_conv": [key], "repaired_sha256": [digest.hexdigest()]})


def _conv() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(" ")).alias("_conv")


class Repair:
    """The repair of every conversation of rows (conv_id, turn, role, text).

    Rows are taken by turn (nulls first), then role and text; null roles and texts read as one space, null conv_ids are
    one conversation. Equal rows of one turn are copies of which all but the first are duplicates. A row is blank
    without a character outside white space, else duplicate if its role and text came earlier, else truncated if its
    last such character isn't . ! or ?. Blank and duplicate rows are deleted. Other columns are not read.
    """

    def __init__(self, rows: DataFrame):
        text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
        order = [F.col("_conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
        copies = rows.select(_conv(), "conv_id", "turn", role.alias("role"), text.alias("text")).groupBy("_conv", "conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
        ranges = copies.repartitionByRange(*order).select("*", F.xxhash64("role", "text").alias("_h1"), F.xxhash64(F.lit(1), "role", "text").alias("_h2"), F.spark_partition_id().alias("_part"))
        self._copies = written(ranges)
        # the first turn of each role and text: counted before the shuffle, so that a common line is a row a task
        firsts = self._copies.groupBy("_conv", "_h1", "_h2").agg(F.min("turn").alias("_first"), F.max(F.col("turn").isNull()).alias("_null"), F.count("*").alias("_turns"))
        firsts = written(firsts.where("_turns > 1"))
        placed = prefix_sums(self._copies, [["_conv"], ["_part"]], [F.col("turn").asc_nulls_first(), "role", "text"], "n", "pos")
        placed = placed.join(firsts, ["_conv", "_h1", "_h2"], "left")
        first = F.col("_turns").isNull() | F.when(F.col("_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("_first"))
        bare = F.btrim("text", F.lit(SPACE_CHARS))
        rows = placed.select(
            "_conv", "conv_id", "turn", "role", "text", "n", "pos", F.floor(F.col("pos") / BLOCK).cast("long").alias("_block"),
            (bare == "").alias("blank"), ((bare != "") & first).alias("stays"), ((bare != "") & ~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        )
        self.rows = written(rows)
        self._blocks = self._solved()

    def _solved(self) -> DataFrame:
        """(_conv, _block, rows, audit, state, cost): each block with its part of the audit, the state before it and the cost from there on."""
        turn = F.struct("pos", "n", F.substring("role", 1, 1).alias("initial"), "stays", "truncated")
        blocks = written(self.rows.groupBy("_conv", "_block").agg(F.sort_array(F.collect_list(turn)).alias("rows")))
        costs = blocks.select("_conv", F.struct("_block", _crossing("rows").alias("c")).alias("b")).groupBy("_conv").agg(F.sort_array(F.collect_list("b")).alias("bs"))
        after = costs.select("_conv", F.explode(F.arrays_zip(F.col("bs._block").alias("_block"), _afterwards("bs.c").alias("after"))).alias("z")).select("_conv", "z.*")
        solved = written(blocks.join(after, ["_conv", "_block"]).withColumn("ways", _audits("rows", "after")))
        ways = solved.select("_conv", F.struct("_block", F.col("ways.state").alias("to")).alias("b")).groupBy("_conv").agg(F.sort_array(F.collect_list("b")).alias("bs"))
        states = ways.select("_conv", F.explode(F.arrays_zip(F.col("bs._block").alias("_block"), _states("bs.to").alias("state"))).alias("z")).select("_conv", "z.*")
        way = F.element_at("ways", F.col("state") + 1)
        return written(solved.join(states, ["_conv", "_block"]).select("_conv", "_block", "rows", "state", way.audit.alias("audit"), way.cost.alias("cost")))

    def audits(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation that has rows.

        A conversation's audit is one string, a character for each edit, so it has to fit in a row.
        """
        kept = F.col("stays").cast("long")
        counts = self.rows.groupBy("_conv").agg(
            F.first("conv_id").alias("conv_id"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
            F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - kept)).alias("duplicate"),
            F.sum(F.when(F.col("stays") & F.col("truncated"), 1).otherwise(0)).cast("long").alias("truncated"),
            F.sum(F.col("n") - 1).alias("_repeats"),
        )
        initials = F.col("rows.initial")
        pairs = F.zip_with(F.slice(initials, F.lit(1), F.size("rows") - 1), F.slice(initials, F.lit(2), F.size("rows") - 1), lambda a, b: F.concat(a, b))
        wrong = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
        part = F.struct("_block", "audit", "cost", wrong.alias("wrong"), F.element_at(initials, 1).alias("first"), F.element_at(initials, -1).alias("last"))
        joined = self._blocks.select("_conv", part.alias("b")).groupBy("_conv").agg(F.sort_array(F.collect_list("b")).alias("bs"))
        seams = F.zip_with(F.slice("bs.last", F.lit(1), F.size("bs") - 1), F.slice("bs.first", F.lit(2), F.size("bs") - 1), lambda a, b: F.concat(a, b))
        between = F.size(F.filter(seams, lambda p: ~p.isin("su", "ua", "au")))
        inside = F.aggregate("bs.wrong", F.lit(0).cast("long"), lambda a, x: a + x)
        joined = joined.select("_conv", F.array_join("bs.audit", "").alias("audit"), F.element_at("bs", 1).cost.alias("cost"), (inside + between).alias("_wrong"))
        out = counts.join(joined, "_conv").withColumn("illegal", F.col("_wrong") + F.col("_repeats"))
        return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "_conv")

    def repaired(self) -> DataFrame:
        """_conv, conv_id, _block, k, edit, role and text of each turn of the repaired conversations, in order of _block and k.

        edit is K (as it was), R (another role) or I (inserted, with an empty text and no conv_id).
        """
        edits = self._blocks.select("_conv", "_block", F.explode(_edits("rows", "audit", "state")).alias("e")).select("_conv", "_block", "e.*")
        rows = self.rows.where("stays").select("_conv", "_block", "pos", "conv_id", F.col("role").alias("_role"), "text")
        taken = edits.where("edit <> 'I'").join(rows, ["_conv", "_block", "pos"])
        taken = taken.select("_conv", "conv_id", "_block", "k", "edit", F.coalesce("role", "_role").alias("role"), "text")
        return taken.unionByName(edits.where("edit = 'I'").select("_conv", "_block", "k", "edit", "role", F.lit("").alias("text")), allowMissingColumns=True)

    def digests(self) -> DataFrame:
        """_conv and repaired_sha256 of each conversation with repaired turns: role:text, joined by newlines.

        A hash has to see a conversation in order, so one task streams it; it holds a batch at a time.
        """
        lines = self.repaired().select("_conv", "_block", "k", F.concat_ws(":", "role", "text").alias("line"))
        ordered = lines.repartition("_conv").sortWithinPartitions("_conv", "_block", "k").select("_conv", "line")
        return ordered.mapInArrow(_hashed, "_conv string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by crc32("conv_id:turn") % 20; a null of any column is one space there.

    0 drops the row, 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4 makes it the user's.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hurt = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), kind.alias("_kind"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    ).where("_kind <> 0")
    times: Column = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.withColumn("_copy", F.explode(times)).select("conv_id", "turn", "role", "text")


def judge(conversations: DataFrame) -> DataFrame:
    """Every conv_id of conversations with its damaged rows' counts, cost, audit and the repaired rows' hash.

    Conversations of which no row is left have zeros, an empty audit and the hash of nothing. Rows of one turn are
    taken by role and text.
    """
    repair = Repair(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = conversations.select("conv_id", _conv()).distinct()
    out = ids.join(repair.audits().drop("conv_id"), "_conv", "left").join(repair.digests(), "_conv", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
