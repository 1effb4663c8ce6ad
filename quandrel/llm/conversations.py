"""Conversation structure repair: the cheapest edits that make roles alternate, ties to the least audit.

Plan.  Rows are ordered by conversation and turn in range partitions, and cut into blocks of at most 2^BLOCK_BITS neighbours,
so a conversation of any length is many small groups.  Later copies are found by a sum over (conversation, role, text).
What an output may look like is an automaton of four states: nothing yet, after the system row, after a user row, after an
assistant row.  A block is a 4 x 4 matrix of costs (min-plus); products over a tree of blocks give each block the cost to
go behind it, and the cost DP runs inside blocks.  Nodes of a block (rows passed, state) keep their optimal arcs.  Ranks of
the nodes by the first 1, 2, 4, ... letters of their least audit follow by prefix doubling: a node's rank for 2^(k+1)
letters orders the pairs (its rank for 2^k, that of the node 2^k letters ahead).  The ranks select one arc a node, and the
doubled pointers spell each entry state's least path.  Its exits compose over the same tree, which names the state that
enters each block.  Texts join the chosen edits last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quandrel.llm.staging import light_batches, staged
from quandrel.llm.text import WHITE
from quandrel.operators.ordered import ordered

#: Rows of a block, children of a node of the tree: powers of two.  Node slots that a numpy step works on.
BLOCK_BITS, TREE_BITS, SLOTS = 10, 10, 1 << 18
DELETE, INSERT, REROLE, TRUNCATED, NEVER = 4, 3, 3, 3, 1 << 40
#: Classes of rows by the role's first letter; what a state becomes after one more user, assistant or system row (-1: not allowed).
CLASSES = "sua"
AFTER = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # [class, state]
#: States from which an inserted or rerolled row is a user's, and what each becomes by it.
NEXT = np.array([2, 2, 3, 2])
#: Cost of the inserts that end an output, by state.
END = [0, 6, 3, 0]
#: Letters in ASCII order: the arcs of a node.
LETTERS = "DIKR"
OK, CUT, GONE = 0, 1, 2


def row_costs(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, next state) [rows, 4 states, 4 letters] of consuming rows; kind = 3 * class + (0 as it is, 1 truncated, 2 must go).

    I consumes no row: NEVER here.
    """
    cls, flag = kinds // 3, kinds % 3
    cost = np.full((len(kinds), 4, 4), NEVER)
    to = np.broadcast_to(np.arange(4)[None, :, None], cost.shape).copy()
    cost[:, :, 0] = DELETE
    keeps, extra = AFTER[cls], np.where(flag == CUT, TRUNCATED, 0)[:, None]
    allowed = (flag != GONE)[:, None]
    cost[:, :, 2] = np.where(allowed & (keeps >= 0), extra, NEVER)
    to[:, :, 2] = np.maximum(keeps, 0)
    cost[:, :, 3] = np.where(allowed, REROLE + extra, NEVER)
    to[:, :, 3] = NEXT
    return cost, to


ROW_COST, ROW_TO = row_costs(np.arange(12))


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Cost to go [..., 4] where rows may be inserted first: two in a row at most, for more would come back to a state."""
    one = np.minimum(cost, INSERT + cost[..., NEXT])
    return np.minimum(one, INSERT + one[..., NEXT])


def block_matrix(kinds: np.ndarray) -> list[int]:
    """Min-plus matrix of a block, flat: least cost from each state before it to each state behind it."""
    out = np.where(np.eye(4, dtype=bool), 0, NEVER).T  # [to, from]
    for kind in kinds[::-1]:
        best = np.full((4, 4), NEVER)
        for letter in (0, 2, 3):
            best = np.minimum(best, np.minimum(ROW_COST[kind, :, letter] + out[:, ROW_TO[kind, :, letter]], NEVER))
        out = np.minimum(with_inserts(best), NEVER)
    return out.T.ravel().tolist()


def product(a: list[int], b: list[int]) -> list[int]:
    x, y = np.array(a).reshape(4, 4), np.array(b).reshape(4, 4)
    return np.minimum((x[:, :, None] + y[None]).min(1), NEVER).ravel().tolist()


def applied(state: list[int], matrix: list[int]) -> list[int]:
    return np.minimum((np.array(matrix).reshape(4, 4) + np.array(state)).min(1), NEVER).tolist()


def through(a: list[int], b: list[int]) -> list[int]:
    """Exits of two neighbours as one: exit state by entry state, then the class of the last row."""
    return [*(b[q] for q in a[:4]), b[4]]


def entered(state: list[int], exits: list[int]) -> list[int]:
    return [exits[state[0]], exits[4]]


def carried(nodes: DataFrame, join: Callable, step: Callable, start: list[int], backward: bool = False) -> DataFrame:
    """(conv, block, state): ``start`` passed by ``step`` through the elements before each of ``nodes`` (conv, block,
    element), or through those behind it.  Elements of 2^TREE_BITS neighbours are joined to one, again and again."""
    parent = F.shiftright("block", TREE_BITS)
    levels = [nodes.select("conv", "block", "element")]

    def up(frame: pd.DataFrame) -> pd.DataFrame:
        found = frame.sort_values("block")["element"].map(list).tolist()
        whole = found[0]
        for x in found[1:]:
            whole = join(whole, x)
        return pd.DataFrame({"conv": [frame["conv"].iloc[0]], "block": [frame["up"].iloc[0]], "element": [whole]})

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", ascending=not backward)
        state, states = list(frame["state"].iloc[0]), []
        for x in frame["element"]:
            states.append(state)
            state = step(state, list(x))
        return pd.DataFrame({"conv": frame["conv"], "block": frame["block"], "state": states})

    while levels[-1].groupBy("conv").count().filter("count > 1").limit(1).collect():
        grouped = levels[-1].withColumn("up", parent).groupBy("conv", "up")
        levels.append(staged(grouped.applyInPandas(up, "conv string, block long, element array<long>"), "tree"))
    states = levels[-1].select("conv", "block", F.array(*(F.lit(x).cast("long") for x in start)).alias("state"))
    for level in levels[-2::-1]:
        children = level.withColumn("up", parent).join(states.withColumnRenamed("block", "up"), ["conv", "up"])
        states = staged(children.groupBy("conv", "up").applyInPandas(down, "conv string, block long, state array<long>"), "states")
    return states


def least_paths(kinds: list[np.ndarray], ahead: np.ndarray, last: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """For blocks of rows: the least audit and the exit state of each entry state.

    ``ahead`` [blocks, 4] is the cost to go behind a block; a ``last`` block may still insert there, others stop.
    """
    n, blocks = max(map(len, kinds)), len(kinds)
    kind = np.zeros((blocks, n), dtype=np.int64)
    size = np.array([len(k) for k in kinds])
    for row, k in zip(kind, kinds):
        row[: len(k)] = k
    # cost DP from the end of each block; its nodes are (rows passed, state)
    cost = np.full((blocks, n + 1, 4), NEVER)
    arcs, to = np.full((blocks, n + 1, 4, 4), 2 * NEVER), np.zeros((blocks, n + 1, 4, 4), dtype=np.int64)
    at = np.arange(blocks)
    cost[at, size] = ahead
    for i in range(n - 1, -1, -1):
        live = np.flatnonzero(size > i)
        of = kind[live, i]
        arcs[live, i] = ROW_COST[of] + np.take_along_axis(cost[live, i + 1], ROW_TO[of].reshape(len(live), 16), 1).reshape(-1, 4, 4)
        to[live, i] = ROW_TO[of] + 4 * (i + 1)
        cost[live, i] = with_inserts(arcs[live, i].min(2))
    inside = np.arange(n + 1)[None] < size[:, None]
    inside[at, size] = last
    arcs[..., 1] = np.where(inside[..., None], INSERT + cost[..., NEXT], 2 * NEVER)
    to[..., 1] = NEXT + 4 * np.arange(n + 1)[:, None]
    to = (to + (at * 4 * (n + 1))[:, None, None, None]).reshape(-1, 4)
    optimal = ((arcs == cost[..., None]) & (cost < NEVER)[..., None]).reshape(-1, 4)
    nodes = np.arange(len(to))
    ends = ~optimal.any(1)
    # ranks by the first letter, then by twice as many letters a round; pointers are doubled with them
    first = optimal.argmax(1)
    rank, ahead_of, powers = np.where(ends, 0, 1 + first), np.where(ends, nodes, to[nodes, first]), []
    while True:
        powers.append(ahead_of)
        if (ends[ahead_of]).all():
            break
        rank = np.unique(rank * (len(nodes) + 5) + rank[ahead_of], return_inverse=True)[1]
        ahead_of = ahead_of[ahead_of]
    chosen = np.where(optimal, np.arange(4) * (len(nodes) + 5) + rank[to], 5 * (len(nodes) + 5)).argmin(1)
    if (chosen != first)[~ends].any():
        raise AssertionError("ranks and pointers disagree")
    # the nodes of each entry's path, doubled
    path = (np.arange(blocks)[:, None] * 4 * (n + 1) + np.arange(4)).reshape(-1, 1)
    for step in powers:
        path = np.concatenate([path, step[path]], axis=1)
    letters = np.append(np.frombuffer(LETTERS.encode(), dtype="S1"), np.array([b""], dtype="S1"))[np.where(ends, 4, chosen)]
    audits = [x.decode() for x in np.ascontiguousarray(letters[path]).view(f"S{path.shape[1]}").ravel()]
    exits = (path[:, -1] % 4).reshape(blocks, 4)
    return [audits[4 * i : 4 * i + 4] for i in range(blocks)], exits


def solved(blocks: DataFrame) -> DataFrame:
    """``blocks`` (conv, block, ats, kinds, ahead, last) with audits and exits by entry state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [np.array(k, dtype=np.int64) for k in batch.column("kinds").to_pylist()]
            ahead, last = np.array(batch.column("ahead").to_pylist()), np.array(batch.column("last").to_pylist())
            audits, exits = [[]] * len(kinds), np.zeros((len(kinds), 5), dtype=np.int64)
            order, i = sorted(range(len(kinds)), key=lambda b: -len(kinds[b])), 0
            while i < len(order):
                part = order[i : i + max(1, SLOTS // (16 * (len(kinds[order[i]]) + 1)))]
                found, exits[part, :4] = least_paths([kinds[b] for b in part], ahead[part], last[part])
                for b, x in zip(part, found):
                    audits[b] = x
                i += len(part)
            exits[:, 4] = [k[-1] // 3 for k in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "block", "ats", "kinds")), pa.array(audits, pa.list_(pa.string())), pa.array(exits.tolist(), pa.list_(pa.int64()))], ["conv", "block", "ats", "kinds", "audits", "exits"])

    return blocks.select("conv", "block", "ats", "kinds", "ahead", "last").mapInArrow(run, "conv string, block long, ats array<long>, kinds array<int>, audits array<string>, exits array<long>")


def edited(blocks: DataFrame) -> DataFrame:
    """(conv, block, step, letter, at, role): the steps of each block (conv, block, ats, audit, entry); role of rows that are
    inserted or rerolled, ``at`` of rows that are consumed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for conv, block, ats, audit, entry, kinds in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "ats", "audit", "entry", "kinds"))):
                state, row = entry, 0
                for step, letter in enumerate(audit):
                    role = None
                    if letter in "IR":
                        state = int(NEXT[state])
                        role = "user" if state == 2 else "assistant"
                    elif letter == "K":
                        state = int(AFTER[kinds[row] // 3, state])
                    for column, value in zip(out, (conv, block, step, letter, None if letter == "I" else ats[row], role)):
                        column.append(value)
                    row += letter != "I"
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()))], ["conv", "block", "step", "letter", "at", "role"])

    return blocks.select("conv", "block", "ats", "kinds", "audit", "entry").mapInArrow(run, "conv string, block long, step int, letter string, at long, role string")


def conv_key(conv_id: Column) -> Column:
    """conv_id as text that is never null, so that rows without an id are a conversation too."""
    return F.when(conv_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def judged(rows: DataFrame) -> DataFrame:
    """(conv, at, turn, kind, fault) of ordered rows: the first fault of each, and the kind by which the DP knows it."""
    bare = F.btrim("text", F.lit(WHITE))
    letter = F.substring("role", 1, 1)
    cls = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    slim = rows.select("conv", "at", "turn", cls.alias("cls"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(13), "text", "role").alias("h2"))
    copies = staged(slim.groupBy("conv", "h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.col("ended"), "truncated")
    flag = F.when(fault.isin("blank", "duplicate"), GONE).when(fault == "truncated", CUT).otherwise(OK)
    return slim.join(copies, ["conv", "h1", "h2"], "left").select("conv", "at", "turn", (3 * F.col("cls") + flag).cast("int").alias("kind"), fault.alias("fault"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, facts) of ``conversations`` (conv_id, turn, role, text).

    ``edits`` (conv_id, block, step, letter, role, text, cost), in the order of block and step: each row's K, R or D, and
    inserted rows (I); rows with K, R and I are the repaired conversation.  ``facts``: conv_id, gaps, blank, duplicate,
    truncated, illegal, one row a conversation.

    Rows go by turn, null first; rows of one turn by role, then text, and equal rows are copies.  Null role and text are
    one space, so a null text is blank; an empty role is no known role.  Rows of a null conv_id are one conversation.
    Roles count by their first letter.  Conversations and texts may have any length: no group holds more rows than a block.
    Other columns are left out, whatever they are named.  No rows, no result.
    """
    light_batches(conversations.sparkSession)
    text = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    mine = conversations.select(conv_key(F.col("conv_id")).alias("conv"), "conv_id", "turn", text("role"), text("text"))
    rows = ordered(mine.withColumn("copy", F.monotonically_increasing_id()), ["conv"], [F.asc_nulls_first("turn"), "role", "text", "copy"], [F.asc_nulls_first("turn"), F.substring("role", 1, 32), F.substring("text", 1, 64), "copy"], at="at")
    known = staged(judged(rows), "judged")
    lists = F.array_sort(F.collect_list(F.struct("at", "kind")))
    grouped = known.groupBy("conv", F.shiftright("at", BLOCK_BITS).alias("block")).agg(lists.alias("rows")).select("conv", "block", F.col("rows.at").alias("ats"), F.col("rows.kind").alias("kinds"))
    blocks = staged(grouped, "blocks")
    many = staged(blocks.groupBy("conv").agg(F.count("*").alias("n"), F.max("block").alias("last")).filter("n > 1"), "many")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"conv": frame["conv"], "block": frame["block"], "element": [block_matrix(np.asarray(k)) for k in frame["kinds"]]})

    long = blocks.join(many.select("conv"), "conv", "left_semi")
    costs = staged(long.select("conv", "block", "kinds").mapInPandas(matrices, "conv string, block long, element array<long>"), "matrices")
    ahead = carried(costs, product, applied, END, backward=True)
    end = F.array(*(F.lit(x).cast("long") for x in END))
    asked = blocks.join(many, "conv", "left").join(ahead, ["conv", "block"], "left")
    done = staged(solved(asked.withColumns({"ahead": F.coalesce("state", end), "last": F.col("last").isNull() | (F.col("last") == F.col("block"))})), "solved")
    entries = carried(done.join(many.select("conv"), "conv", "left_semi").select("conv", "block", F.col("exits").alias("element")), through, entered, [0, -1])
    chosen = done.join(entries, ["conv", "block"], "left").withColumns({"entry": F.coalesce(F.col("state")[0], F.lit(0)).cast("int"), "before": F.coalesce(F.col("state")[1], F.lit(-1)).cast("int")})
    chosen = staged(chosen.withColumn("audit", F.col("audits")[F.col("entry")]), "chosen")
    steps = edited(chosen)
    source = rows.select("at", F.col("role").alias("_role"), "text").join(known.select("at", F.col("kind").alias("_kind")), "at")
    cost = F.when(F.col("letter") == "D", DELETE).when(F.col("letter") == "I", INSERT).otherwise(F.when(F.col("letter") == "R", REROLE).otherwise(0) + F.when(F.col("_kind") % 3 == CUT, TRUNCATED).otherwise(0))
    edits = steps.join(source, "at", "left").select("conv", "block", "step", "letter", F.coalesce("role", "_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), cost.cast("long").alias("cost"))
    pair = lambda a, b: (F.when((a == 0) & (b == 1), 0).when((a == 1) & (b == 2), 0).when((a == 2) & (b == 1), 0).otherwise(1)).cast("long")
    cls = F.transform("kinds", lambda k: (k / 3).cast("int"))
    inner = F.aggregate(F.sequence(F.lit(1), F.size("kinds") - 1), F.lit(0).cast("long"), lambda s, i: s + pair(F.get(cls, i - 1), F.get(cls, i)))
    illegal = chosen.select("conv", (F.when(F.size("kinds") > 1, inner).otherwise(0) + F.when(F.col("before") >= 0, pair(F.col("before"), F.get(cls, F.lit(0)))).otherwise(0)).alias("n"))
    of = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    turns = known.groupBy("conv", "turn").agg(*(of(x) for x in ("blank", "duplicate", "truncated")))
    sums = turns.groupBy("conv").agg(*(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    return edits, sums.join(illegal.groupBy("conv").agg(F.sum("n").alias("illegal")), "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal")


def digests(edits: DataFrame) -> DataFrame:
    """(conv, cost, audit, repaired_sha256) by one pass over each conversation's edits in order; a text is hashed and forgotten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cost, audit, sha, some = None, 0, [], hashlib.sha256(), False
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for conv, letter, role, text, price in zip(*(batch.column(c).to_pylist() for c in ("conv", "letter", "role", "text", "cost"))):
                if conv != now:
                    if now is not None:
                        for column, value in zip(out, (now, cost, "".join(audit), sha.hexdigest())):
                            column.append(value)
                    now, cost, audit, sha, some = conv, 0, [], hashlib.sha256(), False
                cost += price
                audit.append(letter)
                if letter != "D":
                    sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["conv", "cost", "audit", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, cost, "".join(audit), sha.hexdigest()), (pa.string(), pa.int64(), pa.string(), pa.string()))], ["conv", "cost", "audit", "repaired_sha256"])

    dealt = edits.repartition("conv").sortWithinPartitions("conv", "block", "step")
    return dealt.select("conv", "letter", "role", "text", "cost").mapInArrow(run, "conv string, cost long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults planted by crc32 of conv_id:turn, a null being one space.

    Of the remainders by 20, 0 drops the row, 1 empties its text, 2 removes . ! and ? from it, 3 repeats the row, and 4 sets
    its role to user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    edits, facts = repair(damaged(rows))
    ids = rows.select("conv_id").distinct().withColumn("conv", conv_key(F.col("conv_id")))
    out = ids.join(facts, "conv", "left").join(digests(edits), "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
