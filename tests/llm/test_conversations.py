"""Conversation repair against a memoised search over all edits, and the contract's numbers against plain loops."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from quandrel.llm import conversations

WHITE = "\x20\t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            row = (conv, turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
            out += [row] * (2 if code == 3 else 1)
    return out


def brute_edits(rows):
    """rows: (initial, must go, truncated). Least (cost, audit) such that the initials match (s?(ua)+)?."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        options = []
        if i < len(rows):
            initial, gone, cut = rows[i]
            options.append(("D", 4, i + 1, state, 0))
            if not gone:
                if (state, initial) in moves:
                    options.append(("K", 3 * cut, i + 1, moves[state, initial], 0))
                options += [("R", 3 + 3 * cut, i + 1, moves[state, x], 0) for x in "ua" if (state, x) in moves]
        if inserts < 3:
            options += [("I", 3, i, moves[state, x], inserts + 1) for x in "ua" if (state, x) in moves]
        for letter, cost, j, to, k in options:
            if (rest := best(j, to, k)) is not None:
                found.append((cost + rest[0], letter + rest[1]))
        return min(found, default=None)

    return best(0, "", 0)


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in brute_damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults, tags = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, text in mine:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            tags.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(tags, tags[1:]))
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = brute_edits(tuple(tags))
        said, row, state = [], 0, ""
        for letter in audit:
            if letter in "IR":
                state = "a" if state == "u" else "u"
                said.append(({"u": "user", "a": "assistant"}[state], "" if letter == "I" else mine[row][3]))
            elif letter == "K":
                state = mine[row][2][0]
                said.append(mine[row][2:])
            row += letter != "I"
        assert row == len(mine) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said))
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def table(spark, tmp_path, rows, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def random_rows(seed, sizes):
    rng, rows = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for i in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "USER"])
            text = rng.choice(["Hello.", "Hello there", "What?", " ", "", None, "No!\n", f"Text {rng.randrange(4)}.", f"cut {rng.randrange(4)}", "é…"])
            rows.append((conv if conv else None, rng.choice([i, i, i, i, i // 2, i + 3, None]), role, text))
    return rows


def test_smallest_table(spark):
    rows = duckdb.connect().execute("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.001/conversations.parquet'").fetchall()
    assert found(conversations.op13_conversation_repair(spark, "/root/testdata/sf0.001")) == brute(rows)


@pytest.mark.parametrize("bits", [(1, 1), (2, 1), (10, 10)])
def test_random_rows_in_blocks_of_any_size(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(conversations, "TREE_BITS", bits[1])
    rows = random_rows(bits[0], [9] * 12 + [1, 2, 3] * 5 + [40, 60])
    assert found(conversations.op13_conversation_repair(spark, table(spark, tmp_path, rows))) == brute(rows)


def test_a_conversation_that_damage_empties_and_one_with_an_id_that_is_text(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"c{i}:1".encode()) % 20 == 0)
    rows = [(f"c{gone}", 1, "user", "Hi."), ("", 1, "user", "Hi."), ("", 2, "assistant", "Yes."), (None, 1, "user", "Hm."), (" ", None, "assistant", "x")]
    got = found(conversations.op13_conversation_repair(spark, table(spark, tmp_path, rows, "conv_id string, turn int, role string, text string")))
    assert got == brute(rows)
    assert (f"c{gone}", 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got


def test_edits_are_the_repaired_conversation_and_other_columns_stay_out(spark):
    rows = [(1, 0, "user", "Hi.", "x", 1), (1, 1, "user", "Again.", "y", 2), (1, 2, "assistant", "Yes.", "z", 3)]
    edits, facts = conversations.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, at string, block int"))
    got = [tuple(r) for r in edits.orderBy("conv", "block", "step").select("letter", "role", "text", "cost").collect()]
    assert got == [("K", "user", "Hi.", 0), ("I", "assistant", "", 3), ("K", "user", "Again.", 0), ("K", "assistant", "Yes.", 0)]
    assert [tuple(r)[1:] for r in facts.collect()] == [(0, 0, 0, 0, 1)]


def test_long_texts_and_no_rows(spark, tmp_path):
    rows = [(1, 0, "user", "x" * 500_000), (1, 1, "assistant", "y" * 500_000 + ".")]
    assert found(conversations.op13_conversation_repair(spark, table(spark, tmp_path / "a", rows))) == brute(rows)
    assert found(conversations.op13_conversation_repair(spark, table(spark, tmp_path / "b", []))) == []
