"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import duckdb
import pytest

from millrace.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, _conv string, pos int"


def plain(rows):
    """The contract's row of one conversation, from its damaged rows (turn, role, text), searched without layers."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    n, after = len(rows), {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @cache
    def best(j, state, inserted):
        found = []
        if j == n and state in (0, 3):
            found.append((0, "", ()))
        if inserted < 3:
            letter = "a" if state == 2 else "u"
            c, a, out = best(j, after[state, letter], inserted + 1)
            found.append((c + 2, "I" + a, ({"u": "user:", "a": "assistant:"}[letter], *out)))
        if j < n:
            c, a, out = best(j + 1, state, 0)
            found.append((c + 3, "D" + a, out))
            if kinds[j] not in ("blank", "duplicate"):
                more, (_, role, text) = kinds[j] == "truncated", rows[j]
                if (state, role[:1]) in after:
                    c, a, out = best(j + 1, after[state, role[:1]], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *out)))
                letter = "a" if state == 2 else "u"
                c, a, out = best(j + 1, after[state, letter], 0)
                found.append((c + 2 + more, "R" + a, ({"u": "user:", "a": "assistant:"}[letter] + text, *out)))
        return min(found, default=(10**6, "", ()), key=lambda x: x[:2])

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * n + 1000))
    cost, audit, out = best(0, 0, 0)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def hurt(rows):
    """Each conversation's rows after damage."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def same(got, rows):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = {conv: plain(mine) for conv, mine in hurt(rows).items()}
    assert {r.conv_id: tuple(r[c] for c in names) for r in got} == want and len(got) == len(want)


def test_query(spark, sf):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
    got = queries.op11_repair(spark, sf)
    assert got.dtypes[:7] == [("conv_id", "bigint"), *((c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))]
    same(got.collect(), rows)


@pytest.fixture(scope="module")
def odd():
    draw = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "open", "", " \t", None, "so?\n", "é…", "a b. "]
    rows = []
    for k in range(420):
        text = draw.choice(texts)
        rows.append((k % 60, draw.choice([None, *range(9)]), draw.choice(roles[:3] if k % 3 else roles), text and text + draw.choice(["", "1", "2."])))
    rows += [(None, 3, "user", "No id."), (None, None, None, None), (77, None, "user", "Only nulls."), (77, None, "user", "Only nulls.")]
    rows += [(200, t, draw.choice(roles[:3]), draw.choice(texts[:3]) + str(draw.randrange(60))) for t in range(300)]  # several blocks
    rows += [(201, 4, "user", "Copies.")] * 200 + [(201, 5 + t, "user", "Copies.") for t in range(90)] + [(201, 99, "assistant", "End.")]
    rows += [(202, t, "system", f"Rule {t}.") for t in range(150)] + [(203, t, "user", "") for t in range(70)]
    return rows


def test_odd_rows(spark, odd):
    df = spark.createDataFrame([(*r, "extra", 1) for r in odd], SCHEMA)
    same(repair.judge(df.repartition(3)).collect(), odd)


def test_no_rows(spark):
    assert repair.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair.judge(spark.createDataFrame([(conv, 0, "user", "Hello.", "", 1)], SCHEMA)).collect()
    assert tuple(row)[:-1] == (conv, 0, 0, 0, 0, 0, 0, "") and row.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_repaired_turns_read_as_the_grammar_wants(spark, odd):
    df = spark.createDataFrame([(*r, "extra", 1) for r in odd], SCHEMA)
    fixed = {}
    for r in repair.Repair(df).repaired().orderBy("_conv", "_block", "k").collect():
        fixed.setdefault(r._conv, []).append(r.role[:1])
        assert r.text == "" if r.edit == "I" else r.text.strip()
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in fixed.values())


def test_blocks_of_any_size_give_the_same_audit():
    draw = random.Random(1)
    for _ in range(60):
        turns = [(draw.choice("suax"), draw.randrange(2)) for _ in range(draw.randrange(1, 14))]
        whole = repair.least_audit(turns, [0] * (len(turns) + 1), [0, repair.FAR, repair.FAR, 0])[0]
        cut = draw.randrange(len(turns) + 1)
        parts = [turns[:cut], turns[cut:]]
        costs = repair.crossing(parts[1])
        middle = [min(costs[4 * s + q] for q in (0, 3)) for s in range(4)]
        first = repair.least_audit(parts[0], [0] * (cut + 1), middle)[0]
        second = repair.least_audit(parts[1], [0] * (len(turns) - cut + 1), [0, repair.FAR, repair.FAR, 0])[first[1]]
        assert first[0] + second[0] == whole[0] and first[2] == whole[2]
