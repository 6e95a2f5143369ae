"""Conversation repair against a forward search over whole label strings, on both paths."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from placewise.llm import repair
from placewise.llm.queries import QUERIES

CONVERSATIONS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def brute_damage(rows):
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 1:
            text = ""
        elif draw == 2:
            text = re.sub("[.!?]", "", text)
        elif draw == 4:
            role = "user"
        for _ in range((draw != 0) + (draw == 3)):
            yield conv, turn, role, text


def prefixes_of_grammar(roles):
    """Whether roles can begin a legal string."""
    return any(LEGAL.fullmatch(roles + more) for more in ("", "a", "ua"))


def brute_edits(rows):
    """(cost, audit, lines): cheapest first, then least audit; a state stands for all that can be continued alike."""
    def better(into, roles, value):
        if prefixes_of_grammar(roles):
            roles = roles if roles == "s" else {"u": "u", "a": "ua", "": ""}[roles[-1:]]
            if roles not in into or value[:2] < into[roles][:2]:
                into[roles] = value

    now = {"": (0, "", [])}

    def inserted(held):
        for _ in range(4):
            for roles, (cost, audit, lines) in list(held.items()):
                for c in "ua":
                    better(held, roles + c, (cost + 2, audit + "I", [*lines, f"{NAMES[c]}:"]))
        return held

    now = inserted(now)
    for role, text, must_go, truncated in rows:
        after = {}
        for roles, (cost, audit, lines) in now.items():
            better(after, roles, (cost + 3, audit + "D", lines))
            if not must_go:
                if role[:1] in ("s", "u", "a"):
                    better(after, roles + role[0], (cost + truncated, audit + "K", [*lines, f"{role}:{text}"]))
                for c in "ua":
                    better(after, roles + c, (cost + 2 + truncated, audit + "R", [*lines, f"{NAMES[c]}:{text}"]))
        now = inserted(after)
    return min(v for roles, v in now.items() if roles == "" or roles.endswith("a"))


def brute(rows):
    """Of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:256], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults, marked = set(), defaultdict(int), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    turns = {r[0] for r in rows if r[0] is not None}
    cost, audit, lines = brute_edits(marked)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_report(ids, rows):
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(tuple(row))
    return {(conv, *brute(by[conv])) for conv in set(ids)}


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def many_parts(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def test_op13(spark, sf_dir, table):
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op13_conversation_repair"](spark, sf_dir)
    assert df.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert {t for c, t in df.dtypes if c not in ("audit", "repaired_sha256")} == {"bigint"}
    assert found(df) == brute_report([r[0] for r in rows], brute_damage(rows))


def random_rows(rng, n_convs=60, most=14):
    texts = ["Yes.", "No", "What?", "", " \n", "Go on.", "A much longer answer without an end" * 3, "…", "Done! \t", ". \x0b"]
    roles = ["user", "assistant", "system", "tool", "", "u", "State", " ", "süß", None]
    return [(c, rng.choice([None, *range(9)]), rng.choice(roles[: rng.choice([3, 10])]), rng.choice([None, *texts])) for c in [None, *range(n_convs)] for _ in range(rng.randrange(most))]


@pytest.mark.parametrize("long_rows", [10**6, 0, 6])
def test_odd_rows_on_both_paths(spark, many_parts, long_rows):
    rows = random_rows(random.Random(5))
    rows += [(1, t, "user", "Same.") for t in range(40)] + [(2, 3, "user", "Same.")] * 50 + [(3, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(120)]
    df = spark.createDataFrame([(*r, "x") for r in rows], CONVERSATIONS + ", Cost string")
    ids = spark.createDataFrame([(r[0],) for r in rows] + [(77777,)], "conv_id long")
    cleaned = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = brute_report([*(r[0] for r in rows), 77777], cleaned)
    assert found(repair.report_all(ids, df, long_rows=long_rows)) == want
    assert (77777, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want
    lines = repair.repair(df, long_rows=long_rows).orderBy("conv_id", "part", "at", "sub").collect()
    by = defaultdict(list)
    for r in lines:
        by[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(LEGAL.fullmatch("".join(x[0] for x in v)) for v in by.values())
    assert {(w[0], w[-1]) for w in want if w[0] in by} == {(c, hashlib.sha256("\n".join(v).encode()).hexdigest()) for c, v in by.items()}


def test_a_hot_conversation_is_dealt_over_tasks(spark, many_parts):
    rng = random.Random(9)
    rows = [(0, t, rng.choice(["user", "assistant"]), rng.choice(["Fine.", f"Answer {t}", f"Answer {t}."])) for t in range(3000)] + [(0, 5, "user", "Copy.")] * 2000
    df = spark.createDataFrame(rows, CONVERSATIONS)
    assert repair._parts(repair._prepared(df)).groupBy("part").count().count() > 2
    assert found(repair.report(df, long_rows=100)) == found(repair.report(df, long_rows=10**6)) == brute_report([0], rows)


def test_empty_and_very_long_texts(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert repair.report_all(none, repair.damaged(none)).count() == 0
    assert repair.repair(none).count() == 0
    rows = [(0, 0, "user", "word " * 200_000 + "."), (0, 1, "assistant", " " * 300_000)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    assert found(repair.report(df)) == found(repair.report(df, long_bytes=10)) == brute_report([0], rows)


def test_ties_take_the_least_labels():
    # one user row alone: deleting costs 3, an answer put in behind it 2
    assert repair.trace([("u", repair.WHOLE, 1)], repair.END, repair.START, True)[0] == [("K", "u"), ("I", "a")]
    # user, user: D or R would do at unequal costs, I between them and behind is dearer
    path = repair.trace([("u", repair.WHOLE, 1), ("u", repair.WHOLE, 1)], repair.END, repair.START, True)[0]
    assert "".join(x for x, _ in path) == "KR"
