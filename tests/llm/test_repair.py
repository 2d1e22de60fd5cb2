"""Conversation repair against a plain search over edits, which itself is held against the pattern."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from linkwork.llm import ranking, repair
from linkwork.llm.queries import op11_structure_repair
from paths import SF_MID

WORD = re.compile("[^\x20\x09-\x0D]")
SHORT = {"u": "user", "a": "assistant"}


def harm(rows):
    """Damaged rows of (conv, turn, role, text), in the order that ties have."""
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s, role, text = (" " if x is None else str(x) for x in (conv, turn, role, text))
        k = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        letters = WORD.findall(text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def least(rows, marks):
    """Cost, audit and repaired rows by recursion on (row, what stands so far)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def best(i, state, fresh):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if fresh < 2:
            for r in "ua":
                if (state, r) in step:
                    c, audit, rest = best(i, step[state, r], fresh + 1)
                    options.append((c + 2, "I" + audit, ((SHORT[r], ""), rest)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, audit, rest = best(i + 1, state, 0)
            options.append((c + 3, "D" + audit, rest))
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                if (state, role[:1]) in step:
                    c, audit, rest = best(i + 1, step[state, role[:1]], 0)
                    options.append((c + more, "K" + audit, ((role, text), rest)))
                for r in "ua":
                    if (state, r) in step:
                        c, audit, rest = best(i + 1, step[state, r], 0)
                        options.append((c + 2 + more, "R" + audit, ((SHORT[r], text), rest)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    for i in range(len(rows), 0, -50):  # short stacks
        for state in ("", "s", "u", "a"):
            for fresh in (2, 1, 0):
                best(i, state, fresh)
    cost, audit, chain = best(0, "", 0)
    lines = []
    while chain:
        lines.append(":".join(chain[0]))
        chain = chain[1]
    return cost, audit, lines


def want(rows):
    """What the query returns: conv -> its other columns."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in harm(rows):
        groups[r[0]].append(r)
    out = {}
    for conv, talk in groups.items():
        talk.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        marks = faults(talk)
        turns = [r[1] for r in talk if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in talk]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit, lines = least(talk, marks)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, key string, at int, a double"


def run(spark, rows, tmp_path, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)
    df.repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = op11_structure_repair(spark, str(tmp_path)).collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}
    assert len(out) == len(got)
    return out


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op11_structure_repair(spark, SF_MID).collect()}
    assert got == want(rows)


def random_talks(rng, convs, most):
    roles = ["user", "assistant", "system", "tool", "u", None, ""]
    texts = ["Yes.", "No", "", " ", "Why?", "Well then!", None, "So it is. \n", "a\x1f"]
    p = [0.35, 0.35, 0.1, 0.1, 0.04, 0.03, 0.03]
    rows = []
    for c in convs:
        turns = np.cumsum(rng.integers(1, 3, int(rng.integers(1, most)))).tolist()
        rows += [(c, t, str(x) if (x := rng.choice(roles, p=p)) is not None else None, texts[int(rng.integers(0, 9))] if rng.random() < 0.5 else f"w{t} {c}.") for t in turns]
    return rows


def test_random_talks_with_nulls_and_one_long(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = random_talks(rng, [*range(60), None, -5], 14) + random_talks(rng, [700], 1500)
    rows += [(7, None, "user", "first?"), (800, None, "user", "only null turn.")]
    assert run(spark, rows, tmp_path) == want(rows)


def test_copies_ties_and_empty(spark, tmp_path):
    same = [(1, 4, "user", "again and again.")] * 9 + [(2, 1, "user", "a."), (2, 2, "assistant", "b.")]
    same += [(None, None, "user", "x.")] * 3
    assert run(spark, same, tmp_path / "a") == want(same)
    tied = [(3, 1, "user", "one."), (3, 1, "user", "two."), (3, 2, "assistant", "three.")]
    first = run(spark, tied, tmp_path / "b")
    assert first == run(spark, tied[::-1], tmp_path / "c", parts=1)
    assert run(spark, [], tmp_path / "d") == {}
    gone = [(c, t, "user", "x.") for c in range(40) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone and run(spark, gone, tmp_path / "e") == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone}


def test_conversation_over_many_partitions(spark, tmp_path):
    """Each of a few long conversations spans several partitions, and lanes are short."""
    rng = np.random.default_rng(8)
    rows = [(None if c == 2 else c, t, r, x) for c in range(3) for _, t, r, x in random_talks(rng, [c], 4000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        placed = repair.placed(repair.damaged(spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)))
        spans = {r["key"]: r["n"] for r in placed.selectExpr("key", "shiftright(at, 33) p").distinct().groupBy("key").agg({"p": "count"}).withColumnRenamed("count(p)", "n").collect()}
        assert max(spans.values()) > 3
        assert run(spark, rows, tmp_path) == want(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("seed", range(3))
def test_plain_search_meets_the_pattern(seed):
    """The recursion itself, against all audits of up to four rows."""
    rng = np.random.default_rng(seed)
    for rows in [random_talks(rng, [1], 4) for _ in range(25)]:
        rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        marks = faults(rows)
        found = []
        for places in itertools.product(range(3), repeat=len(rows) + 1):
            for ops in itertools.product("DKR", repeat=len(rows)):
                audit = "".join("I" * n + o for n, o in zip(places, ops)) + "I" * places[-1]
                if any(o != "D" and m in ("blank", "duplicate") for o, m in zip(ops, marks)):
                    continue
                cost = sum({"D": 3, "K": 0, "R": 2}[o] + (o != "D" and m == "truncated") for o, m in zip(ops, marks)) + 2 * sum(places)
                free = audit.replace("D", "")
                kept = iter([r[2][:1] or "-" for o, r in zip(ops, rows) if o == "K"])  # an empty role has no place
                fixed = [next(kept) if o == "K" else None for o in free]
                for roles in itertools.product("ua", repeat=sum(x is None for x in fixed)):
                    new = iter(roles)
                    if re.fullmatch("(s?(ua)+)?", "".join(next(new) if x is None else x for x in fixed)):
                        found.append((cost, audit))
        assert least(rows, marks)[:2] == min(found)


def test_ranks_order_audits():
    """Ranks of nodes are the order of their least audits."""
    rng = np.random.default_rng(4)
    lanes, wide = 6, 9
    code, extra, must = rng.integers(0, 4, (lanes, wide)), rng.integers(0, 2, (lanes, wide)), rng.random((lanes, wide)) < 0.2
    n = rng.integers(1, wide + 1, lanes)
    exits = np.tile(ranking.ENDS, (lanes, 1))
    last = np.ones(lanes, dtype=bool)
    go = ranking._costs(code, extra, must, n, exits, last)
    target, valid = ranking._arcs(go, code, extra, must, n, exits, last)
    label, _ = ranking._chosen(target, valid)
    rank = ranking._ranked(target, valid)

    def audit(v):
        out = ""
        while label[v]:
            out += "-DIKR"[label[v]]
            v = target[v, label[v]]
        return out

    audits = [audit(v) for v in range(len(label))]
    order = {a: i for i, a in enumerate(sorted(set(audits)))}
    assert [order[a] for a in audits] == rank.tolist()
