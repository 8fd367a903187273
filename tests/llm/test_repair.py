"""Conversation repair against a uniform-cost search over all edits."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from labeltext.llm import repair
from labeltext.llm.queries import QUERIES

COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}


def grammar(state, role):
    """State after one more row of this role initial, by the pattern (s?(ua)+)?."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, role))


def least_repair(rows):
    """(cost, audit, repaired rows) for rows of (role, text, fault), cheapest and then ASCII-least."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, state, done = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(done)
        for role in ("user", "assistant"):
            if (s := grammar(state, role[0])) is not None and audit.count("I") < 3:
                heapq.heappush(heap, (cost + 5, audit + "I", i, s, (*done, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, done))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (s := grammar(state, role[:1])) is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, s, (*done, (role, text))))
                for new in ("user", "assistant"):
                    if (s := grammar(state, new[0])) is not None:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, s, (*done, (new, text))))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        cut = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def naive_query(table):
    """The query's rows by plain Python over (conv_id, turn, role, text)."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in table):
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        marked = faults([r[1:] for r in rows])
        cost, audit, fixed = least_repair(marked)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        count = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def conversation_rows(seed=0, n=120):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 7)):
            role = r.choice(["system"] + ["user", "assistant"] * 4) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, t + r.choice([0, 0, 0, 3]), role, r.choice(["Hi.", "Yes!", "no end", "a b?", " \t\n", "Ünïcode 漢字. ", "x.y"]) + r.choice(["", str(t) + "."])))
    rows += [(None, 1, "user", "A."), (None, None, "assistant", None), (None, 2, None, "B."), (500, None, "user", "Q."), (500, None, "user", "Q."), (501, 5, "tool", ""), (502, 1, "", "Z."), (503, 2, "user", "A.\n"), (503, 4, "assistant", "long " * 50_000 + ".")]
    rows += [rows[0], rows[0]]
    return rows


FIELDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [repair.SEGMENT, 2])
def test_repair_brute_force(spark, tmp_path, segment, monkeypatch):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], FIELDS + ", pos int, symbol string, fault string").repartition(5)
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(repair.repair, "__defaults__", (segment,))
    got = QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    want = naive_query(rows)
    assert {r["conv_id"]: tuple(r) for r in got.collect()} == want
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repaired_rows_follow_the_grammar(spark):
    rows = repair.damage(spark.createDataFrame(conversation_rows(4), FIELDS))
    done = repair.repair(rows)
    lines = done.rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "place", "role"))).alias("r")).collect()
    assert lines and all(re.fullmatch("s?(ua)+", "".join(x["role"][:1] for x in row["r"])) for row in lines)


def test_repair_empty_table(spark):
    done = repair.repair(spark.createDataFrame([], FIELDS))
    assert done.summary.collect() == [] and done.rows.collect() == [] and repair.digests(done.rows).collect() == []


def test_search_finds_the_least_repair():
    r = random.Random(2)
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(600):
        marked = [(r.choice("suax" if r.random() < 0.5 else "ua"), r.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(r.randint(0, 7))]
        symbols = "".join(chr(65 + 4 * repair.CLASSES.index(c) + repair.FAULTS.index(f)) for c, f in marked)
        cost, audit, _ = least_repair([(names[c], "t", f) for c, f in marked])
        assert repair.solve(symbols) == (cost, audit)
        for k in (1, 2, 3):  # cut into segments and joined again
            cut = [symbols[i : i + k] for i in range(0, len(symbols), k)]
            parts = [repair.options(c, n == 0, n == len(cut) - 1) for n, c in enumerate(cut)]
            whole = [next(o for o in mine if o[:2] == pair) for mine, pair in zip(parts, repair.join_segments(parts))]
            assert (sum(o[2] for o in whole), "".join(o[3] for o in whole)) == (cost, audit)


def test_search_of_a_long_conversation_is_linear():
    r = random.Random(9)
    n = 60_000
    noisy = "".join(chr(65 + 4 * r.randrange(4) + r.choice([0, 0, 1, 2, 3])) for _ in range(n))
    shifted = "E" + "EI" * (n // 2)  # one user row too many in front
    for symbols in (noisy, shifted, "I" * n, "A" * n):
        start = time.time()
        cost, audit = repair.solve(symbols)
        assert len(audit) == len(symbols) and cost < 2 * n + 1 and time.time() - start < 20
    assert repair.solve(shifted)[0] == 2
    assert repair.options("A" * 3000, False, False)


def test_edits_place_inserted_rows():
    assert repair.edits("E", "KI", 0) == [(0, 0, "K", None), (0, 1, "I", "assistant")]
    assert repair.edits("I", "IK", 0) == [(0, -1, "I", "user"), (0, 0, "K", None)]
