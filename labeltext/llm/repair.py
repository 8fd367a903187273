"""Conversation structure repair by depth-first branch-and-bound.

A conversation should have the role initials ``(s?(ua)+)?``. Each row may be kept,
given another role or deleted, and empty rows may be inserted; the cheapest
edits win, the ASCII-least list of their initials among equally cheap ones.

1. Rows are put in order by ranges of (conversation, turn), so that one long
   conversation spreads over tasks, and each gets a symbol: its role's class
   and its first fault.
2. Runs of at most ``SEGMENT`` symbols are solved each for itself (``solve``): a
   search over nodes (row, state of the role grammar) with an explicit stack.
   Suffix lower bounds come from the grammar in which a system row may stand alone.
   A dive along them gives the first incumbent (cost, audit). The search
   then takes edits in ASCII order and cuts off a prefix whose cost plus bound is above the
   incumbent's, or that reaches a node at no less cost than a prefix before
   it, until nothing is left that could be better.
3. A conversation's segments are joined over the states between them. Only its
   first segment starts in the grammar's start alone, only its last one must end
   in an accepting state; the others are solved for every pair of states.

Why equal-cost segments can be compared one after the other: inserting costs
more than deleting the row that it would complete, so a cheapest repair never
inserts, and its audit has one letter a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltext.llm.bytetext import bounded_batches, released
from labeltext.llm.staging import stage

SEGMENT = 1 << 15
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
CLASSES, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
WHITE = " \t\n\x0b\x0c\r"
INFINITE = 1 << 60

#: States: 0 nothing yet, 1 after a system row, 2 after user, 3 after assistant.
ACCEPTING = (0, 3)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NEXT = (2, 2, 3, 2)  # after a user or assistant row is put in
ROLE = ("user", "user", "assistant", "user")
LEGAL = ("su", "ua", "au")


def symbol_class(symbol: str) -> str:
    return CLASSES[(ord(symbol) - 65) // 4]


def _moves() -> dict[str, list[list[tuple[str, int, int]]]]:
    """Per symbol and state, the edits of a row (letter, cost, next state), ASCII-greatest first."""
    out = {}
    for n in range(16):
        fault, after = n % 4, CUT_OFF if n % 4 == 3 else 0
        rows = []
        for state in range(4):
            row = [] if fault in (1, 2) else [("R", REROLE + after, NEXT[state])]
            if fault not in (1, 2) and (state, CLASSES[n // 4]) in KEPT:
                row.append(("K", KEEP + after, KEPT[state, CLASSES[n // 4]]))
            rows.append([*row, ("D", DELETE, state)])
        out[chr(65 + n)] = rows
    return out


MOVES = _moves()


def lower_bounds(symbols: str, exits: tuple[int, ...]) -> list[list[int]]:
    """Per state, a lower bound of the cost from each row to the end in ``exits``."""
    n = len(symbols)
    if not set(exits) & {2, 3}:  # all rows deleted, save one system row if it ends in state 1
        all_gone = [DELETE * (n - i) for i in range(n + 1)]
        never = [INFINITE] * (n + 1)
        return [all_gone, never, never, never] if exits == (0,) else [[max(0, x - DELETE) for x in all_gone], all_gone, never, never]
    start, user, assistant = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # nothing yet; user due; assistant due
    o = 0 if 0 in exits else INFINITE
    u = 0 if set(exits) & {1, 3} else INFINITE  # a system row may stand alone
    a = 0 if 2 in exits else INFINITE
    u, a = min(u, a + INSERT), min(a, u + INSERT)
    start[n], user[n], assistant[n] = min(o, a + INSERT), u, a
    for i in range(n - 1, -1, -1):
        k = ord(symbols[i]) - 65
        fault, role = k % 4, k // 4
        op, up, ap = start[i + 1] + DELETE, u + DELETE, a + DELETE
        if fault not in (1, 2):
            after = CUT_OFF if fault == 3 else 0
            put = a + after + (KEEP if role == 1 else REROLE)
            op, up = min(op, put, u + after + KEEP if role == 0 else INFINITE), min(up, put)
            ap = min(ap, u + after + (KEEP if role == 2 else REROLE))
        u, a = min(up, ap + INSERT), min(ap, up + INSERT)
        start[i], user[i], assistant[i] = min(op, a + INSERT), u, a
    return [start, user, assistant, user]


def dive(symbols: str, entry: int, exits: tuple[int, ...], bounds: list[list[int]]) -> tuple[int, str] | None:
    """A repair (cost, audit) found by always taking the edit of least cost plus bound."""
    state, cost, audit = entry, 0, []
    for i, symbol in enumerate(symbols):
        price, letter, c, nxt = min((c + bounds[s][i + 1], letter, c, s) for letter, c, s in MOVES[symbol][state])
        if price >= INFINITE:
            return None
        audit.append(letter)
        cost, state = cost + c, nxt
    while state not in exits:
        if not set(exits) & {2, 3} or len(audit) > len(symbols) + 2:
            return None
        audit.append("I")
        cost, state = cost + INSERT, NEXT[state]
    return cost, "".join(audit)


def solve(symbols: str, entry: int = 0, exits: tuple[int, ...] = ACCEPTING) -> tuple[int, str] | None:
    """The cheapest repair (cost, audit) of a run of rows from state ``entry`` to
    one of ``exits``, proved by search; None if there is none."""
    n = len(symbols)
    bounds = lower_bounds(symbols, exits)
    incumbent = dive(symbols, entry, exits, bounds)
    limit = incumbent[0] if incumbent else DELETE * n + 3 * INSERT
    least = [[INFINITE] * (n + 1) for _ in range(4)]  # cost of the best prefix that reached a node
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        if cost + bounds[state][i] > limit or cost >= least[state][i]:
            continue
        least[state][i] = cost
        if depth:
            del path[depth - 1 :]
            path.append(letter)
        if i == n and state in exits:  # the first one of its cost in ASCII order
            incumbent, limit = (cost, "".join(path)), cost - 1
            continue
        if i < n:
            moves = MOVES[symbols[i]][state]
            for letter, c, s in moves[:-1]:
                stack.append((i + 1, s, cost + c, depth + 1, letter))
            stack.append((i, NEXT[state], cost + INSERT, depth + 1, "I"))
            letter, c, s = moves[-1]
            stack.append((i + 1, s, cost + c, depth + 1, letter))
        else:
            stack.append((i, NEXT[state], cost + INSERT, depth + 1, "I"))
    return incumbent


_short = lru_cache(maxsize=1 << 16)(solve)


def options(symbols: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of every pair of states that the segment may
    have; the exit of a conversation's last segment is any accepting state (-1)."""
    out = []
    for entry in (0,) if first else range(4):
        for exits in (ACCEPTING,) if last else ((s,) for s in range(4)):
            if found := (_short if len(symbols) <= 64 else solve)(symbols, entry, exits):
                out.append((entry, -1 if last else exits[0], *found))
    return out


def join_segments(segments: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int]]:
    """The (entry, exit) of each segment in the cheapest whole repair, the
    ASCII-least one among equals."""
    togo: list[dict[int, int]] = [{} for _ in segments] + [{-1: 0}]
    for k in range(len(segments) - 1, -1, -1):
        for entry, out, cost, _ in segments[k]:
            if out in togo[k + 1]:
                togo[k][entry] = min(togo[k].get(entry, INFINITE), cost + togo[k + 1][out])
    state, chosen = 0, []
    for k, mine in enumerate(segments):
        _, _, out = min((cost + togo[k + 1][out], audit, out) for entry, out, cost, audit in mine if entry == state and out in togo[k + 1])
        chosen.append((state, out))
        state = out
    return chosen


def edits(symbols: str, audit: str, entry: int) -> list[tuple[int, int, str, str | None]]:
    """(row, place beside it, letter, new role) of every edit of an audit; the
    place of an inserted row is below 0 before its row, above 0 after the last."""
    out, state, row, waiting = [], entry, 0, []
    for letter in audit:
        if letter == "I":
            waiting.append(ROLE[state])
            state = NEXT[state]
            continue
        out += [(row, p - len(waiting), "I", role) for p, role in enumerate(waiting)]
        waiting = []
        out.append((row, 0, letter, ROLE[state] if letter == "R" else None))
        state = next(s for m, _, s in MOVES[symbols[row]][state] if m == letter)
        row += 1
    return out + [(row - 1, p + 1, "I", role) for p, role in enumerate(waiting)]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20:
    0 drops the row, 1 empties its text, 2 removes its ``. ! ?``, 3 repeats it,
    4 makes its role user. Null cells count as one space, but keep turn and conv_id."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("kind", F.crc32(key) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, text_hash, pos), staged; ``pos`` rises by
    conversation, then turn (null first), role and text hash; equal rows are adjacent."""
    space = F.lit(" ")
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text")
    ).withColumn("text_hash", F.md5("text")).withColumn("seen_as", F.monotonically_increasing_id())
    keys = ("conv_id", "turn", "role", "text_hash", "seen_as")
    return stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("seen_as").withColumn("pos", F.monotonically_increasing_id()), "repair-rows")


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def with_symbols(ordered: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, fault, symbol), staged, without texts; ``fault`` is the
    row's first of blank, duplicate, truncated (else 0)."""
    cut = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    rows = ordered.select(
        "conv_id", "pos", "turn", "role", "text_hash", (cut == "").alias("blank"), (~F.substring(cut, -1, 1).isin(".", "!", "?")).alias("truncated"),
        (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)).alias("class"),
    )
    firsts = rows.where("not blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text_hash").alias("t")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(firsts, _same(F.col("conv_id"), F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text_hash") == F.col("t")) & ~F.col("blank"), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first") < F.col("pos"), 2).when(F.col("truncated"), 3).otherwise(0)
    out = joined.select("conv_id", "pos", "turn", fault.alias("fault"), "class")
    return stage(out.select("conv_id", "pos", "turn", "fault", F.char(F.lit(65) + F.col("class") * 4 + F.col("fault")).alias("symbol")), "repair-symbols")


def _cut(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pos, symbols = None, [], []
        for batch in released(batches):
            out = []
            for conv, p, s in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "symbol"))):
                if pos and (conv != now or len(pos) >= segment):
                    out.append((now, pos, "".join(symbols)))
                    pos, symbols = [], []
                now = conv
                pos.append(p)
                symbols.append(s)
            kind = batch.schema.field("conv_id").type
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.list_(pa.int64())), pa.array([r[2] for r in out], pa.string())], ["conv_id", "pos", "symbols"])
        if pos:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([pos], pa.list_(pa.int64())), pa.array(["".join(symbols)])], ["conv_id", "pos", "symbols"])

    return run


OPTION = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        cells = zip(*(batch.column(c).to_pylist() for c in ("symbols", "first", "last")))
        found = [[dict(zip(("entry", "exit", "cost", "audit"), o)) for o in options(*c)] for c in cells]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "pos", "symbols")), pa.array(found, OPTION)], ["conv_id", "pos", "symbols", "options"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        start, entry, out = [], [], []
        for parts in batch.column("parts").to_pylist():
            chosen = join_segments([[(o["entry"], o["exit"], o["cost"], o["audit"]) for o in p["options"]] for p in parts])
            start += [p["start"] for p in parts]
            entry += [c[0] for c in chosen]
            out += [c[1] for c in chosen]
        yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), pa.array(entry, pa.int32()), pa.array(out, pa.int32())], ["start", "entry", "exit"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        rows = []
        for pos, symbols, audit, entry in zip(*(batch.column(c).to_pylist() for c in ("pos", "symbols", "audit", "entry"))):
            rows += [(pos[row], place, letter, role) for row, place, letter, role in edits(symbols, audit, entry)]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()))], ["pos", "place", "edit", "new_role"])


class Repair:
    """The results of :func:`repair`, each a DataFrame.

    ``summary``: one row per conversation (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit); ``rows``: its repaired rows (conv_id, pos,
    place, edit, role, text) in the order of (pos, place), deleted ones left out.
    """

    def __init__(self, summary: DataFrame, rows: DataFrame) -> None:
        self.summary, self.rows = summary, rows


def repair(conversations: DataFrame, segment: int = SEGMENT) -> Repair:
    """Find the cheapest repair of every conversation.

    ``conversations`` needs conv_id (any type that can be grouped), turn, role and text;
    other columns, whatever their names, are ignored. Rows are taken by turn (null
    first; equal turns by role and text hash). A row's first fault counts: blank (no
    character but space and U+0009 to U+000D), duplicate (role and text seen
    earlier in the conversation) or truncated (its last other character is none
    of ``. ! ?``). A blank or duplicate row must be deleted (2), any other may be; it
    may be kept if its role's initial fits (0), else become user or assistant (1);
    a truncated row that stays adds 5; inserting an empty row costs 5.

    Null roles and texts count as one space, rows with a null conv_id as one
    conversation. Repeated rows are duplicates. ``gaps`` is the number of turns
    missing between the least and the greatest, nulls ignored; ``illegal`` counts
    neighbours whose initials are not su, ua or au. An empty table gives no rows.
    """
    bounded_batches(conversations.sparkSession)
    conv = conversations.schema["conv_id"].dataType.simpleString()
    ordered = in_order(conversations)
    symbols = with_symbols(ordered)
    runs = symbols.repartitionByRange("pos").sortWithinPartitions("pos").select("conv_id", "pos", "symbol")
    cut = stage(runs.mapInArrow(_cut(segment), f"conv_id {conv}, pos array<long>, symbols string"), "repair-segments")
    cut = cut.withColumn("start", F.col("pos")[0])
    mine = Window.partitionBy("conv_id").orderBy("start")
    flagged = cut.withColumn("first", F.lag("start").over(mine).isNull()).withColumn("last", F.lead("start").over(mine).isNull())
    solved = stage(flagged.mapInArrow(_solve, f"conv_id {conv}, pos array<long>, symbols string, options array<struct<entry:int,exit:int,cost:long,audit:string>>"), "repair-solved")
    solved = solved.withColumn("start", F.col("pos")[0])
    parts = solved.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "options"))).alias("parts"))
    chosen = stage(parts.select("parts").mapInArrow(_join, "start long, entry int, exit int"), "repair-chosen")
    picked = F.filter("options", lambda o: (o["entry"] == F.col("entry")) & (o["exit"] == F.col("exit")))[0]
    decided = stage(
        solved.join(chosen, "start").withColumn("picked", picked).select("conv_id", "start", "pos", "symbols", "entry", F.col("picked.cost").alias("cost"), F.col("picked.audit").alias("audit")), "repair-decided"
    )

    turns = symbols.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.count_if(F.col("fault") == n).alias(FAULTS[n]) for n in (1, 2, 3)),
    )
    classes = F.translate("symbols", "".join(chr(65 + n) for n in range(16)), "".join(CLASSES[n // 4] for n in range(16)))
    legal = [F.regexp_count(classes, F.lit(f"{a}(?={b})")) for a, b in LEGAL]
    pieces = decided.select(
        F.col("conv_id").alias("c"), "start", "cost", "audit", (F.length("symbols") - 1 - sum(legal[1:], legal[0])).cast("long").alias("inner"),
        F.substring(classes, 1, 1).alias("head"), F.substring(classes, -1, 1).alias("tail"),
    )
    before = F.lag("tail").over(Window.partitionBy("c").orderBy("start"))
    across = F.when(before.isNotNull() & ~F.concat(before, F.col("head")).isin(*LEGAL), 1).otherwise(0)
    whole = pieces.withColumn("across", across).groupBy("c").agg(
        F.sum(F.col("inner") + F.col("across")).alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "audit"))), lambda p: p["audit"]), "").alias("audit"),
    )
    summary = turns.join(whole, _same(F.col("conv_id"), F.col("c"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    steps = decided.select("pos", "symbols", "audit", "entry").mapInArrow(_edits, "pos long, place int, edit string, new_role string").where("edit <> 'D'")
    inserted = F.col("edit") == "I"
    rows = ordered.select("conv_id", "pos", "role", "text").join(steps, "pos").select(
        "conv_id", "pos", "place", "edit", F.coalesce("new_role", "role").alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text")
    )
    return Repair(summary, rows)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation's ``role:text`` lines in order, read
    as a stream: a hash is sequential, its memory does not grow with the rows."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind = None, None, None
        for batch in released(batches):
            kind, out = batch.schema.field("conv_id").type, []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if state is None or c != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {conv}, sha256 string")
