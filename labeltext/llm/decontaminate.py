"""Benchmark decontamination by edit distance.

A text is contaminated by an item if some part of it is within
``floor(max_error * length of the item)`` edits of the item.

1. Windows. An item is cut into one piece more than the edits allowed, so one
   piece at least is unharmed in any such part. An Aho-Corasick automaton over
   all pieces scans the text; a hit says where a window for the items with that
   piece would begin. This only places windows, it selects none.
2. CGK embedding (Chakraborty, Goldenberg, Koucky 2016). Window and item walk
   through their characters with the same random bits: at step j both write the character
   they stand on and go on or stay as bit (j, character) says. After an edit
   the two walks drift apart and fall into step again, so few edits become few mismatches.
3. Bit-sampling LSH. A repetition takes a few steps of a walk as the key of a
   bucket; an item and a window that share any bucket are a candidate pair, and no other pair is. The steps
   of a repetition lie within a short run: two walks that are in step now are
   likely so a few steps on, but over a long walk the share of the time in step falls
   with the root of its length. Samples spread over the whole walk would
   all have to hit such times (recall 0 from 1,600 characters on).
4. Exact check: a lossless bound on short pieces, then the least number of edits
   between the item and any part of the window's surroundings (Myers' bit-vector
   recurrence).

Items are grouped by length (a factor of two a group). A group's walks end before its
shortest item does, so that a window's buckets do not depend on the item, and are
looked up once for all items of the group. Target recall: 0.95 at the full edit limit. Measured with random
insertions, deletions and substitutions, 30 items a length: 1.00 from 20 to 6,000
characters (``lsh_size``; the tests repeat 10 to 6,000).

Each step is a map over the documents. The benchmark is handled in blocks
bounded in items and bytes, each one pass over the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltext.llm.bytetext import U64, bounded_batches, mix64, released
from labeltext.llm.staging import item_blocks

MAX_ERROR = 0.1
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
WINDOWS_AT_ONCE = 4096
#: Steps x windows embedded at once.
EMBEDDED_CELLS = 1 << 24


def lsh_size(shortest: int) -> tuple[int, int, int, int, int]:
    """(steps, walks, repetitions a walk, steps of a run, steps sampled of it) of the
    items of ``shortest`` to twice as many characters. A walk of 1.6 steps a character ends within
    them. Short items have few steps to agree on and take more and shorter repetitions."""
    steps = max(1, int(1.6 * shortest))
    walks, repetitions, run, sampled = (8, 64, 12, 5) if shortest < 64 else (4, 48, 18, 8)
    return steps, walks, repetitions, min(run, steps), min(sampled, run, steps)


def allowed_edits(length: int, max_error: float) -> int:
    return int(max_error * length + 1e-9)


def pieces(text: str, max_error: float) -> list[tuple[int, int]]:
    """(start, end) of the item's pieces, one more than the edits allowed."""
    n = allowed_edits(len(text), max_error) + 1
    cuts = [len(text) * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def best_edits(item: str, part: str) -> tuple[int, int]:
    """(least edits between ``item`` and any substring of ``part``, end of the
    first such substring). Bit-vector dynamic programming, a column per character."""
    m = len(item)
    at: dict[str, int] = {}
    for k, c in enumerate(item):
        at[c] = at.get(c, 0) | (1 << k)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(part):
        eq = at.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def short_pieces(text: str, max_error: float) -> list[tuple[int, str]]:
    """(start, text) of the item's pieces for the bound, so short that there are
    about twice as many as the edits allowed."""
    q = max(1, int(0.5 / max_error)) if max_error > 0 else max(1, len(text))
    return [(p, text[p : p + q]) for p in range(0, len(text) - q + 1, q)]


#: Random bits of a step by character class; a step uses one of these rows.
_BITS = (mix64(np.arange(4096 * 256, dtype=U64) + U64(0x5851F42D4C957F2D)) >> U64(63)).astype(np.uint8).reshape(4096, 256)


def _draw(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 2 + 1)) >> U64(20)


def _classes(texts: list[str], margin: int) -> tuple[np.ndarray, np.ndarray]:
    """(character classes 1 to 255 of the texts, ``margin`` zeros before, between and after them; start of each text)."""
    n = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum(n + margin)))[:-1] + margin
    out = np.zeros(int(n.sum()) + margin * (len(texts) + 1) + 1, np.uint8)
    into = np.arange(len(codes)) + np.repeat(first - (np.cumsum(n) - n), n)
    out[into] = np.maximum((codes * np.uint32(0x9E3779B1)) >> np.uint32(24), 1).astype(np.uint8)
    return out, first


class Group:
    """Walks, sampled steps and buckets of the items of one length group."""

    def __init__(self, shortest: int, items: list[int], texts: list[str]) -> None:
        self.steps, self.walks, repetitions, run, sampled = lsh_size(shortest)
        self.rows = (_draw(self.walks * self.steps, shortest) % U64(4096)).astype(np.int64).reshape(self.walks, self.steps)
        begin = _draw(self.walks * repetitions, shortest + 1) % U64(self.steps - run + 1)
        within = np.argsort(_draw(self.walks * repetitions * run, shortest + 2).reshape(-1, run), axis=1)[:, :sampled]
        self.sampled = (begin[:, None].astype(np.int64) + np.sort(within, axis=1)).reshape(self.walks, repetitions, -1)
        codes, first = _classes(texts, self.steps)
        key = self.keys(codes, first)
        owner = np.broadcast_to(np.array(items, np.int64), key.shape).reshape(-1)
        order = np.lexsort((owner, key.reshape(-1)))
        self.key, self.owner = key.reshape(-1)[order], owner[order]

    def keys(self, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Bucket keys (repetitions x windows) of the windows of ``codes`` at ``start``."""
        out = []
        for w in range(self.walks):
            at, walk = start.copy(), np.empty((self.steps, len(start)), np.uint8)
            for j in range(self.steps):
                walk[j] = char = codes[at]
                at += _BITS[self.rows[w, j]][char]
            sampled = self.sampled[w]
            key = np.zeros((len(sampled), len(start)), U64)
            for i in range(sampled.shape[1]):
                key |= walk[sampled[:, i]].astype(U64) << U64(8 * i)
            # One table for all repetitions: a bijection of the bytes, shifted by the repetition.
            out.append(mix64(key) + _draw(len(sampled), w)[:, None] * U64(0x9E3779B97F4A7C15))
        return np.concatenate(out)

    def candidates(self, codes: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) of all that share a bucket, each pair once."""
        found = []
        width = max(1, EMBEDDED_CELLS // self.steps)
        for lo in range(0, len(start), width):
            key = self.keys(codes, start[lo : lo + width])
            at = np.searchsorted(self.key, key)
            hit = self.key[np.minimum(at, len(self.key) - 1)] == key
            window = np.broadcast_to(np.arange(lo, lo + key.shape[1]), key.shape)[hit]
            first = at[hit]
            many = np.searchsorted(self.key, key[hit], side="right") - first
            place = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            found.append(np.unique(np.stack([np.repeat(window, many), self.owner[place]], axis=1), axis=0))
        return [(int(w), int(k)) for part in found for w, k in part]


class Index:
    """Pieces and buckets of a block of items."""

    def __init__(self, items: Sequence[tuple[int, str]], max_error: float) -> None:
        self.items = [(i, t) for i, t in items if t]
        self.max_error = max_error
        members: dict[int, list[int]] = {}
        words: dict[str, dict[tuple[int, int], set[int]]] = {}
        for k, (_, text) in enumerate(self.items):
            shortest = 1 << (len(text).bit_length() - 1)
            members.setdefault(shortest, []).append(k)
            for a, b in pieces(text, max_error):
                words.setdefault(text[a:b], {}).setdefault((shortest, b), set()).add(k)
        self.automaton = ahocorasick.Automaton()
        for word, where in words.items():
            self.automaton.add_word(word, [(g, b, frozenset(of)) for (g, b), of in where.items()])
        if words:
            self.automaton.make_automaton()
        self.short = [short_pieces(t, max_error) for _, t in self.items]
        self.groups = {g: Group(g, m, [self.items[k][1] for k in m]) for g, m in members.items()}
        #: A window may begin before its text by less than its item's length, and its walk may go on behind it.
        self.margin = 2 * max(members, default=1)

    def possible(self, text: str, start: int, item: int) -> bool:
        """Whether the bound leaves it open that the window's part is within the
        edits allowed. True for any such part with an unharmed piece that stands
        where the window puts it."""
        slack = left = allowed_edits(len(self.items[item][1]), self.max_error)
        for p, piece in self.short[item]:
            at = start + p
            if text.find(piece, max(0, at - slack), max(0, at + len(piece) + slack)) < 0:
                left -= 1
                if left < 0:
                    return False
        return True

    def windows(self, text: str) -> dict[tuple[int, int], list[frozenset[int]]]:
        """(length group, start) of the placed windows, which may lie outside the
        text, with the items that each piece placed there belongs to."""
        out: dict[tuple[int, int], list[frozenset[int]]] = {}
        for end, where in self.automaton.iter(text):
            for g, b, of in where:
                out.setdefault((g, end + 1 - b), []).append(of)
        return out

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text: (item number, edits, end of the part) for each item found."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        checked: dict[tuple[int, int], int] = {}  # last start, which rise
        todo: dict[int, list[tuple[int, int, list[frozenset[int]]]]] = {}
        if not self.items:
            return [[] for _ in texts]

        def flush(g: int) -> None:
            windows = todo.pop(g)
            docs = sorted({w[0] for w in windows})
            codes, first = _classes([texts[d] for d in docs], self.margin)
            base = dict(zip(docs, first.tolist()))
            start = np.array([base[d] + s for d, s, _ in windows])
            for w, k in self.groups[g].candidates(codes, start):
                d, s, placed = windows[w]
                if not any(k in of for of in placed):
                    continue  # a part within the edits allowed has a window that one of the item's own pieces placed
                text = self.items[k][1]
                slack = allowed_edits(len(text), self.max_error)
                if k in found[d] and found[d][k][0] == 0 or s - checked.get((d, k), s - slack - 1) <= slack:
                    continue  # the part of a window so near lies in the surroundings that were checked
                if not self.possible(texts[d], s, k):
                    continue
                checked[d, k] = s
                a = max(0, s - 2 * slack)
                edits, end = best_edits(text, texts[d][a : s + len(text) + 2 * slack])
                if edits <= slack and (k not in found[d] or edits < found[d][k][0]):
                    found[d][k] = (edits, a + end)

        for d, text in enumerate(texts):
            for (g, s), placed in sorted(self.windows(text).items(), key=lambda w: w[0]) if text else ():
                todo.setdefault(g, []).append((d, s, placed))
                if len(todo[g]) >= WINDOWS_AT_ONCE:
                    flush(g)
        for g in list(todo):
            flush(g)
        return [sorted((k, *v) for k, v in f.items()) for f in found]


_built: dict[str, Index] = {}


def _index(name: str, items: list[tuple[int, str]], max_error: float) -> Index:
    """The block's index, built once per worker process; only the last block's is kept."""
    if name not in _built:
        _built.clear()
        _built[name] = Index(items, max_error)
    return _built[name]


def matches(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, edits, end): the items found in each document, with the
    least edits among the parts that were checked and the end of that part.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored. Null or empty texts and items match nothing; a document
    shorter than an item can match only if the missing characters fit the edits
    allowed. An item shorter than 1 / ``max_error`` must be contained exactly.
    Repeated documents or items are matched alike (equal items once). Empty
    tables give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"doc_id {kind}, item_id long, edits int, end long")
    for items in item_blocks(benchmark, block_items, BLOCK_BYTES, "decontaminate-items"):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, items, max_error))  # at most one block of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(*shared.value)
            for batch in released(batches):
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    hits = index.search([t or "" for t in part.column("text").to_pylist()])
                    rows = [(n, *h) for n, found in enumerate(hits) for h in found]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("doc_id").take(pa.array([r[0] for r in rows])),
                                pa.array([index.items[r[1]][0] for r in rows], pa.int64()),
                                pa.array([r[2] for r in rows], pa.int32()),
                                pa.array([r[3] for r in rows], pa.int64()),
                            ],
                            ["doc_id", "item_id", "edits", "end"],
                        )

        out = out.unionByName(texts.mapInArrow(run, out.schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item of ``benchmark``, whole and
    unchanged, all columns kept; a map per block of items, without a shuffle.

    Rows with a null or empty text stay, also if their id is null; repeated rows
    are judged alike. An empty benchmark drops nothing, an empty table gives no rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for items in item_blocks(benchmark, block_items, BLOCK_BYTES, "decontaminate-items"):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, items, max_error))  # at most one block of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(*shared.value)
            for batch in released(batches):
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    hits = index.search([t or "" for t in part.column("text").to_pylist()])
                    yield part.filter(pa.array([not h for h in hits], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
