"""Ranked lexical search by presence masks.

1. One pass over the documents keeps, of every text, its number of terms and
   the occurrences of those terms that any item has; counts over that table give
   the numbers of documents and terms and each term's document frequency.
2. A task takes its documents in chunks. Per item, the presence bits of the
   item's terms are packed into one mask per document, and documents with the
   same mask form a group. A mask's maximum score is the sum of the greatest
   contributions that its terms have in the chunk. The distinct masks
   are evaluated by falling maximum until the next one's is below the score of
   the task's k-th best document so far: nothing after it can enter.
3. Each task hands on its k best documents of every item; two levels of
   row numbers, the first salted by document, leave the k best of all.

Items are handled in blocks bounded in rows and bytes, each one pass. Terms are
compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeltext.llm import bytetext
from labeltext.llm.staging import item_blocks, stage

BLOCK_ITEMS = 1000
BLOCK_BYTES = 4 << 20
#: Presence cells of one chunk: terms of the block's items x documents.
CHUNK_CELLS = 1 << 21
SALTS = 32

#: Everything in ASCII that is neither a digit nor a letter.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[:128] = [not chr(c).isalnum() for c in range(128)]


def term_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, term hashes, text number of each) in slices of the texts."""
    data, offsets = bytetext.buffers(texts)
    for a, b in bytetext.slices(offsets):
        low = bytetext.lower_ascii(data[offsets[a] : offsets[b]])
        s, e, doc = bytetext.words(low, offsets[a : b + 1] - offsets[a], SEPARATORS)
        yield a, b, bytetext.span_hash(bytetext.prefix_hash(low), s, e) if len(s) else np.zeros(0, np.uint64), doc


def _postings(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.released(batches):
            for a, b, h, doc in term_hashes(batch.column("text")):
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = vocabulary[at] == h
                cell, tf = np.unique(doc[known] * len(vocabulary) + at[known], return_counts=True)
                ends = np.searchsorted(cell, np.arange(b - a + 1) * len(vocabulary)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (cell % len(vocabulary), tf)]
                n = np.bincount(doc, minlength=b - a).astype(np.int64)
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    return run


def mask_groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first document of each distinct mask, group of each document) for a
    presence matrix (terms x documents) of 0 and 1."""
    packed = np.packbits(present, axis=0)
    words = np.zeros((present.shape[1], -(-len(packed) // 8) * 8), np.uint8)
    words[:, : len(packed)] = packed.T
    words = words.view(np.uint64)
    _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    for k in range(1, words.shape[1]):
        ids, more = np.unique(words[:, k], return_inverse=True)
        _, first, group = np.unique(group * len(ids) + more, return_index=True, return_inverse=True)
    return first, group


class Best:
    """The k best documents seen: higher score, then smaller id, rows without one last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.doc, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A document must reach this score to enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        ok = score >= self.least
        score, doc, none = (np.concatenate(x) for x in ((self.score, score[ok]), (self.doc, doc[ok]), (self.none, none[ok])))
        order = np.lexsort((doc, none, -score))[: self.k]
        self.score, self.doc, self.none = score[order], doc[order], none[order]


def search_chunk(best: Best, present: np.ndarray, impact: np.ndarray, top: np.ndarray, doc: np.ndarray, none: np.ndarray) -> int:
    """Let ``best`` see every document of the chunk that could enter; ``present``,
    ``impact`` (terms x documents) and ``top`` (greatest impact) are those of one
    item's terms. Returns the number of documents evaluated."""
    first, group = mask_groups(present)
    bound = top @ present[:, first].astype(np.int64)
    order = np.argsort(-bound, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    place, bound = place[group], bound[order]  # place of each document's mask by falling bound
    many = np.cumsum(np.bincount(place, minlength=len(bound)))
    done = at = 0
    while at < len(bound) and bound[at] >= best.least:
        end = int(np.searchsorted(many, done + best.k)) + 1
        end = min(end, at + int(np.searchsorted(-bound[at:], -best.least, side="right")))
        chosen = np.flatnonzero((place >= at) & (place < end))
        best.add(impact[:, chosen].sum(axis=0), doc[chosen], none[chosen])
        done, at = int(many[end - 1]), end
    return done


def _rank(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, terms, weight, documents, total = shared.value
        best = [Best(k) for _ in terms]
        rows = max(16, CHUNK_CELLS // len(weight))
        for batch in bytetext.released(batches):
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                lists = part.column("terms")
                size = lists.value_lengths().to_numpy()
                t, tf = lists.flatten().to_numpy(), part.column("tf").flatten().to_numpy().astype(np.int64)
                m = 50 + (50 * documents * part.column("n").to_numpy()) // total
                d = np.repeat(np.arange(len(size)), size)
                impact = np.zeros((len(weight), len(size)), np.int64)
                impact[t, d] = weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[d]))
                present = np.zeros(impact.shape, np.uint8)
                present[t, d] = 1
                top = impact.max(axis=1)
                none = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                doc = part.column("doc_id").fill_null(0).to_numpy()
                for b, mine in zip(best, terms):
                    if top[mine].sum() >= b.least:
                        search_chunk(b, present[mine], impact[mine], top[mine], doc, none)
        for number, b in zip(numbers, best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.score), number)), pa.array(b.doc, mask=b.none), pa.array(b.score)], ["number", "doc_id", "score"]
                )

    return run


def _best_of(rows: DataFrame, k: int, *by: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents
    with a score above 0, rank 1 the highest, equal scores by rising doc_id.

    ``docs`` needs doc_id (long) and text, ``items`` item_id (long) and text; other
    columns, whatever their names, are ignored. Terms are the maximal runs of
    ASCII letters, digits and all characters beyond ASCII; A-Z count as a-z.
    With N documents that hold a term, L terms in all of them, n in the document, df
    documents holding a term and tf its occurrences in the document, its weight w is
    floor(1000 * ln((2N+2) / (2df+1))), m is 50 + (50 n N) div L, and the score
    is the sum of w * ((10**9 tf) div (1000 tf + 20 m)) over the item's distinct terms.

    A null, empty or termless text holds no term and is not counted; such an
    item has no rows. Every row of ``docs`` is a document of its own, also if its
    id or text is repeated; rows without an id come last among equal scores. An
    item given twice is searched once; items of one id and different texts
    are ranked each for itself under that id. Empty tables give no rows.
    """
    spark = docs.sparkSession
    bytetext.bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    out, base = [], 0
    for block in item_blocks(items, block_items, block_bytes):
        hashes: list[list[np.ndarray]] = [[] for _ in block]
        for a, b, h, doc in term_hashes(pa.array([t for _, t in block])):
            for n in range(a, b):
                hashes[n].append(h[doc == n - a])
        own = [np.unique(np.concatenate(h)) for h in hashes]
        vocabulary = np.unique(np.concatenate(own))
        if not len(vocabulary):
            continue
        found = stage(texts.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>"), "lexical-postings")
        documents, total = found.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for row in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
            df[row["t"]] = row["count"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        numbers = [base + n for n, h in enumerate(own) if len(h)]
        terms = [np.searchsorted(vocabulary, h) for h in own if len(h)]
        shared = spark.sparkContext.broadcast((numbers, terms, weight, documents, total))  # one block's terms
        ids = spark.createDataFrame([(base + n, i) for n, (i, _) in enumerate(block)], "number long, item_id long")
        ranked = found.mapInArrow(_rank(shared, k), "number long, doc_id long, score long")
        salted = _best_of(ranked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "number", "salt")
        out.append(_best_of(salted.drop("rank", "salt"), k, "number").join(F.broadcast(ids), "number"))  # at most block_items rows
        base += len(block)
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in out:
        result = result.unionByName(part.select("item_id", "rank", "doc_id", "score"))
    return result
