"""MinHash near-dedup with SuperMinHash signatures.

1. Every text's distinct word shingles are hashed and given a SuperMinHash
   signature (``superminhash.signatures``); texts with equal shingle sets form
   one class, named by a 128-bit hash of its set, and only the class goes on.
2. Bands of the signature put classes into buckets. Buckets with the same
   members (two close texts share most of their bands) are kept once.
3. The members of a bucket are compared on their full shingle sets, in blocks
   of about ``block`` members and ``BLOCK_BYTES`` of sets at most: a large bucket is
   dealt to a triangle of block pairs, each of them one unit of work, in which a product of two membership
   matrices gives all intersection sizes at once. Only a spanning forest of the
   confirmed links leaves a task, never the pairs.
4. Union-find joins the links to components (``components``).

At 40 bands of 6 places, a pair of similarity 0.8 shares no bucket with
probability (1 - 0.8**6)**40 = 5e-6. Shingles are compared by 64-bit hashes of
their words and classes by 128-bit hashes of their sets.

A hot group of exact copies is one class. A hot group of near copies costs
(members / block) replicas of each member's set, and comparisons as the square
of its members, spread over its block pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from labeltext.llm import bytetext
from labeltext.llm.components import UnionFind, components
from labeltext.llm.staging import small_side, stage
from labeltext.llm.superminhash import band_keys, signatures

PLACES = 240
ROWS = 6
BLOCK = 512
BLOCK_BYTES = 16 << 20


def _name(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def _sketch(width: int, places: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.released(batches):
            data, offsets = bytetext.buffers(batch.column("text"))
            for a, b in bytetext.slices(offsets):
                part = offsets[a : b + 1] - offsets[a]
                h, owner = bytetext.shingle_hashes(data[offsets[a] : offsets[b]], part, width)
                bands = band_keys(signatures(h, owner, b - a, places), rows)
                at = np.searchsorted(owner, np.arange(b - a + 1))
                names = [_name(h[i:j].tobytes()) if j > i else None for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(np.diff(at)),
                        pa.array(names, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1))),
                    ],
                    ["doc_id", "n_shingles", "set_name", "bands"],
                )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.released(batches):
            data, offsets = bytetext.buffers(batch.column("text"))
            for a, b in bytetext.slices(offsets):
                h, owner = bytetext.shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                at = np.searchsorted(owner, np.arange(b - a + 1))
                sets = [h[i:j].tobytes() for i, j in zip(at[:-1], at[1:]) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["set_name", "members"])

    return run


def _intersections(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of ``x`` with every set of ``y``."""
    xs, ys = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(xs, ys)
    out = np.zeros((len(x), len(y)), np.float32)

    def place(flat, sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(shared, flat)
        ok = col < len(shared)
        ok[ok] = shared[col[ok]] == flat[ok]
        order = np.argsort(col[ok], kind="stable")
        return row[ok][order], col[ok][order]

    (xr, xc), (yr, yc) = place(xs, x), place(ys, y)
    for lo in range(0, len(shared), columns):
        n = min(columns, len(shared) - lo)
        a, b = np.zeros((len(x), n), np.float32), np.zeros((len(y), n), np.float32)
        i, j = np.searchsorted(xc, [lo, lo + n])
        a[xr[i:j], xc[i:j] - lo] = 1
        i, j = np.searchsorted(yc, [lo, lo + n])
        b[yr[i:j], yc[i:j] - lo] = 1
        out += a @ b.T
    return out


def _links(percent: int):
    """Forest of the confirmed links of each cell; the rows come sorted by cell."""

    def compare(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        left = {n: np.frombuffer(s, np.uint64) for i, j, b, n, s in rows if b == i}
        right = left if rows[0][0] == rows[0][1] else {n: np.frombuffer(s, np.uint64) for i, j, b, n, s in rows if b == j}
        if not left or not right:
            return []
        a, b = list(left), list(right)
        sa, sb = np.array([len(s) for s in left.values()]), np.array([len(s) for s in right.values()])
        found = UnionFind()
        both = _intersections(list(left.values()), list(right.values()))
        hit = 100 * both.astype(np.int64) >= percent * (sa[:, None] + sb[None, :] - both.astype(np.int64))
        for p, q in zip(*np.nonzero(hit)):
            if a[p] != b[q]:
                found.union(a[p], b[q])
        return [(n, found.find(n)) for n in found.parent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["u", "v"])

        for batch in bytetext.released(batches):
            pairs = []
            cols = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "block", "set_name", "members")]
            for bucket, i, j, b, n, s in zip(*cols):
                if (bucket, i, j) != cell:
                    if rows:
                        pairs += compare(rows)
                    cell, rows = (bucket, i, j), []
                rows.append((i, j, b, n, s))
            if pairs:
                yield out(pairs)
        if rows and (pairs := compare(rows)):
            yield out(pairs)

    return run


def set_names(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` with ``set_name`` (in front of its columns), the 128-bit hash of each text's shingle
    set, null without words. Rows with equal names are copies of one another."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.released(batches):
            data, offsets = bytetext.buffers(batch.column("text"))
            for a, b in bytetext.slices(offsets):
                h, owner = bytetext.shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                at = np.searchsorted(owner, np.arange(b - a + 1))
                names = pa.array([_name(h[i:j].tobytes()) if j > i else None for i, j in zip(at[:-1], at[1:])], pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([names, *part.columns], ["set_name", *columns])

    return docs.mapInArrow(run, StructType([StructField("set_name", BinaryType()), *docs.schema.fields]))


def classified(docs: DataFrame, shingle: int = 5, percent: int = 80, places: int = PLACES, rows: int = ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(sketch, classes), both staged: ``sketch`` has a row per row of ``docs``
    (doc_id, n_shingles, set_name); ``classes`` a row per class of equal sets (set_name, least: its
    smallest doc_id, component: the name of its component)."""
    bytetext.bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stage(texts.mapInArrow(_sketch(shingle, places, rows), "doc_id long, n_shingles long, set_name binary, bands array<long>"), "neardup-sketch")
    # Texts with equal sets have equal bands.
    classes = sketch.where("set_name is not null").groupBy("set_name").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stage(classes, "neardup-classes")
    bands = classes.select("set_name", "n", F.explode("bands").alias("bucket"))
    buckets = (
        bands.groupBy("bucket").agg(F.count("*").alias("many"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("set_name")).alias("x"))
        .where("many > 1").groupBy("many", "shingles", "x").agg(F.min("bucket").alias("bucket"))
    )
    blocks = F.greatest(F.ceil(F.col("many") / block), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int")
    buckets = stage(buckets.select("bucket", blocks.alias("blocks")), "neardup-buckets")
    members = stage(bands.select("set_name", "bucket").join(small_side(buckets), "bucket"), "neardup-members")
    wanted = stage(members.select("set_name").distinct(), "neardup-wanted")
    ids = stage(classes.select("set_name", "least").join(small_side(wanted), "set_name").select(F.col("least").alias("doc_id")).where("doc_id is not null"), "neardup-ids")
    texts_of = texts.join(small_side(ids), "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
    # Repeated rows, and rows that share an id or a set, leave one full set a class.
    sets = texts_of.mapInArrow(_full_sets(shingle), "set_name binary, members binary").groupBy("set_name").agg(F.first("members").alias("members"))
    sets = stage(sets.join(small_side(wanted), "set_name"), "neardup-sets")
    mine = F.pmod(F.xxhash64("set_name"), F.col("blocks")).cast("int")
    cells = (
        members.select("bucket", "set_name", "blocks", mine.alias("block"))
        .select("bucket", "set_name", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("bucket", "set_name", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(sets, "set_name")
        .repartition(F.col("bucket"), F.col("i"), F.col("j"))
        .sortWithinPartitions("bucket", "i", "j")
    )
    # Written first: a second Python function in the same task would need a second worker beside this one's.
    links = stage(cells.mapInArrow(_links(percent), "u binary, v binary"), "neardup-links")
    label = components(links)
    named = classes.select("set_name", "least").join(label.withColumnRenamed("node", "set_name"), "set_name", "left")
    named = stage(named.select("set_name", "least", F.coalesce("component", "set_name").alias("component")), "neardup-named")
    return sketch.select("doc_id", "n_shingles", "set_name"), named


def _with_least(classes: DataFrame) -> DataFrame:
    """(set_name, component, component_id, first): the smallest doc_id of each class's
    component, and the class that holds it (the first by name, if several do)."""
    many = classes.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct(F.col("least").isNull(), "least", "set_name")).alias("best")).where("n > 1")
    many = stage(many.select("component", F.col("best.least").alias("smallest"), F.col("best.set_name").alias("holder")), "neardup-components")
    joined = classes.join(small_side(many), "component", "left")
    return joined.select("set_name", "component", F.coalesce("smallest", "least").alias("component_id"), F.coalesce("holder", "set_name").alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, places: int = PLACES, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Components of near-duplicate texts: (doc_id, n_shingles, component_id, kept).

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns, whatever their
    names, are ignored. Two texts are linked if 100 * |A & B| >= ``percent`` *
    |A | B| for their sets of distinct ``shingle``-word shingles (fewer words:
    the whole sequence as one; A-Z lower-cased). One row per input row.
    ``component_id`` is the smallest doc_id reachable over links.

    A null or wordless text has no shingles, is linked with nothing and is its
    own component. Rows with a null doc_id take part; they get the smallest
    non-null doc_id of their component, or null if there is none, and ``kept``
    is ``doc_id <=> component_id``, so that a row without an id is dropped only
    for one with an id. Repeated rows get equal results (all of them are kept if
    they hold the component's smallest doc_id); an id may stand on rows with different
    texts, each of which is linked for itself. An empty table gives no rows.
    """
    sketch, classes = classified(docs, shingle, percent, places, rows, block)
    named = _with_least(classes).select("set_name", "component_id")
    out = sketch.where("set_name is not null").join(named, "set_name").select("doc_id", "n_shingles", "component_id").unionByName(
        sketch.where("set_name is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component exactly one
    row, the one with its smallest doc_id, all columns kept.

    Rows without words all stay. Ids may repeat or be null: of several rows with
    the component's smallest id and equal sets, the least one by its columns stays; a component
    without any id keeps one row. An empty table gives no rows.
    """
    sketch, classes = classified(docs, shingle, percent)
    chosen = _with_least(classes).select("set_name", F.col("component_id").alias("kept_id"), F.col("first").alias("kept_set"))
    pairs = sketch.where("set_name is not null").groupBy("set_name", "doc_id").agg(F.count("*").alias("n")).join(chosen, "set_name")
    keep = (F.col("set_name") == F.col("kept_set")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    # Rows that are the only one of their component need no decision and meet no shuffle.
    decided = stage(pairs.withColumn("keep", keep).where("not keep or n > 1").select(F.col("set_name").alias("s"), F.col("doc_id").alias("d"), "keep"), "neardup-decided")
    named = set_names(docs, shingle).join(small_side(decided), (F.col("set_name") == F.col("s")) & F.col("doc_id").cast("long").eqNullSafe(F.col("d")), "left")
    out = named.where("keep is null").select(*docs.columns)
    if decided.where("keep").isEmpty():
        return out
    repeated = named.where("keep").groupBy("set_name", "d").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(repeated.select("row.*"))
