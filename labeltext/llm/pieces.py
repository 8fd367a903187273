"""Encoding texts to sentence pieces by sampling, and decoding (DataFrame side
of ``piecelattice``)."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltext.llm import bytetext, piecelattice

#: Where the model lies on every machine; a parameter of all functions here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SUPER_BYTES = 1 << 20


@functools.lru_cache(maxsize=2)
def vocabulary(model_file: str, alpha: float) -> piecelattice.Vocabulary:
    return piecelattice.Vocabulary(model_file, alpha)


def _encoder(model_file: str, alpha: float, k: int, seed: int, ids: bool, packed: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file, alpha)
        for batch in bytetext.released(batches):
            data, offsets = bytetext.buffers(batch.column("text"))
            keys = batch.column("row_key").fill_null(0).to_numpy()
            for a, b in bytetext.slices(offsets, SUPER_BYTES):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                text, rank, pieces, count, logp, value, inclusion = piecelattice.sample(vocab, part, at, keys[a:b], k, seed)
                ends = np.concatenate(([0], np.cumsum(count)))
                back, bound = piecelattice.decode(vocab, pieces, count)
                same = [back[bound[i] : bound[i + 1]].tobytes() == part[at[t] : at[t + 1]].tobytes() for i, t in enumerate(text.tolist())]
                if ids:
                    out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pieces))
                else:
                    out = pa.array([hashlib.sha256(pieces[i:j].tobytes()).hexdigest() for i, j in zip(ends[:-1], ends[1:])], pa.string())
                columns = [batch.column("doc_id").take(pa.array(text + a)), pa.array(rank), out, pa.array(count), pa.array(logp), pa.array(value), pa.array(inclusion), pa.array(same, pa.bool_())]
                names = ["doc_id", "rank", "pieces", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip"]
                if packed:
                    flat = pa.py_buffer(pieces.astype("<i4", copy=False))
                    columns.append(pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((4 * ends).astype(np.int32)), flat]))
                    names.append("packed")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, k: int = 2, seed: int = 0, alpha: float = piecelattice.ALPHA, model_file: str = MODEL, ids: bool = True, packed: bool = False) -> DataFrame:
    """Up to ``k`` distinct sampled segmentations of every text, by rank.

    (doc_id, rank, pieces, n_pieces, log_prob, perturbed, log_inclusion,
    round_trip); ``pieces`` are piece ids (array<int>), or with ``ids=False`` the
    SHA-256 of their little-endian 32-bit integers; ``packed`` adds these integers as
    a column of that name (binary). ``log_inclusion`` is the log
    of the probability that the segmentation is among the ``k``, given the
    (k+1)-th perturbed value; ``round_trip`` whether the pieces spell the text again.

    Draws depend on ``seed`` and doc_id (null: 0) alone, so equal rows get equal
    segmentations, however the table is partitioned. A null or empty text has one
    segmentation without pieces; a text with fewer than ``k`` segmentations has
    them all. Other columns are ignored; an empty table gives no rows.
    """
    bytetext.bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("row_key"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = "array<int>" if ids else "string"
    return rows.mapInArrow(
        _encoder(model_file, alpha, k, seed, ids, packed),
        f"doc_id {kind}, rank int, pieces {out}, n_pieces long, log_prob double, perturbed double, log_inclusion double, round_trip boolean" + ", packed binary" * packed,
    )


def digest(ids: str, packed: bool = False) -> Column:
    """SHA-256 of the piece ids of a column (array<int>), as little-endian 32-bit
    integers; null for null. ``packed``: the column holds these integers (binary),
    so the arrays need not go to Python again."""
    if packed:
        return F.sha2(F.col(ids), 256)

    @F.arrow_udf("string")
    def sha256(arrays: pa.Array) -> pa.Array:
        values = arrays.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        ends = np.cumsum(arrays.value_lengths().fill_null(0).to_numpy())
        found = [hashlib.sha256(values[i:j].tobytes()).hexdigest() for i, j in zip([0, *ends[:-1]], ends)]
        return pa.array(found, pa.string(), mask=arrays.is_null().to_numpy(zero_copy_only=False))

    return sha256(F.col(ids))


def decode(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """``encoded`` (with ``pieces``: array<int>) with a column ``text`` of the
    texts that the pieces spell; bytes that are not UTF-8 become U+FFFD. Null
    pieces give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file, piecelattice.ALPHA)
        for batch in bytetext.released(batches):
            texts = []
            for pieces in batch.column("pieces").to_pylist():
                spelt = None if pieces is None else b"".join(vocab.bytes_of[p] for p in pieces)[1:].decode("utf-8", "replace")
                texts.append(spelt)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    plain = encoded.drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{fields}, text string")
