"""Document fingerprints by Order MinHash (Marcais et al. 2019), in DataFrame
functions only.

The k-mers of a text are its runs of ``K`` words; each carries its occurrence
number, so repeats count. A hash of both throws every k-mer into one of ``BINS``
bins and ranks it there. Per bin the ``PICKED`` lowest are taken, put back into
text order, and hashed as a tuple: moving words about changes a tuple even if
the k-mers stay, which is what makes the sketch follow the edit distance. One
hash for all bins (one-permutation hashing) needs one pass over the k-mers;
bins without k-mers are left out of the likeness.

Numbers are packed into longs, so that arrays sort as plain numbers: a k-mer as
36 bits of hash and 28 of position, a numbered k-mer as 5 bits of bin, 30 of
rank and 28 of position.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltext.llm.staging import wide_partitions

K = 2
BINS = 32
PICKED = 2
POSITION = (1 << 28) - 1
EMPTY = "-" * 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _counting(n: Column) -> Column:
    """0 to n-1; an empty array for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def kmers(text: Column) -> Column:
    """Array of packed k-mers (hash, position) of the text, sorted; a text of
    fewer than ``K`` words has its word sequence as its only k-mer."""
    split = F.split(text, r"[\x09-\x0D\x20]+")
    words = F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))

    def pack(w: Column) -> Column:
        runs = _counting(F.greatest(F.size(w) - (K - 1), F.least(F.size(w), F.lit(1))))
        return F.transform(
            runs, lambda i: F.shiftleft(F.xxhash64(*[F.coalesce(F.get(w, i + k), F.lit(0).cast("long")) for k in range(K)]), 28).bitwiseOR(i.cast("long"))
        )

    return let(words, lambda w: F.sort_array(pack(w)))


def numbered(packed: Column) -> Column:
    """Sorted array of (bin, rank, position) of the k-mers with their numbers.
    Equal k-mers stand together, so a k-mer's number is its distance from the
    first of its run."""

    def differs(p: Column, i: Column) -> Column:
        return (i == 0) | (F.shiftright(F.get(p, i), 28) != F.shiftright(F.get(p, i - 1), 28))

    def number(p: Column, i: Column, n: Column) -> Column:
        x = F.get(p, i)
        h = F.xxhash64(F.shiftright(x, 28), n)
        return F.shiftrightunsigned(h, 29).bitwiseAND(F.lit((BINS << 30) - 1)) * (1 << 28) + x.bitwiseAND(F.lit(POSITION))

    def run(p: Column, starts: Column) -> Column:
        def one(s: Column, j: Column) -> Column:
            stop = F.coalesce(F.get(starts, j + 1), F.size(p))
            return F.when(stop - s == 1, F.array(number(p, s, F.lit(0)))).otherwise(F.transform(F.sequence(s, stop - 1), lambda i: number(p, i, i - s)))

        return F.flatten(F.transform(starts, one))

    return let(packed, lambda p: let(F.filter(_counting(F.size(p)), lambda i: differs(p, i)), lambda s: F.sort_array(run(p, s))))


def signature(text: Column) -> Column:
    """Array of ``BINS`` tuple hashes, null for a bin without k-mers."""

    def bin_of(q: Column, i: Column) -> Column:
        return F.shiftright(F.get(q, i), 58)

    def tuple_hash(q: Column, i: Column) -> Column:
        lowest = F.array(*[F.get(q, i + k) for k in range(PICKED)])  # slice() would copy the whole array
        same = F.filter(lowest, lambda x: F.shiftright(x, 58) == bin_of(q, i))
        in_order = F.sort_array(F.transform(same, lambda x: x.bitwiseAND(F.lit(POSITION)) * (1 << 30) + F.shiftright(x, 28).bitwiseAND(F.lit((1 << 30) - 1))))
        return F.xxhash64(F.transform(in_order, lambda x: x.bitwiseAND(F.lit((1 << 30) - 1))))

    def bins(q: Column) -> Column:
        starts = F.filter(_counting(F.size(q)), lambda i: (i == 0) | (bin_of(q, i) != bin_of(q, i - 1)))
        pairs = F.map_from_entries(F.transform(starts, lambda i: F.struct(bin_of(q, i).cast("int"), tuple_hash(q, i))))
        return let(pairs, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.element_at(m, b)))

    return let(numbered(kmers(text)), bins)


def as_text(sig: Column) -> Column:
    """The fingerprint: 8 hex digits per bin, dashes for an empty one."""
    return F.array_join(F.transform(sig, lambda x: F.coalesce(F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8))), F.lit(EMPTY))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those filled in either; 1 if none is filled."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.coalesce((x == y).cast("int"), F.lit(0))))
    filled = F.filter(pairs, lambda v: v.isNotNull())
    return let(filled, lambda v: F.when(F.size(v) == 0, 1.0).otherwise(F.aggregate(v, F.lit(0), lambda s, x: s + x) / F.size(v)))


def with_next(rows: DataFrame, key: str, tie: str, carried: list[str]) -> DataFrame:
    """``rows`` (key and tie: long, not null) with ``next_<c>`` for the ``carried``
    columns: their values in the next row by key, then tie, then text; the first row's
    after the last.

    Rows are dealt to ranges of (key, tie), several per shuffle partition: a key
    that takes up several shares of the rows gets as many ranges of its
    ties, which are evenly spread hashes. The first row of a range goes to the
    range before it as well, as its tail. Only the ranges' bounds, a number
    set by the shuffle partitions, reach the driver.
    """
    spark = rows.sparkSession
    n = 4 * wide_partitions(spark)
    shares = [(i + 1) / n for i in range(n - 1)]
    found = sorted(rows.agg(F.percentile_approx(key, shares, max(10_000, 20 * n))).first()[0] or [])
    often = Counter(found)
    bounds = [(k, -(1 << 63) + t * ((1 << 64) // m)) for k, m in sorted(often.items()) for t in range(m)]
    steps = [1 << b for b in reversed(range(max(1, len(bounds)).bit_length()))]

    def bucket(k: Column, t: Column) -> Column:
        if not bounds:
            return F.lit(0)
        keys, ties, count = F.array(*[F.lit(b[0]) for b in bounds]), F.array(*[F.lit(b[1]) for b in bounds]), len(bounds)

        def reached(i: Column) -> Column:
            return (F.get(keys, i) < k) | ((F.get(keys, i) == k) & (F.get(ties, i) <= t))

        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= count) & reached(at + s - 1), at + s).otherwise(at))

    dealt = rows.withColumn("range", bucket(F.col(key), F.col(tie)))
    least = dealt.groupBy("range").agg(F.min(F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))).alias("f")).select("range", "f.k", "f.t")
    firsts = sorted(map(tuple, least.collect()))
    if not firsts:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    first_key = F.create_map(*[F.lit(x) for r, k, _ in firsts for x in (r, k)])
    first_tie = F.create_map(*[F.lit(x) for r, _, t in firsts for x in (r, t)])
    previous = F.create_map(*[F.lit(x) for i, (r, _, _) in enumerate(firsts) for x in (r, firsts[i - 1][0])])
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("tail"))
    other = F.struct(F.element_at(previous, F.col("range")).alias("range"), F.lit(True).alias("tail"))
    is_first = (F.element_at(first_key, F.col("range")) == F.col(key)) & (F.element_at(first_tie, F.col("range")) == F.col(tie))
    place = F.explode(F.when(is_first, F.array(own, other)).otherwise(F.array(own)))
    spread = dealt.withColumn("place", place).withColumn("range", F.col("place.range")).withColumn("tail", F.col("place.tail")).drop("place")
    order = Window.partitionBy("range").orderBy("tail", key, tie, "text")
    return spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("not tail").drop("range", "tail")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint, edited, edited_fingerprint, near_edited,
    near_next) of every row of ``docs`` (doc_id: long, text); other columns are
    ignored.

    ``edited`` is the text with its last floor(n / 4) code points replaced by the
    first as many, or all, of the next document by doc_id (equal ids: by a hash of
    the text, so that rows of one id, or without one, spread over tasks; only rows equal
    in id and text stand together; null ids come first; after the last comes
    the first, so a lone document is its own next). A null text counts as empty. Texts without words
    have no filled bin; two of them are alike (1), one and another are not (0).
    An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text")).withColumn("sig", signature(F.col("text")))
    both = with_next(rows, "key", "tie", ["text", "sig"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sig", "next_sig").withColumn("edited_sig", signature(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", as_text(F.col("sig")).alias("fingerprint"), "edited", as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
