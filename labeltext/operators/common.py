"""Small plan-shaping helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def fence(df: DataFrame, label: str) -> DataFrame:
    """Count the rows passing this point (``df.observe``) and keep later
    filters above it.

    Catalyst pushes a filter through a projection by inlining the projected
    expressions into the predicate. For the regex cleaning chain that means
    evaluating it again (several times: ``nullif`` and word counts repeat
    their input) inside the pushed filter. A ``CollectMetrics`` node is not
    pushed through, so the projection below is computed once and the filter
    reads its output columns. The count is available through
    ``pyspark.sql.Observation`` or the query listener.
    """
    name = f"{label}_{uuid.uuid4().hex[:8]}"
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def sized_broadcast(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 256 << 20) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows
    and about ``max_bytes`` of data.

    The proof is one job over ``limit(max_rows + 1)``, which stops reading once
    the row bound is exceeded; it counts the rows and sums the byte length of
    the string and binary values (8 bytes for any other value). Larger inputs
    are returned as they are and the join shuffles (AQE may still pick a
    broadcast from runtime sizes).
    """
    sizes = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            sizes.append(F.coalesce(F.sum(F.octet_length(F.col(f.name))), F.lit(0)))
        else:
            sizes.append(F.count("*") * F.lit(8))
    total = sum(sizes[1:], sizes[0]) if sizes else F.lit(0)
    row = df.limit(max_rows + 1).agg(F.count("*").alias("n"), total.alias("bytes")).first()
    if row["n"] <= max_rows and row["bytes"] <= max_bytes:
        return F.broadcast(df)
    return df
