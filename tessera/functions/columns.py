"""Column functions built from Spark's JVM-side expressions only.

Nothing here runs Python per row.  Helpers over arrays use lambda functions
(``transform``, ``zip_with``, ``aggregate``), which Spark interprets outside
whole-stage code generation; the hot loops that used them work on Arrow
batches instead (``learn._nearest``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def java_hash_code(s: Column | str) -> Column:
    """FN4: ``String.hashCode`` of a string, as a 32-bit int (null for null).

    The function is the JVM's own: one call a row instead of a lambda over the
    characters.
    """
    s = F.col(s) if isinstance(s, str) else s
    s = s.cast("string")
    return F.when(s.isNotNull(), F.reflect(F.lit("java.util.Objects"), F.lit("hashCode"), s).cast("int"))


def sig(x: Column | str, digits: int = 9) -> Column:
    """Round a double to ``digits`` significant digits (scientific text
    round-trip).  Used where sums of very different magnitudes would differ
    in the last bits between engines."""
    x = F.col(x) if isinstance(x, str) else x
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


def dec(x: Column | str, p: int = 12, s: int = 2) -> Column:
    """Exact money arithmetic: decimals sum without rounding drift."""
    x = F.col(x) if isinstance(x, str) else x
    return x.cast(f"decimal({p},{s})")


def vec_dot(a: Column, b: Column) -> Column:
    """FN6: dot product of two equal-length array<double> columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def vec_sqdist(a: Column, b: Column) -> Column:
    """FN6: squared Euclidean distance of two array<double> columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, v: acc + v)


def literal_vectors(rows: list[list[float]]) -> Column:
    """A small model (K centres, one weight vector) as an array literal.

    The size is the model's, fixed by the caller's K and dimension, never the
    data's; it travels inside the plan instead of a join.
    """
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


# --------------------------------------------------------------------------
# Time-zone-free conversions between TIMESTAMP_NTZ and epoch instants
# --------------------------------------------------------------------------

_EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, read as UTC wall
    clock — independent of the session time zone (a plain cast to
    TIMESTAMP would shift by the session's offset)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), ts)


def ntz_to_instant(ts: Column | str) -> Column:
    """TIMESTAMP_NTZ → TIMESTAMP at the same UTC wall clock (what event-time
    windows and watermarks need), whatever the session time zone is."""
    return F.timestamp_micros(ntz_micros(ts))


def instant_to_ntz(ts: Column | str) -> Column:
    """Inverse of :func:`ntz_to_instant`."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))
