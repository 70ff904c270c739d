"""Fixed rounding by field, applied once to nested rows where they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Places by field name. Fixed values.
PLACES = {
    "echo_ratio": 4,
    "overlap_with_cited_rank": 4,
    "best_overlap": 4,
    "recall": 6,
    "point_estimate": 6,
    "lower": 6,
    "upper": 6,
    "width": 6,
    "coverage": 6,
    "abstention_rate": 6,
    "escalation_rate": 6,
    "routing_agreement": 6,
    "macro": 6,
    "micro": 6,
    "unsafe_answer_rate": 6,
    "abstention_precision": 6,
    "abstention_recall": 6,
    "escalation_precision": 6,
    "escalation_recall": 6,
    "seconds": 6,
    "stage_seconds": 6,
}


def round_exact(x: Column, places: int) -> Column:
    """x rounded by its binary value, ties to even, as Python's round() does it; bround() takes the shortest decimal form for the value.

    The sign of 2 * x * 10^places minus an odd number is exact: x is split into halves of 26 bits, and their products with so small a
    number need no rounding. Beyond 2^31, and for infinite and NaN values, bround() answers; null stays null."""
    m = 10.0**places
    n = F.floor(x * m).cast("double")
    split = x * 134217729.0
    high = split - (split - x)
    over = (high * (2 * m) - (2 * n + 1)) + (x - high) * (2 * m)
    up = (over > 0) | ((over == 0) & (F.pmod(n, F.lit(2.0)) == 1))
    return F.when(F.abs(x) < 2.0**31, (n + F.when(up, 1.0).otherwise(0.0)) / m).otherwise(F.bround(x, places))


def _told(c: Column, kind: S.DataType, name: str, places: dict[str, int]) -> Column | None:
    """The column with its fields rounded; None where nothing in it is."""
    if isinstance(kind, (S.DoubleType, S.FloatType)):
        return round_exact(c.cast("double"), places[name]).cast(kind) if name in places else None
    if isinstance(kind, S.StructType):
        new = {f.name: _told(c.getField(f.name), f.dataType, f.name, places) for f in kind.fields}
        if not any(v is not None for v in new.values()):
            return None
        return F.when(c.isNotNull(), F.struct(*[(c.getField(k) if v is None else v).alias(k) for k, v in new.items()]))
    if isinstance(kind, S.ArrayType):
        return F.transform(c, lambda v: _told(v, kind.elementType, name, places)) if _any(kind.elementType, name, places) else None
    if isinstance(kind, S.MapType):
        return F.transform_values(c, lambda _, v: _told(v, kind.valueType, name, places)) if _any(kind.valueType, name, places) else None
    return None


def _any(kind: S.DataType, name: str, places: dict[str, int]) -> bool:
    if isinstance(kind, S.StructType):
        return any(_any(f.dataType, f.name, places) for f in kind.fields)
    if isinstance(kind, (S.ArrayType, S.MapType)):
        return _any(kind.elementType if isinstance(kind, S.ArrayType) else kind.valueType, name, places)
    return isinstance(kind, (S.DoubleType, S.FloatType)) and name in places


def rounded(df: DataFrame, places: dict[str, int] | None = None) -> DataFrame:
    """df with every floating field named in places rounded, however deep in structs, arrays and map values; an array's or a map's numbers go
    by its own name. Other columns are left as they are, and nothing is shuffled."""
    places = PLACES if places is None else places
    new = {f.name: _told(F.col(f"`{f.name}`"), f.dataType, f.name, places) for f in df.schema.fields}
    return df.withColumns({k: v for k, v in new.items() if v is not None})
