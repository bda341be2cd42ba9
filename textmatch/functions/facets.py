"""Facet filters and custom sorting over typed or text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"


def number(c: Column) -> Column:
    """The value as a double; null if it is none. Blank text is 0."""
    text = c.cast("string")
    return F.when(F.trim(text) == "", F.lit(0.0)).when(text.rlike(_NUMBER), text.try_cast("double"))


def same_value(c: Column, value) -> Column:
    """Equal text without case; a number equals text that reads as it."""
    text = c.cast("string")
    if isinstance(value, bool):
        return F.lower(text) == str(value).lower()
    if isinstance(value, (int, float)):
        return number(c) == F.lit(float(value))
    return F.lower(text) == value.lower()


def in_range(c: Column, low=None, high=None) -> Column:
    """Within the limits; what is missing or no number passes."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (number(c) >= low)
    if high is not None:
        ok = ok & (number(c) <= high)
    return F.coalesce(ok, F.lit(True))


def in_terms(c: Column, values: list, every: bool = False, array: bool = False) -> Column:
    """One of values (every: all of them, for arrays); what is missing passes."""
    hits = [_any(c, v) if array else same_value(c, v) for v in values]
    out = hits[0]
    for h in hits[1:]:
        out = out & h if every else out | h
    return F.coalesce(out, F.lit(True))


def _any(c: Column, v) -> Column:
    return F.exists(c, lambda x: same_value(x, v))


def is_flag(c: Column, value: bool) -> Column:
    text = F.lower(c.cast("string"))
    return F.when(c.isNull(), True).otherwise(((text == "true") | F.coalesce(number(c) == 1, F.lit(False))) == F.lit(value))


def apply_filters(df: DataFrame, filters: dict, of=F.col) -> DataFrame:
    """filters: ranges [{field, min, max}], terms [{field, values, operator}], booleans [{field, value}]."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for r in filters.get("ranges", []):
        df = df.where(in_range(of(r["field"]), r.get("min"), r.get("max")))
    for t in filters.get("terms", []):
        df = df.where(in_terms(of(t["field"]), t["values"], t.get("operator", "OR") == "AND", isinstance(kinds.get(t["field"]), T.ArrayType)))
    for b in filters.get("booleans", []):
        df = df.where(is_flag(of(b["field"]), b["value"]))
    return df


def sort_keys(c: Column, order: str = "asc", kind: str = "string") -> list[Column]:
    """Missing values last in either order; numbers that don't parse come behind numbers, or first if descending."""
    if kind == "number":
        key, bad = number(c), number(c).isNull() & c.isNotNull()
        return [c.isNull().asc(), bad.asc() if order == "asc" else bad.desc(), key.asc() if order == "asc" else key.desc()]
    if kind == "date":
        key = F.coalesce(F.try_to_timestamp(c.cast("string")), F.try_to_timestamp(c.cast("string"), F.lit("MM/dd/yyyy")))
        return [c.isNull().asc(), key.asc() if order == "asc" else key.desc()]
    key = F.collate(c.cast("string"), "UNICODE")
    return [c.isNull().asc(), key.asc() if order == "asc" else key.desc()]


def kind_of(df: DataFrame, name: str) -> str:
    """number, date or string: by type, for text by its first value that is not null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    row = df.where(F.col(name).isNotNull()).select(F.col(name).rlike(_NUMBER).alias("n"), F.col(name).rlike(_DATE).alias("d")).first() if isinstance(kind, T.StringType) else None
    return "string" if row is None else "number" if row["n"] else "date" if row["d"] else "string"


def apply_sort(df: DataFrame, primary: dict, secondary: dict | None = None, relevance: tuple[str, ...] = ("score",), keep_relevance: bool = True) -> list[Column]:
    """Sort keys for {field, order, type} and, unless it is not to be kept, relevance."""
    keys = []
    for s in (primary, secondary):
        if s:
            keys += sort_keys(F.col(s["field"]), s.get("order", "asc"), s.get("type") or kind_of(df, s["field"]))
    return keys + ([F.col(c).desc() for c in relevance if c in df.columns] if keep_relevance else [])
