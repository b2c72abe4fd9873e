"""The log-query language: OR-ed field clauses over semi-structured rows, parsed once into a Column."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The numeric prefix of a string, as a number parser that stops at the first odd character reads it.
_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def text_of(value: Column, kind: str) -> Column:
    """A value's text; null is empty, and whole doubles print without a fraction."""
    s = value.cast("string")
    if kind in ("double", "float"):
        s = F.regexp_replace(s, r"\.0$", "")
    return F.coalesce(s, F.lit(""))


def number_of(text: Column) -> Column:
    return F.regexp_extract(text, _NUMBER, 1).try_cast("double")


def typed_values(df: DataFrame, json_columns: tuple[str, ...] = ()) -> Callable[[str], Column]:
    """Resolves dotted paths over columns, null where there is nothing; a path into a JSON text column is read from it."""
    kinds = dict(df.dtypes)

    def value(path: str) -> Column:
        head, _, rest = path.partition(".")
        if path in kinds:
            return F.when(F.col(f"`{path}`").isNotNull(), text_of(F.col(f"`{path}`"), kinds[path]))
        if rest and head in json_columns:
            return F.get_json_object(head, f"$.{rest}")
        if rest and kinds.get(head, "").startswith("variant"):
            return F.try_variant_get(F.col(head), f"$.{rest}", "string")
        return F.lit(None).cast("string")

    return value


def typed_fields(df: DataFrame, json_columns: tuple[str, ...] = ()) -> Callable[[str], Column]:
    """``typed_values`` with the empty text where there is nothing."""
    value = typed_values(df, json_columns)
    return lambda path: F.coalesce(value(path), F.lit(""))


def variant_fields(column: str = "v") -> Callable[[str], Column]:
    """Resolves dotted paths over one variant column."""
    return lambda path: F.coalesce(F.try_variant_get(F.col(column), "$." + path, "string"), F.lit(""))


def _like(value: Column, pattern: str) -> Column:
    body = pattern.strip("%")
    lead, trail = pattern.startswith("%"), pattern.endswith("%")
    if lead and trail:
        return F.contains(value, F.lit(body))
    return F.endswith(value, F.lit(body)) if lead else F.startswith(value, F.lit(body)) if trail else value == body


#: Operators of a clause, longer ones before those they begin with.
OPERATORS = ["=~", "~=", "~", ">=", "<=", "!=", "="]


def scanned(text: str) -> tuple[str, str, str] | None:
    """(field, operator, rest) of a clause, read from the left; None if there is none.

    ``field like value`` comes first.  Else the field runs up to the first of = ~ < > !, where an
    operator must stand; without any of these, up to the first : or =, and the value up to the next.
    """
    words = text.split(None, 2)
    if len(words) == 3 and words[1].lower() == "like":
        value = words[2][1:] if words[2][0] in "'\"" else words[2]
        value = value[:-1] if value[-1:] in ("'", '"') else value
        if "'" not in value and '"' not in value:
            return words[0], "like", value
    at = next((i for i, c in enumerate(text) if c in "=~<>!"), len(text))
    if 0 < at < len(text):
        found = next((o for o in OPERATORS if text.startswith(o, at)), None)
        return (text[:at].strip(), found, text[at + len(found) :]) if found else None
    parts = text.split(":")
    return (parts[0].strip(), "=", parts[1]) if at == len(text) and len(parts) > 1 and parts[0] else None


def _number(text: str) -> float | None:
    """The number that a text begins with."""
    m = re.match(_NUMBER, text)
    return float(m[1]) if m else None


def clause(text: str, field: Callable[[str], Column], strict: bool = True) -> Column:
    """One clause; in compat mode (``strict=False``) a malformed clause passes every row and values keep blanks."""
    parts = scanned(text)
    if parts is None:
        if strict:
            raise ValueError(f"malformed clause: {text!r}")
        return F.lit(True)
    name, op, value = parts
    have = field(name)
    if op == "like":
        return _like(have, value)
    value = value.strip() if strict else value
    bare, prefix = value.removesuffix("%"), value.endswith("%")
    if op == "~":
        return F.contains(have, F.lit(bare))
    if op == "!=":
        return have != bare
    if op in (">=", "<="):
        n = _number(bare)
        compare = operator.ge if op == ">=" else operator.le
        return F.lit(False) if n is None else F.coalesce(compare(number_of(have), F.lit(n)), F.lit(False))
    return F.startswith(have, F.lit(bare)) if prefix else have == value


def where(text: str, field: Callable[[str], Column], strict: bool = True) -> Column:
    """``c1 OR c2 ...``; an empty text passes every row."""
    parts = [p.strip() for p in re.split(r"\s+or\s+", text, flags=re.I) if p.strip()]
    return functools.reduce(operator.or_, [clause(p, field, strict) for p in parts]) if parts else F.lit(True)


def query(df: DataFrame, text: str, select: list[str], limit: int | None = 100, order: str = "ord", json_columns: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Filter, first ``limit`` rows by ``order``, projection; a dotted path's column has its whole name."""
    field = typed_fields(df, json_columns)
    out = df.filter(where(text, field, strict))
    if limit is not None:
        out = out.orderBy(order).limit(limit)
    kinds = dict(df.dtypes)
    value = typed_values(df, json_columns)
    return out.select(*[F.col(f"`{p}`") if p in kinds else value(p).alias(p) for p in select])
