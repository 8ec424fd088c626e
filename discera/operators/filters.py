"""Selections: declarative filters, JSON filters, scopes, retries, text queries, overlays."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discera.functions.text import blank_to_null, fold, fold_letters

OPS = ("eq", "ne", "in", "contains", "gte", "lte", "between", "is_null", "is_not_null")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def _typed(column: Column, values: list) -> tuple[Column, list]:
    """The declared values decide how to compare: as dates, as numbers, or as folded text."""
    texts = [str(v).strip() for v in values]
    if all(_DATE.match(t) for t in texts):
        return F.try_to_timestamp(column.cast("string")), [F.lit(t).cast("timestamp") for t in texts]
    try:
        return column.try_cast("double"), [F.lit(float(t)) for t in texts]
    except ValueError:
        return F.lower(F.trim(column.cast("string"))), [F.lit(t.lower()) for t in texts]


def condition(column: Column, op: str, value=None) -> Column:
    """A row filter; text is trimmed and compared without case, blank counts as null, and `ne` keeps nulls."""
    text = blank_to_null(column.cast("string"))
    low = F.lower(F.trim(text))
    if op == "is_null":
        return text.isNull()
    if op == "is_not_null":
        return text.isNotNull()
    if op == "eq":
        return F.coalesce(low == str(value).strip().lower(), F.lit(False))
    if op == "ne":
        return F.coalesce(low != str(value).strip().lower(), F.lit(True))
    if op == "in":
        return F.coalesce(low.isin([str(v).strip().lower() for v in value]), F.lit(False)) if value else F.lit(False)
    if op == "contains":
        return F.coalesce(F.contains(F.lower(text), F.lit(str(value).lower())), F.lit(False))
    if op in ("gte", "lte", "between"):
        values = list(value) if op == "between" else [value]
        c, v = _typed(column, values)
        test = c >= v[0] if op == "gte" else c <= v[0] if op == "lte" else (c >= v[0]) & (c <= v[1])
        return F.coalesce(test, F.lit(False))
    raise ValueError(f"unknown operator {op}; one of {', '.join(OPS)}")


def apply_selection(df: DataFrame, filters: Iterable[dict], *, must_match: bool = False) -> DataFrame:
    """Rows that pass all filters {field, op, value}. A field that is missing is an error, and with must_match an empty result too."""
    filters = list(filters)
    if missing := [f["field"] for f in filters if f["field"] not in df.columns]:
        raise KeyError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    out = df.where(reduce(lambda a, b: a & b, (condition(F.col(f["field"]), f["op"], f.get("value")) for f in filters), F.lit(True)))
    if must_match and out.isEmpty():
        raise ValueError("the selection leaves no row")
    return out


def json_condition(payload: Column, path: str, op: str, value=None, *, case_sensitive: bool = True) -> Column:
    """The same operators on a path of a JSON text, exactly: `ne` drops nulls, blank is not null, bad JSON is null."""
    got = F.get_json_object(payload, "$." + path)
    if op == "is_null":
        return got.isNull()
    if op == "is_not_null":
        return got.isNotNull()
    if op == "in":
        return got.isin([str(v) for v in value]) if value else F.lit(False)
    if op == "contains":
        return F.contains(got, F.lit(str(value))) if case_sensitive else F.contains(F.lower(got), F.lit(str(value).lower()))
    if op in ("gte", "lte", "between"):
        values = [float(v) for v in (value if op == "between" else [value])]
        n = got.try_cast("double")
        return n >= values[0] if op == "gte" else n <= values[0] if op == "lte" else n.between(*values)
    return got == str(value) if op == "eq" else got != str(value)


def pending(df: DataFrame, payload: str, error: str) -> DataFrame:
    """Rows that a stage has neither finished nor failed."""
    return df.where(F.col(payload).isNull() & F.col(error).isNull())


def retry(df: DataFrame, payload: str, error: str, target: str, match: Column | None = None, *, version: str | None = None) -> DataFrame:
    """Clears payload, error and version of the rows that a policy selects: failed, completed or all."""
    of = {"failed": F.col(error).isNotNull(), "completed": F.col(payload).isNotNull(), "all": F.lit(True)}[target]
    hit = F.coalesce(of & (match if match is not None else F.lit(True)), F.lit(False))
    cleared = {c: F.when(~hit, F.col(c)) for c in (payload, error, version) if c}
    return df.withColumns(cleared)


def in_lists(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose list (or single value) meets the wanted values; no wanted values: all rows."""
    if not wanted:
        return df
    if dict(df.dtypes)[column].startswith("array"):
        return df.where(F.arrays_overlap(F.col(column), F.array(*map(F.lit, wanted))))
    return df.where(F.col(column).isin(wanted))


def by_dimensions(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows equal to one of the wanted values in each dimension, without case and accents."""
    from discera.functions.text import fold_value

    return df.where(reduce(lambda a, b: a & b, (fold(F.col(c)).isin([fold_value(v) for v in vs]) for c, vs in wanted.items() if vs), F.lit(True)))


def scope(df: DataFrame, key: str, producers: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """Keys of df that are in scope: for each producer (rows, payload column, filter) that has finished all its rows, those with a row that passes. Unfinished producers do not filter."""
    out = df
    for rows, payload, test in producers.values():
        done = rows.agg((F.count(payload) == F.count(F.lit(1))).alias("d")).first()["d"]
        if done:
            out = out.join(rows.where(test).select(key).distinct(), key, "left_semi")
    return out


def scope_table(all_keys: DataFrame, scoped: DataFrame, key: str) -> DataFrame:
    """Every key with 1 in scope or 0."""
    return all_keys.select(key).join(scoped.select(key).distinct().withColumn("in_scope", F.lit(1)), key, "left").fillna(0, ["in_scope"])


def variants(phrase: str, most: int = 16) -> list[str]:
    """A phrase with its optional parts, in ( ) or [ ], left out or put in."""
    out = [""]
    for part in re.split(r"(\([^)]*\)|\[[^\]]*\])", phrase):
        if part[:1] in "([" and part[-1:] in ")]" and part:
            out = [o + x for o in out for x in ("", part[1:-1])][:most]
        else:
            out = [o + part for o in out]
    return sorted({re.sub(r"\s+", " ", o).strip() for o in out} - {""})


def parse_text_query(text: str) -> list[list[str]]:
    """Terms to be found together: words or "phrases", each as its variants, folded."""
    from discera.functions.text import fold_value

    terms = [a or b for a, b in re.findall(r'"([^"]+)"|(\S+)', text)]
    return [v for t in terms if (v := variants(fold_value(t)))]


def text_query(column: Column, text: str, literal: bool = False) -> Column:
    """Whether folded text holds, for each term, one of its variants. White space counts as one space, unless literal: then it and accents that are characters of their own stay as they are in the text."""
    folded = fold_letters(column) if literal else F.regexp_replace(fold(column), r"\s+", " ")
    return reduce(lambda a, b: a & b, (reduce(lambda x, y: x | y, (F.contains(folded, F.lit(v)) for v in term)) for term in parse_text_query(text)), F.lit(True))


def overlay(base: DataFrame, patch: DataFrame, key: list[str]) -> DataFrame:
    """Corrections over base rows: a value of the patch wins where it is not null."""
    cols = [c for c in patch.columns if c not in key]
    p = patch.select(*key, *(F.col(c).alias(f"__{c}") for c in cols))
    out = base.join(p, key, "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns))


def rename_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Columns by label; a label in use gets a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = labels.get(c, c)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return df.toDF(*names)
