"""Three-valued predicates as JSON values, and their translation to Spark columns.

A predicate is an object with one operator: {"eq": [column, value]}, {"in": [column, values]}, lt, le, gt, ge, ne and
their *_abs forms, {"range": [column, low, high, low_inclusive, high_inclusive]}, {"contains": [list, value]},
{"any": [list, predicate]}, {"all": [list, predicate]}, {"nonempty": column}, {"is_null": column},
{"censored": [time, event, op, value]}, {"text": [column, text, mode]}, {"not": p}, {"and": [...]}, {"or": [...]}.
{"param": name} stands for a value until `bind`. A path crosses lists as "items[].price"; a comparison over such a
path asks for some item.

Null and NaN are unknown and never pass; a comparison across families of types is unknown, not an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "ne": "!="}


class PredicateError(ValueError):
    """A predicate that names no known operator, or a parameter that nothing binds."""


def bind(p: Any, values: dict[str, Any]) -> Any:
    """`p` with every {"param": name} replaced; a list bound within a list is spliced into it."""
    if isinstance(p, dict):
        if set(p) == {"param"}:
            if p["param"] not in values:
                raise PredicateError(f"unbound parameter {p['param']}")
            return values[p["param"]]
        return {k: bind(v, values) for k, v in p.items()}
    if isinstance(p, list):
        out = []
        for v in p:
            bound = bind(v, values)
            if isinstance(v, dict) and "param" in v and isinstance(bound, list):
                out += bound
            else:
                out.append(bound)
        return out
    return p


def merged(preds: list[dict]) -> list[dict]:
    """Conjuncts on one list become one `any`, so that they hold of the same item."""
    own: dict[str, list[dict]] = {}
    out: list[dict] = []
    for p in preds:
        (name, args), = p.items()
        path = args[0] if isinstance(args, list) and args and isinstance(args[0], str) else args if isinstance(args, str) else ""
        if name == "any":
            own.setdefault(args[0], []).append(args[1])
        elif name not in ("and", "or", "not", "all") and "[]." in path:
            head, rest = path.split("[].", 1)
            own.setdefault(head, []).append({name: [rest, *args[1:]] if isinstance(args, list) else rest})
        else:
            out.append(p)
    return out + [{"any": [head, ps[0] if len(ps) == 1 else {"and": merged(ps)}]} for head, ps in own.items()]


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "other"


def _literal_family(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "time" if hasattr(v, "year") else "other"


def _bad(v: Any) -> bool:
    return v is None or isinstance(v, float) and math.isnan(v)


class Scope:
    """Where names are looked up: a frame, or an item of a list."""

    def __init__(self, kind: T.DataType, get: Callable[[str], Column]):
        self.kind, self.get = kind, get

    def find(self, path: str) -> tuple[Column, T.DataType]:
        if path == "[]":
            return self.get(""), self.kind
        column, kind = None, self.kind
        for part in path.split("."):
            column = self.get(part) if column is None else column[part]
            kind = kind[part].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            column = F.when(F.isnan(column), None).otherwise(column)
        return column, kind


def _null() -> Column:
    return F.lit(None).cast("boolean")


def _compared(op: str, column: Column, kind: T.DataType, value: Any) -> Column:
    family = _family(kind)
    if _bad(value) or not (family == _literal_family(value) or family == "time" and isinstance(value, str)):
        return _null()
    if family == "number" and isinstance(kind, T.IntegralType):
        literal = F.lit(value) if isinstance(value, int) else F.lit(float(value))
    elif family in ("number", "time"):
        literal = F.lit(value).cast(kind)  # rounded to how the column is stored
    else:
        literal = F.lit(value)
    return {"eq": lambda: column == literal, "<": lambda: column < literal, "<=": lambda: column <= literal, ">": lambda: column > literal, ">=": lambda: column >= literal, "!=": lambda: column != literal}[op]()


def _some(scope: Scope, path: str, test: Callable[[Column, T.DataType], Column]) -> Column:
    """`test` of the value at the path; of some value where the path crosses lists or ends in one."""
    if "[]." in path:
        head, rest = path.split("[].", 1)
        column, kind = scope.find(head)
        return F.exists(column, lambda x: F.when(x.isNull(), None).otherwise(_some(Scope(kind.elementType, lambda n, x=x: x[n]), rest, test)))
    column, kind = scope.find(path)
    if isinstance(kind, T.ArrayType) and path != "[]":
        return F.exists(column, lambda x: test(x, kind.elementType))
    return test(column, kind)


def _text(column: Column, kind: T.DataType, text: str, mode: str) -> Column:
    value = column if isinstance(kind, T.StringType) else column.cast("string")
    folded = text.lower()
    if mode == "exact":
        return value == text
    if mode == "casefold":
        return F.lower(value) == folded
    if mode == "substring":
        return value.contains(text)
    if mode == "casefold_substring":
        return F.lower(value).contains(folded)
    if mode == "word":
        return F.lower(value).rlike(r"(?U)(?<!\w)" + re.escape(folded) + r"(?!\w)")
    raise PredicateError(f"text mode {mode}")


def compiled(p: dict, scope: Scope) -> Column:
    (name, a), = p.items()
    if name == "eq":
        return _some(scope, a[0], lambda c, k: _compared("eq", c, k, a[1]))
    if name == "in":
        tests = [compiled({"eq": [a[0], v]}, scope) for v in a[1] if not _bad(v)]
        tests += [_null()] * any(map(_bad, a[1]))
        return _fold(tests, lambda x, y: x | y) if tests else F.when(scope.find(a[0])[0].isNotNull(), False)
    if name in ORDER:
        return _some(scope, a[0], lambda c, k: _compared(ORDER[name], c, k, a[1]))
    if name.endswith("_abs"):
        return _some(scope, a[0], lambda c, k: _compared(ORDER[name[:-4]], F.abs(c), k, a[1]) if _family(k) == "number" else _null())
    if name == "range":
        low, high, low_in, high_in = [*a[1:], *[None, None, True, True][len(a) - 1 :]]
        tests = [_some(scope, a[0], lambda c, k: F.when(c.isNotNull(), True))]
        tests += [compiled({"ge" if low_in else "gt": [a[0], low]}, scope)] * (low is not None)
        tests += [compiled({"le" if high_in else "lt": [a[0], high]}, scope)] * (high is not None)
        return _fold(tests, lambda x, y: x & y)
    if name == "contains":
        column, kind = scope.find(a[0])
        return F.exists(column, lambda x: _compared("eq", x, kind.elementType, a[1]))
    if name in ("any", "all"):
        column, kind = scope.find(a[0])
        if len(a) > 2 and a[2]:  # null items are skipped
            column = F.filter(column, lambda x: x.isNotNull())
        over = F.exists if name == "any" else F.forall
        return over(column, lambda x: F.when(x.isNull(), None).otherwise(compiled(a[1], Scope(kind.elementType, lambda n, x=x: x[n] if n else x))))
    if name == "nonempty":
        column, kind = scope.find(a)
        size = F.size(column) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(column) if isinstance(kind, T.StringType) else F.lit(1)
        return F.when(column.isNull(), None).otherwise(size > 0)
    if name == "is_null":
        if "[]." in a:
            head, rest = a.split("[].", 1)
            column, kind = scope.find(head)
            return F.coalesce(F.forall(column, lambda x: F.coalesce(compiled({"is_null": rest}, Scope(kind.elementType, lambda n, x=x: x[n])), F.lit(True))), F.lit(True))
        return scope.find(a)[0].isNull()
    if name == "censored":
        (time, _), (event, _), op, at = scope.find(a[0]), scope.find(a[1]), a[2], a[3]
        happened = event.cast("boolean")
        if op in ("le", "lt"):
            inside = time <= at if op == "le" else time < at
            return F.when(inside & happened, True).when(~inside, False)
        beyond = time > at if op == "gt" else time >= at
        return F.when(beyond, True).when(~beyond & happened, False)
    if name == "text":
        return _some(scope, a[0], lambda c, k: _text(c, k, a[1], a[2]))
    if name == "not":
        return ~compiled(a, scope)
    if name in ("and", "or"):
        return _fold([compiled(x, scope) for x in a], (lambda x, y: x & y) if name == "and" else (lambda x, y: x | y)) if a else F.lit(name == "and")
    raise PredicateError(f"operator {name}")


def _fold(columns: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = join(out, c)
    return out


def where(df: DataFrame, *preds: dict) -> Column:
    """The conjunction of predicates over `df`; conjuncts on one list hold of the same item."""
    scope = Scope(df.schema, lambda n: F.col(f"`{n}`"))
    return _fold([compiled(p, scope) for p in merged(list(preds))] or [F.lit(True)], lambda x, y: x & y)


def columns_of(p: dict) -> set[str]:
    """The top-level columns a predicate reads."""
    (name, a), = p.items()
    if name in ("and", "or"):
        return set().union(*map(columns_of, a))
    if name == "not":
        return columns_of(a)
    if name == "censored":
        return {a[0], a[1]}
    return {re.split(r"[.\[]", a[0] if isinstance(a, list) else a)[0]}


def unknown_counts(df: DataFrame, *preds: dict) -> DataFrame:
    """One row: rows that pass, and rows whose truth is unknown, in all and for each column to blame.

    A row counts as unknown only if no conjunct is false; where some columns of an unknown conjunct are null, only
    those are to blame.
    """
    scope = Scope(df.schema, lambda n: F.col(f"`{n}`"))
    parts = [(compiled(p, scope), columns_of(p)) for p in merged(list(preds))]
    truth = _fold([c for c, _ in parts] or [F.lit(True)], lambda x, y: x & y)
    blamed: dict[str, Column] = {}
    for c, names in parts:
        nulls = {n: F.col(f"`{n}`").isNull() for n in names}
        none = ~_fold(list(nulls.values()), lambda x, y: x | y)
        for n in sorted(names):
            blame = c.isNull() & (nulls[n] | none)
            blamed[n] = blamed[n] | blame if n in blamed else blame
    return df.agg(F.count_if(truth).alias("total"), F.count_if(truth.isNull()).alias("excluded_unknown"), *(F.count_if(truth.isNull() & b).alias(f"unknown_{n}") for n, b in blamed.items()))


def truth(p: dict, row: Any) -> bool | None:
    """The same semantics on one row of Python values, for tests."""
    (name, a), = p.items()
    if name == "not":
        t = truth(a, row)
        return None if t is None else not t
    if name in ("and", "or"):
        found = [truth(x, row) for x in a]
        stop = name == "or"
        return stop if stop in found else None if None in found else not stop
    if name in ("any", "all"):
        items = row.get(a[0])
        if items is None:
            return None
        found = [None if x is None else truth(a[1], x) for x in items]
        stop = name == "any"
        return stop if stop in found else None if None in found else not stop
    value = row.get(a[0] if isinstance(a, list) else a)
    if name == "is_null":
        return _bad(value)
    if name == "nonempty":
        return None if value is None else len(value) > 0
    if name == "contains":
        return None if value is None else True if a[1] in [x for x in value if x is not None] else None if None in value else False
    if name == "in":
        found = [truth({"eq": [a[0], v]}, row) for v in a[1]]
        return True if True in found else None if None in found or _bad(value) else False
    if name == "range":
        if _bad(value):
            return None
        low, high, low_in, high_in = [*a[1:], *[None, None, True, True][len(a) - 1 :]]
        return (low is None or (value >= low if low_in else value > low)) and (high is None or (value <= high if high_in else value < high))
    if _bad(value) or name in ("eq", *ORDER) and (_bad(a[1]) or _literal_family(value) != _literal_family(a[1])):
        return None
    if name == "text":
        text, mode = a[1], a[2]
        value = str(value)
        return {"exact": value == text, "casefold": value.lower() == text.lower(), "substring": text in value, "casefold_substring": text.lower() in value.lower(), "word": bool(re.search(r"(?<!\w)" + re.escape(text.lower()) + r"(?!\w)", value.lower()))}[mode]
    if name.endswith("_abs"):
        name, value = name[:-4], abs(value)
    return {"eq": value == a[1], "ne": value != a[1], "lt": value < a[1], "le": value <= a[1], "gt": value > a[1], "ge": value >= a[1]}[name]
