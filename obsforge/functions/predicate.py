"""IR predicates as columns: typed literals, and absence that satisfies neither a test nor its negation."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidInput
from .timeutil import duration_ns, instant_ns

OPS = {"eq", "ne", "gt", "gte", "lt", "lte", "in", "between", "contains", "regex", "exists"}
MAX_REGEX = 1 << 20


def literal(value, kind: str, now_ns: int = 0):
    """A literal coerced to a field's type, or refused; never cast later."""
    try:
        if kind == "string":
            if isinstance(value, str):
                return value
            if isinstance(value, bool):
                return str(value).lower()
            if isinstance(value, (int, float)):
                return str(value)
        elif kind == "int64":
            if isinstance(value, bool) or isinstance(value, float):
                raise ValueError
            return int(value)
        elif kind == "float64":
            if isinstance(value, bool):
                raise ValueError
            return float(value)
        elif kind == "bool":
            if isinstance(value, bool):
                return value
            if value in ("true", "false"):
                return value == "true"
        elif kind == "duration_ns" and not isinstance(value, (bool, float)):
            return duration_ns(value)
        elif kind == "timestamp_ns" and not isinstance(value, (bool, float)):
            return instant_ns(value, now_ns)
        elif kind == "bytes" and isinstance(value, str):
            return base64.b64decode(value, validate=True)
    except (ValueError, TypeError):
        pass
    raise InvalidInput(f"{value!r} is not a {kind}")


def check_regex(pattern: str) -> str:
    """The syntax that regex engines share: no look-around, no references back, bounded length."""
    if len(pattern) > MAX_REGEX:
        raise InvalidInput("pattern is too long")
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise InvalidInput(f"look-around and references back are not supported: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise InvalidInput(f"not a pattern: {pattern!r}: {e}") from None
    return pattern


def lower(node: dict, resolve: Callable[[str], tuple[Column, str]], now_ns: int = 0) -> Column:
    """A predicate tree as a Column; SQL's three values are the truth values of the tree."""
    if not isinstance(node, dict):
        raise InvalidInput(f"not a predicate: {node!r}")
    if "and" in node or "or" in node:
        key = "and" if "and" in node else "or"
        out = F.lit(key == "and")
        for child in node[key]:
            c = lower(child, resolve, now_ns)
            out = out & c if key == "and" else out | c
        return out
    if "not" in node:
        return ~lower(node["not"], resolve, now_ns)
    unknown = set(node) - {"field", "op", "value"}
    op = node.get("op")
    if unknown or "field" not in node or op not in OPS:
        raise InvalidInput(f"not a predicate: {node!r}")
    column, kind = resolve(node["field"])
    if op == "exists":
        return column.isNotNull()
    value = node.get("value")
    if op == "contains":
        return column.cast("string").contains(str(value))
    if op == "regex":
        return column.cast("string").rlike(check_regex(str(value)))
    # A number against an attribute compares numbers; text compares in order of its characters.
    if kind == "string" and isinstance(value, (int, float)) and not isinstance(value, bool):
        column, kind = column.try_cast("double"), "float64"
    if op in ("in", "between"):
        if not isinstance(value, list) or op == "between" and len(value) != 2:
            raise InvalidInput(f"{op} needs a list")
        if kind == "string" and value and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value):
            column, kind = column.try_cast("double"), "float64"
        values = [literal(v, kind, now_ns) for v in value]
        return column.between(*values) if op == "between" else column.isin(*values)
    want = F.lit(literal(value, kind, now_ns))
    return {"eq": column == want, "ne": column != want, "gt": column > want, "gte": column >= want, "lt": column < want, "lte": column <= want}[op]
