"""Metadata conditions as two-valued Column predicates.

Every leaf is true or false, never null, so negation is safe. Over typed columns a missing key is a null; over VARIANT
metadata equality compares type and value, and ranges take numbers only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Getter = Callable[[str], Column]


@dataclass(frozen=True)
class Condition:
    """op: eq ne in not_in gt gte lt lte contains, and or not."""

    op: str
    key: str = ""
    value: object = None
    parts: tuple["Condition", ...] = ()


def eq(key, value):
    return Condition("eq", key, value)


def ne(key, value):
    return Condition("ne", key, value)


def is_in(key, values):
    return Condition("in", key, tuple(values))


def not_in(key, values):
    return Condition("not_in", key, tuple(values))


def gt(key, value):
    return Condition("gt", key, float(value))


def gte(key, value):
    return Condition("gte", key, float(value))


def lt(key, value):
    return Condition("lt", key, float(value))


def lte(key, value):
    return Condition("lte", key, float(value))


def contains(key, value):
    return Condition("contains", key, value)


def all_of(*parts):
    return Condition("and", parts=tuple(parts))


def any_of(*parts):
    return Condition("or", parts=tuple(parts))


def negate(part):
    return Condition("not", parts=(part,))


class Typed:
    """Reads keys from real columns; ``numeric`` and ``text`` name those that ranges and contains apply to."""

    def __init__(self, numeric: Iterable[str] = (), text: Iterable[str] = ()):
        self.numeric, self.text = set(numeric), set(text)

    def equals(self, key: str, value: object) -> Column:
        fits = (key in self.text) == isinstance(value, str)
        return F.coalesce(F.col(key).eqNullSafe(F.lit(value)), F.lit(False)) if fits and value is not None else F.lit(False)

    def number(self, key: str) -> Column:
        return F.col(key).cast("double") if key in self.numeric else F.lit(None).cast("double")

    def string(self, key: str) -> Column:
        return F.col(key) if key in self.text else F.lit(None).cast("string")


class Variant:
    """Reads keys from one VARIANT column that holds an object."""

    def __init__(self, column: str):
        self.column = column

    def _at(self, key: str) -> Column:
        """The key's value; a key that both kinds of quotes stand in can't be named in a path and is missing."""
        if "'" in key and '"' in key:
            return F.lit(None).cast("variant")
        quote = '"' if "'" in key else "'"
        return F.try_variant_get(F.col(self.column), f"$[{quote}{key}{quote}]", "variant")

    def _kind(self, key: str) -> Column:
        return F.schema_of_variant(self._at(key))

    def equals(self, key: str, value: object) -> Column:
        kind = self._kind(key)
        if isinstance(value, bool):
            same = (kind == "BOOLEAN") & (F.try_variant_get(self._at(key), "$", "boolean") == F.lit(value))
        elif isinstance(value, int):
            same = (kind == "BIGINT") & (F.try_variant_get(self._at(key), "$", "bigint") == F.lit(value))
        elif isinstance(value, float):
            same = (kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (F.try_variant_get(self._at(key), "$", "double") == F.lit(value))
        else:
            same = (kind == "STRING") & (F.try_variant_get(self._at(key), "$", "string") == F.lit(value))
        return F.coalesce(same, F.lit(False))

    def number(self, key: str) -> Column:
        kind = self._kind(key)
        numeric = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
        return F.when(numeric, F.try_variant_get(self._at(key), "$", "double"))

    def string(self, key: str) -> Column:
        return F.when(self._kind(key) == "STRING", F.try_variant_get(self._at(key), "$", "string"))


def compile(condition: Condition, metadata: Typed | Variant) -> Column:
    """The predicate of a condition; empty ``and`` is true, empty ``or`` is false."""
    op, key, value = condition.op, condition.key, condition.value
    if op in ("and", "or", "not"):
        parts = [compile(p, metadata) for p in condition.parts]
        if op == "not":
            return ~parts[0]
        found = F.lit(op == "and")
        for part in parts:
            found = found & part if op == "and" else found | part
        return found
    if op in ("eq", "ne"):
        same = metadata.equals(key, value)
        return same if op == "eq" else ~same
    if op in ("in", "not_in"):
        found = F.lit(False)
        for v in value:
            found = found | metadata.equals(key, v)
        return found if op == "in" else ~found
    if op == "contains":
        return F.coalesce(metadata.string(key).contains(value), F.lit(False))
    x, y = metadata.number(key), F.lit(float(value))
    return F.coalesce({"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[op], F.lit(False))


def literal(text: str) -> int | float | bool | str:
    """A command-line value: whole number, number, true or false, else text."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text, text)


def from_flags(flags: Iterable[str]) -> Condition:
    """``key=value`` flags, joined by and."""
    pairs = []
    for flag in flags:
        key, sep, value = flag.partition("=")
        if not sep or not key:
            raise ValueError(f"expected key=value, got {flag!r}")
        pairs.append(eq(key, literal(value)))
    return all_of(*pairs)


def require(arguments: dict, names: Iterable[str]) -> None:
    """Raises if an argument is missing; types are not looked at."""
    missing = [n for n in names if n not in arguments]
    if missing:
        raise ValueError(f"missing arguments: {', '.join(missing)}")
