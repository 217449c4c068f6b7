"""Written forms of linked-data ids reduced to one QName, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A context is a driver-side document; more prefixes than this are refused.
MAX_PREFIXES = 10_000

_OUTER_BLANKS = r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$"

#: Most ids are written plainly; these need none of the steps below.
_PLAIN = r"^[A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+$"


def strip_blanks(c: Column) -> Column:
    """Without outer white space of any script (no-break space included)."""
    return F.regexp_replace(c, _OUTER_BLANKS, "")


def read_context(context: DataFrame) -> list[tuple[str, str]]:
    """(prefix, iri) pairs, longest IRI first; null or empty parts name nothing."""
    rows = context.select("prefix", "iri").where("length(prefix) > 0 and length(iri) > 0").distinct().limit(MAX_PREFIXES + 1).collect()
    if len(rows) > MAX_PREFIXES:
        raise ValueError(f"the context has more than {MAX_PREFIXES} prefixes")
    return sorted(((r[0], r[1]) for r in rows), key=lambda p: (-len(p[1]), p))


def qname(c: Column, context: list[tuple[str, str]]) -> Column:
    """The id that a written reference stands for.

    Outer blanks go, a one-element array and an ``{"@id": ...}`` object stand for
    the id inside, and an IRI of the context reduces to ``prefix:local`` by the
    longest IRI that begins it. Null stays null, blank text becomes ''. Anything
    else is kept as written (ids are case-sensitive).
    """
    out = let(strip_blanks(c), _unwrap_array)
    out = let(out, _unwrap_object)
    if context:
        out = let(out, lambda s: F.when(s.contains("://"), _reduce(s, context)).otherwise(s))
    return F.when(c.rlike(_PLAIN), c).otherwise(out)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unwrap_array(s: Column) -> Column:
    inner = let(F.from_json(s, "array<string>"), lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))
    return F.when(s.startswith("["), F.coalesce(strip_blanks(inner), s)).otherwise(s)


def _unwrap_object(s: Column) -> Column:
    return F.when(s.startswith("{"), F.coalesce(strip_blanks(F.get_json_object(s, "$['@id']")), s)).otherwise(s)


def _reduce(s: Column, context: list[tuple[str, str]]) -> Column:
    out = s
    for prefix, iri in reversed(context):
        out = F.when(s.startswith(iri), F.concat(F.lit(f"{prefix}:"), F.substring(s, len(iri) + 1, 2_000_000_000))).otherwise(out)
    return out


def split_qname(c: Column) -> tuple[Column, Column]:
    """(prefix, local) of a QName; the prefix is null where the id has none, either where it is empty."""
    at = F.instr(c, ":")
    prefix = F.when(at > 1, F.substring_index(c, ":", 1))
    local = F.when(at > 1, F.substr(c, at + 1)).otherwise(c)
    return prefix, F.nullif(local, F.lit(""))
