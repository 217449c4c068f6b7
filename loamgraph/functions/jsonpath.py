"""Paths into JSON values: names, indexes, slices, unions, wildcards and descent; no script filters."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column

from loamgraph.runtime import arrow_udf

_STEP = re.compile(r"\.\.(?=[\w*@\[])|\.(?P<dot>[\w@:-]+|\*)|(?P<name>[\w@:-]+|\*)|\[(?P<inside>(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^\]'\"])*)\]")


def parse(path: str) -> list:
    """Steps of a path; raises for anything that is not one (script expressions included)."""
    if not path.startswith("$"):
        raise ValueError(f"a path begins with $: {path!r}")
    steps, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or not m.end() > at:
            raise ValueError(f"no path at {path[at:]!r}")
        if m.group() == "..":
            steps.append(("descend", None))
        elif m["inside"] is not None:
            steps.append(("pick", [_selector(x) for x in _split(m["inside"])]))
        else:
            name = m["dot"] or m["name"]
            steps.append(("pick", [("all", None) if name == "*" else ("key", name)]))
        at = m.end()
    return steps


def _split(text: str) -> list[str]:
    return [x.strip() for x in re.findall(r"\s*(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,])+", text)]


def _selector(text: str):
    if text == "*":
        return ("all", None)
    if text[:1] in "'\"":
        return ("key", re.sub(r"\\(.)", r"\1", text[1:-1]))
    if re.fullmatch(r"-?\d+", text):
        return ("index", int(text))
    if re.fullmatch(r"(-?\d+)?:(-?\d+)?(:-?\d+)?", text):
        return ("slice", slice(*[int(x) if x else None for x in text.split(":")]))
    raise ValueError(f"unsupported selector {text!r}")


def find_all(value, path: str) -> list:
    """The values at a path, in document order."""
    found = [value]
    for kind, arg in parse(path):
        found = [y for v in found for y in _descend(v)] if kind == "descend" else [y for v in found for s in arg for y in _pick(v, *s)]
    return found


def _descend(v):
    yield v
    for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
        yield from _descend(x)


def _pick(v, kind: str, arg):
    if kind == "all":
        yield from v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    elif kind == "key" and isinstance(v, dict) and arg in v:
        yield v[arg]
    elif kind == "index" and isinstance(v, list) and -len(v) <= arg < len(v):
        yield v[arg]
    elif kind == "slice" and isinstance(v, list):
        yield from v[arg]


def path_values(doc: Column, path: str) -> Column:
    """array<string> of JSON texts at a path of a JSON text column; text that is not JSON has none."""
    parse(path)

    def at(text):
        try:
            return [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in find_all(json.loads(text), path)]
        except (ValueError, TypeError):
            return []

    return arrow_udf(at, "array<string>")(doc)
