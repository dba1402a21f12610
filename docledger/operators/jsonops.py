"""Searching and filtering JSON records."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_key(col: Column, key: str) -> Column:
    """Top-level value of a key, as text; JVM-side."""
    return F.get_json_object(col, f"$.{key}")


def json_try_parse(col: Column, default: str | None = None) -> Column:
    """Variant of a JSON text; malformed text gives the default."""
    parsed = F.try_parse_json(col)
    return parsed if default is None else F.coalesce(parsed, F.parse_json(F.lit(default)))


def _walk(node: object, key: str) -> Iterator[str]:
    if isinstance(node, dict):
        for k, v in node.items():
            if k == key:
                yield v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
            yield from _walk(v, key)
    elif isinstance(node, list):
        for v in node:
            yield from _walk(v, key)


def json_find_key(col: Column, key: str) -> Column:
    """All values of a key at any depth, in document order, as an array of texts.

    Unbounded recursion has no built-in expression; one Arrow batch UDF walks the parsed text.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: list(_walk(_loads(v), key)))

    return find(col)


def _loads(text: object) -> object:
    try:
        return json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return None


def _prune(node: object, include: set[str] | None, exclude: set[str], equals: dict[str, object]) -> object:
    if isinstance(node, list):
        kept = [_prune(v, include, exclude, equals) for v in node]
        return [v for v in kept if v is not None]
    if not isinstance(node, dict):
        return node
    if any(k in node and node[k] != want for k, want in equals.items()):
        return None
    out = {}
    for k, v in node.items():
        if k in exclude or (include is not None and k not in include and not isinstance(v, (dict, list))):
            continue
        pruned = _prune(v, include, exclude, equals)
        if pruned is not None or v is None:
            out[k] = pruned
    return out


def json_filter(
    col: Column,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    equals: dict[str, object] | None = None,
) -> Column:
    """JSON text with keys kept or dropped and objects that contradict ``equals`` removed, at every depth.

    For known schemas prefer ``struct`` / ``dropFields``; this form takes open JSON through an Arrow batch UDF.
    """
    inc = None if include is None else set(include)
    exc, eq = set(exclude), dict(equals or {})

    @F.pandas_udf(T.StringType())
    def prune(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(v: object) -> str | None:
            node = _loads(v)
            kept = None if node is None else _prune(node, inc, exc, eq)
            return None if kept is None else json.dumps(kept, ensure_ascii=False)

        for s in batches:
            yield s.map(one)

    return prune(col)
