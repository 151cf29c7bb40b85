"""Deeply nested JSON to flat related tables through an adjacency table.

Each document is shredded into nodes (node, parent, label, ordinal, kind, scalar); the scalar children of object nodes are then
joined to them by node number and pivoted into entity rows. A document is wholly in one row, so numbers are dense within a batch
and the join is by array position, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OBJECT, ARRAY, SCALAR = 0, 1, 2
#: Documents whose nodes are held in memory together; it changes no result.
DOCUMENTS_AT_ONCE = 200


@dataclass(frozen=True)
class Entity:
    """An entity table of the documents.

    Its rows are the object nodes (scalar nodes, where ``scalar``) labelled one of ``labels`` (an array's items bear its label, the root
    an empty one; no labels: any), inside an entity of level ``within`` with only objects labelled as in ``wrap`` between (None: anywhere),
    and with a child labelled as one in ``need``, if that is given. ``key`` is the path of labels to the scalar that is the key.
    """

    level: str
    key: tuple[str, ...]
    labels: tuple[str, ...] = ()
    within: str | None = None
    wrap: tuple[str, ...] = ()
    scalar: bool = False
    need: tuple[str, ...] = ()


def parse_document(raw: str | None) -> tuple[bool, object]:
    """Whether the text parses as a whole, and the value; objects written one per line come as a list."""
    if raw is None or not raw.strip():
        return False, None
    try:
        return True, json.loads(raw)
    except (ValueError, RecursionError):
        pass
    lines = [line for line in raw.splitlines() if line.strip()]
    if len(lines) < 2:
        return False, None
    try:
        values = [json.loads(line) for line in lines]
    except (ValueError, RecursionError):
        return False, None
    return (True, values) if all(isinstance(v, dict) for v in values) else (False, None)


def as_text(value: object) -> str:
    """A scalar as text: empty for null, true/false for booleans, whole numbers without a fraction."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def adjacency(value: object, doc: int, table: dict[str, list], keep: frozenset[str] | None = None) -> None:
    """Appends the nodes of one document to ``table`` (doc, parent, label, ordinal, kind, scalar); a node's number is its position.

    The ordinal is the place in the own array, 0 elsewhere. With ``keep``, scalars under other labels are left out.
    """
    docs, parents, labels, ordinals, kinds, scalars = table["doc"], table["parent"], table["label"], table["ordinal"], table["kind"], table["scalar"]
    todo: list[tuple[object, int, str, int]] = [(value, -1, "", 0)]
    while todo:
        v, parent, label, ordinal = todo.pop()
        me = len(docs)
        kind = OBJECT if isinstance(v, dict) else ARRAY if isinstance(v, list) else SCALAR
        if kind == SCALAR and keep is not None and label not in keep:
            continue
        docs.append(doc)
        parents.append(parent)
        labels.append(label)
        ordinals.append(ordinal)
        kinds.append(kind)
        scalars.append(as_text(v) if kind == SCALAR else None)
        if kind == OBJECT:
            todo.extend((x, me, k, 0) for k, x in v.items())
        elif kind == ARRAY:
            todo.extend((x, me, label, i) for i, x in enumerate(v))


def empty_table() -> dict[str, list]:
    return {c: [] for c in ("doc", "parent", "label", "ordinal", "kind", "scalar")}


def adjacency_table(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key, node, parent, label, ordinal, kind (object, array or scalar), scalar: all nodes of every document that parses as a whole."""
    key_type = dict(df.dtypes)[key]

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, text in zip(pdf["k"], pdf["raw"], strict=True):
                ok, value = parse_document(text)
                if not ok:
                    continue
                table = empty_table()
                adjacency(value, 0, table)
                out = pd.DataFrame(table).drop(columns="doc")
                out["kind"] = np.array(["object", "array", "scalar"], dtype=object)[out["kind"].to_numpy()]
                out.insert(0, "k", k)
                out.insert(1, "node", np.arange(len(out)))
                yield out

    pairs = df.selectExpr(f"`{key}` as k", f"`{raw}` as raw")
    return pairs.mapInPandas(shred, f"k {key_type}, node int, parent int, label string, ordinal int, kind string, scalar string").withColumnRenamed("k", key)


def _entities(table: dict[str, list], entities: tuple[Entity, ...]) -> pd.DataFrame:
    """doc, level, parent_key, ordinal, item_key of every entity in a batch's adjacency table."""
    doc, parent = np.array(table["doc"], dtype=np.int64), np.array(table["parent"], dtype=np.int64)
    label, scalar = np.array(table["label"], dtype=object), np.array(table["scalar"], dtype=object)
    ordinal, kind = np.array(table["ordinal"], dtype=np.int64), np.array(table["kind"], dtype=np.int8)
    names, code = np.unique(label.astype(str), return_inverse=True)
    number = {n: i for i, n in enumerate(names)}

    def labelled(*wanted: str) -> np.ndarray:
        return np.isin(code, [number[w] for w in wanted if w in number])

    # the object around each node, arrays skipped
    around = parent.copy()
    for _ in range(len(parent)):
        inside = (around >= 0) & (kind[np.maximum(around, 0)] == ARRAY)
        if not inside.any():
            break
        around[inside] = parent[around[inside]]
    in_array = (parent >= 0) & (kind[np.maximum(parent, 0)] == ARRAY)

    def pivot(path: tuple[str, ...]) -> np.ndarray:
        """Per object node the scalar at ``path`` below it (None where it has none): the join of objects with their scalar children."""
        value = np.full(len(doc), None, dtype=object)
        children = np.flatnonzero((kind == SCALAR) & ~in_array & labelled(path[-1]) & (parent >= 0))
        at = parent[children]
        for step in reversed(path[:-1]):
            ok = (at >= 0) & (code[np.maximum(at, 0)] == number.get(step, -1)) & ~in_array[np.maximum(at, 0)]
            children, at = children[ok], parent[at[ok]]
        ok = at >= 0
        value[at[ok]] = scalar[children[ok]]
        return value

    level_of = np.full(len(doc), "", dtype=object)
    key_of = np.full(len(doc), None, dtype=object)
    parts = []
    for e in entities:
        # an item of an array, or a lone one that is not null
        nodes = ((kind == SCALAR) & (in_array | (scalar != ""))) if e.scalar else (kind == OBJECT)
        if e.labels:
            nodes &= labelled(*e.labels)
        if e.need:
            has = np.zeros(len(doc), dtype=bool)
            has[parent[np.flatnonzero(labelled(*e.need) & (parent >= 0) & ~in_array)]] = True
            nodes &= has
        top = around
        for step in e.wrap:
            ok = (top >= 0) & (code[np.maximum(top, 0)] == number.get(step, -1))
            top = np.where(ok, around[np.maximum(top, 0)], -1)
        if e.within is not None:
            nodes &= (top >= 0) & (level_of[np.maximum(top, 0)] == e.within)
        at = np.flatnonzero(nodes)
        found = scalar[at] if e.scalar else pivot(e.key)[at]
        keys = np.array([k or "" for k in found], dtype=object)
        level_of[at], key_of[at] = e.level, keys
        above = key_of[top[at]] if e.within is not None else np.full(len(at), "", dtype=object)
        # of a pair written as two objects the second is named away
        place = np.where(in_array[at], ordinal[at], np.where(labelled("away")[at], 1, 0))
        parts.append(pd.DataFrame({"doc": doc[at], "level": e.level, "parent_key": above, "ordinal": place, "item_key": keys}))
    return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("doc", "level", "parent_key", "ordinal", "item_key")})


def entity_rows(df: DataFrame, key: str, raw: str, entities: tuple[Entity, ...]) -> DataFrame:
    """key, level, parent_key, ordinal, item_key: the entities of each document that parses as a whole.

    Texts that are null, empty or broken give no rows, nor do objects outside the entities' places; unknown labels are passed
    over; a lone object where an array is usual has ordinal 0; a missing or null key is empty text. Repeated documents give
    repeated rows. An empty table gives no rows; other columns are not read.
    """
    key_type = dict(df.dtypes)[key]
    keep = frozenset(x for e in entities for x in (*e.key[-1:], *e.need, *(e.labels if e.scalar else ())))

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), DOCUMENTS_AT_ONCE):
                part = pdf.iloc[start : start + DOCUMENTS_AT_ONCE]
                table = empty_table()
                for i, text in enumerate(part["raw"]):
                    ok, value = parse_document(text)
                    if ok:
                        adjacency(value, i, table, keep)
                if table["doc"]:
                    out = _entities(table, entities)
                    out.insert(0, "k", part["k"].to_numpy()[out.pop("doc").to_numpy(dtype=np.int64)])
                    yield out

    pairs = df.selectExpr(f"`{key}` as k", f"`{raw}` as raw")
    return pairs.mapInPandas(shred, f"k {key_type}, level string, parent_key string, ordinal int, item_key string").withColumnRenamed("k", key)
