"""Deeply nested records as flat rows that know their parent.

One operator serves JSON text and typed columns (serialised on the JVM side first). Child lists may
be arrays, single objects, objects keyed by id, JSON encoded once more in a string, or a string of
separated values, directly in their parent or below wrapper objects.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import structure

#: Bytes of text that are indexed at once; a longer single text is indexed alone.
_CHUNK = 8_000_000


@dataclass(frozen=True)
class Child:
    """A kind of child record: its name, the key of its list, its parent's kind, and its form.

    ``scalars``: the list holds plain values, which one string may hold separated by , ; or |.
    """

    name: str
    key: str
    parent: str | None = None
    scalars: bool = False


def _elements(ix: structure.Index, slot: int, child: Child) -> tuple[list[tuple[int, int, int]], str | None]:
    """(container or -1, start, end) of each element, and a decoded string that holds more JSON."""
    held = int(ix.holds[slot])
    start, end = int(ix.start[slot]), int(ix.end[slot])
    if held >= 0:
        slots = range(int(ix.first[held]), int(ix.first[held]) + int(ix.count[held])) if ix.count[held] else range(0)
        if ix.data[ix.open[held]] == 91 or (slots and not child.scalars and all(ix.holds[s] >= 0 and ix.data[ix.open[ix.holds[s]]] == 123 for s in slots)):
            return [(int(ix.holds[s]), int(ix.start[s]), int(ix.end[s])) for s in slots], None
        return ([(held, start, end)] if slots else []), None
    text = ix.text(start, end).strip()
    if not text.startswith('"'):
        return [], None
    try:
        return [], json.loads(text)
    except ValueError:
        return [], None


def _walk(ix: structure.Index, spec: list[Child], within: dict[int, tuple[str, int]], roots: bool, raw: bool) -> list[tuple]:
    """(text, child, parent_pos, pos, raw) of all child records of an index.

    ``within`` has the (kind, position) of containers that are records; it is filled as kinds are
    found, parents first. ``roots``: kinds without a parent are looked for as well.
    """
    out = []
    placed: dict[tuple, int] = {}
    for child in spec:
        if child.parent is None and not roots:
            continue
        for slot in structure.slots_named(ix, structure.spellings(child.key)).tolist():
            c = int(ix.slot_of[slot])
            body = int(ix.body[c])
            while c >= 0 and c not in within:
                c = int(ix.parent[c])
            kind, parent_pos = within[c] if c >= 0 else (None, 0)
            if kind != child.parent:
                continue
            elements, text = _elements(ix, slot, child)
            pos = placed.get((body, child.name, parent_pos), 0)
            if text is not None and child.scalars:
                try:
                    inner = json.loads(text)
                except ValueError:
                    inner = None
                values = inner if isinstance(inner, list) else re.split(r"[,;|]", text)
                for v in values:
                    if v is not None and str(v).strip():
                        pos += 1
                        out.append((body, child.name, parent_pos, pos, str(v).strip() if raw else None))
            elif text is not None:
                sub = structure.build([b'{"' + child.key.encode() + b'":' + text.encode() + b"}"])
                if sub.valid[0]:
                    found = _walk(sub, [Child(child.name, child.key), *[x for x in spec if x.parent == child.name]], {}, True, raw)
                    shift = {True: pos, False: 0}
                    for _, name, p, q, r in found:
                        own = name == child.name
                        out.append((body, name, parent_pos if own else p + pos, q + shift[own], r))
                        if own:
                            placed[(body, child.name, parent_pos)] = q + pos
                continue
            else:
                for held, start, end in elements:
                    pos += 1
                    if child.scalars:
                        value = ix.text(start, end).strip()
                        if value in ("", "null"):
                            continue
                        if value.startswith('"'):
                            try:
                                value = json.loads(value)
                            except ValueError:
                                continue
                        out.append((body, child.name, parent_pos, pos, value if raw else None))
                    elif held >= 0 and ix.data[ix.open[held]] == 123:
                        within[held] = (child.name, pos)
                        out.append((body, child.name, parent_pos, pos, ix.text(start, end).strip() if raw else None))
            placed[(body, child.name, parent_pos)] = pos
    return out


def plain_key(name: str) -> str:
    """A key without regard to case and the marks between its words."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def fields(raw: Column, names: list[str]) -> list[Column]:
    """The values of a record's own text, by field: text, nested values as JSON; null if absent or null.

    Keys count however their words are joined; of several spellings of one key the last counts.
    """
    entries = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "").alias("key"), e["value"].alias("value")))
    of = lambda n: F.get(F.filter(entries, lambda e: e["key"] == plain_key(n)), F.size(F.filter(entries, lambda e: e["key"] == plain_key(n))) - 1)["value"]
    return [of(n).alias(n) for n in names]


def shred(df: DataFrame, keys: list[str], body: str | Column, spec: list[Child], raw: bool = False) -> DataFrame:
    """``keys``, child, parent_pos, pos (and raw): one row for each child record of each text.

    pos counts from 1 in the parent in the order written; parent_pos is the parent's pos, 0 for
    kinds without a parent. Kinds come after their parents in ``spec``. Null elements keep their
    place but give no row. Null, empty, truncated or scalar texts give no rows, empty and null
    lists none. ``raw`` adds the record's own text. Extra columns of ``df`` are not carried; join
    by ``keys``.
    """
    col = F.col(body) if isinstance(body, str) else body
    source = df.select(*keys, col.alias("__body")).filter(F.col("__body").isNotNull())
    types = dict(source.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys]) + ", child string, parent_pos int, pos int" + (", raw string" if raw else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = [t.encode() for t in frame["__body"]]
            cuts, size = [0], 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > _CHUNK:
                    cuts.append(i + 1)
                    size = 0
            if cuts[-1] != len(texts):
                cuts.append(len(texts))
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows = _walk(structure.build(texts[a:b]), spec, {}, True, raw)
                if not rows:
                    continue
                of, child, parent_pos, pos, text = zip(*rows, strict=True)
                part = frame[keys].iloc[[a + i for i in of]].reset_index(drop=True)
                part["child"], part["parent_pos"], part["pos"] = child, parent_pos, pos
                if raw:
                    part["raw"] = text
                yield part

    return source.mapInPandas(run, schema)
