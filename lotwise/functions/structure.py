"""Structural index of many JSON texts at once, in whole-array operations.

Quote, bracket and delimiter bitmaps are taken over the concatenated bytes; strings are the spans
of odd quote parity, nesting depth is a prefix sum over the brackets outside of them, and the spans
of members and elements lie between the delimiters of one depth. No text is parsed value by value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_QUOTE, _BACKSLASH, _COMMA, _COLON = 34, 92, 44, 58
_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[[123, 91]] = 1  # { [
_CLASS[[125, 93]] = -1  # } ]
_CLASS[_COMMA], _CLASS[_COLON] = 2, 3
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 13]] = True


@dataclass
class Index:
    """Containers and the slots (members or elements) between their delimiters, in text order."""

    data: np.ndarray  # all bytes
    valid: np.ndarray  # by text: one whole object or array, and nothing else
    body: np.ndarray  # by container: the text it is in
    open: np.ndarray
    close: np.ndarray
    parent: np.ndarray  # the container around it, -1 at the root
    first: np.ndarray  # by container: its first slot, or -1 if it is empty
    count: np.ndarray  # by container: its slots
    slot_of: np.ndarray  # by slot: its container
    start: np.ndarray  # by slot: its value's span
    end: np.ndarray
    key_start: np.ndarray  # by slot: its key's span between the quotes, -1 in arrays
    key_end: np.ndarray
    holds: np.ndarray  # by slot: the container that is its value, or -1

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def build(texts: list[bytes]) -> Index:
    """The index of ``texts``. Truncated, unbalanced, empty and scalar texts are not valid."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    place = np.arange(len(data))

    plain = data != _BACKSLASH
    last_plain = np.maximum.accumulate(np.where(plain, place, -1))
    run = np.zeros(len(data), dtype=np.int64)
    run[1:] = (place[1:] - 1) - last_plain[:-1]
    quote = (data == _QUOTE) & (run % 2 == 0)
    quotes = np.cumsum(quote)
    before = np.where(starts > 0, quotes[np.maximum(starts - 1, 0)], 0)
    text_of = np.repeat(np.arange(len(texts)), lengths + 1)
    inside = (quotes - quote - before[text_of]) % 2 == 1
    whole = (quotes[ends] - before) % 2 == 0

    at = np.flatnonzero((_CLASS[data] != 0) & ~inside)
    kind = _CLASS[data[at]]
    of = text_of[at]
    step = np.where(np.abs(kind) == 1, kind, 0).astype(np.int64)
    depth = np.cumsum(step)
    if len(at):
        first_of = np.searchsorted(at, starts)
        base = np.where(first_of > 0, depth[np.maximum(first_of - 1, 0)], 0)
        depth = depth - base[of]
        last_of = np.searchsorted(at, ends) - 1
        some = last_of >= first_of
        final = np.where(some, depth[np.maximum(last_of, 0)], -1)
        lowest = np.full(len(texts), 0)
        np.minimum.at(lowest, of, depth)
        roots = np.bincount(of[(kind == 1) & (depth == 1)], minlength=len(texts))
        ink = np.flatnonzero(~_SPACE[data])
        i0 = np.searchsorted(ink, starts)
        i1 = np.searchsorted(ink, ends) - 1
        inked = i1 >= i0
        outer = np.zeros(len(texts), dtype=bool)
        w = np.flatnonzero(inked & some)
        outer[w] = (ink[i0[w]] == at[first_of[w]]) & (kind[first_of[w]] == 1) & (ink[i1[w]] == at[last_of[w]]) & (kind[last_of[w]] == -1)
        valid = whole & some & (final == 0) & (lowest >= 0) & (roots == 1) & outer
    else:
        valid = np.zeros(len(texts), dtype=bool)

    keep = valid[of] if len(at) else np.zeros(0, dtype=bool)
    at, kind, of, depth = at[keep], kind[keep], of[keep], depth[keep]
    opens, closes = np.flatnonzero(kind == 1), np.flatnonzero(kind == -1)
    # at one depth, openings and closings take turns
    o = opens[np.argsort(depth[opens], kind="stable")]
    c = closes[np.argsort(depth[closes] + 1, kind="stable")]
    wrong = data[at[c]].astype(int) - data[at[o]] != 2
    valid[of[o[wrong]]] = False
    close_of = np.empty(len(kind), dtype=np.int64)
    close_of[o] = c
    ok = valid[of[opens]]
    opens = opens[ok]
    number = np.full(len(kind) + 1, -1)
    number[opens] = np.arange(len(opens))
    open_at, close_at = at[opens], at[close_of[opens]] if len(opens) else at[:0]

    levels = depth[opens]
    parent = np.full(len(opens), -1)
    marks_owner, marks_at, marks_kind = [], [], []
    mark = np.flatnonzero((kind >= 2) & valid[of]) if len(of) else opens[:0]
    for level in range(1, int(levels.max(initial=0)) + 1):
        here = np.flatnonzero(levels == level)
        inner = np.flatnonzero(levels == level + 1)
        parent[inner] = here[np.searchsorted(open_at[here], open_at[inner]) - 1]
        m = mark[depth[mark] == level]
        marks_owner.append(here[np.searchsorted(open_at[here], at[m]) - 1])
        marks_at.append(at[m])
        marks_kind.append(kind[m])
    owner = np.concatenate([np.zeros(0, np.int64), *marks_owner])
    mark_at = np.concatenate([np.zeros(0, np.int64), *marks_at])
    mark_kind = np.concatenate([np.zeros(0, np.int64), *marks_kind])

    # a slot begins behind an opening that isn't followed by its closing, and behind each comma
    ink_at = np.flatnonzero(~_SPACE[data])
    following = ink_at[np.minimum(np.searchsorted(ink_at, open_at + 1), max(len(ink_at) - 1, 0))] if len(ink_at) else open_at
    filled = following != close_at
    comma = mark_kind == 2
    begin_owner = np.concatenate([np.flatnonzero(filled), owner[comma]]).astype(np.int64)
    begin_at = np.concatenate([open_at[filled], mark_at[comma]]).astype(np.int64) + 1
    order = np.lexsort((begin_at, begin_owner))
    slot_of, start = begin_owner[order], begin_at[order]
    end = np.empty(len(start), dtype=np.int64)
    if len(start):
        last = np.append(slot_of[1:] != slot_of[:-1], True)
        end[:-1] = start[1:] - 1
        end[last] = close_at[slot_of[last]]
    first = np.full(len(opens), -1)
    count = np.bincount(slot_of, minlength=len(opens))
    if len(start):
        head = np.append(True, slot_of[1:] != slot_of[:-1])
        first[slot_of[head]] = np.flatnonzero(head)

    key_start, key_end = np.full(len(start), -1), np.full(len(start), -1)
    colon_at, colon_owner = mark_at[mark_kind == 3], owner[mark_kind == 3]
    if len(colon_at):
        by = np.lexsort((start, slot_of))  # already so; slots are found by (container, place)
        span = len(data) + 1
        slot = np.searchsorted(slot_of[by] * span + start[by], colon_owner * span + colon_at, side="right") - 1
        q_at = np.flatnonzero(quote)
        k0 = q_at[np.minimum(np.searchsorted(q_at, start[slot]), max(len(q_at) - 1, 0))] if len(q_at) else colon_at
        k1 = q_at[np.maximum(np.searchsorted(q_at, colon_at) - 1, 0)] if len(q_at) else colon_at
        key_start[slot], key_end[slot] = k0 + 1, k1
        start[slot] = colon_at + 1
    # the container a slot holds is the first one inside it, if that is a child of the slot's own
    holds = np.full(len(start), -1)
    if len(start) and len(open_at):
        nxt = np.searchsorted(open_at, start)
        fits = nxt < len(open_at)
        cand = np.minimum(nxt, len(open_at) - 1)
        fits &= (open_at[cand] < end) & (parent[cand] == slot_of)
        holds[fits] = cand[fits]
    return Index(data, valid, of[opens], open_at, close_at, parent, first, count, slot_of, start, end, key_start, key_end, holds)


def spellings(name: str) -> set[bytes]:
    """The ways a snake-case key may be spelled."""
    words = name.split("_")
    pascal = "".join(w.title() for w in words)
    return {s.encode() for s in (name, pascal, pascal[:1].lower() + pascal[1:], name.upper(), "-".join(words), "".join(words), "".join(words).upper())}


def slots_named(index: Index, names: set[bytes]) -> np.ndarray:
    """The slots whose key is one of ``names``, found by comparing byte columns."""
    out = []
    width = index.key_end - index.key_start
    for name in names:
        some = np.flatnonzero((index.key_start >= 0) & (width == len(name)))
        for i, b in enumerate(name):
            some = some[index.data[index.key_start[some] + i] == b]
        out.append(some)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
