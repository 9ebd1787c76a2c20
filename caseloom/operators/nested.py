"""Nested JSON bodies as linked flat rows, by vectorised structural indexing.

Bodies are joined into one byte array a block. Bitmaps of quotes (without
escaped ones), brackets and delimiters, a prefix sum for what is inside a
string and one for the depth give every token's place; a stable sort of the
tokens by depth puts each container's members side by side, from which parent,
position and key of every value follow without a loop over characters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of bodies indexed at a time; one body larger than this makes a block of its own.
BLOCK_BYTES = 1 << 20
ROW_SCHEMA = "fetch_id bigint, item_pos bigint, child_pos bigint, name string, appointed_on string, officer_path string"

_NONE = -1


def _constant(_: str) -> float:
    raise ValueError("not JSON")


def readable(body: bytes) -> bool:
    """Whether the body is JSON (without the NaN and Infinity that some parsers let pass)."""
    try:
        json.loads(body, parse_constant=_constant)
    except (ValueError, RecursionError):
        return False
    return True


class StructuralIndex:
    """All values of a block of readable bodies.

    Arrays by value: start, end (bytes, end exclusive), kind (the first byte),
    doc, parent (the value's container, _NONE for a root), place (position in
    the container) and key_start, key_end (without quotes, 0 and 0 in lists).
    """

    def __init__(self, bodies: list[bytes]):
        self.data = data = np.frombuffer(b"\n".join([*bodies, b""]), np.uint8)
        ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
        at = np.arange(len(data))
        plain = data != 92
        last_plain = np.maximum.accumulate(np.where(plain, at, -1))
        before = np.concatenate(([-1], last_plain[:-1]))
        quote = (data == 34) & ((at - 1 - before) % 2 == 0)
        opened = np.cumsum(quote, dtype=np.int32)
        inside = (opened - quote) % 2 == 1
        free = ~inside & ~quote
        opens = free & ((data == 123) | (data == 91))
        closes = free & ((data == 125) | (data == 93))
        comma, colon = free & (data == 44), free & (data == 58)
        space = (data == 32) | (data == 10) | (data == 13) | (data == 9)
        scalar = free & ~(opens | closes | comma | colon | space)
        scalar_starts = scalar & ~np.concatenate(([False], scalar[:-1]))
        scalar_ends = scalar & ~np.concatenate((scalar[1:], [False]))
        depth = np.cumsum(opens.astype(np.int32) - closes.astype(np.int32), dtype=np.int32)

        quotes = np.flatnonzero(quote)
        str_start, str_end = quotes[0::2], quotes[1::2]
        # A string is a key if the next token after it is a colon.
        marks = np.flatnonzero(opens | closes | comma | colon | quote | scalar_starts)
        after = marks[np.minimum(np.searchsorted(marks, str_end, side="right"), len(marks) - 1)] if len(marks) else str_end
        is_key = (after > str_end) & (data[after] == 58) if len(marks) else np.zeros(0, bool)

        open_at, close_at = np.flatnonzero(opens), np.flatnonzero(closes)
        order_o, order_c = np.argsort(depth[open_at], kind="stable"), np.argsort(depth[close_at] + 1, kind="stable")
        match = np.empty(len(open_at), np.int64)
        match[order_o] = close_at[order_c]

        starts = np.concatenate((open_at, str_start[~is_key], np.flatnonzero(scalar_starts)))
        stops = np.concatenate((match + 1, str_end[~is_key] + 1, np.flatnonzero(scalar_ends) + 1))
        order = np.argsort(starts, kind="stable")
        self.start, self.end = starts[order], stops[order]
        self.kind = data[self.start]
        self.doc = np.searchsorted(ends, self.start)
        is_open = (self.kind == 123) | (self.kind == 91)
        level = depth[self.start] - is_open
        self.parent = np.full(len(self.start), _NONE)
        self.place = np.zeros(len(self.start), np.int64)

        # Members, containers' openings and commas in one list, by level and then by place.
        own = np.flatnonzero(is_open)
        commas = np.flatnonzero(comma)
        ids = np.concatenate((np.arange(len(self.start)), own, np.full(len(commas), _NONE)))
        kinds = np.repeat(np.array([0, 1, 2], np.int8), [len(self.start), len(own), len(commas)])
        pos = np.concatenate((self.start, self.start[own], commas))
        levels = np.concatenate((level, level[own] + 1, depth[commas]))
        by = np.lexsort((pos, levels))
        ids, kinds, levels = ids[by], kinds[by], levels[by]
        head = np.maximum.accumulate(np.where(kinds == 1, np.arange(len(by)), -1)) if len(by) else by
        seen = np.cumsum(kinds == 2)
        member = np.flatnonzero((kinds == 0) & (levels > 0))
        self.parent[ids[member]] = ids[head[member]]
        self.place[ids[member]] = seen[member] - seen[head[member]]

        # The key of a member of an object is the last key before it.
        self.key_start, self.key_end = np.zeros(len(self.start), np.int64), np.zeros(len(self.start), np.int64)
        k_start, k_end = str_start[is_key], str_end[is_key]
        has = np.flatnonzero((self.parent >= 0) & (self.kind[np.maximum(self.parent, 0)] == 123)) if len(self.start) else np.zeros(0, int)
        if len(has):
            k = np.searchsorted(k_start, self.start[has]) - 1
            self.key_start[has], self.key_end[has] = k_start[k] + 1, k_end[k]

    def named(self, key: str) -> np.ndarray:
        """Which values are members of an object under this key; of a repeated key, only the last."""
        want = np.frombuffer(key.encode(), np.uint8)
        hit = self.key_end - self.key_start == len(want)
        at = np.flatnonzero(hit)
        for i, c in enumerate(want):
            at = at[self.data[self.key_start[at] + i] == c]
        escaped = [i for i in self._escaped_keys() if self.string(self.key_start[i], self.key_end[i]) == key]
        at = np.union1d(at, np.array(escaped, np.int64)).astype(np.int64)
        last: dict[int, int] = {int(self.parent[i]): int(i) for i in at}
        out = np.zeros(len(self.start), bool)
        out[list(last.values())] = True
        return out

    def _escaped_keys(self) -> np.ndarray:
        if not hasattr(self, "_escapes"):
            slash = np.cumsum(self.data == 92)
            self._escapes = np.flatnonzero((self.key_end > self.key_start) & (slash[self.key_end - 1] > slash[self.key_start - 1]))
        return self._escapes

    def string(self, start: int, end: int) -> str:
        raw = self.data[start:end].tobytes()
        return json.loads(b'"' + raw + b'"', strict=False) if b"\\" in raw else raw.decode("utf-8", "replace")

    def text(self, value: int) -> str:
        """A string's text, '' for null and containers, the written form of numbers and truth values."""
        kind, start, end = self.kind[value], self.start[value], self.end[value]
        if kind == 34:
            return self.string(start + 1, end - 1)
        if kind in (123, 91):
            return ""
        raw = self.data[start:end].tobytes().decode()
        return "" if raw == "null" else raw


def _index_rows(keys: list[int], bodies: list[bytes]) -> Iterator[tuple]:
    index = StructuralIndex(bodies)
    parent, kind, place = index.parent, index.kind, index.place

    def under(mask: np.ndarray) -> np.ndarray:
        return np.append(mask, False)[parent]

    def elements(lists: np.ndarray) -> np.ndarray:
        """Objects in these lists, or the single object in place of a list."""
        return (kind == 123) & (under(lists & (kind == 91)) | lists)

    if len(parent) == 0:
        return
    root = parent == _NONE
    for v in np.flatnonzero(root & (kind == 34)):  # a record written as a JSON string
        inner = index.text(v).encode("utf-8", "surrogatepass")
        if readable(inner):
            yield from _index_rows([keys[index.doc[v]]], [inner])
    obj = kind == 123
    name, links, officer = index.named("name"), index.named("links"), index.named("officer")
    is_items = index.named("items")
    pages = index.named("pages") & under(root & obj)
    page = elements(pages)
    casefile = index.named("casefile") & under(root & obj) & obj
    lists = (is_items & (under(root & obj) | under(page))) | (index.named("officers") & under(casefile))
    # Positions run on through the lists of one body.
    size = np.zeros(len(parent), np.int64)
    held = under(lists & (kind == 91))
    np.add.at(size, parent[held], 1)
    size[lists & obj] = 1
    list_ids = np.flatnonzero(lists & ((kind == 91) | obj))
    total = np.cumsum(size[list_ids]) - size[list_ids]
    docs = index.doc[list_ids]
    first_of_doc = np.searchsorted(docs, docs)
    offset = np.zeros(len(parent), np.int64)
    offset[list_ids] = total - (total[first_of_doc] if len(list_ids) else 0)

    entry = elements(lists)
    single = lists & obj
    item_pos = np.where(single, offset, offset[np.maximum(parent, 0)] + place)
    former = index.named("former_names") & under(entry)
    child = elements(former)
    child_pos = np.where(former & obj, 0, place)
    grand = np.where(parent >= 0, np.append(parent, _NONE)[parent], _NONE)

    def by_parent(mask: np.ndarray) -> dict[int, int]:
        at = np.flatnonzero(mask)
        return dict(zip(parent[at].tolist(), at.tolist(), strict=True))

    names = by_parent(name & (under(entry) | under(child)))
    dates = by_parent(index.named("appointed_on") & under(entry))
    link = links & under(entry) & obj
    off = officer & under(link) & obj
    path = {int(grand[parent[v]]): int(v) for v in np.flatnonzero(index.named("appointments") & under(off))}
    say = lambda at, v: index.text(at[v]) if v in at else ""
    for v in np.flatnonzero(entry).tolist():
        yield keys[index.doc[v]], int(item_pos[v]), -1, say(names, v), say(dates, v), say(path, v)
    for v in np.flatnonzero(child).tolist():
        up = int(parent[v]) if former[v] else int(grand[v])
        yield keys[index.doc[v]], int(item_pos[up]), int(child_pos[v]), say(names, v), "", ""


def nested_rows(keys: list[int], bodies: list[bytes]) -> list[tuple]:
    """Rows of some bodies; an unreadable one gives none."""
    good = [i for i, b in enumerate(bodies) if readable(b)]
    return list(_index_rows([keys[i] for i in good], [bodies[i] for i in good]))


def flatten_bodies(fetches: DataFrame) -> DataFrame:
    """(fetch_id, body) -> entries (child_pos -1) and their former names, each with its parent's position.

    Null, empty and unreadable bodies give no row, nor do elements that are no
    objects, though they count as positions. Repeated rows come out once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("fetch_id", pa.int64()), ("item_pos", pa.int64()), ("child_pos", pa.int64()), ("name", pa.string()), ("appointed_on", pa.string()), ("officer_path", pa.string())]
        )
        for batch in batches:
            keys, bodies, size = [], [], 0
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = body.as_py().encode("utf-8")
                keys.append(key)
                bodies.append(raw)
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield _batch(nested_rows(keys, bodies), schema)
                    keys, bodies, size = [], [], 0
            if keys:
                yield _batch(nested_rows(keys, bodies), schema)

    wanted = fetches.select("fetch_id", "body").where("fetch_id is not null and body is not null and body <> ''")
    return wanted.mapInArrow(run, ROW_SCHEMA).distinct()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
