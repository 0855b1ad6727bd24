"""Pixel lists of Arrow tables as numpy arrays and back, without an object for each pixel."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa


def one_chunk(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def blocks(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as float arrays; NULL is NaN."""
    column = one_chunk(column)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return []
    at = column.offsets.to_numpy()
    at, values = at - at[0], column.values.slice(at[0], at[-1] - at[0])
    data = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return [data[a:b] for a, b in zip(at, at[1:])]


def lists(arrays: Iterable[np.ndarray]) -> pa.Array:
    """A list column of float arrays; NaN is NULL."""
    arrays = [np.asarray(a, dtype=np.float64).ravel() for a in arrays]
    data = np.concatenate([*arrays, np.zeros(0)])
    at = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(data, mask=np.isnan(data)))


def geometries(column: pa.Array | pa.ChunkedArray) -> list[dict | None]:
    """A geometry column's values, as `to_pylist` gives them but without an Arrow scalar for each point."""
    column = one_chunk(column)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return []
    kinds, rings, part = column.flatten()
    inner = rings.values
    points = inner.values
    if inner.null_count or points.null_count:
        return column.to_pylist()
    x, y = (v.to_pylist() if v.null_count else v.to_numpy().tolist() for v in points.flatten())
    if inner.offset or points.offset or len(x) != len(points):
        return column.to_pylist()
    at = inner.offsets.to_numpy().tolist()
    xy = [{"x": a, "y": b} for a, b in zip(x, y)]
    lines = [xy[a:b] for a, b in zip(at, at[1:])]
    at, numbers = rings.offsets.to_numpy().tolist(), part.to_pylist()
    held = rings.is_valid().to_pylist()
    found = [{"type": k, "rings": lines[a:b] if h else None, "part": n} for k, a, b, h, n in zip(kinds.to_pylist(), at, at[1:], held, numbers)]
    return [g if v else None for g, v in zip(found, column.is_valid().to_pylist())] if column.null_count else found


def maps(column: pa.Array | pa.ChunkedArray) -> list[list[tuple] | None]:
    """A map column's values as lists of pairs, as `to_pylist` gives them but without an Arrow scalar for each pair."""
    column = one_chunk(column)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return []
    pairs = list(zip(column.keys.to_pylist(), column.items.to_pylist()))
    at = column.offsets.to_numpy().tolist()
    if at and at[-1] > len(pairs):
        return column.to_pylist()
    return [pairs[a:b] if v else None for a, b, v in zip(at, at[1:], column.is_valid().to_pylist())]


def cubes(table: pa.Table) -> np.ndarray:
    """Bands by height by width of one tile's rows, in the order of their bands."""
    order = np.argsort(table["band"].to_numpy(), kind="stable")
    found, heights, widths = blocks(table["pixels"]), table["height"].to_pylist(), table["width"].to_pylist()
    return np.stack([found[i].reshape(heights[i], widths[i]) for i in order])


_PLAIN = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _split(text: str) -> list[str]:
    """At commas outside angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _type(text: str) -> pa.DataType:
    if text in _PLAIN:
        return _PLAIN[text]
    kind, inside = text.split("<", 1)
    parts = _split(inside[:-1])
    if kind == "array":
        return pa.list_(_type(parts[0]))
    if kind == "map":
        return pa.map_(_type(parts[0]), _type(parts[1]))
    return pa.struct([pa.field(n.strip(), _type(t.strip())) for n, t in (p.split(":", 1) for p in parts)])


@lru_cache(64)
def arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a Spark schema's text, also where there is no session."""
    return pa.schema([pa.field(n, _type(t)) for n, t in (f.split(" ", 1) for f in _split(schema))])


def table_of(rows: dict[str, list | pa.Array], schema: str) -> pa.Table:
    """Columns as a table of a Spark schema."""
    fields = arrow(schema)
    columns = [(rows[n], t) for n, t in zip(fields.names, fields.types)]
    return pa.Table.from_arrays([(v if v.type == t else v.cast(t)) if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns], schema=fields)


@lru_cache(64)
def empty_table(schema: str) -> pa.Table:
    return arrow(schema).empty_table()
