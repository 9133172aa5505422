"""Grids as rows of tiles: arrays of a bounded size with a margin of neighbouring cells, and values that settle over tiles
while only margins travel.

A tile row is (tr, tc) and one array a field, in bytes: (size + 2 * MARGIN) squared doubles by row, NaN where there is
nothing. Tasks hold one tile at a time; no step needs a group larger than a tile and its margin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.iterate import checkpointed

MARGIN = 2
#: Rows of margins that may be broadcast (8 kB each for tiles of 256); more of them meet the tiles by a shuffle.
FEW = 2048
WIDE = 1_000_000_000


def node(row: Column | str, col: Column | str) -> Column:
    """One number a cell, in row-major order."""
    of = lambda x: F.col(x) if isinstance(x, str) else x
    return of(row).cast("long") * WIDE + of(col).cast("long")


def extent(cells: DataFrame) -> tuple[int, int, int, int]:
    """First and last row, first and last column (0, -1, 0, -1 without cells)."""
    r = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    return (0, -1, 0, -1) if r[0] is None else tuple(map(int, r))


class Frame:
    """Where a tile's array lies on the grid."""

    def __init__(self, tr: int, tc: int, size: int):
        self.row, self.col, self.side = tr * size - MARGIN, tc * size - MARGIN, size + 2 * MARGIN
        self.inner = (slice(MARGIN, MARGIN + size),) * 2

    def nodes(self, at: np.ndarray) -> np.ndarray:
        return (self.row + at // self.side) * WIDE + self.col + at % self.side

    def places(self, nodes: np.ndarray) -> np.ndarray:
        return (nodes // WIDE - self.row) * self.side + nodes % WIDE - self.col

    def mask(self) -> np.ndarray:
        """Cells of the tile itself."""
        inside = np.zeros((self.side, self.side), bool)
        inside[self.inner] = True
        return inside

    def within(self, box: tuple[int, int, int, int]) -> np.ndarray:
        """Cells of the array that lie on the grid."""
        rows, cols = self.row + np.arange(self.side), self.col + np.arange(self.side)
        return ((rows >= box[0]) & (rows <= box[1]))[:, None] & ((cols >= box[2]) & (cols <= box[3]))[None, :]


def _between(lo: int, hi: int) -> Callable[[Column], Column]:
    return lambda t: t.between(lo, hi)


def tiled(cells: DataFrame, fields: dict[str, Column], size: int, box: tuple[int, int, int, int]) -> DataFrame:
    """tr, tc and an array for each field of cells (row, col, ...). A cell near a border goes to the tiles beside it too."""
    side = size + 2 * MARGIN
    names = list(fields)
    keys = {}
    for key, at, lo, hi in (("tr", "row", box[0], box[1]), ("tc", "col", box[2], box[3])):
        near = F.array_distinct(F.array(*(F.floor((F.col(at) + d) / size).cast("long") for d in (-MARGIN, 0, MARGIN))))
        keys[key] = F.filter(near, _between(lo // size, hi // size))
    rows = cells.select("row", "col", *(c.cast("double").alias(n) for n, c in fields.items()), keys["tr"].alias("trs"), keys["tc"].alias("tcs"))
    rows = rows.withColumn("tr", F.explode("trs")).withColumn("tc", F.explode("tcs"))
    place = (F.col("row") - F.col("tr") * size + MARGIN) * side + F.col("col") - F.col("tc") * size + MARGIN
    rows = rows.select("tr", "tc", place.cast("int").alias("place"), *names)

    def build(table: pa.Table) -> pa.Table:
        place = table.column("place").to_numpy()
        out = {"tr": table.column("tr").slice(0, 1), "tc": table.column("tc").slice(0, 1)}
        for n in names:
            array = np.full(side * side, np.nan)
            array[place] = table.column(n).to_numpy()  # null: NaN
            out[n] = pa.array([array.tobytes()], pa.binary())
        return pa.table(out)

    return rows.groupBy("tr", "tc").applyInArrow(build, "tr long, tc long, " + ", ".join(f"{n} binary" for n in names))


Arrays = dict[str, np.ndarray]


def each_tile(tiles: DataFrame, fields: list[str], size: int, work: Callable[[Frame, Arrays, dict], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` over every tile row: its frame, its arrays and its other columns; yields columns of rows for ``schema``."""
    tiles = tiles.drop(*(c for c in tiles.columns if dict(tiles.dtypes)[c] == "binary" and c not in (*fields, "places", "values")))
    others = [c for c in tiles.columns if c not in fields]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rest = {c: batch.column(c)[i].as_py() for c in others}
                frame = Frame(rest["tr"], rest["tc"], size)
                arrays = {f: np.frombuffer(batch.column(f)[i].as_buffer()).reshape(frame.side, frame.side) for f in fields}
                for columns in work(frame, arrays, rest):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names], names)

    return tiles.mapInArrow(run, schema)


def with_margins(tiles: DataFrame, margins: DataFrame, how: str = "left", rows: int | None = None) -> DataFrame:
    """tiles joined with one row of margins each; few of them are broadcast (``rows`` says how many there are)."""
    few = (margins.count() if rows is None else rows) <= FEW
    return tiles.join(F.broadcast(margins) if few else margins, ["tr", "tc"], how)


MARGINS = "tr long, tc long, places binary, values binary, changed boolean"


def settled(tiles: DataFrame, fields: list[str], size: int, box: tuple[int, int, int, int], kernel: Callable[[Frame, Arrays, np.ndarray], np.ndarray], most_rounds: int = 10_000) -> DataFrame:
    """The tiles with ``places`` and ``values``: the settled values of their margin cells.

    ``kernel`` gives a tile's values from the values of its margin (an array with infinity where none is known yet); they
    may only fall as margins fall. After the first round only tiles whose margin fell are solved again, and only margins
    move; rounds grow with the tiles that a value crosses, not with the cells.
    """

    def solve(frame: Frame, arrays: Arrays, rest: dict) -> Iterator[dict]:
        margin = np.full((frame.side, frame.side), np.inf)
        if rest.get("places"):
            margin.reshape(-1)[np.frombuffer(rest["places"], np.int32)] = np.frombuffer(rest["values"])
        inside = frame.mask()
        values = np.where(inside, kernel(frame, arrays, margin), np.inf)
        rows = {"tr": [], "tc": [], "places": [], "values": [], "changed": []}
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                tr, tc = rest["tr"] + a, rest["tc"] + b
                if (a or b) and box[0] // size <= tr <= box[1] // size and box[2] // size <= tc <= box[3] // size:
                    other = Frame(tr, tc, size)
                    top, left = other.row - frame.row, other.col - frame.col
                    r0, r1, c0, c1 = max(top, 0), min(top, 0) + frame.side, max(left, 0), min(left, 0) + frame.side
                    part = values[r0:r1, c0:c1]
                    known = np.isfinite(part) & ~other.mask()[r0 - top : r1 - top, c0 - left : c1 - left]
                    r, c = np.nonzero(known)
                    if len(r):
                        places = ((r + r0 - top) * frame.side + c + c0 - left).astype(np.int32)
                        for k, v in zip(rows, (tr, tc, places.tobytes(), part[known].tobytes(), True), strict=True):
                            rows[k].append(v)
        if rows["tr"]:
            yield rows

    def merge(table: pa.Table) -> pa.Table:
        best: dict[int, float] = {}
        old: dict[int, float] = {}
        for new, places, values in zip(table.column("changed").to_pylist(), table.column("places").to_pylist(), table.column("values").to_pylist(), strict=True):
            for p, v in zip(np.frombuffer(places, np.int32).tolist(), np.frombuffer(values).tolist(), strict=True):
                if not new:
                    old[p] = v
                if v < best.get(p, np.inf):
                    best[p] = v
        places = np.array(sorted(best), np.int32)
        values = np.array([best[p] for p in places.tolist()])
        return pa.table({"tr": table.column("tr").slice(0, 1), "tc": table.column("tc").slice(0, 1), "places": pa.array([places.tobytes()], pa.binary()), "values": pa.array([values.tobytes()], pa.binary()), "changed": pa.array([best != old])})

    active, margins = tiles.withColumns({"places": F.lit(None).cast("binary"), "values": F.lit(None).cast("binary")}), None
    for _ in range(most_rounds):
        sent = each_tile(active, fields, size, solve, MARGINS)
        if margins is not None:
            sent = margins.withColumn("changed", F.lit(False)).unionByName(sent)
        margins = checkpointed(sent.groupBy("tr", "tc").applyInArrow(merge, MARGINS))
        again = margins.where("changed").select("tr", "tc", "places", "values")
        n = again.count()
        if not n:
            return with_margins(tiles, margins.select("tr", "tc", "places", "values"))
        active = with_margins(tiles, again, "inner", n)
    raise RuntimeError("values did not settle")
