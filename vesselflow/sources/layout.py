"""A table of months clustered by place, and boxes that read only the row groups they meet (FLT4, GEO1).

Geohashes in the order of their text follow a space-filling curve, so rows sorted by geohash
have narrow ranges of it in each file, row group and page, and Parquet keeps those ranges. A
box becomes a few ranges of geohashes that cover it; they are pushed to the scan, and the
exact comparison of the coordinates decides about the rows that are left.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselflow.functions.predicates import in_bbox
from vesselflow.schema import GEOHASH_ALPHABET, GEOHASH_PRECISION, MESSAGE_KEY

#: Ranges of a covering at most, and bytes of a row group. More ranges fit a box closer.
RANGES = 32
ROW_GROUP_BYTES = 32 << 20
BITS = 5 * GEOHASH_PRECISION
#: A coordinate may be rounded up into the cell above it; degrees by which boxes are widened.
MARGIN = 1e-9

Bounds = tuple[float | None, float | None, float | None, float | None]


def write_clustered(
    messages: DataFrame, out: str, files: int | None = None, geohash: str = "geohash9", row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Months of Parquet, the rows of each sorted by place; only touched months are replaced.

    One shuffle by ranges of (month, geohash, message key). The key stands behind the
    geohash, so a harbour with a third of all rows fills as many files as its share asks
    for. ``files`` is the number of ranges over all months; by default Spark's setting,
    merged by AQE to its advisory size. Rows without a geohash come first.
    """
    order = ["ym", geohash, *[c for c in reversed(MESSAGE_KEY) if c in messages.columns]]
    ranged = messages.repartitionByRange(*([files] if files else []), *order)
    (
        ranged.sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .option("parquet.block.size", row_group_bytes)
        .partitionBy("ym")
        .parquet(out)
    )


def _text(number: int) -> str:
    """Geohash of a place on the curve."""
    return "".join(GEOHASH_ALPHABET[number >> shift & 31] for shift in range(BITS - 5, -1, -5))


def covering(bounds: Bounds, ranges: int = RANGES) -> list[tuple[str, str]]:
    """At most ``ranges`` ranges of geohashes, both ends included, that hold every place of a box.

    Cells are halved along the longer side in turn, as geohashes do; the largest cell that
    lies only partly in the box is halved next. A cell on the edge of the box counts as
    partly in it. ``bounds`` are (lat_min, lat_max, lon_min, lon_max), None for no bound.
    An empty box has no range.
    """
    if ranges < 1:
        raise ValueError("a covering has at least one range")
    world = ((-90.0, 90.0), (-180.0, 180.0))
    box = []
    for (low, high), least, most in zip(world, bounds[::2], bounds[1::2], strict=True):
        if least is not None and most is not None and least > most:
            return []
        # Places beyond the edge of the world are written with its outermost cells.
        box.append(
            (
                low if least is None else min(max(least - MARGIN, low), high),
                high if most is None else max(min(most + MARGIN, high), low),
            )
        )

    def outside(cell):
        return any(c[1] < b[0] or c[0] > b[1] for c, b in zip(cell, box, strict=True))

    def inside(cell):
        return all(b[0] <= c[0] and c[1] <= b[1] for c, b in zip(cell, box, strict=True))

    turn = count()
    whole: list[tuple[int, int]] = []
    parts = [(0, next(turn), 0, world)]
    while parts and len(parts) + len(whole) < 4 * ranges:
        depth, _, number, cell = heapq.heappop(parts)
        if inside(cell) or depth == BITS:
            whole.append((number << BITS - depth, (number + 1 << BITS - depth) - 1))
            continue
        axis = 1 - depth % 2  # the first bit is that of the longitude
        middle = sum(cell[axis]) / 2
        for bit, side in enumerate(((cell[axis][0], middle), (middle, cell[axis][1]))):
            half = (side, cell[1]) if axis == 0 else (cell[0], side)
            if not outside(half):
                heapq.heappush(parts, (depth + 1, next(turn), number << 1 | bit, half))
    spans = sorted([*whole, *[(n << BITS - d, (n + 1 << BITS - d) - 1) for d, _, n, _ in parts]])
    return [(_text(a), _text(b)) for a, b in _joined(spans, ranges)]


def _joined(spans: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    """Neighbours joined, and then whatever the widest gaps do not part."""
    gaps = [(b[0] - a[1], i) for i, (a, b) in enumerate(zip(spans, spans[1:], strict=False), 1)]
    widest = sorted((g for g in gaps if g[0] > 1), reverse=True)[: ranges - 1]
    cuts = [0, *sorted(i for _, i in widest), len(spans)]
    return [(spans[i][0], spans[j - 1][1]) for i, j in zip(cuts, cuts[1:], strict=False)]


def in_clustered_box(
    lat_min: float | None = None,
    lat_max: float | None = None,
    lon_min: float | None = None,
    lon_max: float | None = None,
    geohash: str = "geohash9",
    ranges: int = RANGES,
) -> Column:
    """FLT4 over a table of :func:`write_clustered`: the rows of ``in_bbox``, read by place.

    The ranges are plain comparisons of the bare column, so Parquet skips files, row groups
    and pages outside them. They only ever leave out rows that the exact box leaves out
    as well: rows without a geohash are kept for it, and box borders count on both sides.
    The geohash must be that of LAT and LON, as in a curated table.
    """
    bounds = (lat_min, lat_max, lon_min, lon_max)
    exact = in_bbox(*bounds)
    if bounds == (None,) * 4:
        return exact
    place = F.col(geohash)
    near = place.isNull()
    for low, high in covering(bounds, ranges):
        near = near | ((place >= low) & (place <= high))
    return near & exact
