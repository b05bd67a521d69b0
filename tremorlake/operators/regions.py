"""Point-in-box join of events with region boxes.

Box edges belong to the box on both sides, so a point on a shared edge lies in both boxes. Three
equivalent plans; the measured size of the boxes decides:

* up to ``NESTED_LOOP_BOXES``: broadcast the boxes, compare each event with each box. No shuffle.
* up to ``BROADCAST_CELLS`` grid cells: cover every box with cells, broadcast the cells and hash-join
  on the event's own cell. No shuffle, an event meets only the boxes near it.
* beyond: shuffle events and cells by cell. Where events are dense, counted in a sample, cells are split
  into quarters again and again; a cell that stays dense to the last, such as a single hot point, is
  spread over at most ``salts`` reducers. All other cells and boxes have one copy.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tremorlake.operators.lists import PIECE, first_hit, first_per_row, salt_of
from tremorlake.operators.sizing import measure, row_bytes

NESTED_LOOP_BOXES = 64
BROADCAST_CELLS = 500_000
BROADCAST_BYTES = 128 << 20
DEFAULT_SALTS = 32

#: Candidate cell edges in degrees, fine to coarse.
_CELL_EDGES = (0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 90.0)

#: Cells per box, on average, at which an event meets hardly any box but its own.
_CELLS_PER_BOX = 16

#: Cells beyond this coordinate are folded onto the outermost one; the box test still decides.
_WORLD = 180.0

_LAT, _LON, _SALT = "_cell_lat", "_cell_lon", "_salt"
_LEVEL, _ROW = "_level", "_row"

#: Halvings of a dense cell's edge at most.
SPLITS = 6

#: A cell that holds more than this share of all events is dense, so at most so many cells of a level are.
_DENSE_SHARE = 1000

#: Fewer events than this are never dense.
_LEAST_DENSE = 16

#: Rows that the sample of events holds, about.
SAMPLE_ROWS = 2_000_000

#: Tasks over which events without a cell are spread.
_NOWHERE = 4_096


class BoxPlan(NamedTuple):
    """How to run the join: ``nested_loop``, ``broadcast_cells`` or ``shuffle_cells``."""

    kind: str
    cell_degrees: float = 1.0
    salts: int = DEFAULT_SALTS


def _inside(events: DataFrame, boxes: DataFrame) -> Column:
    lat, lon = events["latitude"], events["longitude"]
    return (
        (lat >= boxes["lat_min"])
        & (lat <= boxes["lat_max"])
        & (lon >= boxes["lon_min"])
        & (lon <= boxes["lon_max"])
    )


def _cell(value: Column, edge: float) -> Column:
    clamped = F.greatest(F.lit(-_WORLD), F.least(F.lit(_WORLD), value))
    return F.floor(clamped / edge).cast("int")


def _side(low: str, high: str) -> Column:
    world = F.lit(_WORLD)
    return F.greatest(F.least(F.col(high), world) - F.greatest(F.col(low), -world), F.lit(0.0))


def plan_box_join(
    boxes: DataFrame,
    nested_loop_boxes: int = NESTED_LOOP_BOXES,
    broadcast_cells: int = BROADCAST_CELLS,
    salts: int = DEFAULT_SALTS,
) -> BoxPlan:
    """Measure the boxes (one pass over the dimension) and choose a plan."""
    height, width = _side("lat_min", "lat_max"), _side("lon_min", "lon_max")
    area, rim, weight = height * width, height + width, row_bytes(boxes)
    terms = (area, rim, area * weight, rim * weight)
    size, sums = measure(boxes, *(F.coalesce(F.sum(term), F.lit(0.0)) for term in terms))
    if size.rows <= nested_loop_boxes and size.bytes <= BROADCAST_BYTES:
        return BoxPlan("nested_loop")

    def covering(edge: float, area: float, rim: float, count: int) -> float:
        """At most ``side / edge + 2`` cells per axis, multiplied out and summed over the boxes."""
        return area / edge**2 + 2 * rim / edge + 4 * count

    def cells(edge: float) -> float:
        return covering(edge, sums[0], sums[1], size.rows)

    def cell_bytes(edge: float) -> float:
        return covering(edge, sums[2], sums[3], size.bytes)

    target = _CELLS_PER_BOX * size.rows
    fitting = [
        edge
        for edge in _CELL_EDGES
        if cells(edge) <= broadcast_cells and cell_bytes(edge) <= BROADCAST_BYTES
    ]
    if fitting:
        # The coarsest grid that is still fine compared with the boxes, else the finest that fits.
        fine = [edge for edge in fitting if cells(edge) >= target]
        return BoxPlan("broadcast_cells", max(fine) if fine else min(fitting), salts)
    affordable = [edge for edge in _CELL_EDGES if cells(edge) <= target]
    return BoxPlan("shuffle_cells", min(affordable) if affordable else _CELL_EDGES[-1], salts)


class CellTree(NamedTuple):
    """Which cells are split, level by level, and the salts of last-level cells that are dense still.

    A cell of level n has an edge of ``edge / 2 ** n``; ``(latitude, longitude)`` are its numbers.
    """

    edge: float
    split: tuple[tuple[tuple[int, int], ...], ...] = ()
    salts: tuple[tuple[int, int, int], ...] = ()


def _placed() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def dense_cells(
    events: DataFrame, edge: float, salts: int = DEFAULT_SALTS, levels: int = SPLITS, sample_rows: int = SAMPLE_ROWS
) -> CellTree:
    """Count a sample of the events in cells of all levels. The answer has at most ``_DENSE_SHARE`` cells a level.

    It steers where events go, never what they match.
    """
    if events.isStreaming:
        return CellTree(edge)
    points = events.select("latitude", "longitude").where(_placed())
    total = points.count()
    if total > sample_rows:
        points = points.sample(sample_rows / total, seed=7)
        total = sample_rows
    limit = max(_LEAST_DENSE, -(-total // _DENSE_SHARE))
    cells = [
        F.struct(F.lit(n).alias("level"), *(_cell(F.col(c), edge / 2**n).alias(c) for c in ("latitude", "longitude")))
        for n in range(levels + 1)
    ]
    counts = points.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    dense = counts.where(F.col("n") > limit).select("cell.*", "n").orderBy("level", "latitude", "longitude").collect()
    split = [tuple((r["latitude"], r["longitude"]) for r in dense if r["level"] == n) for n in range(levels)]
    hot = [(r["latitude"], r["longitude"], min(salts, -(-r["n"] // limit))) for r in dense if r["level"] == levels]
    return CellTree(edge, tuple(split), tuple(hot))


def _code(lat: Column, lon: Column) -> Column:
    return F.shiftleft(lat.cast("bigint"), 32) + lon


def _among(lat: Column, lon: Column, cells: tuple[tuple[int, int], ...]) -> Column:
    """Whether a cell is one of the given: a look into a hash set in generated code."""
    return _code(lat, lon).isin([(a << 32) + b for a, b in cells]) if cells else F.lit(False)


def _salts(spark: SparkSession, tree: CellTree) -> DataFrame:
    rows = [(len(tree.split), *cell) for cell in tree.salts]
    return F.broadcast(spark.createDataFrame(rows, f"{_LEVEL} int, {_LAT} int, {_LON} int, _salts int"))


def _events_in_leaves(events: DataFrame, tree: CellTree) -> DataFrame:
    """Events with the leaf cell they lie in, and a salt."""
    depth, lat, lon = len(tree.split), F.col("latitude"), F.col("longitude")
    cells = [(_cell(lat, tree.edge / 2**n), _cell(lon, tree.edge / 2**n)) for n in range(depth + 1)]
    level = F.lit(depth)
    for n in reversed(range(depth)):
        level = F.when(~_among(*cells[n], tree.split[n]), F.lit(n)).otherwise(level)
    # A missing coordinate has no cell: an inner join filters it before the shuffle or lookup.
    result = events.withColumn(_LEVEL, F.when(_placed(), level))
    for name, axis in ((_LAT, lat), (_LON, lon)):
        own = F.lit(None).cast("int")
        for n in range(depth + 1):
            own = F.when(F.col(_LEVEL) == n, _cell(axis, tree.edge / 2**n)).otherwise(own)
        result = result.withColumn(name, own)
    result = result.join(_salts(events.sparkSession, tree), [_LEVEL, _LAT, _LON], "left")
    salts = F.when(F.col(_LEVEL).isNull(), F.lit(_NOWHERE)).otherwise(F.coalesce("_salts", F.lit(1)))
    return result.withColumn(_SALT, salt_of(salts, lat, lon)).drop("_salts")


def _boxes_in_leaves(boxes: DataFrame, tree: CellTree) -> DataFrame:
    """A row for each box, leaf cell it touches and salt of that cell."""
    cells = _covered(boxes, tree.edge).withColumn(_LEVEL, F.lit(0))
    for n, split in enumerate(tree.split):
        if not split:
            continue
        edge = tree.edge / 2 ** (n + 1)
        inner = (F.col(_LEVEL) == n) & _among(F.col(_LAT), F.col(_LON), split)

        def quarters(name: str, low: str, high: str, edge: float = edge, inner: Column = inner) -> Column:
            first = F.greatest(2 * F.col(name), _cell(F.col(low), edge))
            last = F.least(2 * F.col(name) + 1, _cell(F.col(high), edge))
            return F.when(inner, F.sequence(first, last)).otherwise(F.array(F.col(name)))

        marked = cells.withColumns({"_lats": quarters(_LAT, "lat_min", "lat_max"), "_lons": quarters(_LON, "lon_min", "lon_max")})
        marked = marked.withColumn(_LEVEL, F.when(inner, F.lit(n + 1)).otherwise(F.col(_LEVEL)))
        cells = marked.withColumn(_LAT, F.explode("_lats")).withColumn(_LON, F.explode("_lons")).drop("_lats", "_lons")
    cells = cells.join(_salts(boxes.sparkSession, tree), [_LEVEL, _LAT, _LON], "left")
    return cells.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def _covered(boxes: DataFrame, edge: float) -> DataFrame:
    """One row per box and grid cell it touches. An empty or NULL box touches none."""
    valid = boxes.filter(
        (F.col("lat_min") <= F.col("lat_max")) & (F.col("lon_min") <= F.col("lon_max"))
    )
    rows = F.sequence(_cell(F.col("lat_min"), edge), _cell(F.col("lat_max"), edge))
    columns = F.sequence(_cell(F.col("lon_min"), edge), _cell(F.col("lon_max"), edge))
    return valid.withColumn(_LAT, F.explode(rows)).withColumn(_LON, F.explode(columns))


def _holds_at(box: Column, lat_name: str, lon_name: str) -> Column:
    lat, lon = F.col(lat_name), F.col(lon_name)
    return (lat >= box["lat_min"]) & (lat <= box["lat_max"]) & (lon >= box["lon_min"]) & (lon <= box["lon_max"])


def _locate_first(events: DataFrame, boxes: DataFrame, how: str, plan: BoxPlan, order: str) -> DataFrame:
    """Each event once, with the first box by ``order`` (then by the other columns) that contains it.

    A cell lists its boxes in that order and the test stops at the first hit. Few boxes: one broadcast
    lookup. Many: lists come in bounded pieces, which one join by leaf cell brings to the events.
    """
    box = F.struct(F.col(order).alias("_order"), *(F.col(c) for c in boxes.columns))
    if plan.kind == "shuffle_cells":
        tree = dense_cells(events, plan.cell_degrees, plan.salts)
        keys = [_LEVEL, _LAT, _LON, _SALT]
        cells = _boxes_in_leaves(boxes, tree)
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *boxes.columns)) - 1
        pieces = cells.withColumn("_piece", F.floor(place / PIECE)).groupBy(*keys, "_piece")
        pieces = pieces.agg(F.sort_array(F.collect_list(box)).alias("_boxes")).drop("_piece")
        rows = _events_in_leaves(events, tree).withColumn(_ROW, F.monotonically_increasing_id())
        carried = rows.withColumns({"_at_lat": F.col("latitude"), "_at_lon": F.col("longitude")})
        hit = first_hit(F.col("_boxes"), lambda b: _holds_at(b, "_at_lat", "_at_lon"), lambda b: b)
        found = first_per_row(carried, pieces, keys, _ROW, events.columns, hit)
    else:
        edge = plan.cell_degrees if plan.kind == "broadcast_cells" else _CELL_EDGES[-2]
        lists = _covered(boxes, edge).groupBy(_LAT, _LON).agg(F.sort_array(F.collect_list(box)).alias("_boxes"))
        points = events.withColumns({_LAT: F.when(_placed(), _cell(F.col("latitude"), edge)), _LON: F.when(_placed(), _cell(F.col("longitude"), edge))})
        found = points.join(F.broadcast(lists), [_LAT, _LON], "left")
        hit = first_hit(F.col("_boxes"), lambda b: _holds_at(b, "latitude", "longitude"), lambda b: b)
        found = found.select(*(F.col(c) for c in events.columns), hit.alias("_hit"))
    if how == "inner":
        found = found.where(F.col("_hit").isNotNull())
    return found.select(*events.columns, *(F.col("_hit")[c].alias(c) for c in boxes.columns))


def locate(
    events: DataFrame,
    boxes: DataFrame,
    how: str = "inner",
    plan: BoxPlan | None = None,
    resolve: str = "all",
    order: str = "region_id",
) -> DataFrame:
    """Events with the columns of every box that contains them.

    ``how="left"`` keeps events outside all boxes, with NULL box columns. ``plan`` skips measuring,
    for example to reuse one decision for all micro-batches of a stream. ``resolve="first"`` keeps each
    event once, with the box that comes first by ``order``, where boxes share an edge or overlap.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how!r}")
    if resolve not in ("all", "first"):
        raise ValueError(f"unsupported way to resolve several boxes: {resolve!r}")
    plan = plan or plan_box_join(boxes)
    if resolve == "first":
        return _locate_first(events, boxes, how, plan, order)
    if plan.kind == "nested_loop":
        return events.join(F.broadcast(boxes), _inside(events, boxes), how)

    edge = plan.cell_degrees
    if plan.kind == "shuffle_cells":
        tree = dense_cells(events, edge, plan.salts)
        points, cells = _events_in_leaves(events, tree), _boxes_in_leaves(boxes, tree)
        keys = [_LEVEL, _LAT, _LON, _SALT]
    else:
        # A missing coordinate has no cell.
        points = events.withColumns(
            {
                _LAT: F.when(_placed(), _cell(F.col("latitude"), edge)),
                _LON: F.when(_placed(), _cell(F.col("longitude"), edge)),
            }
        )
        cells = F.broadcast(_covered(boxes, edge))
        keys = [_LAT, _LON]
    condition = _inside(points, cells)
    for key in keys:
        condition = condition & (points[key] == cells[key])
    joined = points.join(cells, condition, how)
    return joined.select(*(points[c] for c in events.columns), *(cells[c] for c in boxes.columns))
