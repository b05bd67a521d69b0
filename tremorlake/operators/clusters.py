"""First matching cluster sphere per event, and distances to given centres.

A cluster is a sphere around its centre on the Earth scaled to radius 1. An event belongs to the
cluster with the lowest id whose sphere holds it. Comparing every event with every cluster costs
events x clusters; here space is cut into cubes, each cube lists the clusters whose sphere may reach
into it, and an event looks only at the list of its own cube. A table of bounded size is broadcast, so
no event is shuffled. A larger dimension meets the events in one shuffle by cube, whatever its size.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tremorlake.functions.sphere import (
    EARTH_RADIUS_KM,
    Vector,
    great_circle_km,
    hypocentre_vector,
    squared_distance,
    squared_reach,
)
from tremorlake.operators.lists import PIECE, first_hit, first_per_row, salt_of, shuffled
from tremorlake.operators.sizing import broadcast_when_small
from tremorlake.sources.writers import Staged

#: Cube rows (cluster x cube) that one broadcast may hold, about 64 bytes each.
BROADCAST_CUBES = 500_000

#: Clusters that one broadcast table may hold; more clusters meet the events in a shuffle.
CLUSTERS_PER_PASS = 10_000

#: Events of one cube that one task may take; a cube with more is dealt over several, by salt.
HOT_EVENTS = 1_000_000

#: So many of the fullest cubes can be hot at most; any other holds less than that share of the events.
_HOT_CUBES = 2_000

#: Tasks over which events without a place are spread.
_NOWHERE = 4_096

#: Cube edges as powers of two, fine to coarse. At the coarsest a cluster touches at most 8 cubes.
_EDGES = tuple(2.0**-power for power in range(8, -3, -1))

#: A point far outside (an absurd depth) is folded onto the outermost cube; the distance decides.
_LIMIT = 2.0

#: Cubes per cluster, on average, at which a cube lists hardly any cluster that misses the event.
_CUBES_PER_CLUSTER = 343

#: Cubes per cluster, on average, with which a table of pieces begins: cubes about as wide as a radius, which the
#: larger spheres of a crowd begin to hold whole.
_FIRST_CUBES = 64

#: Edges of the cubes in which a sphere is compared with lower ids, fine to coarse.
_CROWD_EDGES = (2.0**-12, 2.0**-10, 2.0**-8, 2.0**-7)

_CUBE = ("_cube_x", "_cube_y", "_cube_z")
_CENTRE = ("center_x", "center_y", "center_z")
_CANDIDATES = "_candidates"
_POINT = ("_point_x", "_point_y", "_point_z")
_SALT, _ROW = "_salt", "_row"


def usable_clusters(clusters: DataFrame) -> DataFrame:
    """The dimension as numbers, without rows that cannot take part in a distance test."""
    typed = clusters.select(
        F.col("cluster_id").try_cast("int").alias("cluster_id"),
        *(F.col(name).try_cast("double").alias(name) for name in (*_CENTRE, "max_r_km")),
    )
    return typed.na.drop()


def _cube(value: Column, edge: float) -> Column:
    clamped = F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), value))
    return F.floor(clamped / edge).cast("int")


def _reach() -> Column:
    """Radius on the unit sphere, a hair wider, so that rounding never loses a cube."""
    return F.abs(F.col("max_r_km")) / EARTH_RADIUS_KM * (1.0 + 1e-9) + 1e-12


def _bounds(centre: str, edge: float) -> tuple[Column, Column]:
    """First and last cube along one axis that the sphere can reach."""
    return _cube(F.col(centre) - _reach(), edge), _cube(F.col(centre) + _reach(), edge)


class _Extent(NamedTuple):
    """Sums over a dimension that bound its number of cubes at any edge."""

    clusters: int
    reach: float
    reach2: float
    reach3: float

    def cubes(self, edge: float) -> float:
        """At most ``2 * reach / edge + 2`` cubes per axis, multiplied out and summed."""
        return (
            8 * self.reach3 / edge**3
            + 24 * self.reach2 / edge**2
            + 24 * self.reach / edge
            + 8 * self.clusters
        )


def _extent(clusters: DataFrame) -> _Extent:
    reach = F.least(_reach(), F.lit(_LIMIT))
    sums = [F.coalesce(F.sum(term), F.lit(0.0)) for term in (reach, reach * reach, reach * reach * reach)]
    return _Extent(*clusters.agg(F.count("*"), *sums).first())


def _edge(extent: _Extent, cube_limit: int) -> float:
    """The coarsest edge that is still fine compared with the spheres, else the finest that fits."""
    fitting = [edge for edge in _EDGES if extent.cubes(edge) <= cube_limit] or [_EDGES[-1]]
    fine = [edge for edge in fitting if extent.cubes(edge) >= _CUBES_PER_CLUSTER * extent.clusters]
    return max(fine) if fine else min(fitting)


def _holds_cube(edge: float) -> Column:
    """Whether a sphere holds every point of the cube, by the cube's farthest corner.

    Never true for an outermost cube, which also stands for everything beyond it.
    """
    outermost = int(_LIMIT // edge)
    farthest, inner = F.lit(0.0), F.lit(True)
    for name, centre in zip(_CUBE, _CENTRE):
        low = F.col(name) * edge
        gap = F.greatest(F.abs(low - F.col(centre)), F.abs(low + edge - F.col(centre)))
        farthest = farthest + gap * gap
        inner = inner & (F.col(name) > -outermost) & (F.col(name) < outermost)
    return inner & (farthest < squared_reach(F.col("max_r_km")) * (1.0 - 1e-9))


def _touches_cube(edge: float) -> Column:
    """Whether a sphere reaches into the cube itself, by the cube's nearest place; always true for an outermost cube."""
    outermost = int(_LIMIT // edge)
    nearest, inner = F.lit(0.0), F.lit(True)
    for name, centre in zip(_CUBE, _CENTRE):
        low = F.col(name) * edge
        gap = F.greatest(low - F.col(centre), F.col(centre) - (low + edge), F.lit(0.0))
        nearest = nearest + gap * gap
        inner = inner & (F.col(name) > -outermost) & (F.col(name) < outermost)
    return ~inner | (nearest <= _reach() * _reach())


def _covered(clusters: DataFrame, edge: float) -> DataFrame:
    """A row for each cluster and cube that its sphere can reach."""
    for name, centre in zip(_CUBE, _CENTRE):
        low, high = _bounds(centre, edge)
        clusters = clusters.withColumn(name, F.explode(F.sequence(low, high)))
    return clusters


def _candidate() -> Column:
    return F.struct("cluster_id", *_CENTRE, squared_reach(F.col("max_r_km")).alias("reach"))


def _cube_table(clusters: DataFrame, edge: float) -> DataFrame:
    """Per cube the clusters that may match there, by ascending id.

    The list ends with the first cluster that holds the whole cube: no later one can be the first
    match of an event in it.
    """
    lists = _covered(clusters, edge).groupBy(*_CUBE).agg(
        F.sort_array(F.collect_list(_candidate())).alias("_all"),
        F.min(F.when(_holds_cube(edge), F.col("cluster_id"))).alias("_last"),
    )
    needed = F.filter("_all", lambda c: F.col("_last").isNull() | (c["cluster_id"] <= F.col("_last")))
    return lists.select(*_CUBE, needed.alias(_CANDIDATES))


def _leading(clusters: DataFrame) -> DataFrame:
    """The clusters without those that can be no event's first match.

    Two centres in one cube are no farther apart than its diagonal. A sphere that is smaller by the diagonal than one
    with a lower id lies inside it. What stays of a crowd are the largest spheres and the lowest ids. One window over
    the clusters for each edge; outermost cubes, which also stand for everything beyond, are left alone.
    """
    for edge in _CROWD_EDGES:
        outermost = int(_LIMIT // edge)
        cubes = clusters.withColumns({name: _cube(F.col(centre), edge) for name, centre in zip(_CUBE, _CENTRE)})
        inner = F.greatest(*(F.abs(F.col(name)) for name in _CUBE)) < outermost
        lower = Window.partitionBy(*_CUBE).orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
        diagonal = math.sqrt(3) * edge * (1.0 + 1e-9) + 1e-9
        cubes = cubes.withColumn("_widest", F.max(_reach()).over(lower))
        inside = F.coalesce(F.col("_widest") >= _reach() + diagonal, F.lit(False))
        clusters = cubes.where(~(inner & inside)).drop(*_CUBE, "_widest")
    return clusters


def _finer(cubes: DataFrame, edge: float) -> DataFrame:
    """The cubes of half the edge, ``edge``, that a sphere can reach inside the cubes it is listed in."""
    for name, centre in zip(_CUBE, _CENTRE):
        low, high = _bounds(centre, edge)
        first = F.col(name) * 2
        cubes = cubes.withColumn(name, F.explode(F.sequence(F.greatest(low, first), F.least(high, first + 1))))
    return cubes


def _chunk_table(clusters: DataFrame, edge: float, first_edge: float) -> DataFrame:
    """The lists of ``_cube_table`` in pieces of at most ``PIECE`` candidates, a row for each piece.

    Lists are made for cubes of ``first_edge`` and cut, then each cube hands what is left of its list to its eight
    parts: a cluster that holds a whole cube ends the lists of all parts, so of many spheres in one place few reach
    the small cubes. Windows over a cube spill to disk, so a cube that a million clusters reach needs no more memory.
    """
    cube = Window.partitionBy(*_CUBE)
    at = max(first_edge, edge)
    cubes = _covered(clusters, at).where(_touches_cube(at))
    while True:
        last = F.min(F.when(_holds_cube(at), F.col("cluster_id"))).over(cube)
        cubes = cubes.withColumn("_last", last).where("_last is null or cluster_id <= _last").drop("_last")
        if at <= edge:
            break
        at /= 2
        cubes = _finer(cubes, at).where(_touches_cube(at))
    place = F.row_number().over(cube.orderBy("cluster_id", *_CENTRE, "max_r_km")) - 1
    cubes = cubes.withColumn("_piece", F.floor(place / PIECE))
    return cubes.groupBy(*_CUBE, "_piece").agg(F.sort_array(F.collect_list(_candidate())).alias(_CANDIDATES))


def _first_match(point: Vector) -> Column:
    """Id of the first candidate that holds the point."""

    def holds(candidate: Column) -> Column:
        centre = Vector(*(candidate[name] for name in _CENTRE))
        return squared_distance(point, centre) < candidate["reach"]

    return first_hit(F.col(_CANDIDATES), holds, lambda candidate: candidate["cluster_id"])


class ClusterLookup(NamedTuple):
    """A measured dimension, ready to be matched with any number of event tables.

    ``table`` holds candidates by cube: a whole list per cube if it is to be broadcast, else pieces of lists.
    """

    table: DataFrame
    edge: float
    broadcast: bool


def cluster_lookup(
    clusters: DataFrame, cube_limit: int = BROADCAST_CUBES, per_pass: int = CLUSTERS_PER_PASS
) -> ClusterLookup:
    """Measure the dimension (one pass over it) and lay it out by cubes."""
    usable = usable_clusters(clusters)
    extent = _extent(usable)
    edge = _edge(extent, cube_limit)
    if extent.clusters <= per_pass and extent.cubes(edge) <= max(cube_limit, 8 * per_pass):
        return ClusterLookup(_cube_table(usable, edge), edge, True)
    edge = _edge(extent, 2 * _CUBES_PER_CLUSTER * extent.clusters)
    first_edge = min((e for e in _EDGES if extent.cubes(e) <= _FIRST_CUBES * extent.clusters), default=max(_EDGES))
    return ClusterLookup(_chunk_table(_leading(usable), edge, first_edge), edge, False)


def _with_point(events: DataFrame) -> tuple[DataFrame, Vector]:
    where = hypocentre_vector(F.col("latitude"), F.col("longitude"), F.col("depth_km"))
    return events.withColumns(dict(zip(_POINT, where))), Vector(*(F.col(name) for name in _POINT))


def hot_cubes(placed: DataFrame, hot_events: int) -> list[tuple[int, int, int, int]]:
    """(cube, salts) of the cubes with more than ``hot_events`` events, counted over all events.

    The fullest ``_HOT_CUBES`` at most, so the answer is bounded; it takes one scan of three columns.
    """
    counts = placed.groupBy(*_CUBE).agg(F.count("*").alias("n")).where(F.col("n") > hot_events)
    fullest = counts.orderBy(F.desc("n"), *_CUBE).limit(_HOT_CUBES).collect()
    return [(*row[:3], -(-row["n"] // hot_events)) for row in fullest if row[0] is not None]


def _match_shuffled(events: DataFrame, lookup: ClusterLookup, hot_events: int) -> DataFrame:
    """One shuffle by (cube, salt): an event meets the pieces of its cube's list and keeps the lowest hit.

    Only hot cubes have salts. Pieces of a list are brought together by the event's row number inside
    the partition that the join has made, so events are not shuffled again.
    """
    if events.isStreaming:
        raise ValueError("a dimension too large for a broadcast is matched batch by batch, see start_ingest")
    spark = events.sparkSession
    result, point = _with_point(events)
    result = result.withColumns({name: _cube(axis, lookup.edge) for name, axis in zip(_CUBE, point)})
    hot = hot_cubes(result, hot_events)
    hot = F.broadcast(spark.createDataFrame(hot, ", ".join(f"{name} int" for name in (*_CUBE, "_salts"))))
    result = result.withColumn(_ROW, F.monotonically_increasing_id()).join(hot, list(_CUBE), "left")
    salts = F.when(F.col(_CUBE[0]).isNull(), F.lit(_NOWHERE)).otherwise(F.coalesce("_salts", F.lit(1)))
    result = result.withColumn(_SALT, salt_of(salts, *point)).drop("_salts")
    pieces = lookup.table.join(hot, list(_CUBE), "left")
    pieces = pieces.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    pieces = pieces.select(*_CUBE, _SALT, _CANDIDATES)
    found = first_per_row(result, pieces, (*_CUBE, _SALT), _ROW, events.columns, _first_match(point))
    return found.withColumnRenamed("_hit", "cluster_id")


def match_clusters(
    events: DataFrame,
    clusters: DataFrame | ClusterLookup,
    cube_limit: int = BROADCAST_CUBES,
    per_pass: int = CLUSTERS_PER_PASS,
    hot_events: int = HOT_EVENTS,
) -> DataFrame:
    """Events with ``cluster_id``: the lowest id whose sphere holds the event, NULL if none does.

    Measures the dimension first, so pass a stored or derived-from-small one, or a lookup made before.
    Up to ``per_pass`` clusters are broadcast; more are joined in one shuffle of the events.
    """
    lookup = clusters if isinstance(clusters, ClusterLookup) else cluster_lookup(clusters, cube_limit, per_pass)
    events = events.drop("cluster_id")
    if not lookup.broadcast:
        return _match_shuffled(events, lookup, hot_events)
    result, point = _with_point(events)
    keys = {name: _cube(axis, lookup.edge) for name, axis in zip(_CUBE, point)}
    result = result.withColumns(keys).join(F.broadcast(lookup.table), list(_CUBE), "left")
    return result.withColumn("cluster_id", _first_match(point)).drop(*_CUBE, _CANDIDATES, *_POINT)


def _neighbourhoods(centres: DataFrame, edge: float) -> DataFrame:
    """Per cube the centres in it and in the 26 cubes around it."""
    around = centres
    for name, centre in zip(_CUBE, _CENTRE):
        own = _cube(F.col(centre), edge)
        around = around.withColumn(name, F.explode(F.sequence(own - 1, own + 1)))
    lists = F.collect_list(F.struct("cluster_id", *_CENTRE))
    return around.groupBy(*_CUBE).agg(lists.alias(_CANDIDATES))


def _cells(centres: DataFrame, edge: float) -> DataFrame:
    """Per occupied cube the box that its centres fill; a centre beyond the outermost cubes widens that box."""
    bounds = [bound(name).alias(f"_{side}_{name}") for name in _CENTRE for side, bound in (("low", F.min), ("high", F.max))]
    cells = centres.withColumns({f"_cell{name}": _cube(F.col(centre), edge) for name, centre in zip(_CUBE, _CENTRE)})
    return cells.groupBy(*(f"_cell{name}" for name in _CUBE)).agg(*bounds)


def _box_distances(point: Vector) -> tuple[Column, Column]:
    """Squared distances of the point from the nearest and the farthest place of a cell's box."""
    least, most = F.lit(0.0), F.lit(0.0)
    for axis, name in zip(point, _CENTRE):
        below, above = F.col(f"_low_{name}") - axis, axis - F.col(f"_high_{name}")
        gap, far = F.greatest(below, above, F.lit(0.0)), F.greatest(F.abs(below), F.abs(above))
        least, most = least + gap * gap, most + far * far
    return least, most


def _ring(asks: DataFrame, centres: DataFrame, cell: float, edge: float) -> DataFrame:
    """(row, near): the least (distance, cluster) among the centres of the 27 cubes around each asking point.

    The cubes are cut into cells. The nearest farthest place of a cell's box bounds the distance, and only
    centres of cells that come within the bound are compared: their number hardly depends on that of all centres.
    """
    point = Vector(*(F.col(name) for name in _POINT))
    cells = _cells(centres, cell)
    for name in _CUBE:
        own = F.floor(F.col(f"_cell{name}") * (cell / edge)).cast("int")
        cells = cells.withColumn(name, F.explode(F.sequence(own - 1, own + 1)))
    asks = asks.withColumns({name: _cube(axis, edge) for name, axis in zip(_CUBE, point)})
    met = asks.join(shuffled(cells), list(_CUBE))
    least, most = _box_distances(point)
    bound = met.groupBy(_ROW, *_POINT, *_CUBE).agg((F.min(most) * (1.0 + 1e-9)).alias("_bound"))
    alive = bound.join(shuffled(cells), list(_CUBE)).where(least <= F.col("_bound"))
    keys = [f"_cell{name}" for name in _CUBE]
    placed = centres.withColumns({key: _cube(F.col(centre), cell) for key, centre in zip(keys, _CENTRE)})
    pairs = alive.select(_ROW, *_POINT, *keys).join(shuffled(placed), keys)
    distance = squared_distance(point, Vector(*(F.col(name) for name in _CENTRE)))
    near = F.struct(distance.alias("d"), F.col("cluster_id").alias("cluster_id"))
    return pairs.groupBy(_ROW).agg(F.min(near).alias("_near"))


def _nearest_shuffled(matched: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """``matched`` with ``_near``, for a dimension beyond a broadcast: only events that ask travel to the centres.

    A ring's cubes are eight times as wide as its cells, and the next ring's cells as wide as those cubes.
    """
    placed, point = _with_point(matched)
    rows = Staged(placed.withColumn(_ROW, F.monotonically_increasing_id()), "matched").df
    known = F.coalesce(~F.isnan(point[0] + point[1] + point[2]), F.lit(False))
    asks = rows.where(F.col("_held").isNull() & known).select(_ROW, *_POINT)
    # A cell of the first ring holds a few centres of the surface.
    cell = min((edge for edge in _EDGES if 4 * math.pi / edge**2 <= n / 4), default=max(_EDGES))
    found = used = None
    while n and not asks.isEmpty():
        edge = 8 * cell
        last = edge >= max(_EDGES)
        near = _ring(asks, centres, cell, edge)
        if not last:
            near = near.join(asks, _ROW).where(F.greatest(*(F.abs(axis) for axis in point)) < _LIMIT)
            near = near.where(F.col("_near.d") <= (edge * (1.0 - 1e-9)) ** 2)
        near = Staged(near.select(F.col(_ROW).alias("_of"), F.col("_near.cluster_id").alias("_near")), "nearest").df
        found = near if found is None else found.union(near)
        if last:
            break
        left = Staged(asks.join(near, F.col(_ROW) == F.col("_of"), "left_anti"), "asks")
        if used is not None:
            used.drop()
        used, asks = left, left.df
        cell = edge
    if used is not None:
        used.drop()
    if found is None:
        return rows.withColumn("_near", F.lit(None).cast("int")).drop(_ROW)
    return rows.join(found, F.col(_ROW) == F.col("_of"), "left").drop(_ROW, "_of")


def _settled(result: DataFrame) -> DataFrame:
    result = result.withColumn("cluster_id", F.coalesce("_held", "_near"))
    result = result.withColumn("is_nearest", F.col("_held").isNull() & F.col("_near").isNotNull())
    return result.drop(*_POINT, "_held", "_near")


def nearest_clusters(events: DataFrame, clusters: DataFrame, per_pass: int = CLUSTERS_PER_PASS) -> DataFrame:
    """``match_clusters``, and for events in no sphere the cluster with the nearest centre (ties: lowest id).

    ``cluster_id`` comes with ``is_nearest``. A ring search: an event looks at the 27 cubes around it, and the
    nearest centre found there is the nearest of all if it is no farther than a cube's edge, the least
    distance to anything outside. Where it is not, the edge doubles; at the last the 27 cubes hold everything.
    The number of rings depends on the Earth's size alone. Up to ``per_pass`` clusters each ring is one lookup in
    a broadcast table with a list for every cube, made of 27 entries a cluster. Beyond, events that are in no sphere
    are written and joined with the cubes' cells by shuffles. Events without coordinates keep NULL.
    """
    matched = match_clusters(events, clusters, per_pass=per_pass).withColumnRenamed("cluster_id", "_held")
    centres = usable_clusters(clusters)
    n = centres.count()
    if n > per_pass:
        return _settled(_nearest_shuffled(matched, centres, n))
    result, point = _with_point(matched)
    result = result.withColumn("_near", F.lit(None).cast("int"))
    # At the first edge a neighbourhood of the surface holds a few centres.
    edges = [edge for edge in sorted(_EDGES) if 4 * math.pi / edge**2 <= max(n, 1)] or [max(_EDGES)]
    for edge in edges:
        last = edge == edges[-1]
        placed = F.coalesce(~F.isnan(point[0] + point[1] + point[2]), F.lit(False)) & point[0].isNotNull()
        asks = F.col("_held").isNull() & F.col("_near").isNull() & placed
        # Rows that ask for nothing are spread over cubes that do not exist.
        nowhere = -(F.lit(1 << 20) + salt_of(F.lit(_NOWHERE), *point))
        keys = {name: F.when(asks, _cube(axis, edge)).otherwise(nowhere) for name, axis in zip(_CUBE, point)}
        table = _neighbourhoods(centres, edge)
        result = result.withColumns(keys).join(F.broadcast(table), list(_CUBE), "left")

        def distance(c: Column) -> Column:
            centre = Vector(*(c[name] for name in _CENTRE))
            return F.struct(squared_distance(point, centre).alias("d"), c["cluster_id"].alias("cluster_id"))

        best = F.array_min(F.transform(_CANDIDATES, distance))
        inside = F.greatest(*(F.abs(axis) for axis in point)) < _LIMIT
        sure = F.lit(True) if last else inside & (best["d"] <= (edge * (1.0 - 1e-9)) ** 2)
        result = result.withColumn("_near", F.coalesce("_near", F.when(sure, best["cluster_id"])))
        result = result.drop(*_CUBE, _CANDIDATES)
    return _settled(result)


def distance_to_centre(
    members: DataFrame, centres: DataFrame, cluster: str = "cluster_id"
) -> DataFrame:
    """Members (with ``x, y, z``) and ``dist_km``, the great-circle distance to their own centre.

    A member whose cluster has no centre is at distance 0.
    """
    own = broadcast_when_small(
        centres.select(F.col("cluster_id").alias("_centre"), *_CENTRE)
    )
    distance = great_circle_km(
        Vector(F.col("x"), F.col("y"), F.col("z")),
        Vector(*(F.col(name) for name in _CENTRE)),
    )
    return (
        members.join(own, F.col(cluster) == F.col("_centre"), "left")
        .withColumn("dist_km", F.when(F.col("_centre").isNull(), 0.0).otherwise(distance))
        .drop("_centre", *_CENTRE)
    )


def attach_assignment(events: DataFrame, assignment: DataFrame, key: str = "id") -> DataFrame:
    """Events joined with their cluster assignment by id; unassigned and id-less events drop out.

    The assignment holds one row per id, so only the event side can be skewed, which AQE splits.
    """
    return events.join(assignment, key, "inner")
