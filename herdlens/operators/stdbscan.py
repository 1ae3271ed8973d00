"""Space-time density clustering (ST-DBSCAN, Birant and Kut 2007) on DataFrames.

Rows of one place and day are one *cell* with a weight. Cells fall into boxes
whose points are all within ``eps_km`` of each other, so within a box and
``eps_days`` neither counting nor linking needs a single pair. Between boxes,
bounding rectangles decide most cases; what they leave open is compared
directly where a box and day holds few places, and cut into finer boxes where
it holds many. So no group ever emits all its pairs, and no key of any join
gathers more than a bounded number of rows on both sides.

Labels are those of a sequential run in ``order``: clusters are numbered by
their first core row, a border row takes the lowest neighbouring cluster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdlens.config import DEFAULT, Config
from herdlens.functions.geo import Bounds, Grid, nearest_and_farthest
from herdlens.functions.numeric import lit_double
from herdlens.operators.components import connected_components
from herdlens.operators.skew import lookup_join, numbered, shuffled
from herdlens.session import materialize

DIRECT_PAIRS = 4096  # two nodes with at most this many place pairs are compared directly
FACTOR = 4  # a finer level cuts each side of a box into this many parts
FINEST = 15  # 4**15 parts a side are numbered; places closer than that are compared directly
SPAN = 8  # a span of days is this many times ``eps_days``, so that most days are probed in one span

A, B = Bounds.of("a_"), Bounds.of("b_")
NODE = Bounds.of("")


@dataclass(frozen=True)
class Neighbourhood:
    grid: Grid
    days: int

    @staticmethod
    def of(eps_km: float, eps_days: float) -> "Neighbourhood":
        return Neighbourhood(Grid(float(eps_km)), int(math.floor(eps_days)))


def cells_of(points: DataFrame, lat: str, lon: str, day: str, order: str, grid: Grid) -> DataFrame:
    """One row per place and day: weight, first row, box, position within the box."""
    cells = points.groupBy(
        F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(day).cast("bigint").alias("day")
    ).agg(F.count(F.lit(1)).alias("weight"), F.min(order).alias("first"))
    boxes = F.col("_boxes")
    along = Grid.lon_place(F.col("lon"), boxes)
    return (
        cells.withColumn("_band", grid.band(F.col("lat")))
        .withColumn("_boxes", grid.boxes_in_band(F.col("_band")))
        .withColumn("_along", along)
        .select(
            "lat", "lon", "day", "weight", "first",
            Grid.box(F.col("_band"), F.pmod(F.floor("_along"), boxes)).alias("box"),
            (
                (F.col("lat") + lit_double(90.0)) / lit_double(grid.height) - F.col("_band").cast("double")
            ).alias("up"),
            (F.col("_along") - F.floor("_along").cast("double")).alias("across"),
        )
    )


def part(level: int) -> Column:
    """Number of a cell's finer box at ``level`` (0: the box itself)."""
    size = FACTOR**level

    def place(share: str) -> Column:
        at = F.floor(F.col(share) * lit_double(size)).cast("bigint")
        return F.greatest(F.lit(0), F.least(F.lit(size - 1), at))

    return F.shiftleft(place("up").cast("bigint"), 32) + place("across").cast("bigint")


def nodes_of(cells: DataFrame, level: int = 0) -> DataFrame:
    """Cells combined per box, day and finer box, with the next coarser part."""
    coarser = part(level - 1) if level else F.lit(0).cast("bigint")
    return cells.groupBy("box", "day", coarser.alias("parent"), part(level).alias("part")).agg(
        F.count(F.lit(1)).alias("places"),
        F.sum("weight").alias("weight"),
        *NODE.aggregates("lat", "lon"),
    )


def adjacent_boxes(cells: DataFrame, grid: Grid) -> DataFrame:
    """Pairs of occupied boxes that may hold neighbours, each box with itself."""
    boxes = cells.groupBy("box").agg(*NODE.aggregates("lat", "lon"))
    band = F.col("_band")
    near = F.col("_near_band")
    reach = F.col("_reach")
    count = F.col("_boxes")
    first = F.floor(Grid.lon_place(F.col("a_lon_low") - reach, count))
    last = F.floor(Grid.lon_place(F.col("a_lon_high") + reach, count))
    probes = (
        boxes.select(F.col("box"), *[F.col(c).alias(f"a_{c}") for c in NODE.columns()])
        .withColumn("_band", F.shiftright("box", 32))
        .withColumn("_near_band", F.explode(F.sequence(band - grid.reach, band + grid.reach)))
        .where(near.between(0, grid.bands))
        .withColumn("_boxes", grid.boxes_in_band(near))
        .withColumn("_reach", grid.lon_reach(band, near))
        .withColumn("_first", first)
        .withColumn("_last", F.least(last, F.col("_first") + count - 1))
        .withColumn("_column", F.explode(F.sequence(F.col("_first"), F.col("_last"))))
        .withColumn("near_box", Grid.box(near, F.pmod(F.col("_column"), count)))
    )
    others = boxes.select(
        F.col("box").alias("near_box"), *[F.col(c).alias(f"b_{c}") for c in NODE.columns()]
    )
    nearest, _ = nearest_and_farthest(A, B)
    return (
        probes.join(shuffled(others), "near_box")
        .where(nearest <= lit_double(grid.limit))
        .select("box", "near_box")
    )


def _as(df: DataFrame, prefix: str, columns: list) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])


NODE_COLUMNS = ["box", "day", "part", "places", "weight", *NODE.columns()]


def _judged(pairs: DataFrame, grid: Grid) -> DataFrame:
    """Keep pairs that are not surely apart; ``sure`` marks those surely near."""
    nearest, farthest = nearest_and_farthest(A, B)
    limit = lit_double(grid.limit)
    return pairs.withColumn("_nearest", nearest).where(F.col("_nearest") <= limit).withColumn(
        "sure", farthest <= limit
    ).drop("_nearest")


class _Finer:
    """Open cases between nodes, settled directly or one level finer at a time."""

    def __init__(self, cells: DataFrame, hood: Neighbourhood):
        self.cells = cells
        self.hood = hood

    def _direct(self, open_pairs: DataFrame, level: int) -> DataFrame:
        """Compare the places of few-place nodes one by one."""
        places = self.cells.select(
            F.col("box").alias("b_box"), F.col("day").alias("b_day"), part(level).alias("b_part"),
            F.col("lat").alias("b_lat_low"), F.col("lat").alias("b_lat_high"),
            F.col("lon").alias("b_lon_low"), F.col("lon").alias("b_lon_high"),
            F.col("weight").alias("b_weight"),
        )
        kept = [c for c in open_pairs.columns if c not in (*B.columns(), "b_weight", "sure")]
        return _judged(
            open_pairs.select(*kept).join(shuffled(places), ["b_box", "b_day", "b_part"]), self.hood.grid
        )

    def resolve(self, judged, near: DataFrame, crowded: DataFrame, name: str, expand_a, size: Column) -> list[DataFrame]:
        """Settled near pairs of nodes, as one or more tables.

        ``judged`` gives the judged pairs (level 0) of pairs of boxes, ``near`` are all
        of those and ``crowded`` those that may hold pairs too large to compare directly.
        ``size`` tells how many place pairs a pair of nodes stands for and
        ``expand_a`` replaces the left node by its places or finer nodes.
        """
        pairs = judged(near)
        settled = [pairs.where("sure")]
        small = size <= DIRECT_PAIRS
        settled.append(self._direct(expand_a(pairs.where("NOT sure").where(small), 0, True), 0))
        # All pairs are worked out once, where they are summed; those of crowded boxes once more.
        crowded = materialize(crowded, "crowded")
        if crowded.isEmpty():
            return settled
        # Each level cuts the sides of a box into FACTOR times as many parts, until
        # the places of a part are so few that all that is open has been compared.
        level = 0
        rest = materialize(judged(crowded).where("NOT sure").where(~small), name)
        while not rest.isEmpty():
            level += 1
            finer = _as(nodes_of(self.cells, level).withColumnRenamed("part", "_finer")
                        .withColumnRenamed("parent", "part").withColumnRenamed("_finer", "finer"),
                        "b_", [*NODE_COLUMNS, "finer"])
            kept = [c for c in rest.columns if c not in (*B.columns(), "b_places", "b_weight", "sure")]
            judged = _judged(
                expand_a(rest.select(*kept), level, False)
                .join(shuffled(finer), ["b_box", "b_day", "b_part"])
                .drop("b_part").withColumnRenamed("b_finer", "b_part"),
                self.hood.grid,
            )
            judged = materialize(judged, name)
            settled.append(judged.where("sure"))
            open_pairs = judged.where("NOT sure")
            few = small | F.lit(level == FINEST)
            settled.append(self._direct(expand_a(open_pairs.where(few), level, True), level))
            rest = materialize(open_pairs.where(~few), name)
        return settled


def _span(day: Column, days: int) -> Column:
    return F.floor(day / max(1, SPAN * days)).cast("bigint")


def _days_around(
    sent: DataFrame, met: DataFrame, keys: list, days: int, day: str = "a_day", other: str = "b_day"
) -> DataFrame:
    """Join on ``keys`` and days at most ``days`` apart, however many days these are.

    Rows of ``sent`` go to the spans that their ``day`` reaches, two at most, rows of ``met`` to that of ``other``.
    """
    reached = F.sequence(_span(F.col(day) - days, days), _span(F.col(day) + days, days))
    joined = sent.withColumn("_span", F.explode(reached)).join(
        shuffled(met.withColumn("_span", _span(F.col(other), days))), [*keys, "_span"]
    )
    return joined.where(F.abs(F.col("a_day") - F.col("b_day")) <= days).drop("_span")


def _crowded(near: DataFrame, nodes: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """Pairs of boxes of ``near`` that may hold two nodes (without ``left``: a place and a node) too large to compare."""
    most = nodes.groupBy("box").agg(F.max("places").alias("_b"))
    if left is None:
        many = most.where(F.col("_b") > DIRECT_PAIRS).select(F.col("box").alias("near_box"))
        return near.join(shuffled(many), "near_box", "left_semi")
    own = left.groupBy("box").agg(F.max("places").alias("_a"))
    both = near.join(shuffled(own), "box").join(shuffled(most.withColumnRenamed("box", "near_box")), "near_box")
    return both.where(F.col("_a") * F.col("_b") > DIRECT_PAIRS).select("box", "near_box")


def _point_pairs(points: DataFrame, nodes: DataFrame, near: DataFrame, hood: Neighbourhood) -> DataFrame:
    """Judged pairs of single cells (left) and nodes around them (right).

    The nodes, one for a box and day, go to the boxes and spans around them; each cell goes to its own.
    """
    places = points.select(
        F.col("first").alias("a_first"), F.col("box").alias("a_box"), F.col("day").alias("a_day"),
        F.col("lat").alias("a_lat_low"), F.col("lon").alias("a_lon_low"),
    )
    sent = _as(nodes, "b_", NODE_COLUMNS).join(shuffled(_as_near(near)), "b_box")
    met = _days_around(sent, places, ["a_box"], hood.days, day="b_day", other="a_day")
    return _judged(met.withColumns({"a_lat_high": F.col("a_lat_low"), "a_lon_high": F.col("a_lon_low")}), hood.grid)


def _as_near(near: DataFrame) -> DataFrame:
    return near.select(F.col("box").alias("a_box"), F.col("near_box").alias("b_box"))


def _union(frames: list[DataFrame], columns: list) -> DataFrame:
    out = frames[0].select(*columns)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*columns))
    return out


def _left_is_point(pairs: DataFrame, level: int, direct: bool) -> DataFrame:
    return pairs


def _left_side(cells: DataFrame):
    """Replaces left nodes by their places (with ``a_first``) or finer nodes."""

    def expand(open_pairs: DataFrame, level: int, direct: bool) -> DataFrame:
        if direct:
            left = cells.select(
                F.col("box").alias("a_box"), F.col("day").alias("a_day"), part(level).alias("a_part"),
                F.col("first").alias("a_first"),
                F.col("lat").alias("a_lat_low"), F.col("lat").alias("a_lat_high"),
                F.col("lon").alias("a_lon_low"), F.col("lon").alias("a_lon_high"),
            )
            kept = [c for c in open_pairs.columns if c not in A.columns()]
            return open_pairs.select(*kept).join(shuffled(left), ["a_box", "a_day", "a_part"])
        finer = _as(nodes_of(cells, level).withColumnRenamed("part", "_finer")
                    .withColumnRenamed("parent", "part").withColumnRenamed("_finer", "finer"),
                    "a_", ["box", "day", "part", "places", "finer", *NODE.columns()])
        kept = [c for c in open_pairs.columns if c not in (*A.columns(), "a_places")]
        return (
            open_pairs.select(*kept).join(shuffled(finer), ["a_box", "a_day", "a_part"])
            .drop("a_part").withColumnRenamed("a_finer", "a_part")
        )

    return expand


def neighbour_weight(cells: DataFrame, near: DataFrame, hood: Neighbourhood) -> DataFrame:
    """Weight around every cell, itself included, as (first, near_weight).

    Nodes are compared with nodes and both sides are refined, so cells of nodes
    that are surely near share one sum and are never paired.
    """
    nodes = materialize(nodes_of(cells), "nodes")

    def judged(near: DataFrame) -> DataFrame:
        left = _as(nodes, "a_", ["box", "day", "part", "places", *NODE.columns()]).join(shuffled(_as_near(near)), "a_box")
        return _judged(_days_around(left, _as(nodes, "b_", NODE_COLUMNS), ["b_box"], hood.days), hood.grid)

    settled = _Finer(cells, hood).resolve(
        judged, near, _crowded(near, nodes, nodes), "count", _left_side(cells), F.col("a_places") * F.col("b_places")
    )
    sums = []
    for i, table in enumerate(settled):  # by turns nodes surely near and places compared, level by level
        if i % 2:
            sums.append(table.groupBy(F.col("a_first").alias("first")).agg(F.sum("b_weight").alias("near_weight")))
            continue
        keys = ["a_box", "a_day", "a_part"]
        by_node = table.groupBy(*keys).agg(F.sum("b_weight").alias("near_weight"))
        places = cells.select(
            "first", F.col("box").alias("a_box"), F.col("day").alias("a_day"), part(i // 2).alias("a_part")
        )
        sums.append(lookup_join(places, by_node, keys, "inner", broadcasts=False).select("first", "near_weight"))
    return _union(sums, ["first", "near_weight"]).groupBy("first").agg(F.sum("near_weight").alias("near_weight"))


def near_weight(
    points: DataFrame, cells: DataFrame, nodes: DataFrame, near: DataFrame, hood: Neighbourhood
) -> DataFrame:
    """Weight of the cells around each of ``points``, as (first, near_weight); ``nodes`` are those of ``cells``."""
    settled = _Finer(cells, hood).resolve(
        lambda near: _point_pairs(points, nodes, near, hood),
        near, _crowded(near, nodes), "count", _left_is_point, F.col("b_places"),
    )
    return (
        _union(settled, ["a_first", "b_weight"])
        .groupBy(F.col("a_first").alias("first"))
        .agg(F.sum("b_weight").alias("near_weight"))
    )


def mark_core(cells: DataFrame, near: DataFrame, hood: Neighbourhood, min_samples: int) -> DataFrame:
    """Cells with ``core``: at least ``min_samples`` rows around, own row included."""
    by_day = Window.partitionBy("box").orderBy("day").rangeBetween(-hood.days, hood.days)
    nodes = materialize(nodes_of(cells), "nodes")
    own = nodes.select("box", "day", F.sum("weight").over(by_day).alias("own_weight"))
    counted = materialize(lookup_join(cells, own, ["box", "day"], broadcasts=False), "counted")
    # Sparse cells only: fewer than min_samples rows share their box and days.
    sparse = counted.where(F.col("own_weight") < min_samples)
    others = near.where("box != near_box")
    around = near_weight(sparse, counted, nodes, others, hood)
    enough = F.col("own_weight") + F.coalesce("near_weight", F.lit(0)) >= min_samples
    return counted.join(shuffled(around), "first", "left").withColumn("core", enough).drop("near_weight")


def core_runs(core: DataFrame, days: int) -> DataFrame:
    """Core nodes per box and day; days of a box at most ``days`` apart share a run.

    ``run`` is the first core row of the run, a unique number.
    """
    by_day = Window.partitionBy("box").orderBy("day")
    starts = (F.col("day") - F.lag("day").over(by_day) > days).cast("int")
    nodes = core.groupBy("box", "day").agg(
        F.lit(0).cast("bigint").alias("part"),
        F.count(F.lit(1)).alias("places"),
        F.sum("weight").alias("weight"),
        F.min("first").alias("_first"),
        *NODE.aggregates("lat", "lon"),
    )
    stretched = nodes.withColumn("_start", F.coalesce(starts, F.lit(0))).withColumn(
        "_stretch", F.sum("_start").over(by_day)
    )
    return stretched.withColumn(
        "run", F.min("_first").over(Window.partitionBy("box", "_stretch"))
    ).select(*NODE_COLUMNS, "run")


def linked_runs(core: DataFrame, runs: DataFrame, near: DataFrame, hood: Neighbourhood) -> DataFrame:
    """Edges (u, v) between runs of different boxes that have a core pair within reach."""
    node = _as(runs, "a_", ["run", "box", "day", "part", "places", *NODE.columns()])
    other = _as(runs, "b_", ["run", *NODE_COLUMNS])

    def judged(near: DataFrame) -> DataFrame:
        sides = node.join(shuffled(_as_near(near)), "a_box")
        return _judged(_days_around(sides, other, ["b_box"], hood.days), hood.grid)

    ahead = near.where("box < near_box")
    settled = _Finer(core, hood).resolve(
        judged, ahead, _crowded(ahead, runs, runs), "link", _left_side(core), F.col("a_places") * F.col("b_places")
    )
    return _union(settled, ["a_run", "b_run"]).select(
        F.col("a_run").alias("u"), F.col("b_run").alias("v")
    ).distinct()


def st_dbscan(
    points: DataFrame,
    eps_km: float | None = None,
    eps_days: float | None = None,
    min_samples: int | None = None,
    lat: str = "latitude",
    lon: str = "longitude",
    day: str = "day_offset",
    order: str = "report_id",
    cfg: Config = DEFAULT,
) -> DataFrame:
    """Add ``st_cluster``: -1 for noise, else 0, 1, ... in order of first core row.

    ``order`` is a unique whole number per row. Rows without a day or coordinates
    are noise.
    """
    eps_km = cfg.eps_km if eps_km is None else eps_km
    eps_days = cfg.eps_days if eps_days is None else eps_days
    min_samples = cfg.min_samples if min_samples is None else min_samples
    hood = Neighbourhood.of(eps_km, eps_days)

    # Rows without a day or coordinates have no neighbours: noise.
    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(day).isNotNull()
    placed = placed & ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lon).cast("double"))
    cells = materialize(cells_of(points.where(placed), lat, lon, day, order, hood.grid), "cells")
    near = materialize(adjacent_boxes(cells, hood.grid), "near")

    marked = materialize(mark_core(cells, near, hood, min_samples), "marked")
    core = marked.where("core")
    runs = materialize(core_runs(core, hood.days), "runs")
    edges = linked_runs(core, runs, near, hood)
    joined = connected_components(edges)

    labelled = runs.join(shuffled(joined), runs.run == joined.node, "left").withColumn(
        "component", F.coalesce("component", "run")
    )
    clusters = numbered(labelled.select("component").distinct(), ["component"], "st_cluster", start=0)
    runs_out = labelled.join(shuffled(clusters), "component").select(*NODE_COLUMNS, "st_cluster")

    core_labels = lookup_join(
        core.select("lat", "lon", "day", "box"), runs_out.select("box", "day", "st_cluster"), ["box", "day"], "inner",
        broadcasts=False,
    ).select("lat", "lon", "day", "st_cluster")
    fringe = marked.where("NOT core")
    reached = border_clusters(fringe, core, runs_out, near, hood)
    fringe_labels = fringe.join(shuffled(reached), "first", "left").select(
        "lat", "lon", "day", F.coalesce("st_cluster", F.lit(-1).cast("bigint")).alias("st_cluster")
    )
    labels = core_labels.unionByName(fringe_labels).select(
        F.col("lat").alias(lat), F.col("lon").alias(lon), F.col("day").alias("_day"), "st_cluster"
    )
    joined = lookup_join(points.withColumn("_day", F.col(day).cast("bigint")), labels, [lat, lon, "_day"], broadcasts=False)
    return joined.withColumn("st_cluster", F.coalesce("st_cluster", F.lit(-1).cast("bigint"))).select(
        *points.columns, "st_cluster"
    )


def border_clusters(
    fringe: DataFrame, core: DataFrame, runs: DataFrame, near: DataFrame, hood: Neighbourhood
) -> DataFrame:
    """Lowest cluster with a core cell in reach of each non-core cell."""
    settled = _Finer(core, hood).resolve(
        lambda near: _point_pairs(fringe, runs, near, hood),
        near, _crowded(near, runs), "border", _left_is_point, F.col("b_places"),
    )
    found = _union(settled, ["a_first", "b_box", "b_day"]).distinct()
    cluster = runs.select(F.col("box").alias("b_box"), F.col("day").alias("b_day"), "st_cluster")
    return (
        found.join(shuffled(cluster), ["b_box", "b_day"])
        .groupBy(F.col("a_first").alias("first"))
        .agg(F.min("st_cluster").alias("st_cluster"))
    )
