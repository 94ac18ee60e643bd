"""Density topics: groups of texts that lie in connected dense regions of the vector space.

Comparing texts pairwise grows with the square of the largest group.  Instead the unit sphere is
cut into small cells; texts are counted per cell, and everything after that is about cells.  The
number of cells is limited by the geometry, whatever the number of texts or copies of a text.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civictopics.functions.vectors import sum_of
from civictopics.storage import cut


class Grid:
    """Cells of the given width over unit vectors with ``k`` coordinates."""

    def __init__(self, k: int, width: float):
        self.k, self.width = k, width
        self.half = math.ceil(1 / width)
        # One spare cell on either side, so that a neighbour's key never wraps around.
        self.base = 2 * self.half + 3
        if self.base**k >= 1 << 63:
            raise ValueError(f"keys of {k} coordinates in cells of width {width} do not fit a long")

    def key(self, unit: Sequence[Column]) -> Column:
        steps = [F.floor(F.round(u, 9) / self.width) + (self.half + 1) for u in unit]
        return sum_of([step * self.base**i for i, step in enumerate(steps)])

    def later_neighbours(self) -> list[int]:
        """Key differences to half of the adjacent cells; the other half are their negatives."""
        deltas = (
            sum(d * self.base**i for i, d in enumerate(step))
            for step in itertools.product((-1, 0, 1), repeat=self.k)
        )
        return sorted(delta for delta in deltas if delta > 0)


def unit_coordinates(vector_col: str, k: int) -> list[Column]:
    """The vector scaled to length 1, one column per coordinate; nulls for a zero vector."""
    vector = F.col(vector_col)
    norm = F.sqrt(sum_of([vector[i] * vector[i] for i in range(k)]))
    return [F.try_divide(vector[i], norm) for i in range(k)]


def with_cells(df: DataFrame, k: int, width: float = 0.25, vector_col: str = "reduced") -> DataFrame:
    """Adds ``cell``, the key of the grid cell of the normalised vector; null for a zero vector."""
    grid = Grid(k, width)
    unit = df.withColumns({f"_u{i}": u for i, u in enumerate(unit_coordinates(vector_col, k))})
    names = [f"_u{i}" for i in range(k)]
    return unit.withColumn("cell", grid.key([F.col(n) for n in names])).drop(*names)


def cell_table(
    df: DataFrame, k: int, vector_col: str = "reduced", by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., cell, cnt, first_row, sum_0, ...)``: one row per occupied cell.

    Counts and coordinate sums are combined in the map tasks, so a cell that holds a third of all
    texts costs no more than any other.
    """
    unit = unit_coordinates(vector_col, k)
    return (
        df.filter(F.col("cell").isNotNull())
        .groupBy(*by, "cell")
        .agg(
            F.count("*").alias("cnt"),
            F.min("row_id").alias("first_row"),
            *[F.sum(u).alias(f"sum_{i}") for i, u in enumerate(unit)],
        )
    )


def similar_cells(
    cells: DataFrame, k: int, width: float = 0.25, sim: float = 0.9, by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., cell, other, sim, cnt)`` for adjacent cells whose mean vectors have cosine >= ``sim``.

    ``cnt`` is the size of ``other``; each link appears in both directions.  Neighbours are
    looked up by key, with a fixed number of probes per cell.
    """
    by = list(by)
    deltas = Grid(k, width).later_neighbours()
    left = cells.select(
        *by, "cell", F.col("cnt").alias("cnt_a"),
        *[F.col(f"sum_{i}").alias(f"a{i}") for i in range(k)],
        F.explode(F.transform(F.lit(deltas), lambda d: F.col("cell") + d)).alias("other"),
    )
    right = cells.select(
        *by, F.col("cell").alias("other"), F.col("cnt").alias("cnt_b"),
        *[F.col(f"sum_{i}").alias(f"b{i}") for i in range(k)],
    )

    def norm(side: str) -> Column:
        return F.sqrt(sum_of([F.col(f"{side}{i}") * F.col(f"{side}{i}") for i in range(k)]))

    inner = sum_of([F.col(f"a{i}") * F.col(f"b{i}") for i in range(k)])
    linked = (
        left.join(right, [*by, "other"])
        .withColumn("sim", F.round(F.try_divide(inner, norm("a") * norm("b")), 9))
        .filter(F.col("sim") >= sim)
    )
    there = linked.select(*by, "cell", "other", "sim", F.col("cnt_b").alias("cnt"))
    back = linked.select(
        *by, F.col("other").alias("cell"), F.col("cell").alias("other"), "sim",
        F.col("cnt_a").alias("cnt"),
    )
    return there.unionByName(back)


def connected_components(
    nodes: DataFrame, links: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., node, label)`` where ``label`` is the smallest node of the component.

    ``links (by..., node, other)`` holds both directions.  Each round gives every node, and the
    node it is labelled with, the smallest label around it, and then the label of that label.
    Whole chains shrink at once, so the number of rounds grows with the logarithm of their length.
    Every round is written to the shared folder, which keeps the plan short.
    """
    by = list(by)
    keys = [*by, "node"]
    labels = cut(nodes.select(*keys, F.col("node").alias("label")), "labels")
    while True:
        around = (
            links.join(labels.withColumnRenamed("node", "other"), [*by, "other"])
            .groupBy(*keys)
            .agg(F.min("label").alias("lowest"))
        )
        lowest = labels.join(around, keys, "left").select(
            *keys, "label", F.least("label", "lowest").alias("lowest")
        )
        proposals = lowest.select(*keys, "lowest").unionByName(
            lowest.select(*by, F.col("label").alias("node"), "lowest")
        )
        hooked = cut(proposals.groupBy(*keys).agg(F.min("lowest").alias("hook")), "labels")
        jump = hooked.select(*by, F.col("node").alias("hook"), F.col("hook").alias("new_label"))
        moved = cut(
            labels.join(hooked, keys).join(jump, [*by, "hook"]).select(*keys, "label", "new_label"),
            "labels",
        )
        labels = moved.select(*keys, F.col("new_label").alias("label"))
        if moved.filter("new_label <> label").isEmpty():
            return labels


def follow_pointers(pointers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., node, label)``: where the chain of ``pointers (by..., node, label)`` ends.

    An end points to itself.  Each round takes the label of the label, so chains halve.
    """
    by = list(by)
    keys = [*by, "node"]
    labels = cut(pointers.select(*keys, "label"), "pointers")
    while True:
        jump = labels.select(*by, F.col("node").alias("label"), F.col("label").alias("new_label"))
        moved = cut(labels.join(jump, [*by, "label"]).select(*keys, "label", "new_label"), "pointers")
        labels = moved.select(*keys, F.col("new_label").alias("label"))
        if moved.filter("new_label <> label").isEmpty():
            return labels


def cell_topics(
    cells: DataFrame,
    links: DataFrame,
    min_pts: int = 10,
    min_topic_size: int = 10,
    by: Sequence[str] = (),
    by_limits: DataFrame | None = None,
) -> DataFrame:
    """``(by..., cell, topic)`` for the cells that belong to a topic.

    The density of a cell is the number of texts in it and its linked cells.  A cell points to its
    most similar linked cell that is denser (ties to the smaller key), and those that point up to
    the same peak are a group.  Only densities are compared, so groups do not run together, or
    change, when all counts grow alike.  Groups whose peak is below ``min_pts``, or that hold fewer
    than ``min_topic_size`` texts, are outliers.  Topics are numbered by size, the largest is 0,
    equal sizes by their smallest ``row_id``.  ``by_limits (by..., min_pts, min_topic_size)`` sets
    the limits per run.
    """
    by = list(by)
    around = links.groupBy(*by, "cell").agg(F.sum("cnt").alias("around"))
    sized = cut(
        cells.select(*by, "cell", "cnt", "first_row").join(around, [*by, "cell"], "left").select(
            *by, "cell", "cnt", "first_row", (F.col("cnt") + F.coalesce("around", F.lit(0))).alias("density")
        ),
        "cells",
    )
    here = sized.select(*by, "cell", "density")
    there = sized.select(*by, F.col("cell").alias("other"), F.col("density").alias("higher"))
    denser = (F.col("higher") > F.col("density")) | (
        (F.col("higher") == F.col("density")) & (F.col("other") < F.col("cell"))
    )
    up = (
        links.select(*by, "cell", "other", "sim").join(here, [*by, "cell"]).join(there, [*by, "other"])
        .filter(denser)
        .groupBy(*by, "cell")
        .agg(F.max(F.struct("sim", (-F.col("other")).alias("minus"))).alias("best"))
        .select(*by, "cell", (-F.col("best.minus")).alias("label"))
    )
    pointers = here.join(up, [*by, "cell"], "left").select(
        *by, F.col("cell").alias("node"), F.coalesce("label", "cell").alias("label")
    )
    labels = follow_pointers(pointers, by).withColumnRenamed("node", "cell")
    grouped = cut(labels.join(sized, [*by, "cell"]), "grouped")
    groups = grouped.groupBy(*by, "label").agg(
        F.sum("cnt").alias("size"), F.min("first_row").alias("first_row"), F.max("density").alias("peak")
    )
    if by_limits is None:
        groups = groups.withColumns({"min_pts": F.lit(min_pts), "min_topic_size": F.lit(min_topic_size)})
    else:
        groups = groups.join(by_limits.select(*by, "min_pts", "min_topic_size"), by)
    groups = groups.filter((F.col("size") >= F.col("min_topic_size")) & (F.col("peak") >= F.col("min_pts")))
    order = Window.partitionBy(*by).orderBy(F.desc("size"), "first_row")
    numbered = groups.select(
        *by, "label", (F.row_number().over(order) - 1).cast("long").alias("topic")
    )
    return grouped.join(numbered, [*by, "label"]).select(*by, "cell", "topic")


def density_topics(
    df: DataFrame,
    k: int,
    width: float = 0.25,
    sim: float = 0.9,
    min_pts: int = 10,
    min_topic_size: int = 10,
    by: Sequence[str] = (),
    by_limits: DataFrame | None = None,
    vector_col: str = "reduced",
) -> DataFrame:
    """Adds ``topic`` to ``df (by..., row_id, reduced)``; -1 marks outliers.

    The topics of the cells are written as a small table, so that Spark knows its size when it
    plans the last join: it is broadcast when it is small and shuffled otherwise.
    """
    by = list(by)
    placed = with_cells(df, k, width, vector_col)
    cells = cut(cell_table(placed, k, vector_col, by), "cells")
    links = cut(similar_cells(cells, k, width, sim, by), "links")
    topics = cut(cell_topics(cells, links, min_pts, min_topic_size, by, by_limits), "cell-topics")
    return (
        placed.join(topics, [*by, "cell"], "left")
        .withColumn("topic", F.coalesce("topic", F.lit(-1).cast("long")))
        .select(*[c for c in df.columns if c != "topic"], "topic")
    )
