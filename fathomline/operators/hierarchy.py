"""Parent-child links of unknown depth turned into full hierarchies.

The frontier of known nodes starts at the roots (parents that are nobody's
child) and moves down one level per round: the links whose parent stands in the
frontier give the next frontier with root, depth and path extended. A link that
is never reached has no root above it, so its way up runs in a circle.

Scale: a round joins the links not yet used with one level only. Each level is
written once to the shared scratch folder, so lineage stays flat and the
planner knows the level's true size (it broadcasts a level only below its own
size threshold, and otherwise sorts and merges with adaptive skew splitting for
parents with very many children). When most of the remaining links are used up
they are compacted, so the links read over all rounds stay proportional to the
links plus the deep tail. Nothing is collected to the driver but row counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.session import drop_path, materialize


@dataclass
class Hierarchy:
    """``nodes``: scope..., node, parent, root, depth, path of every node.

    Roots have a null parent, depth 0 and themselves as root. Nodes whose way
    up never ends have root ``''``, depth -1 and a null path. ``dropped``: the
    links (scope..., node, parent) that lost to another link of their node.
    """

    nodes: DataFrame
    scope: list[str]
    levels: int = 0
    paths: list[str] = field(default_factory=list)
    dropped: DataFrame | None = None
    has_paths: bool = True

    def linked(self) -> DataFrame:
        """Nodes that have a parent."""
        return self.nodes.where(F.col("parent").isNotNull())

    def descendants(self) -> DataFrame:
        """One row per (ancestor, descendant) with their distance; none for nodes without a root.

        The pairs come from the paths, without another join.
        """
        if not self.has_paths:
            raise ValueError("the hierarchy was built without paths")
        pairs = self.nodes.where("depth > 0").select(
            *self.scope, F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor")
        )
        return pairs.where("at < depth").select(*self.scope, "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))

    def circular(self) -> DataFrame:
        """Nodes whose way up never ends, with ``on_circle`` for those on the circle itself.

        Nodes without an unreached child are peeled off level by level; what is
        left has a child on the same circle.
        """
        left = self.nodes.where("depth = -1").select(*self.scope, "node", "parent")
        current, n, path = materialize(left, "circles")
        peeled = []
        while n:
            parents = current.select(*self.scope, F.col("parent").alias("node")).distinct()
            on = [current[c].eqNullSafe(parents[c]) for c in self.scope] + [current["node"] == parents["node"]]
            kept, m, next_path = materialize(current.join(parents, on, "left_semi"), "circles")
            if m == n:
                drop_path(left.sparkSession, next_path)
                break
            peeled.append(current.join(kept, [current[c].eqNullSafe(kept[c]) for c in self.scope] + [current["node"] == kept["node"]], "left_anti"))
            current, n = kept, m
        flagged = [current.withColumn("on_circle", F.lit(True))] + [p.withColumn("on_circle", F.lit(False)) for p in peeled]
        return reduce(DataFrame.unionByName, flagged)


def build_hierarchy(links: DataFrame, child: Column | str, parent: Column | str, scope: dict[str, Column | str] | None = None, newest: Column | str | None = None, several: str = "newest", paths: bool = True) -> Hierarchy:
    """Resolve ``links`` into a :class:`Hierarchy`.

    scope: columns within which a name identifies a node (a null is a scope of its own).
    newest: decides between several links of one child: the greatest value wins, then the greatest parent.
    several: what to do where a child has several parents, which no tree can
    hold: ``newest`` takes one and gives the others as ``dropped``; ``error``
    raises, naming their number.
    paths: without them the nodes carry no paths, which spares their size.

    Defined cases: a link with a null or empty child or parent is no link (but
    a node named by it as parent of another link still counts through that
    link); repeated links count once; a self link is a circle; an empty table
    gives an empty hierarchy; other columns of ``links`` are ignored, whatever
    their names.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    scope = scope or {}
    names = list(scope)
    rows = links.select(
        *[as_column(c).alias(n) for n, c in scope.items()],
        as_column(child).alias("node"),
        as_column(parent).alias("parent"),
        (as_column(newest) if newest is not None else F.lit(0)).alias("_newest"),
    ).where((F.length("node") > 0) & (F.length("parent") > 0))
    edges, total, edge_path = materialize(
        rows.groupBy(*names, "node").agg(F.max(F.struct("_newest", "parent")).alias("_top")).select(*names, "node", F.col("_top.parent").alias("parent")),
        "links",
    )
    spark = links.sparkSession
    every = rows.select(*names, "node", "parent").distinct()
    dropped = every.join(edges, reduce(lambda x, y: x & y, [every[n].eqNullSafe(edges[n]) for n in names], (every["node"] == edges["node"]) & (every["parent"] == edges["parent"])), "left_anti")
    if several == "error":
        n_dropped = dropped.count()
        if n_dropped:
            raise ValueError(f"{n_dropped} links give a node a second parent")
    elif several != "newest":
        raise ValueError("several must be newest or error")
    own_path = (lambda column: column) if paths else (lambda column: F.lit(None).cast("array<string>"))

    def same(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
        return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names], a[left] == b[right])

    children = edges.select(*names, F.col("node").alias("child"))
    tops = edges.select(*names, F.col("parent").alias("node")).distinct()
    frontier, n, path = materialize(
        tops.join(children, same(tops, children, "node", "child"), "left_anti").select(
            *names, "node", F.lit(None).cast("string").alias("parent"), F.col("node").alias("root"), F.lit(0).alias("depth"), own_path(F.array("node")).alias("path")
        ),
        "level",
    )
    level_paths, temporary = [path], []
    remaining, left, since = edges, total, []
    while n and left:
        above = frontier.select(*[F.col(c).alias(f"_{c}") for c in names], F.col("node").alias("_node"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        on = reduce(lambda x, y: x & y, [remaining[c].eqNullSafe(above[f"_{c}"]) for c in names], remaining["parent"] == above["_node"])
        frontier, n, path = materialize(
            remaining.join(above, on).select(
                *names, "node", "parent", F.col("_root").alias("root"), (F.col("_depth") + 1).alias("depth"), own_path(F.concat(F.col("_path"), F.array("node"))).alias("path")
            ),
            "level",
        )
        level_paths.append(path)
        since.append((path, n))
        used = sum(k for _, k in since)
        if used == left:
            break
        if n and 2 * used >= left:
            done = spark.read.schema(frontier.schema).parquet(*[p for p, k in since if k]).select(*names, F.col("node").alias("_done"))
            remaining, left, kept = materialize(remaining.join(done, same(remaining, done, "node", "_done"), "left_anti"), "links")
            temporary.append(kept)
            since = []
    reached = spark.read.schema(frontier.schema).parquet(*level_paths)
    met = reached.where("depth > 0").select(*names, F.col("node").alias("_met"))
    lost = edges.join(met, same(edges, met, "node", "_met"), "left_anti").select(
        *names, "node", "parent", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path")
    )
    for p in temporary:
        drop_path(spark, p)
    return Hierarchy(reached.unionByName(lost), names, len(level_paths) - 1, [edge_path, *level_paths], dropped, paths)
