"""Relations between technologies of one record: requirement gates, implied technologies, exclusions.

The graph of a record is small (its own detections and what they imply), and the
rules are sequential by nature, so it is resolved in memory, record by record.
Records meet the relations of their catalog revision in a co-grouped map keyed
by (revision, slice): a revision has as many slices as its rows need (at most
about ``SLICE_ROWS`` rows a slice) and its edges (bounded by the catalog) are
copied to these slices only, so a revision that most records share makes no hot
task and one with few records no copies.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from fathomline.session import ensure_workers_import


@dataclass
class Relations:
    """implies: name to (target, rule_id, confidence, version); requires and excludes: name to names; categories by name and required by name."""

    implies: dict[str, list[tuple[str, str | None, int, str | None]]] = field(default_factory=lambda: defaultdict(list))
    requires: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    requires_category: dict[str, set[int]] = field(default_factory=lambda: defaultdict(set))
    excludes: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    categories: dict[str, set[int]] = field(default_factory=lambda: defaultdict(set))


def admit(direct: dict[str, int], relations: Relations) -> set[str]:
    """Detections that pass their gate.

    A gate is one OR over required names and categories, met by any *other*
    available technology: an admitted one or anything reachable by implication
    from one. Work is proportional to names and edges.
    """
    waiting_name, waiting_category = defaultdict(list), defaultdict(list)
    admitted, available, todo = set(), set(), deque()

    def enter(name: str) -> None:
        if name not in available:
            available.add(name)
            todo.append(name)

    for name in direct:
        names, kinds = relations.requires.get(name, ()), relations.requires_category.get(name, ())
        if not names and not kinds:
            admitted.add(name)
        for other in names:
            waiting_name[other].append(name)
        for kind in kinds:
            waiting_category[kind].append(name)
    for name in list(admitted):
        enter(name)
    while todo:
        name = todo.popleft()
        for target, *_ in relations.implies.get(name, ()):
            enter(target)
        kept = {}
        for table, keys in ((waiting_name, (name,)), (waiting_category, relations.categories.get(name, ()))):
            for key in keys:
                for gated in table.pop(key, ()):
                    if gated == name:
                        kept.setdefault((id(table), key), (table, key, []))[2].append(gated)
                    elif gated not in admitted:
                        admitted.add(gated)
                        enter(gated)
        for table, key, names in kept.values():
            table[key] = names
    return admitted


Inferred = dict[str, tuple[int, int, list[tuple[str, str | None, int, str | None]]]]


def imply(direct: dict[str, int], relations: Relations, forbidden: frozenset[str] | set[str] = frozenset(), allowed: set[str] | None = None) -> Inferred:
    """Implied technologies: name to (confidence, hops, winning parents).

    Widest path from any detection: the highest smallest confidence on the way,
    then the fewest hops. Detections are ends: never targets, never passed
    through as implied. All parents tied for the best label are kept.
    """
    done: Inferred = {}
    best: dict[str, tuple[int, int]] = {}
    parents: dict[str, dict] = {}
    heap = [(-confidence, 0, name) for name, confidence in direct.items()]
    heapq.heapify(heap)
    while heap:
        negative, hops, name = heapq.heappop(heap)
        if name not in direct:
            if name in done or best[name] != (-negative, hops):
                continue
            done[name] = (-negative, hops, [])
        for target, rule, confidence, version in relations.implies.get(name, ()):
            if target in direct or target in forbidden or target in done or (allowed is not None and target not in allowed):
                continue
            label = (min(-negative, confidence), hops + 1)
            known = best.get(target)
            if known is None or label[0] > known[0] or (label[0] == known[0] and label[1] < known[1]):
                best[target] = label
                parents[target] = {(name, rule, confidence, version): label[0]}
                heapq.heappush(heap, (-label[0], label[1], target))
            elif label == known:
                parents[target][(name, rule, confidence, version)] = label[0]
    order = lambda p: tuple((x is not None, x) for x in p)
    return {n: (c, h, sorted(((p, rule, capped, v) for (p, rule, _, v), capped in parents[n].items()), key=order)) for n, (c, h, _) in done.items()}


def components(nodes: set[str], edges: dict[str, set[str]]) -> list[list[str]]:
    """Strongly connected components by two passes of depth-first search."""
    order, seen = [], set()
    for root in sorted(nodes):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(edges.get(root, ())))]
        while stack:
            name, rest = stack[-1]
            for target in rest:
                if target in nodes and target not in seen:
                    seen.add(target)
                    stack.append((target, iter(edges.get(target, ()))))
                    break
            else:
                order.append(name)
                stack.pop()
    backward = defaultdict(list)
    for name in nodes:
        for target in edges.get(name, ()):
            if target in nodes:
                backward[target].append(name)
    out, placed = [], set()
    for root in reversed(order):
        if root in placed:
            continue
        placed.add(root)
        group, stack = [root], [root]
        while stack:
            for source in backward[stack.pop()]:
                if source not in placed:
                    placed.add(source)
                    group.append(source)
                    stack.append(source)
        out.append(group)
    return out


def exclude(nodes: dict[str, tuple[bool, int]], excludes: dict[str, set[str]]) -> tuple[set[str], set[str]]:
    """(retained, suppressed) of nodes name to (direct, confidence).

    Nodes that nothing left excludes are retained as a batch and suppress what
    they exclude; a suppressed node excludes nothing. Where only circles are
    left, each circle that nothing outside excludes keeps its best node (direct
    first, then confidence, then name) and suppresses its others.
    """
    edges = {n: {t for t in excludes.get(n, ()) if t in nodes} for n in nodes}
    into = dict.fromkeys(nodes, 0)
    for targets in edges.values():
        for t in targets:
            into[t] += 1
    left, retained, suppressed = set(nodes), set(), set()
    batch = [n for n in nodes if not into[n]]

    def remove(name: str, free: list[str]) -> None:
        left.discard(name)
        for t in edges[name]:
            if t in left:
                into[t] -= 1
                if not into[t]:
                    free.append(t)

    while left:
        if batch:
            gone = set()
            for name in batch:
                retained.add(name)
                gone.update(t for t in edges[name] if t in left)
            free: list[str] = []
            gone -= set(batch)
            suppressed |= gone
            for name in (*batch, *gone):
                left.discard(name)
            for name in (*batch, *gone):
                remove(name, free)
            batch = [n for n in free if n in left]
            continue
        groups = components(left, edges)
        place = {n: i for i, g in enumerate(groups) for n in g}
        reached = {place[t] for n in left for t in edges[n] if t in left and place[t] != place[n]}
        free = []
        for i, group in enumerate(groups):
            if i in reached:
                continue
            winner = min(group, key=lambda n: (not nodes[n][0], -nodes[n][1], n))
            losers = [n for n in group if n != winner]
            suppressed |= set(losers)
            for n in losers:
                left.discard(n)
            for n in losers:
                remove(n, free)
            if not losers:
                into[winner] = 0
                free.append(winner)
        batch = [n for n in dict.fromkeys(free) if n in left]
    return retained, suppressed


def resolve(direct: dict[str, int], relations: Relations) -> tuple[list[tuple], tuple[int, int, int, int]]:
    """Final technologies (name, type, confidence, hops, parents) and counts (raw, gated, suppressed, retained)."""
    passed = admit(direct, relations)
    admitted = {n: c for n, c in direct.items() if n in passed}
    implied = imply(admitted, relations)
    if not any(n in relations.excludes for n in (*admitted, *implied)):
        rows = [(n, "direct", c, 0, []) for n, c in admitted.items()] + [(n, "inferred", c, h, p) for n, (c, h, p) in implied.items()]
        return sorted(rows), (len(direct), len(direct) - len(admitted), 0, len(admitted))
    nodes = {n: (True, c) for n, c in admitted.items()} | {n: (False, c) for n, (c, _, _) in implied.items()}
    retained, suppressed = exclude(nodes, relations.excludes)
    kept = {n: c for n, c in admitted.items() if n in retained}
    final = imply(kept, relations, forbidden=suppressed, allowed=retained)
    rows = [(n, "direct", c, 0, []) for n, c in kept.items()] + [(n, "inferred", c, h, p) for n, (c, h, p) in final.items()]
    return sorted(rows), (len(direct), len(direct) - len(admitted), len(admitted) - len(kept), len(kept))


def direct_names(direct: dict[str, int], relations: Relations) -> tuple[list[str], tuple[int, int, int, int]]:
    """The direct technologies of :func:`resolve` and its counts; where nothing is excluded, implied ones need no working out."""
    if relations.excludes:
        rows, counts = resolve(direct, relations)
        return [n for n, kind, *_ in rows if kind == "direct"], counts
    passed = admit(direct, relations)
    names = sorted(n for n in direct if n in passed)
    return names, (len(direct), len(direct) - len(names), 0, len(names))


EDGE_SCHEMA = "revision string, kind string, name string, target string, rule_id string, confidence int, version string, category int"
RESULT = "type string, confidence int, hops int, parents array<struct<technology:string,rule_id:string,confidence:int,version:string>>, inferred_version string"


def relations_of(edges: Iterable[dict]) -> Relations:
    out = Relations()
    for e in edges:
        kind, name, target = e["kind"], e["name"], e["target"]
        if kind == "implies":
            out.implies[name].append((target, e["rule_id"], int(e["confidence"]), e["version"]))
        elif kind == "requires":
            out.requires[name].add(target)
        elif kind == "excludes":
            out.excludes[name].add(target)
        elif kind == "category":
            out.categories[name].add(int(e["category"]))
        elif kind == "requires_category":
            out.requires_category[name].add(int(e["category"]))
    return out


#: Rows of a slice of a revision, on average at most.
SLICE_ROWS = 100_000
#: Slices in all, at least: they keep all cores busy where there are few revisions; many revisions need no copies for that.
LEAST_SLICES = 32


def slices(rows: DataFrame, slice_rows: int) -> DataFrame:
    """revision, _slices: into how many slices the rows of each revision are cut."""
    counted = rows.groupBy("revision").agg(F.count(F.lit(1)).alias("_n"))
    least = F.ceil(F.lit(LEAST_SLICES) / F.count(F.lit(1)).over(Window.partitionBy()))
    return counted.select("revision", F.greatest(least, F.ceil(F.col("_n") / slice_rows)).cast("long").alias("_slices"))


def resolve_technologies(direct: DataFrame, edges: DataFrame, record: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Admission, implication and exclusion for every record.

    direct: record, revision, technology, confidence (one row per technology of
    a record, or one per record with arrays of both); edges: :data:`EDGE_SCHEMA`, of the revisions. Gives record,
    technology, type, confidence, hops, parents, inferred_version, raw_direct,
    gated_direct, suppressed_direct, retained_direct; a record whose directs are
    all gated or suppressed still gives one row with a null technology.

    Defined cases: a null revision has no edges; rows without technology or with
    no positive confidence are left out; repeated rows count once, with the
    highest confidence.
    """
    spark = direct.sparkSession
    ensure_workers_import(spark)
    packed = isinstance(direct.schema["technology"].dataType, ArrayType)
    if packed:  # a row stands for many
        slim, slice_rows = direct.select(*record, F.coalesce("revision", F.lit("")).alias("revision"), "technology", "confidence"), max(1, slice_rows // 100)
    else:
        slim = direct.where("technology IS NOT NULL AND confidence > 0").select(*record, F.coalesce("revision", F.lit("")).alias("revision"), "technology", F.col("confidence").cast("int").alias("confidence"))
    sizes = slices(slim, slice_rows)
    left = slim.join(sizes, "revision").withColumn("_slice", F.pmod(F.xxhash64(*record), F.col("_slices"))).drop("_slices")
    right = edges.where("revision IS NOT NULL").join(sizes, "revision").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    types = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in record)
    schema = f"{types}, technology string, {RESULT}, raw_direct int, gated_direct int, suppressed_direct int, retained_direct int"

    result = to_arrow_schema(StructType.fromDDL(schema))

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        relations = relations_of(known.to_pylist())
        detected: dict[tuple, dict[str, int]] = defaultdict(dict)
        for *keys, name, confidence in zip(*[rows[c].to_pylist() for c in (*record, "technology", "confidence")]):
            own = detected[tuple(keys)]
            for n, c in zip(name, confidence) if packed else ((name, confidence),):
                if n is not None and c > 0:
                    own[n] = max(own.get(n, 0), c)
        out: list[tuple] = []
        for keys, own in detected.items():
            if not own:
                continue
            found, counts = resolve(own, relations)
            for name, kind, confidence, hops, parents in found or [(None, None, None, None, [])]:
                versions = {v for *_, v in parents if v is not None}
                tied = [{"technology": p, "rule_id": r, "confidence": c, "version": v} for p, r, c, v in parents]
                out.append((*keys, name, kind, confidence, hops, tied, versions.pop() if len(versions) == 1 else None, *counts))
        columns = zip(*out) if out else [()] * len(result)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, result)], schema=result)

    return left.groupBy("revision", "_slice").cogroup(right.groupBy("revision", "_slice")).applyInArrow(run, schema)
