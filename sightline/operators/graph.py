"""Grids as graphs: neighbours, components, reachability, distances and regions.

Loops run on the driver, one bounded job a round, and cut their lineage by a
checkpoint in the shared folder. Edges are (src, dst, cost), both directions.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import cut

#: Half of the offsets around a cell; the other half are their mirror images.
HALF_OFFSETS = ((1, 0), (0, 1), (1, 1), (1, -1), (2, 0), (0, 2), (2, 1), (1, 2), (2, -1), (1, -2))


def grid_edges(cells: DataFrame, *, grid: float = 1.0, reach: float = 2.3, max_rise: float = 0.36, offsets: Sequence[tuple[int, int]] = HALF_OFFSETS, keep: Sequence[str] = ()) -> DataFrame:
    """Edges between cells (id, ix, iy, x, y, z) at the offsets, no farther than reach * grid apart and no steeper than max_rise.

    An equi-join on the shifted grid place, merged, as each cell is in it once for each
    offset; both directions come out, once each. `keep` may name `rise`, the difference in height.
    """
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets]))
    a = cells.select("*", step.alias("o")).select(F.col("id").alias("src"), (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    b = cells.select(F.col("id").alias("dst"), "ix", "iy", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    e = a.join(b.hint("merge"), ["ix", "iy"]).withColumn("flat", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).withColumn("rise", F.abs(F.col("az") - F.col("bz")))
    e = e.where((F.col("flat") <= reach * grid + 1e-9) & (F.col("rise") <= max_rise + 1e-9)).select("src", "dst", F.sqrt(F.col("flat") * F.col("flat") + F.col("rise") * F.col("rise")).alias("cost"), *keep)
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    return e.select(both, "cost", *keep).select("e.src", "e.dst", "cost", *keep)


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v), root being its component's least node.

    Alternating large and small stars: each round rewires every edge towards the
    least neighbour seen, the number of edges never grows, and the rounds grow with
    the logarithm of the longest chain. Least neighbours are aggregates joined back,
    never gathered lists, so a node with a great many edges is split like any skewed
    join, and they are merged, as a broadcast would hold a row for every node in the
    driver. No edges: no rows. Loops and repeated edges change nothing.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        e = cut(small.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Edges (u, v) with the components of those given: each range of them is replaced by a link from each node to the least that it reaches there.

    A long chain that runs along the order of the nodes so takes few rounds of
    components(). A task holds `most` nodes at once; what it has is then put out, and it begins anew.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        kind = None

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def out() -> pa.RecordBatch:
            n = [x for x in up if up[x] != x]
            return pa.RecordBatch.from_arrays([pa.array(n, kind), pa.array([root(x) for x in n], kind)], ["u", "v"])

        for b in batches:
            kind = b.schema.field("u").type
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                u, v = root(u), root(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
            if len(up) > most:
                yield out()
                up.clear()
        if up:
            yield out()

    kind = dict(e.dtypes)["u"]
    return e.repartitionByRange("v").mapInArrow(links, f"u {kind}, v {kind}")


def components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, size, component): isolated nodes are their own; components are numbered by (-size, root).

    Ranges of edges are linked to their least nodes first. Only those least nodes that
    share a node meet in the rounds of components(), the others are looked up.
    """
    links = cut(forest(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))))
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    heads = links.select(F.col("v").alias("u")).distinct()
    shared = links.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    tops = components(shared.unionByName(least.join(heads.hint("merge"), "u", "left_semi").select("u", F.col("m").alias("v"))))
    own = nodes.select(F.col("id").alias("node")).join(least.withColumnRenamed("u", "node").hint("merge"), "node", "left").withColumn("m", F.coalesce("m", "node"))
    own = cut(own.join(tops.withColumnRenamed("node", "m").hint("merge"), "m", "left").select("node", F.coalesce("root", "m").alias("root")))
    sizes = own.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    ranked = sizes.withColumn("component", F.row_number().over(Window.orderBy(F.desc("size"), "root")))
    return own.join(ranked.hint("merge"), "root").select("node", "root", "size", "component")


def reachable_set(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) of what the seeds (node) reach in an undirected graph: their whole components, in few rounds."""
    c = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    roots = c.join(seeds.select("node"), "node", "left_semi").select("root").distinct()
    return c.join(roots, "root", "left_semi").select("node").unionByName(seeds.select("node")).distinct()


def reachable(edges: DataFrame, seeds: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, hops) of what the seeds (node) reach; a seed outside the graph reaches itself."""
    seen = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for k in range(1, rounds + 1):
        new = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k))
        front = cut(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if k % 8 == 0:
            seen = cut(seen)
    return seen


def _settled(edges, state):
    """(node, distance, previous, open) that get nearer from one block's open nodes: edges (src, dst, cost, block) and state (node, distance, open, ...) of the block, as pandas; open are those of other blocks."""
    e = edges.sort_values("src", kind="stable")
    src, dst, cost = (e[c].tolist() for c in ("src", "dst", "cost"))
    starts = [i for i in range(len(src)) if i == 0 or src[i] != src[i - 1]]
    span = {src[a]: (a, b) for a, b in zip(starts, [*starts[1:], len(src)], strict=True)}
    have = dict(zip(state["node"].tolist(), state["distance"].tolist(), strict=True))
    heap = [(have[n], n) for n in state.loc[state["open"], "node"].tolist()]
    heapq.heapify(heap)
    found = {}
    while heap:
        d, n = heapq.heappop(heap)
        if d > have[n] or n not in span:
            continue
        for i in range(*span[n]):
            m, far = dst[i], d + cost[i]
            if m not in have or far < have[m] - 1e-12:
                have[m], found[m] = far, n
                if m in span:
                    heapq.heappush(heap, (far, m))
    out = pd.DataFrame({"node": list(found), "distance": [have[n] for n in found], "previous": list(found.values()), "open": [n not in span for n in found]})
    return out.astype({"node": edges["src"].dtype, "previous": edges["src"].dtype, "distance": "float64", "open": "bool"})


def _blocks(nodes: DataFrame, block: int) -> Callable[[Column], Column]:
    """Which of some blocks of about `block` nodes (src) a node falls into: ranges of a number, else of a hash."""
    n = max(1, -(-nodes.count() // block))
    number = (lambda c: c.cast("double")) if dict(nodes.dtypes)["src"] in ("tinyint", "smallint", "int", "bigint") else (lambda c: F.xxhash64(c).cast("double"))
    bounds = sorted(set(nodes.select(number(F.col("src")).alias("x")).approxQuantile("x", [k / n for k in range(1, n)], max(0.1 / n, 1e-4)))) if n > 1 else []
    return lambda c: F.size(F.filter(F.lit(bounds), lambda b: b <= number(c))) if bounds else F.lit(0)


def shortest(edges: DataFrame, seeds: DataFrame, rounds: int = 10_000, block: int = 20_000) -> DataFrame:
    """(node, distance, previous): least cost from any seed; ties by the lesser previous node.

    Nodes fall into blocks of about `block` by the order of their ids. A round settles
    each block that got nearer nodes from outside, in a task of its own, and offers what
    it found to the others. So the rounds grow with the blocks that a path crosses and
    not with its steps; ids without an order in space take more rounds, with the same
    result.
    """
    kind = dict(edges.dtypes)["src"]
    at = _blocks(edges.select("src").distinct(), block)
    held = cut(edges.select("src", "dst", "cost", at(F.col("src")).alias("block")))
    best = cut(seeds.select("node").distinct().select("node", F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("previous"), F.lit(True).alias("open"), at(F.col("node")).alias("block")))
    for _ in range(rounds):
        open_ = [r.block for r in best.where("open").select("block").distinct().collect()]
        if not open_:
            break
        mine, state = (d.where(F.col("block").isin(open_)) for d in (held, best))
        step = mine.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(_settled, f"node {kind}, distance double, previous {kind}, open boolean")
        step = step.groupBy("node").agg(F.min(F.struct("distance", "previous", "open")).alias("m")).select("node", "m.*")
        nearer = step.join(best.select("node", F.col("distance").alias("was")).hint("merge"), "node", "left").where(F.col("was").isNull() | (F.col("distance") < F.col("was") - 1e-12))
        nearer = nearer.select("node", "distance", "previous", "open", at(F.col("node")).alias("block"))
        old = best.withColumn("open", F.lit(False)).join(nearer.select("node").hint("merge"), "node", "left_anti")
        best = cut(old.unionByName(nearer))
    else:
        raise RuntimeError("distances did not settle")
    # of all nodes that a least way may come from, the least; a way without cost keeps its own
    ends = held.join(best.select(F.col("node").alias("src"), F.col("distance").alias("from")).hint("merge"), "src").join(best.select(F.col("node").alias("dst"), "distance").hint("merge"), "dst")
    before = ends.where((F.col("from") + F.col("cost") <= F.col("distance") + 1e-9) & (F.col("from") < F.col("distance"))).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("least"))
    return cut(best.join(before.hint("merge"), "node", "left").select("node", "distance", F.coalesce("least", "previous").alias("previous")))


def route(found: DataFrame, end, limit: int = 1_000_000) -> list:
    """Nodes from a seed to the end along `previous`; empty if it isn't reached. The part known doubles in a round."""
    up = cut(found.select("node", "previous"))
    known = up.where(F.col("node") == end).select("node", F.lit(0).cast("long").alias("back"))
    out = {r.node: r.back for r in known.collect()}
    n = 1
    while out and n <= limit:
        steps = known.join(up.hint("merge"), "node").where("previous is not null").select(F.col("previous").alias("node"), (F.col("back") + n).alias("back"))
        known = cut(known.unionByName(steps))
        out = {r.node: r.back for r in known.collect()}
        if len(out) < 2 * n:
            break
        n *= 2
        up = cut(up.alias("a").join(up.select(F.col("node").alias("p"), F.col("previous").alias("far")).hint("merge"), F.col("previous") == F.col("p")).select("node", F.col("far").alias("previous")))
    return sorted(out, key=out.get, reverse=True)


def diameter(edges: DataFrame, start) -> tuple:
    """Ends and length of a longest shortest path by a double sweep."""
    spark = edges.sparkSession
    far = lambda d: d.agg(F.max(F.struct("distance", "node")).alias("m")).first().m
    kind = dict(edges.dtypes)["src"]
    a = far(shortest(edges, spark.createDataFrame([(start,)], f"node {kind}")))
    b = far(shortest(edges, spark.createDataFrame([(a.node,)], f"node {kind}")))
    return a.node, b.node, b.distance


def restrict(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """The subgraph on the allowed nodes (id)."""
    a = allowed.select(F.col("id").alias("src"))
    return edges.join(a.hint("merge"), "src", "left_semi").join(a.withColumnRenamed("src", "dst").hint("merge"), "dst", "left_semi").select(*edges.columns)


def flat_edges(edges: DataFrame, cells: DataFrame, tolerance: float, surface: str | None = None) -> DataFrame:
    """Edges between cells at most the tolerance apart in height and, if named, of one surface."""
    cols = ["z", *([surface] if surface else [])]
    a, b = (cells.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in cols]) for n in ("src", "dst"))
    ok = F.abs(F.col("src_z") - F.col("dst_z")) <= tolerance + 1e-9
    if surface:
        ok = ok & F.col(f"src_{surface}").eqNullSafe(F.col(f"dst_{surface}"))
    return edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where(ok).select(*edges.columns)


def weighted(edges: DataFrame, cells: DataFrame, clearance: str, wanted: float) -> DataFrame:
    """Costs raised by half again for each share of the wanted clearance that the cell entered lacks."""
    c = cells.select(F.col("id").alias("dst"), F.greatest(F.lit(0.0), 1 - F.col(clearance) / wanted).alias("lack"))
    return edges.join(c, "dst").select("src", "dst", (F.col("cost") * (1 + 1.5 * F.col("lack"))).alias("cost"))


def regions(cells: DataFrame, edges: DataFrame, *, tolerance: float, least_cells: int, cell_area: float = 1.0, least_area: float = 0.0) -> DataFrame:
    """Level regions: components of flat edges with enough cells and area, numbered by mean height, then root."""
    c = components_of(cells, flat_edges(edges, cells, tolerance)).join(cells.select(F.col("id").alias("node"), "z"), "node")
    r = c.groupBy("root").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("z"), 9).alias("mean_z"))
    return r.where((F.col("cells") >= least_cells) & (F.col("cells") * cell_area >= least_area)).withColumn("region", F.row_number().over(Window.orderBy("mean_z", "root")))


def boundary_distance(cells: DataFrame, edges: DataFrame, least_links: int = 8) -> DataFrame:
    """(node, distance, previous) from the nearest cell with fewer than least_links links."""
    links = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    edge_cells = cells.select("id").join(links, "id", "left").where(F.coalesce("links", F.lit(0)) < least_links)
    return shortest(edges, edge_cells.select(F.col("id").alias("node")))


def uncovered(cells: DataFrame, edges: DataFrame, covered: DataFrame, least: int) -> DataFrame:
    """Components of the cells that aren't covered, of at least so many cells, largest first."""
    left = cells.join(covered.select("id").distinct(), "id", "left_anti")
    return components_of(left, restrict(edges, left)).groupBy("root", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("size") >= least).select("root", "size")


def cluster_minima(cells: DataFrame, edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of each component the cell that comes first by order, then id."""
    c = components_of(cells, edges).select("node", "root").join(cells.withColumnRenamed("id", "node"), "node")
    return c.groupBy("root").agg(F.min(F.struct(*order, "node")).alias("m")).select("root", F.col("m.node").alias("id"))


def crossing_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """How many links join each pair of labels (id, label)."""
    a, b = (labels.select(F.col("id").alias(n), F.col("label").alias(f"{n}_label")) for n in ("src", "dst"))
    e = edges.where("src < dst").join(a, "src").join(b, "dst").where("src_label <> dst_label")
    return e.groupBy(F.least("src_label", "dst_label").alias("a"), F.greatest("src_label", "dst_label").alias("b")).agg(F.count(F.lit(1)).alias("links"))


def grow_labels(edges: DataFrame, seeds: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, label, hops): each node takes the label of its nearest seed (node, label), ties by the lesser label."""
    got = cut(seeds.select("node", "label", F.lit(0).alias("hops")))
    front = got
    for k in range(1, rounds + 1):
        new = edges.join(front.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label")).join(got.select("node"), "node", "left_anti").withColumn("hops", F.lit(k))
        front = cut(new)
        if front.isEmpty():
            break
        got = cut(got.unionByName(front))
    return got


def degree(edges: DataFrame, name: str = "links") -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias(name))


def local_structure(cells: DataFrame, neighbours: DataFrame, clearance: Column) -> DataFrame:
    """Flags by the four neighbours: boundary (fewer than four), medial (no neighbour is wider and at least the median)."""
    c = cells.withColumn("__c", clearance)
    n = neighbours.join(c.select(F.col("id").alias("dst"), F.col("__c").alias("nc")), "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("nc").alias("widest"))
    median = c.agg(F.median("__c")).first()[0] or 0.0
    out = c.join(n, "id", "left")
    return out.select("id", (F.coalesce("n", F.lit(0)) < 4).alias("boundary"), ((F.col("__c") >= F.coalesce("widest", F.lit(0.0))) & (F.col("__c") >= median)).alias("medial"))
