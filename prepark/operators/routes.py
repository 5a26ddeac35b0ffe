"""Graph: H1 directed weighted edges, H2 weighted shortest route.

H2 runs in four steps, none of which carries a path along:

1. Chains. A node with two neighbours at most, which no route can leave but by the
   other one, only passes through. Edges along such nodes form lists; pointer jumping
   turns each list into one edge in as many rounds as its length has binary digits, and
   dead ends fall away. A chain of 100,000 nodes is one edge after 17 rounds.
2. Distance buckets (delta-stepping). Nodes whose tentative distance falls into the
   current bucket relax their light edges (weight up to the bucket's width) until the
   bucket holds still, then their heavy edges once. A round reads the frontier's edges and
   the known rows of the nodes it reached, and writes the improved nodes only, as rows
   (node, dist, hops, pred); every few rounds these deltas are folded into one table.
3. The route, backwards: predecessor pointers are doubled, so a route of n edges takes
   log n rounds.
4. Chain edges on the route are opened by one join with the lists of step 1.

A source with very many edges has them dealt over salted keys, and a frontier row of it
goes to each. Each round is cut by a table in the shared folder, so lineage does not grow and a lost
executor costs one round at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import order_column, qcol
from ..session import write_scratch

EDGE_SCHEMA = "src string, dst string, weight double"
#: a frontier is broadcast only under this many bytes (summed each round), else joined by shuffle
BROADCAST_BYTES = 64 << 20
#: a source with more out-edges than this has them dealt over several join keys
HUB_EDGES = 100_000
#: chains are shortened first if this many nodes, and an eighth of all, only pass through
PASSING_NODES = 64
#: delta tables of improved nodes after which they are folded into one
FOLD_ROUNDS = 8
#: nodes that make a bucket worth its rounds
BUCKET_NODES = 1_000_000


def build_graph(edges: DataFrame, source: str = "source", target: str = "target", weight: str | None = "weight",
                order_by=None) -> DataFrame:
    """H1: ``(src, dst, weight)`` with node ids as text; weight 1.0 when the
    weight column is absent; a repeated edge keeps its last row."""
    has_weight = weight is not None and weight in edges.columns
    edges, order, _ = order_column(edges, order_by)
    w = qcol(weight).cast("double") if has_weight else F.lit(1.0)
    e = edges.select(qcol(source).cast("string").alias("src"), qcol(target).cast("string").alias("dst"),
                     w.alias("weight"), order.alias("_o"))
    return e.groupBy("src", "dst").agg(F.max_by("weight", "_o").alias("weight"))


def _passing(edges: DataFrame, origin: str, destination: str) -> DataFrame:
    """(node, out1, out2): nodes with at most two neighbours in all, and where they lead."""
    ends = (edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(None).cast("string").alias("by"))
            .unionByName(edges.select(F.col("dst").alias("node"), F.lit(None).cast("string").alias("to"), F.col("src").alias("by"))))
    few = ends.groupBy("node").agg(F.count("to").alias("outs"), F.count("by").alias("ins"), F.min("to").alias("out1"), F.max("to").alias("out2"),
                                   F.min("by").alias("in1"), F.max("by").alias("in2"), F.count(F.lit(1)).alias("edges"))
    near = F.array_compact(F.array_distinct(F.array("out1", "out2", "in1", "in2")))
    return few.select("node", "out1", "out2", ((F.col("outs") <= 2) & (F.col("ins") <= 2) & (F.size(near) <= 2)
                                               & ~F.col("node").isin(origin, destination)).alias("passing"))


def _chains(edges: DataFrame, passing: DataFrame) -> DataFrame:
    """Every edge (src, dst) with where its list ends: (end, last, weight, hops, dead).

    ``last`` is the source of the list's last edge, ``dead`` says that the list ends in a
    passing node. Rings of passing nodes, which nothing enters, are left out."""
    turn = F.when(F.col("out1") != F.col("src"), F.col("out1")).when(F.col("out2") != F.col("src"), F.col("out2"))
    lists = write_scratch(
        edges.join(passing.withColumnRenamed("node", "dst"), "dst", "left")
        .select("src", "dst", F.col("dst").alias("end"), F.col("src").alias("last"), "weight", F.lit(1).cast("long").alias("hops"),
                turn.alias("next"), (F.col("out1").isNotNull() & turn.isNull()).alias("dead")), "route-lists")
    for _ in range(max(1, math.ceil(math.log2(max(2, lists.count()))) + 1)):
        if lists.filter("next is not null").isEmpty():
            break
        on = lists.select(F.col("src").alias("end"), F.col("dst").alias("next"), F.col("end").alias("e"), F.col("last").alias("l"),
                          F.col("weight").alias("w"), F.col("hops").alias("h"), F.col("next").alias("n"), F.col("dead").alias("d"))
        jumped = lists.filter("next is not null").join(on, ["end", "next"]).select(
            "src", "dst", F.col("e").alias("end"), F.col("l").alias("last"), (F.col("weight") + F.col("w")).alias("weight"),
            (F.col("hops") + F.col("h")).alias("hops"), F.col("n").alias("next"), F.col("d").alias("dead"))
        lists = write_scratch(lists.filter("next is null").unionByName(jumped), "route-lists")
    return lists.filter("next is null").drop("next")


def _salted(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges with a ``salt``, and (node, salts) of the sources whose edges are dealt (None
    if there is none). There are at most edges / HUB_EDGES of them."""
    hubs = edges.groupBy(F.col("src").alias("node")).count().filter(F.col("count") > HUB_EDGES)
    hubs = write_scratch(hubs.select("node", F.ceil(F.col("count") / HUB_EDGES).cast("int").alias("salts")), "route-hubs")
    if hubs.isEmpty():
        return edges.withColumn("salt", F.lit(0)), None
    dealt = edges.join(hubs.withColumnRenamed("node", "src"), "src", "left")
    return dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int"), F.lit(0))).drop("salts"), hubs


def _best(rows: DataFrame) -> DataFrame:
    """The best row of each node: shortest, then fewest stops, then smallest predecessor."""
    one = rows.groupBy("node").agg(F.min(F.struct("dist", "hops", "pred", "last", "span")).alias("b"))
    return one.select("node", "b.*")


def _bytes(c: Column | str = "node") -> Column:
    return F.coalesce(F.sum(F.octet_length(c) + 48), F.lit(0))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def shortest_route(graph: DataFrame, origin, destination, checkpoint: bool = True, delta: float | None = None) -> DataFrame:
    """H2: one row ``(origin, destination, path array<string>, length)``.

    Errors as in the reference: unknown origin or destination, no route.
    Negative or missing weights are rejected before any round runs.
    Equal-length routes: the one with fewest stops wins, then, from the destination
    backwards, the smallest predecessor. ``delta`` is the width of a distance bucket (four mean
    weights if None, more for few nodes). ``checkpoint`` is kept for callers; rounds are always cut.
    """
    origin, destination = str(origin), str(destination)
    spark = graph.sparkSession
    edges = write_scratch(graph.select("src", "dst", F.col("weight").cast("double").alias("weight")), "route-graph")
    check = edges.agg(
        F.count_if((F.col("src") == origin) | (F.col("dst") == origin)).alias("o"),
        F.count_if((F.col("src") == destination) | (F.col("dst") == destination)).alias("d"),
        F.count_if(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0)).alias("bad"),
        F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("mean"), F.max("weight").alias("most")).first()
    for name, count in ((origin, check["o"]), (destination, check["d"])):
        if not count:
            raise KeyError(f"no node {name!r} among the edges")
    if check["bad"]:
        raise ValueError("edge weights must be non-negative numbers")
    schema = "origin string, destination string, path array<string>, length double"
    if origin == destination:
        return spark.createDataFrame([(origin, destination, [origin], 0.0)], schema)

    edges = edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    nodes = _passing(edges, origin, destination)
    seen = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if("passing").alias("passing")).first()
    chains, weights = None, check
    if seen["passing"] > max(PASSING_NODES, seen["n"] // 8):
        passing = write_scratch(nodes.filter("passing").select("node", F.coalesce("out1", F.lit("")).alias("out1"), "out2"), "route-passing")
        chains = write_scratch(_chains(edges, passing), "route-chains")
        heads = chains.join(passing.select(F.col("node").alias("src")), "src", "left_anti").filter("not dead and src <> end")
        best = heads.groupBy("src", "end").agg(F.min(F.struct("weight", "hops", "dst", "last")).alias("b"))
        edges = best.select("src", F.col("end").alias("dst"), "b.weight", "b.hops", "b.last")
    else:
        edges = edges.select("src", "dst", "weight", F.lit(1).cast("long").alias("hops"), F.col("src").alias("last"))
    salted, hubs = _salted(edges) if check["edges"] > HUB_EDGES else (edges.withColumn("salt", F.lit(0)), None)
    # read every round: once written sorted by source, a small frontier's ids prune row groups
    edges = write_scratch(salted.repartitionByRange("src", "salt").sortWithinPartitions("src"), "route-edges")
    if chains is not None:
        weights = edges.agg(F.avg("weight").alias("mean"), F.max("weight").alias("most")).first()
    if delta is None:  # wider where a bucket of four mean weights would hold few nodes: it costs a job or more
        delta = 4 * (weights["mean"] or 0.0) * max(1.0, BUCKET_NODES / seen["n"]) or 1.0
    heavy_edges = (weights["most"] or 0.0) > delta

    def relax(frontier: DataFrame, size: int, heavy: bool) -> DataFrame:
        """The best way to each node that an edge of the frontier reaches."""
        if hubs is not None:
            frontier = frontier.join(hubs, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        else:
            frontier = frontier.withColumn("salt", F.lit(0))
        side = frontier.select(F.col("node").alias("src"), "salt", F.col("dist").alias("d"), F.col("hops").alias("h"))
        out = edges.filter((F.col("weight") > delta) if heavy else (F.col("weight") <= delta))
        return _best(out.join(_small(side, size), ["src", "salt"]).select(
            F.col("dst").alias("node"), (F.col("d") + F.col("weight")).alias("dist"), (F.col("h") + F.col("hops")).alias("hops"),
            F.col("src").alias("pred"), "last", F.col("hops").alias("span")))

    known = [spark.createDataFrame([(origin, 0.0, 0, None, None, 0)], "node string, dist double, hops long, pred string, last string, span long")]
    known_size = 0  # bytes of the known rows, those that were bettered included
    bound = math.inf  # length of the best route found so far

    def rows() -> DataFrame:
        out = known[0]
        for other in known[1:]:
            out = out.unionByName(other)
        return out

    def step(frontier: DataFrame, size: int, heavy: bool, inside: Column) -> tuple[DataFrame, int]:
        """Relax, keep what is better than all that is known, and note it. Returns what of
        it lies ``inside`` the bucket, and its bytes."""
        nonlocal bound, known_size
        reached = relax(frontier, size, heavy).filter(F.col("dist") <= bound)
        old = rows()
        if known_size <= BROADCAST_BYTES:
            old = F.broadcast(old)
        else:  # only what is known of the nodes just reached
            reached = write_scratch(reached, "route-reached")
            old = old.join(_small(reached.select("node"), reached.agg(_bytes()).first()[0]), "node", "left_semi")
        old = old.select(F.col("node").alias("known"), F.struct("dist", "hops", "pred", "last").alias("old"))
        worse = (F.col("node") == F.col("known")) & (F.col("old") <= F.struct("dist", "hops", "pred", "last"))
        better = write_scratch(reached.join(old, worse, "left_anti"), "route-delta")
        got = better.agg(F.min(F.when(F.col("node") == destination, F.col("dist"))).alias("hit"), _bytes(F.when(inside, F.col("node"))).alias("size"),
                         F.count_if(inside).alias("n"), _bytes().alias("all")).first()
        known_size += got["all"]
        bound = min(bound, got["hit"] if got["hit"] is not None else math.inf)
        known.append(better)
        if len(known) > FOLD_ROUNDS:
            known[:] = [write_scratch(_best(rows()), "route-known")]
        return better.filter(inside), got["size"] if got["n"] else 0

    low = 0.0  # the bucket is [low, low + delta)
    while low <= bound:
        inside = F.col("dist") < low + delta
        frontier, frontier_size = known[0], 1
        if low:
            frontier = write_scratch(_best(rows().filter(inside)).filter(F.col("dist") >= low), "route-bucket")
            frontier_size = frontier.agg(_bytes()).first()[0]
        while frontier_size:
            frontier, frontier_size = step(frontier, frontier_size, False, inside)
        if heavy_edges:
            settled = write_scratch(_best(rows().filter(inside)).filter(F.col("dist") >= low), "route-bucket")
            size = settled.agg(_bytes()).first()[0]
            if size:
                step(settled, size, True, inside)
        nearest = rows().filter(~inside).agg(F.min("dist")).first()[0]
        if nearest is None:
            break
        # the bucket that holds the nearest open node; at least the next one where widths vanish beside distances
        low = max(low + delta, math.floor(nearest / delta) * delta)
        if low + delta <= nearest:
            low = nearest
    if bound == math.inf:
        raise ValueError(f"No route leads from {origin!r} to {destination!r}")
    known[:] = [write_scratch(_best(rows()), "route-known")]
    return _route(known[0], chains, origin, destination)


def _route(known: DataFrame, chains: DataFrame | None, origin: str, destination: str) -> DataFrame:
    """The path to the destination from (node, pred) rows, chain edges opened."""
    jump = known.select("node", F.col("pred").alias("to"))
    on_way = known.filter(F.col("node") == destination).select("node")
    while on_way.filter(F.col("node") == origin).isEmpty():  # all nodes up to some place from the end
        before = on_way.join(jump, "node").filter("to is not null").select(F.col("to").alias("node"))
        on_way = write_scratch(on_way.unionByName(before).distinct(), "route-way")
        further = jump.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jump = write_scratch(jump.filter("to is not null").join(further, "to").select("node", F.col("far").alias("to")), "route-jump")
    steps = known.join(on_way, "node").filter("pred is not null").select(
        "pred", "node", "last", "span", (F.col("hops") - F.col("span")).alias("pos"))
    stops = steps.select((F.col("pos") + F.col("span")).alias("pos"), "node")
    if chains is not None:
        # an edge of a list ends where the list ends; its place follows from the hops left to the end
        lists = chains.select(F.col("end").alias("node"), "last", F.col("dst").alias("stop"), F.col("hops").alias("left"))
        inner = steps.filter("span > 1").join(lists, ["node", "last"]).filter("left > 1 and left <= span")
        stops = stops.unionByName(inner.select((F.col("pos") + F.col("span") - F.col("left") + 1).alias("pos"), F.col("stop").alias("node")))
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"])
    length = known.filter(F.col("node") == destination).select(F.col("dist").alias("length"))
    return (stops.agg(F.concat(F.array(F.lit(origin)), path).alias("path")).join(F.broadcast(length))  # one row each
            .select(F.lit(origin).alias("origin"), F.lit(destination).alias("destination"), "path", "length"))
