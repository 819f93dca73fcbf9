"""Co-occurrence graph: edges, centralities, communities.

A graph is an edge table ``(source, target, weight)`` with ``source < target``. The
iterative measures keep their state in DataFrames keyed by (start, node); every round
is one join and one aggregation, written to the shared checkpoint folder. The edge
table is broadcast only when counted to be small; otherwise the joins shuffle, where
adaptive execution may split skewed hubs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlift.params import DEFAULTS
from tierlift.session import broadcast_if_small, cut_lineage

# Fixed value: keeps the bridge score finite for isolated nodes.
BRIDGE_EPSILON = 1e-5
TOLERANCE = 1e-9


def top_items(stats: DataFrame, n: int = DEFAULTS.max_graph_nodes) -> DataFrame:
    """The most held items by name; ties go to the smaller name."""
    return stats.orderBy(F.col("entity_count").desc(), "item_name").limit(n).select("item_name")


def cooccurrence_edges(links: DataFrame, top: DataFrame,
                       min_weight: float = DEFAULTS.min_edge_weight) -> DataFrame:
    """Item pairs with the number of entities holding both.

    ``top`` is a limited list, so an entity contributes at most that many items and the
    pairs per entity are bounded by the node limit. Counts combine before the shuffle. The
    limit also tells Catalyst that the list is small enough to broadcast.
    """
    kept = links.select("entity_id", "item_name").join(top, "item_name", "left_semi")
    left = kept.select("entity_id", F.col("item_name").alias("source"))
    right = kept.select("entity_id", F.col("item_name").alias("target"))
    return (
        left.join(right, "entity_id").where(F.col("source") < F.col("target"))
        .groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
        .where(F.col("weight") >= min_weight)
    )


def both_directions(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("source").alias("u"), F.col("target").alias("v")),
        F.struct(F.col("target").alias("u"), F.col("source").alias("v")))
    return edges.select(F.explode(ends).alias("e"), "weight").select(
        "e.u", "e.v", F.col("weight").alias("w"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """Endpoints of the kept edges; items without an edge drop out."""
    return both_directions(edges).select(F.col("u").alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Degree centrality and weighted degree of every node."""
    n = nodes_of(edges).agg(F.count(F.lit(1))).scalar()
    per_node = both_directions(edges).groupBy(F.col("u").alias("node")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weighted_degree"))
    return per_node.select(
        "node", "degree", "weighted_degree",
        F.when(n > 1, F.col("degree") / (n - 1)).otherwise(F.lit(0.0))
        .alias("degree_centrality"))


def shortest_distances(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """``(s, v, d)`` for every source and reachable node, by frontier relaxation.

    Only rows improved in the last round are extended in the next one.
    """
    own = sources.select(F.col("node").alias("s"), F.col("node").alias("v"),
                         F.lit(0).cast(arcs.schema["w"].dataType).alias("d"))
    direct = arcs.join(sources.select(F.col("node").alias("u")), "u", "left_semi").select(
        F.col("u").alias("s"), "v", F.col("w").alias("d"))
    state = own.withColumn("fresh", F.lit(False)).unionByName(
        direct.withColumn("fresh", F.lit(True)))
    while True:
        reached = (
            state.where("fresh").withColumnRenamed("v", "u").join(arcs, "u")
            .select("s", "v", (F.col("d") + F.col("w")).alias("d"),
                    F.lit(None).cast("boolean").alias("fresh")))
        merged = (
            state.withColumn("fresh", F.lit(False)).unionByName(reached)
            .groupBy("s", "v")
            .agg(F.min("d").alias("d"),
                 F.min(F.when(F.col("fresh").isNotNull(), F.col("d"))).alias("old")))
        state = cut_lineage(merged.select(
            "s", "v", "d",
            (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("fresh")))
        if state.where("fresh").isEmpty():
            return state.select("s", "v", "d")


def _accumulate(start: DataFrame, steps: DataFrame, source: str, target: str) -> DataFrame:
    """Sum of ``x`` over repeated steps ``source -> target`` until nothing is left."""
    layer = start
    layers = [layer]
    while True:
        layer = cut_lineage(
            layer.withColumnRenamed("v", source).join(steps, ["s", source])
            .groupBy("s", F.col(target).alias("v")).agg(F.sum("x").alias("x")))
        if layer.isEmpty():
            break
        layers.append(layer)
    total = layers[0]
    for extra in layers[1:]:
        total = total.unionByName(extra)
    return total.groupBy("s", "v").agg(F.sum("x").alias("x"))


def betweenness(edges: DataFrame, distance: str = "weight",
                sources: DataFrame | None = None) -> DataFrame:
    """Normalised shortest-path betweenness.

    ``distance="weight"`` uses the co-occurrence weight as path length, ``"inverse"``
    its reciprocal. Path counts run forward over the shortest-path arcs; dependencies
    run backward with ``f(s,v) = 1/sigma(s,v) + sum f(s,next)``, so that
    ``delta = sigma * f - 1``. ``sources`` restricts the start nodes.
    """
    length = F.col("weight") if distance == "weight" else F.lit(1.0) / F.col("weight")
    arcs = broadcast_if_small(cut_lineage(
        both_directions(edges.withColumn("weight", length))))
    nodes = cut_lineage(nodes_of(edges))
    starts = nodes if sources is None else sources
    dist = shortest_distances(arcs, starts)
    ahead = dist.select("s", F.col("v").alias("b"), F.col("d").alias("db"))
    gap = F.abs(F.col("d") + F.col("w") - F.col("db"))
    tight = cut_lineage(
        dist.withColumnRenamed("v", "u").join(arcs, "u")
        .select("s", F.col("u").alias("a"), F.col("v").alias("b"), "d", "w")
        .join(ahead, ["s", "b"])
        .where(gap <= TOLERANCE * F.col("db"))
        .select("s", "a", "b"))
    origin = starts.select(F.col("node").alias("s"), F.col("node").alias("v"),
                           F.lit(1.0).alias("x"))
    sigma = cut_lineage(_accumulate(origin, tight, "a", "b"))
    inverse = sigma.select("s", "v", (F.lit(1.0) / F.col("x")).alias("x"))
    f = _accumulate(inverse, tight, "b", "a").withColumnRenamed("x", "f")
    n = nodes.agg(F.count(F.lit(1))).scalar()
    scale = F.when(n > 2, F.lit(1.0) / ((n - 1) * (n - 2))).otherwise(F.lit(0.0))
    dependency = (
        sigma.join(f, ["s", "v"]).where(F.col("s") != F.col("v"))
        .groupBy(F.col("v").alias("node"))
        .agg(F.sum(F.col("x") * F.col("f") - 1.0).alias("delta")))
    return nodes.join(dependency, "node", "left").select(
        "node", (F.coalesce("delta", F.lit(0.0)) * scale).alias("betweenness"))


def closeness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Closeness over unweighted hops, scaled by the reachable share of the graph.

    Of all nodes, or only of those in ``sources(node)``: state is kept per start node.
    """
    arcs = broadcast_if_small(cut_lineage(
        both_directions(edges).withColumn("w", F.lit(1).cast("bigint"))))
    nodes = cut_lineage(nodes_of(edges))
    n = nodes.agg(F.count(F.lit(1))).scalar()
    starts = nodes if sources is None else nodes.join(sources, "node", "left_semi")
    per_node = shortest_distances(arcs, starts).groupBy(F.col("s").alias("node")).agg(
        (F.count(F.lit(1)) - 1).alias("reached"), F.sum("d").alias("total"))
    score = (F.col("reached") / F.col("total")) * (F.col("reached") / (n - 1))
    return per_node.select(
        "node", F.when(F.col("total") > 0, score).otherwise(F.lit(0.0)).alias("closeness"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row with Q of a partition ``(node, community)``."""
    arcs = both_directions(edges)
    two_m = arcs.agg(F.sum("w")).scalar().cast("double")
    cu = partition.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    cv = partition.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    per_community = (
        arcs.join(cu, "u").join(cv, "v").groupBy("cu")
        .agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(F.lit(0)))
             .alias("inside"), F.sum("w").alias("total")))
    share = F.col("total") / two_m
    return per_community.agg(
        F.sum(F.col("inside") / two_m - share * share).alias("modularity"),
        F.count(F.lit(1)).alias("communities"))


def communities(edges: DataFrame) -> DataFrame:
    """``(node, community)`` by modularity moves, deterministic.

    Per round every node names its best community. Not all of these moves go together, so several
    sets of them are tried at once: all, those from one half of the communities to the other, and
    shares of them, each chosen by hashes of names and the round. The set with the largest
    modularity is kept, so Q never falls; if none raises it, the single best move is made. A
    level ends when no move to any community gains; then communities become the nodes of a
    smaller graph. At the end single nodes move again, until neither they nor communities gain.
    """
    first = cut_lineage(both_directions(edges).withColumn("w", F.col("w").cast("double")))
    two_m = first.agg(F.sum("w").alias("t")).first()["t"] or 0.0
    member = cut_lineage(nodes_of(edges).select("node", F.col("node").alias("level")))
    while True:
        start = member.withColumnRenamed("level", "community")
        assigned, moved = _move_until_stable(first, two_m, start)
        if not moved:
            break
        member = cut_lineage(assigned.withColumnRenamed("community", "level"))
        while moved:
            cu = member.select(F.col("node").alias("u"), F.col("level").alias("cu"))
            cv = member.select(F.col("node").alias("v"), F.col("level").alias("cv"))
            arcs = cut_lineage(
                first.join(cu, "u").join(cv, "v").groupBy("cu", "cv").agg(F.sum("w").alias("w"))
                .select(F.col("cu").alias("u"), F.col("cv").alias("v"), "w"))
            assigned, moved = _move_until_stable(
                arcs, two_m, member.select(F.col("level").alias("node"),
                                           F.col("level").alias("community")).distinct())
            renamed = assigned.select(F.col("node").alias("level"), "community")
            member = cut_lineage(
                member.join(renamed, "level").select("node", F.col("community").alias("level")))
    # Dense ids by size; one row per community enters the window.
    sizes = member.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    ids = sizes.select("level", (F.row_number().over(
        Window.orderBy(F.col("n").desc(), "first")) - 1).alias("community"))
    return member.join(ids, "level").select("node", "community")


def gaining_moves(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """``(node, c, gain)``: moves of single nodes that would raise the modularity."""
    arcs = cut_lineage(both_directions(edges).withColumn("w", F.col("w").cast("double")))
    two_m = arcs.agg(F.sum("w").alias("t")).first()["t"] or 0.0
    weights = arcs.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    return _moves(weights.join(partition, "node"), arcs.where(F.col("u") != F.col("v")), two_m
                  ).withColumnRenamed("u", "node")


# Of the moves, those whose hash in 64 is below each number are one trial.
SHARES = (64, 32, 16, 4, 1)


def _move_until_stable(arcs: DataFrame, two_m: float, start: DataFrame) -> tuple[DataFrame, bool]:
    """``(node, community)`` without a gaining move, from the one given, and whether any was made."""
    weights = arcs.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    state = cut_lineage(weights.join(start, "node").select("node", "k", "community"))
    outward = cut_lineage(arcs.where(F.col("u") != F.col("v")))
    loops = arcs.where(F.col("u") == F.col("v")).agg(F.sum("w")).first()[0] or 0.0
    any_move, turn = False, 0
    while True:
        trials = cut_lineage(_trials(state, _moves(state, outward, two_m), turn))
        movers, (before, *scores) = _scores(trials, outward, loops, two_m)
        if not movers:
            return state.select("node", "community"), any_move
        best = max(range(len(scores)), key=scores.__getitem__)
        turn += 1
        if scores[best] > before + TOLERANCE:
            state = trials.select("node", "k", F.col("trial")[best + 1].alias("community"))
        else:
            first = trials.where("gain is not null").orderBy(F.col("gain").desc(), "node").first()
            state = cut_lineage(state.withColumn("community", F.when(
                F.col("node") == first["node"], F.lit(first["trial"][1])).otherwise(
                F.col("community"))))
        any_move = True


def _moves(state: DataFrame, outward: DataFrame, two_m: float) -> DataFrame:
    """Best move ``(u, c, gain)`` of each node that gains by one."""
    totals = state.groupBy("community").agg(F.sum("k").alias("tot"))
    sized = state.join(totals, "community")
    here = sized.select(F.col("node").alias("u"), "k", F.col("community").alias("own"),
                        F.col("tot").alias("tot_own"))
    there = sized.select(F.col("node").alias("v"), F.col("community").alias("c"), "tot")
    pull = (
        outward.join(there, "v")
        .groupBy("u", "c").agg(F.sum("w").alias("wc"), F.first("tot").alias("tot"))
        .join(here, "u"))
    own = F.col("c") == F.col("own")
    away = F.col("wc") - F.col("k") * F.col("tot") / two_m
    best = (
        pull.groupBy("u", "own", "k", "tot_own")
        .agg(F.min(F.when(~own, F.struct((-away).alias("loss"), F.col("c").alias("c"))))
             .alias("best"),
             F.coalesce(F.max(F.when(own, F.col("wc"))), F.lit(0.0)).alias("w_own"))
        .where(F.col("best").isNotNull()))
    stay = F.col("w_own") - F.col("k") * (F.col("tot_own") - F.col("k")) / two_m
    return best.select("u", F.col("best.c").alias("c"), (-F.col("best.loss") - stay).alias("gain")
                       ).where(F.col("gain") > TOLERANCE * two_m)


def _trials(state: DataFrame, moves: DataFrame, turn: int) -> DataFrame:
    """``(node, k, trial, gain)``: the community of each node now, and after each trial."""
    stay, to = F.col("community"), F.coalesce("c", "community")

    def half(community: str) -> Column:
        return F.pmod(F.xxhash64(community, F.lit(turn)), F.lit(2))

    place = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(64))
    sets = [F.when(place < share, to).otherwise(stay) for share in SHARES]
    across = F.when((half("community") == 0) & (half("c") == 1), to).otherwise(stay)
    return state.join(moves.withColumnRenamed("u", "node"), "node", "left").select(
        "node", "k", F.array(stay, *sets, across).alias("trial"), "gain")


def _scores(trials: DataFrame, outward: DataFrame, loops: float,
            two_m: float) -> tuple[int, list[float]]:
    """Nodes with a move, and the modularity now and after each trial; one row each is joined."""
    n = len(SHARES) + 2
    ends = outward.join(trials.select(F.col("node").alias("u"), F.col("trial").alias("tu")), "u").join(
        trials.select(F.col("node").alias("v"), F.col("trial").alias("tv")), "v")
    inside = ends.agg(*[F.sum(F.when(F.col("tu")[i] == F.col("tv")[i], F.col("w"))).alias(f"i{i}")
                        for i in range(n)])
    squares = (
        trials.select("k", F.posexplode("trial").alias("i", "c")).groupBy("i", "c")
        .agg(F.sum("k").alias("tot"))
        .agg(*[F.sum(F.when(F.col("i") == i, F.col("tot") * F.col("tot"))).alias(f"s{i}")
               for i in range(n)]))
    movers = trials.agg(F.count("gain").alias("movers"))
    row = inside.join(squares).join(movers).first()
    return row["movers"], [((row[f"i{i}"] or 0.0) + loops) / two_m - (row[f"s{i}"] or 0.0) / two_m ** 2
            for i in range(n)] if two_m else [0.0] * n


def bridge_score(betweenness_: Column, degree_centrality: Column) -> Column:
    return betweenness_ / (degree_centrality + BRIDGE_EPSILON)


def node_table(edges: DataFrame, stats: DataFrame, partition: DataFrame) -> DataFrame:
    """Nodes with community, item statistics (0 when missing) and centralities.

    Item statistics are by (id, name); the graph is by name, so the most held id of a
    name stands for it.
    """
    by_name = stats.groupBy("item_name").agg(F.max(F.struct(
        "entity_count", "item_id", "median_metric", "top_rate", "median_rate")).alias("x"))
    lookup = by_name.select(
        F.col("item_name").alias("node"), "x.entity_count", "x.median_metric",
        "x.top_rate", "x.median_rate")
    joined = (
        degrees(edges).join(betweenness(edges), "node").join(closeness(edges), "node")
        .join(partition, "node").join(lookup, "node", "left"))
    return joined.select(
        "node", "community",
        F.coalesce("entity_count", F.lit(0).cast("bigint")).alias("entity_count"),
        *[F.coalesce(c, F.lit(0.0)).alias(c)
          for c in ["median_metric", "top_rate", "median_rate"]],
        "degree_centrality", "weighted_degree", "betweenness", "closeness",
        bridge_score(F.col("betweenness"), F.col("degree_centrality")).alias("bridge_score"))


def community_summary(nodes: DataFrame, top_names: int = 5) -> DataFrame:
    """Size, entity total, mean label rate, median of medians and leading items."""
    order = Window.partitionBy("community").orderBy(F.col("entity_count").desc(), "node")
    leading = (
        nodes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_names)
        .groupBy("community")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))),
                                      lambda x: x["node"]), ", ").alias("top_items")))
    return (
        nodes.groupBy("community")
        .agg(F.count(F.lit(1)).alias("num_items"),
             F.sum("entity_count").alias("total_entities"),
             F.avg("top_rate").alias("avg_top_rate"),
             F.median("median_metric").alias("median_metric"))
        .join(leading, "community"))


def subgraph(edges: DataFrame, members: DataFrame, min_weight: float) -> DataFrame:
    """Edges of at least ``min_weight`` with both ends in ``members(node)``."""
    heavy = edges.where(F.col("weight") >= min_weight)
    return (
        heavy.join(members.select(F.col("node").alias("source")), "source", "left_semi")
        .join(members.select(F.col("node").alias("target")), "target", "left_semi")
        .select("source", "target", "weight"))
