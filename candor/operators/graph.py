"""Edges and hierarchies: neighbours, networks, common partners, closures, members, cycles."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.plans.order import checked_limit, top


class GraphError(ValueError):
    """A hierarchy with a cycle, or an expansion past its bound."""


def cut(df: DataFrame) -> DataFrame:
    """`df` in the checkpoint folder of the session (a temporary one only where none is named); lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise GraphError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge from either side, as node and partner; edges with an unknown end are left out."""
    whole = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return whole.withColumn("node", F.col(a)).withColumn("partner", F.col(b)).unionByName(whole.where(F.col(a) != F.col(b)).withColumn("node", F.col(b)).withColumn("partner", F.col(a)))


def neighbors(edges: DataFrame, a: str, b: str, node, rank: list[tuple[str, str]], limit: int) -> DataFrame:
    return top(both_ways(edges.where((F.col(a) == node) | (F.col(b) == node)), a, b).where(F.col("node") == node), rank, ["partner"], limit).drop("node")


def expand_network(edges: DataFrame, a: str, b: str, seeds: DataFrame, hops: int, max_nodes: int) -> DataFrame:
    """node and hop of everything within `hops` of the seeds; the hop that passes max_nodes is cut in order of nodes.

    A hop reads the edges that touch the frontier, by one join for each end, and keeps the new nodes only.
    """
    checked_limit(hops, 4)
    seen = cut(seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("hop")).distinct())
    n = seen.count()
    for hop in range(1, hops + 1):
        frontier = seen.where(F.col("hop") == hop - 1).select(F.col("node").alias("from_"))
        touched = [edges.join(frontier, F.col(x) == F.col("from_"), "left_semi").select(F.col(y).alias("node")) for x, y in ((a, b), (b, a))]
        fresh = touched[0].unionByName(touched[1]).where("node is not null").distinct().join(seen.select("node"), "node", "left_anti")
        room = max_nodes - n
        if room <= 0:
            break
        fresh = cut(fresh.orderBy("node").limit(room).withColumn("hop", F.lit(hop)))
        seen, n = seen.unionByName(fresh), n + fresh.count()
    return seen


def network_edges(edges: DataFrame, a: str, b: str, nodes: DataFrame) -> DataFrame:
    """The edges between the nodes of a network, each unordered pair once for each of its other values."""
    left, right = nodes.select(F.col("node").alias("a_")), nodes.select(F.col("node").alias("b_"))
    inside = edges.join(left, F.col(a) == F.col("a_"), "left_semi").join(right, F.col(b) == F.col("b_"), "left_semi")
    return inside.withColumns({a: F.least(a, b), b: F.greatest(a, b)}).distinct()


def common_partners(edges: DataFrame, a: str, b: str, inputs: DataFrame, min_targets: int, score: str) -> DataFrame:
    """Partners outside the inputs that touch at least so many of them, with their best score."""
    wanted = inputs.select(F.col(inputs.columns[0]).alias("node")).distinct()
    touched = both_ways(edges, a, b).join(wanted, "node").join(wanted.withColumnRenamed("node", "partner"), "partner", "left_anti")
    return touched.groupBy("partner").agg(F.count_distinct("node").alias("n_targets"), F.max(score).alias("best_score")).where(F.col("n_targets") >= min_targets)


def closure(edges: DataFrame, parent: str, child: str, max_depth: int = 50) -> DataFrame:
    """(ancestor, descendant, depth) of every pair, the shortest depth; a cycle is an error."""
    step = cut(edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).distinct())
    found = cut(step.withColumn("depth", F.lit(1)))
    last = found
    for depth in range(2, max_depth + 1):
        longer = last.select("ancestor", F.col("descendant").alias("middle")).join(step.select(F.col("ancestor").alias("middle"), "descendant"), "middle").select("ancestor", "descendant").distinct()
        if not longer.where("ancestor = descendant").isEmpty():
            raise GraphError("the hierarchy has a cycle")
        last = cut(longer.join(found, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            return found
        found = cut(found.unionByName(last))
    raise GraphError(f"deeper than {max_depth}")


def expand(edges: DataFrame, parent: str, child: str, values: DataFrame, direction: str = "descendants", include_self: bool = True, max_depth: int = 50, max_expand: int | None = None) -> DataFrame:
    """node and depth of the descendants or ancestors of the values, walked from these values only.

    A value that is its own descendant, a walk past max_depth, or more than max_expand nodes are errors.
    """
    near, far = (parent, child) if direction == "descendants" else (child, parent)
    start = values.select(F.col(values.columns[0]).alias("node")).distinct()
    seen, last = cut(start.withColumn("depth", F.lit(0))), start
    for depth in range(1, max_depth + 2):
        met = edges.join(last.select(F.col("node").alias("from_")), F.col(near) == F.col("from_"), "left_semi").where(F.col(far).isNotNull()).select(F.col(far).alias("node")).distinct()
        last = cut(met.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        n = last.count()
        if not n:
            break
        if depth > max_depth:
            raise GraphError(f"deeper than {max_depth}")
        seen = seen.unionByName(last)
        if max_expand is not None and seen.count() > max_expand:
            raise GraphError(f"more than {max_expand} nodes")
    inside = edges.join(seen.select(F.col("node").alias("near_")), F.col(near) == F.col("near_"), "left_semi").join(seen.select(F.col("node").alias("far_")), F.col(far) == F.col("far_"), "left_semi")
    if not cyclic_nodes(inside, near, far).isEmpty():
        raise GraphError("the hierarchy has a cycle")
    return seen if include_self else seen.where("depth > 0")


def members(membership: DataFrame, set_id: str, member: str, edges: DataFrame, parent: str, child: str, wanted) -> DataFrame:
    """Members of a set and of the sets below it, once each, with the set they come by (direct, else the shallowest)."""
    start = membership.sparkSession.createDataFrame([(wanted,)], f"node {dict(membership.dtypes)[set_id]}")
    sets = expand(edges, parent, child, start)
    joined = membership.join(sets, membership[set_id] == sets.node)
    return joined.groupBy(member).agg(F.min(F.struct("depth", F.col(set_id).alias("via"))).alias("best")).select(member, F.col("best.via").alias("via"), F.col("best.depth").alias("depth"))


def _peeled(left: DataFrame, a: str, b: str) -> DataFrame:
    """Edges left after those into nodes without a way on, and from nodes without a way in, are gone, round by round."""
    n = left.count()
    while n:
        kept = left.join(left.select(F.col(a).alias("on_")).distinct(), F.col(b) == F.col("on_"), "left_semi")
        kept = cut(kept.join(left.select(F.col(b).alias("in_")).distinct(), F.col(a) == F.col("in_"), "left_semi"))
        now = kept.count()
        if now == n:
            break
        left, n = kept, now
    return left


def cyclic_nodes(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The edges within cycles: both ends in one strongly connected component, or a self loop.

    Peeling leaves cycles and what lies between them. Each node then takes the greatest node that reaches it as its
    colour; walking back from a colour's own node within the colour gives that node's component. Components are put
    aside and the rest is peeled and coloured again.
    """
    left, found = _peeled(cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()), a, b), []
    while not left.isEmpty():
        colour = cut(left.select(F.col(a).alias("node")).unionByName(left.select(F.col(b).alias("node"))).distinct().withColumn("colour", F.col("node")))
        while True:
            reached = left.join(colour, F.col(a) == F.col("node")).groupBy(F.col(b).alias("to_")).agg(F.max("colour").alias("new_"))
            step = cut(colour.join(reached, F.col("node") == F.col("to_"), "left").select("node", F.greatest("colour", "new_").alias("colour"), (F.col("new_") > F.col("colour")).alias("moved")))
            colour = step.select("node", "colour")
            if step.where("moved").isEmpty():
                break
        same = left.join(colour.select(F.col("node").alias("a_"), F.col("colour").alias("ca_")), F.col(a) == F.col("a_")).join(colour.select(F.col("node").alias("b_"), F.col("colour").alias("cb_")), F.col(b) == F.col("b_")).where("ca_ = cb_").select(a, b)
        same = cut(same)
        back = cut(colour.where("node = colour").select("node"))
        last = back
        while not last.isEmpty():
            met = same.join(last.select(F.col("node").alias("to_")), F.col(b) == F.col("to_"), "left_semi").select(F.col(a).alias("node")).distinct()
            last = cut(met.join(back, "node", "left_anti"))
            back = back.unionByName(last)
        inside = same.join(back.select(F.col("node").alias("a_")), F.col(a) == F.col("a_"), "left_semi").join(back.select(F.col("node").alias("b_")), F.col(b) == F.col("b_"), "left_semi")
        found.append(cut(inside))
        gone = back.select(F.col("node").alias("gone_"))
        left = _peeled(cut(left.join(gone, F.col(a) == F.col("gone_"), "left_anti").join(gone, F.col(b) == F.col("gone_"), "left_anti")), a, b)
    out = edges.select(a, b).limit(0) if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def missing_reverse(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges whose reverse is not stored."""
    back = edges.select(F.col(b).alias("ra"), F.col(a).alias("rb")).distinct()
    return edges.join(back, (F.col(a) == F.col("ra")) & (F.col(b) == F.col("rb")), "left_anti")


def direct_members(membership: DataFrame, set_id: str, member: str, wanted) -> DataFrame:
    """The members listed for a set itself, once each."""
    return membership.where((F.col(set_id) == wanted) & F.col(member).isNotNull()).select(member).distinct()


def mixed_fraction(membership: DataFrame, set_id: str, member: str, edges: DataFrame, parent: str, child: str) -> DataFrame:
    """How many annotations name a member that a set below also names, and their share of all."""
    rows = membership.where(F.col(set_id).isNotNull() & F.col(member).isNotNull()).select(F.col(set_id).alias("set_"), F.col(member).alias("member_")).distinct()
    above = rows.join(closure(edges, parent, child), F.col("set_") == F.col("descendant")).select(F.col("ancestor").alias("set_"), "member_").distinct()
    marked = rows.join(above.withColumn("below_", F.lit(1)), ["set_", "member_"], "left")
    return marked.agg(F.count("*").alias("n_annotations"), F.count("below_").alias("n_mixed")).withColumn("fraction", F.try_divide("n_mixed", "n_annotations"))
