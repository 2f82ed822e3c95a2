"""Co-mention networks as edge and node DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import released, written


def comentions(mentions: DataFrame, least: int = 1, most_names: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(source, target, weight): items that name both. An item's names form pairs, the source first in `order`, else by name; names outside `order` come last. `most_names` leaves out longer items."""
    per = mentions.groupBy("item").agg(F.sort_array(F.collect_set("name")).alias("names")).filter(F.size("names") >= 2)
    if order:
        place = F.create_map(*[F.lit(x) for pair in zip(order, range(len(order)), strict=True) for x in pair])
        placed = F.transform("names", lambda n: F.struct(F.coalesce(place[n], F.lit(len(order))).alias("at"), n.alias("name")))
        per = per.withColumn("names", F.transform(F.array_sort(placed), lambda x: x["name"]))
    if most_names:
        per = per.filter(F.size("names") <= most_names)
    at = per.select("names", F.posexplode("names").alias("i", "source"))
    pairs = at.select("source", F.explode(F.expr("slice(names, i + 2, size(names))")).alias("target"))
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def upwards(edges: DataFrame) -> DataFrame:
    """The edges (source, target, weight) from the node with fewer neighbours to the one with more, ties by name."""
    rank = degrees(edges).select("name", F.struct("degree", "name").alias("r"))
    ends = edges.select("source", "target", "weight").join(rank.toDF("source", "s"), "source").join(rank.toDF("target", "t"), "target")
    return ends.select(F.least("s", "t")["name"].alias("source"), F.greatest("s", "t")["name"].alias("target"), "weight")


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles of every node and its local clustering.

    Edges point from the node with fewer neighbours to the one with more, so a hub leads nowhere and no node has more than
    the square root of twice the number of edges ahead of it.
    """
    e = upwards(edges).drop("weight")
    ab, bc, ac = (e.toDF(*p) for p in ("ab", "bc", "ac"))
    t = ab.join(bc, "b").join(ac, ["a", "c"])
    per = t.select(F.explode(F.array("a", "b", "c")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("triangles"))
    d = degrees(edges)
    k = F.col("degree")
    return d.join(per, "name", "left").select("name", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.coalesce(F.try_divide(2.0 * F.coalesce("triangles", F.lit(0)), k * (k - 1)), F.lit(0.0)).alias("clustering"))


def transitivity(edges: DataFrame) -> DataFrame:
    t, d = triangles(edges), degrees(edges)
    j = t.join(d, "name")
    return j.agg(F.coalesce(F.try_divide(2.0 * F.sum("triangles"), F.sum(F.col("degree") * (F.col("degree") - 1))), F.lit(0.0)).alias("transitivity"), F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"))


def components(edges: DataFrame) -> DataFrame:
    """(name, component): the least name reachable. Labels spread along edges and jump to their label's label until none changes.

    Each round doubles the way a label has come, so a long chain takes as many rounds as its length has digits.
    """
    both = written(both_ways(edges).select("source", "target"), "both")
    label = written(both.select(F.col("source").alias("name")).distinct().withColumn("component", F.col("name")), "labels")
    while True:
        near = both.join(label.select(F.col("name").alias("target"), "component"), "target").groupBy(F.col("source").alias("name")).agg(F.min("component").alias("near"))
        spread = label.join(near, "name", "left").select("name", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = label.select(F.col("name").alias("to"), F.col("component").alias("further"))
        new = written(spread.join(jump, "to", "left").select("name", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("was")).alias("moved")), "labels")
        settled = new.filter("moved").isEmpty()
        released(label)
        label = new.drop("moved")
        label.written_to = new.written_to
        if settled:
            released(both)
            return label


def summary(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes, edges, density, isolates, mean degree and strength, components (isolates count), the giant one's size, of a network over `names` (name).

    A network without edges has density 0 and as many components as nodes.
    """
    d = names.select("name").distinct().join(degrees(edges), "name", "left").fillna(0, ["degree", "strength"])
    c = names.select("name").distinct().join(components(edges), "name", "left").groupBy(F.coalesce("component", "name").alias("component")).agg(F.count(F.lit(1)).alias("size"))
    n = F.count(F.lit(1))
    one = d.agg(n.alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.coalesce(F.try_divide(F.sum("degree"), n * (n - 1)), F.lit(0.0)).alias("density"), F.count_if(F.col("degree") == 0).alias("isolates"), F.avg("degree").alias("mean_degree"), F.avg("strength").alias("mean_strength"))
    two = c.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("giant"))
    return one.withColumn("_k", F.lit(1)).join(two.withColumn("_k", F.lit(1)), "_k").drop("_k")


def diameter(edges: DataFrame) -> DataFrame:
    """(diameter): the longest shortest path, in edges, within the largest component (ties: the least name's); 0 without edges.

    Distances spread from all nodes at once, a step a round: pairs of the component, so for networks of few thousand nodes.
    """
    c = components(edges)
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    giant = size.agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"))
    both = written(both_ways(edges).select("source", "target").distinct().join(c.join(giant, "component").select(F.col("name").alias("source")), "source"), "both")
    seen = written(both.select("source", F.col("source").alias("target")).distinct(), "seen")
    front, far = seen, 0
    while True:
        step = front.select("source", F.col("target").alias("via")).join(both.withColumnRenamed("source", "via"), "via").select("source", "target").distinct()
        front = written(step.join(seen, ["source", "target"], "left_anti"), "front")
        if front.isEmpty():
            released(both)
            return edges.sparkSession.createDataFrame([(far,)], "diameter long")
        far += 1
        seen = written(seen.unionByName(front), "seen")


def top_ties(edges: DataFrame, n: int = 10) -> DataFrame:
    """The n heaviest edges, ties by name."""
    return edges.orderBy(F.desc("weight"), "source", "target").limit(n)


def top_flows(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The n largest net flows (source, target, flow), ties by name."""
    return pairs.orderBy(F.desc("flow"), "source", "target").limit(n)


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Weighted PageRank by fixed rounds from the uniform start. Every node of an undirected edge list has a way out."""
    both = both_ways(edges)
    out = both.groupBy("source").agg(F.sum("weight").alias("total"))
    share = written(both.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("p")), "shares")
    names = written(share.select(F.col("source").alias("name")).distinct(), "names")
    n = names.count()
    rank = names.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(1, rounds + 1):
        got = share.join(rank.withColumnRenamed("name", "source"), "source").groupBy(F.col("target").alias("name")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        rank = names.join(got, "name", "left").select("name", ((1 - damping) / max(n, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 5 == 0:  # so that the plan stays short
            rank = written(rank, "ranks")
    return rank


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of degrees over both directions of every edge; null if all degrees are equal."""
    d = degrees(edges).select("name", "degree")
    j = both_ways(edges).join(d.toDF("source", "x"), "source").join(d.toDF("target", "y"), "target")
    return j.agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("assortativity"))


def monthly_focus(mentions: DataFrame, dates: DataFrame, focus: str) -> DataFrame:
    """Co-mentions of one name by month: partners, weight and its share of all weight."""
    m = mentions.join(dates, "item").withColumn("month", F.date_format("d", "yyyy-MM"))
    per = m.groupBy("month", "item").agg(F.sort_array(F.collect_set("name")).alias("names")).filter(F.size("names") >= 2)
    at = per.select("month", "names", F.posexplode("names").alias("i", "source"))
    e = at.select("month", "source", F.explode(F.expr("slice(names, i + 2, size(names))")).alias("target")).groupBy("month", "source", "target").agg(F.count(F.lit(1)).alias("weight"))
    own = (F.col("source") == focus) | (F.col("target") == focus)
    return e.groupBy("month").agg(F.count_if(own).alias("partners"), F.coalesce(F.sum(F.when(own, F.col("weight"))), F.lit(0)).alias("strength"), F.try_divide(F.coalesce(F.sum(F.when(own, F.col("weight"))), F.lit(0)), F.sum("weight")).alias("share"))


def ranked(nodes: DataFrame, by: str) -> DataFrame:
    """Ranks with gaps, the greatest first. For node tables, which are small."""
    return nodes.withColumn("rank", F.rank().over(Window.orderBy(F.desc(by))))


def connectedness(shares: DataFrame) -> DataFrame:
    """FROM, TO, NET and OWN of each node of long shares (target, source, share)."""
    off = F.col("target") != F.col("source")
    f = shares.groupBy(F.col("target").alias("node")).agg(F.sum(F.when(off, F.col("share")).otherwise(0.0)).alias("from_others"), F.sum(F.when(~off, F.col("share")).otherwise(0.0)).alias("own"))
    t = shares.groupBy(F.col("source").alias("node")).agg(F.sum(F.when(off, F.col("share")).otherwise(0.0)).alias("to_others"))
    return f.join(t, "node").withColumn("net", F.col("to_others") - F.col("from_others"))


def pairwise_net(shares: DataFrame) -> DataFrame:
    """Net flow of each unordered pair, from the stronger to the weaker sender."""
    a, b = shares.toDF("t", "s", "x"), shares.toDF("s", "t", "y")
    d = a.join(b, ["t", "s"]).filter("s < t").withColumn("flow", F.col("x") - F.col("y"))
    return d.select(F.when(F.col("flow") >= 0, F.col("s")).otherwise(F.col("t")).alias("source"), F.when(F.col("flow") >= 0, F.col("t")).otherwise(F.col("s")).alias("target"), F.abs("flow").alias("flow"))


def weighted_clustering(edges: DataFrame) -> DataFrame:
    """Mean over a node's pairs of neighbours of the geometric mean of the triangle's weights, relative to the greatest weight. Edges point from low to high degree, as in `triangles`."""
    top = edges.agg(F.max("weight").cast("double")).first()[0] or 1.0
    e = upwards(edges).withColumn("weight", F.col("weight") / top)
    w = lambda a, b, n: e.toDF(a, b, n)
    t = w("a", "b", "x").join(w("b", "c", "y"), "b").join(w("a", "c", "z"), ["a", "c"]).withColumn("v", F.cbrt(F.col("x") * F.col("y") * F.col("z")))
    per = t.select(F.explode(F.array("a", "b", "c")).alias("name"), "v").groupBy("name").agg(F.sum("v").alias("v"))
    d = degrees(edges)
    return d.join(per, "name", "left").select("name", F.coalesce(F.try_divide(2 * F.col("v"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)).alias("clustering"))


#: Stands between a group and a name; names and groups do not hold it.
APART = "\x1f"


def grouped_comentions(mentions: DataFrame, group: str, least: int = 1) -> DataFrame:
    """(group, source, target, weight): co-mentions of (group, item, name) within each group."""
    per = mentions.groupBy(F.col(group).cast("string").alias("group"), "item").agg(F.sort_array(F.collect_set("name")).alias("names")).filter(F.size("names") >= 2)
    at = per.select("group", "names", F.posexplode("names").alias("i", "source"))
    pairs = at.select("group", "source", F.explode(F.expr("slice(names, i + 2, size(names))")).alias("target"))
    return pairs.groupBy("group", "source", "target").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)


def _apart(edges: DataFrame) -> DataFrame:
    """The groups' networks as one, in which no edge leads from one to another."""
    return edges.select(F.concat("group", F.lit(APART), "source").alias("source"), F.concat("group", F.lit(APART), "target").alias("target"), "weight")


def _split(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"group": F.substring_index("name", APART, 1), "name": F.substring_index("name", APART, -1)})


def grouped_nodes(edges: DataFrame) -> DataFrame:
    """(group, name, degree, strength, centrality, triangles, clustering) of (group, source, target, weight). Centrality: the degree by the other nodes of the group's network."""
    one = _apart(edges)
    d = _split(degrees(one).join(triangles(one), "name"))
    n = d.groupBy(F.col("group").alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    return d.join(n, F.col("group") == F.col("_g")).select("group", "name", "degree", "strength", F.coalesce(F.try_divide("degree", F.col("_n") - 1), F.lit(0.0)).alias("centrality"), "triangles", "clustering")


def grouped_metrics(edges: DataFrame) -> DataFrame:
    """(group, metric, value): the figures of every group's network, all groups in the same passes.

    nodes, edges, density, mean_degree, mean_strength, max_centrality, clustering (mean), transitivity, assortativity (null if all degrees are equal), components and giant. Nodes without an edge are not known here.
    """
    nodes = written(grouped_nodes(edges), "nodes")
    n, k = F.count(F.lit(1)), F.col("degree")
    figures = nodes.groupBy("group").agg(
        n.cast("double").alias("nodes"), (F.sum(k) / 2).alias("edges"), F.coalesce(F.try_divide(F.sum(k), n * (n - 1)), F.lit(0.0)).alias("density"), F.avg(k).alias("mean_degree"), F.avg("strength").alias("mean_strength"),
        F.max("centrality").alias("max_centrality"), F.avg("clustering").alias("clustering"), F.coalesce(F.try_divide(2.0 * F.sum("triangles"), F.sum(k * (k - 1))), F.lit(0.0)).alias("transitivity"),
    )
    end = lambda c, x: nodes.select(F.col("group").alias(f"g{x}"), F.col("name").alias(c), k.cast("double").alias(x))
    both = edges.select("group", "source", "target").unionByName(edges.select("group", F.col("target").alias("source"), F.col("source").alias("target")))
    ends = both.join(end("source", "x"), ["source"]).filter("group = gx").join(end("target", "y"), ["target"]).filter("group = gy")
    mixing = ends.groupBy("group").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("assortativity"))
    sizes = _split(components(_apart(edges))).groupBy("group", "component").agg(n.alias("size"))
    parts = sizes.groupBy("group").agg(n.cast("double").alias("components"), F.max("size").cast("double").alias("giant"))
    wide = figures.join(mixing, "group").join(parts, "group")
    return wide.unpivot("group", [c for c in wide.columns if c != "group"], "metric", "value")
