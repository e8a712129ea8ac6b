"""Trees of analogs: roots of components, breadth-first trees, cluster representatives and their children, statistics, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import connected_components

#: (name, least score) of a node's kind in a tree, and how many of each kind a tree shows.
KINDS, SHOWN = (("exact", 0.7), ("close", 0.5), ("possible", 0.0)), {"exact": 10, "close": 15, "possible": 20}
#: The ladder of a hierarchy's relations.
RELATIONS = (("дубль", 0.9), ("аналог", 0.7), ("близкий аналог", 0.5), ("возможный аналог", 0.3), ("похожий товар", 0.1))


def ladder(score: Column, steps, other: str) -> Column:
    out = None
    for name, least in steps:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(other)


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of edges (a, b, score)."""
    return edges.select("a", "b", "score").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))


def components_of(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges, a component named by its least node."""
    roots = connected_components(edges.select("a", "b"))
    return written(roots.select("node", F.col("root").alias("component")).union(roots.select("root", "root").distinct()))


def tree_roots(edges: DataFrame) -> DataFrame:
    """(component, root, weight): of each component the node of the greatest .4 degree + .3 mean score + .3 sum of scores; ties: the least."""
    weights = mirrored(edges).groupBy("a").agg((0.4 * F.count("*") + 0.3 * F.avg("score") + 0.3 * F.sum("score")).alias("weight"))
    known = weights.join(components_of(edges), F.col("a") == F.col("node")).select("component", F.col("a").alias("node"), F.round("weight", 9).alias("weight"))
    best = F.row_number().over(Window.partitionBy("component").orderBy(F.col("weight").desc(), "node"))
    return known.withColumn("_r", best).where("_r = 1").select("component", F.col("node").alias("root"), "weight")


def trees(edges: DataFrame, depth: int = 5) -> DataFrame:
    """(root, node, parent, level, score, kind, shown): breadth-first trees from each component's root, to `depth` levels.

    A node hangs under the parent visited first: of one level, by the parents' own place, then by the greater score. `shown` tells which
    nodes a tree lists: so many of each kind, by their place."""
    both = written(mirrored(edges))
    front = written(tree_roots(edges).select("root", F.col("root").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level"), F.lit(None).cast("double").alias("score"), F.array(F.lit(0).cast("long")).alias("place")))
    seen = front
    for level in range(1, depth + 1):
        # children of a parent are visited by falling score; places are compared from the root down
        rank = F.row_number().over(Window.partitionBy("root", "node").orderBy(F.col("s").desc(), "b"))
        step = front.select("root", "node", "place").join(both.select(F.col("a").alias("node"), "b", F.col("score").alias("s")), "node")
        step = step.join(seen.select("root", F.col("node").alias("b")), ["root", "b"], "left_anti").withColumn("at", F.concat("place", F.array(rank.cast("long"))))
        first = F.row_number().over(Window.partitionBy("root", "b").orderBy("at"))
        step = step.withColumn("_r", first).where("_r = 1").select("root", F.col("b").alias("node"), F.col("node").alias("parent"), F.lit(level).alias("level"), F.col("s").alias("score"), F.col("at").alias("place"))
        front = written(step)
        if front.isEmpty():
            break
        seen = seen.union(front)
    out = seen.withColumn("kind", F.when(F.col("level") == 0, "root").otherwise(ladder(F.col("score"), KINDS[:2], KINDS[2][0])))
    nth = F.row_number().over(Window.partitionBy("root", "kind").orderBy("level", "place"))
    most = F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv])
    return out.withColumn("shown", (F.col("kind") == "root") | (nth <= F.element_at(most, F.col("kind")))).drop("place")


def representatives(members: DataFrame) -> DataFrame:
    """(cluster, root, root_name): of members (cluster, id, name) the shortest name, the least id on ties."""
    first = F.row_number().over(Window.partitionBy("cluster").orderBy(F.length("name"), "id"))
    return members.withColumn("_r", first).where("_r = 1").select("cluster", F.col("id").alias("root"), F.col("name").alias("root_name"))


def most_similar(members: DataFrame) -> DataFrame:
    """(cluster, root, mean): the member of the greatest mean Jaccard of words to the others, without comparing all pairs: a member's sum of
    overlaps goes over the words' counts only where sizes are equal, so all pairs that share a word are joined by it, in salted cells."""
    words = members.select("cluster", "id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w"))
    size = words.groupBy("cluster", "id").agg(F.count("*").alias("n"))
    k = words.alias("x").join(words.alias("y"), (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.id") != F.col("y.id")))
    k = k.groupBy(F.col("x.cluster").alias("cluster"), F.col("x.id").alias("id"), F.col("y.id").alias("other")).agg(F.count("*").alias("k"))
    scored = k.join(size, ["cluster", "id"]).join(size.select("cluster", F.col("id").alias("other"), F.col("n").alias("m")), ["cluster", "other"])
    total = scored.groupBy("cluster", "id").agg(F.sum(F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("total"))
    count = members.groupBy("cluster").agg((F.count("*") - 1).alias("others"))
    mean = total.join(count, "cluster").select("cluster", "id", F.round(F.col("total") / F.col("others"), 9).alias("mean"))
    first = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("mean").desc(), "id"))
    return mean.withColumn("_r", first).where("_r = 1").select("cluster", F.col("id").alias("root"), "mean")


def word_set(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def hierarchy(members: DataFrame, least: float = 0.5, children: int | None = 20) -> DataFrame:
    """(cluster, root, child, score, relation, rank): under each cluster's representative its members of a word Jaccard of `least` or
    more to it, the best `children` of them, or all, without a rank, if that is None. Linear: members meet their representative alone."""
    met = members.join(representatives(members), "cluster").where("id <> root")
    a, b = word_set(F.col("name")), word_set(F.col("root_name"))
    both = F.size(F.array_intersect(a, b))
    scored = met.withColumn("score", both / (F.size(a) + F.size(b) - both)).where(F.col("score") >= least - 1e-12)
    columns = ["cluster", "root", F.col("id").alias("child"), "score", ladder(F.col("score"), RELATIONS, "нет аналогов").alias("relation")]
    if children is None:
        return scored.select(*columns)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("score", 9).desc(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= children).select(*columns, "rank")


def local_pairs(members: DataFrame, least: float) -> DataFrame:
    """(cluster, a, b, score): pairs within a cluster of a word Jaccard of `least` or more, by the exact prefix-filter join of the members' word sets,
    so a large cluster doesn't put out all its pairs."""
    from .pairs import jaccard_pairs

    kept = written(members.select("cluster", "id", word_set(F.col("name")).alias("terms")).where(F.size("terms") > 0))
    met = jaccard_pairs(kept.select(F.col("id").alias("class_id"), "terms"), least)
    a, b = (kept.select(F.col("id").alias(k), F.col("cluster").alias(f"c{k}")) for k in "ab")
    return met.join(a, "a").join(b, "b").where("ca = cb").select(F.col("ca").alias("cluster"), "a", "b", "score")


def assign_to_centroids(points: DataFrame, centroids: DataFrame, least: float = -1.0) -> DataFrame:
    """(id, label, cosine): for points (id, e) the nearest of centroids (label, c), unit vectors, if its cosine is `least` or more.

    Labels found on a sample go to all rows by this. Centroids are broadcast; they number the clusters, not the rows."""
    dot = F.aggregate(F.zip_with("e", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    near = points.crossJoin(F.broadcast(centroids)).withColumn("cosine", F.when(norm > 0, dot / norm).otherwise(0.0))
    best = near.groupBy("id").agg(F.max(F.struct(F.round("cosine", 12).alias("cosine"), (-F.col("label")).alias("l"))).alias("m"))
    return best.select("id", (-F.col("m.l")).alias("label"), F.col("m.cosine").alias("cosine")).where(F.col("cosine") >= least)


def tree_lines(hierarchies: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, tree): a text of a root and, indented, its children by rank: '- code | name [relation] (0.0000)'. Names: (id, name)."""
    roots = hierarchies.select("cluster", "root").distinct().select("cluster", F.lit(0).alias("rank"), F.col("root").alias("id"), F.lit("root").alias("relation"), F.lit(None).cast("double").alias("score"))
    rows = roots.union(hierarchies.select("cluster", "rank", F.col("child").alias("id"), "relation", "score")).join(names, "id")
    indent = F.when(F.col("rank") == 0, "").otherwise("    ")
    score = F.when(F.col("score").isNull(), "").otherwise(F.concat(F.lit(" ("), F.format_string("%.4f", F.round(F.col("score") + 1e-9, 4)), F.lit(")")))
    line = F.concat(indent, F.lit("- "), F.col("id").cast("string"), F.lit(" | "), F.col("name"), F.lit(" ["), F.col("relation"), F.lit("]"), score)
    return rows.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("tree"))
