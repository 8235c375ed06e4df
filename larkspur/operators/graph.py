"""Graph operators: filtered edges, adjacency, shared neighbours, relatedness, term-entity edges, traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import relatedness
from larkspur.operators.sorted_lists import packed, shared
from larkspur.operators.tables import hinted, parts
from larkspur.storage import materialize

#: Neighbours in a share of a hub's, on average: a task's pairs of one hub are at most these times all of its neighbours.
SHARE = 1000
#: Pairs for each edge from which on they are counted before they shuffle.
DENSE = 8
#: Neighbours of a node that fit a list in its row.
LIST = 1000
PAGE_OFFSET = 100_000_000
EDGE_OFFSET = 200_000_000


def inner_edges(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """Distinct edges with both ends among the nodes."""
    known = nodes.select(F.col(node).alias(src)).distinct()
    other = known.withColumnRenamed(src, dst)
    return edges.select(src, dst).distinct().join(known, src, "left_semi").join(other, dst, "left_semi").select(src, dst)


def union_distinct(*edges: DataFrame) -> DataFrame:
    """Distinct rows of several edge lists."""
    rows = edges[0]
    for other in edges[1:]:
        rows = rows.unionByName(other)
    return rows.distinct()


def adjacency(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Distinct neighbours of each node in order, and their number."""
    found = edges.groupBy(key).agg(F.sort_array(F.collect_set(other)).alias("neighbours"))
    return found.withColumn("degree", F.size("neighbours"))


def neighbour_rows(edges: DataFrame, key: str, other: str) -> DataFrame:
    """(key, other, degree): distinct neighbours as rows, for graphs whose hubs don't fit a list."""
    distinct = edges.select(key, other).distinct()
    return distinct.join(distinct.groupBy(key).agg(F.count("*").alias("degree")), key)


def degrees(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Number of distinct neighbours of each node."""
    return edges.groupBy(key).agg(F.countDistinct(other).alias("degree"))


def shared_neighbours(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(a, b, both): pairs a < b that share in-neighbours, with their number."""
    return counted_pairs(distinct_edges(edges, src, dst), src, dst)


def distinct_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct edges, worked out by as many tasks as they ask for and written out."""
    edges = edges.select(src, dst)
    return materialize(edges.repartition(parts(edges.sparkSession, edges.count()), src, dst).distinct(), "distinct-edges")


def counted_pairs(one: DataFrame, src: str, dst: str, *own: str) -> DataFrame:
    """(a, b, both) of distinct edges, and further columns of the edges, which the far end fixes, as <name>_a and <name>_b.

    A neighbour's pairs are the result's own rows before they are counted. Those of a hub are dealt by one of the two ends over
    as many shares as its degree asks for. Edges and pairs go to as many tasks as their numbers, known from the degrees, ask for; where
    pairs are many more than edges, they are counted before they shuffle.
    """
    counts = one.where(F.col(dst).isNotNull()).groupBy(src).agg(F.count("*").alias("degree"))
    counts = materialize(counts.select(src, "degree", F.ceil(F.col("degree") / SHARE).cast("int").alias("shares")), "degrees")
    degree = F.col("degree").cast("double")
    n_edges, n_pairs = counts.where(F.col(src).isNotNull()).agg(F.sum(degree * F.col("shares")), F.sum(degree * (degree - 1) / 2)).first()
    n_edges, n_pairs = int(n_edges or 0), int(n_pairs or 0)
    hubs = counts.where("shares > 1").select(src, "shares")
    n_hubs = hubs.count()
    salted = one.join(hinted(hubs, n_hubs), src, "left").withColumn("shares", F.coalesce("shares", F.lit(1))) if n_hubs else one.withColumn("shares", F.lit(1))
    left = salted.select(src, F.col(dst).alias("a"), F.pmod(F.xxhash64(dst), F.col("shares")).cast("int").alias("salt"), *[F.col(c).alias(f"{c}_a") for c in own])
    right = salted.select(src, F.col(dst).alias("b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), *[F.col(c).alias(f"{c}_b") for c in own])
    tasks = parts(one.sparkSession, n_edges)
    dealt = lambda side: side.where(F.col(src).isNotNull()).repartition(tasks, src, "salt")
    pairs = dealt(left).join(dealt(right), [src, "salt"]).where("a < b").select("a", "b", *[f"{c}_{end}" for c in own for end in "ab"])
    if n_pairs <= DENSE * n_edges:
        pairs = pairs.repartition(parts(one.sparkSession, n_pairs), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("both"), *[F.max(f"{c}_{end}").alias(f"{c}_{end}") for c in own for end in "ab"])


def common_neighbours(edges: DataFrame, pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """(a, b, both): for given pairs of nodes how many in-neighbours they share, 0 if none. Repeated pairs count once.

    A pair takes the sorted neighbours of both its ends along, packed in a byte or two each, if they are integers and at most ``LIST``; so
    a pair shuffles two times, whatever its ends' degrees. Pairs of hubs walk the end of lower degree, see walked_pairs().
    """
    wanted = materialize(pairs.select("a", "b").distinct(), "pairs")
    ends = wanted.select(F.col("a").alias(dst)).unionByName(wanted.select(F.col("b").alias(dst))).distinct()
    one = materialize(edges.select(src, dst).where(F.col(src).isNotNull()).distinct().join(ends, dst, "left_semi"), "ends-edges")
    if one.schema[src].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return walked_pairs(one, wanted, src, dst)
    hubs = materialize(one.groupBy(dst).agg(F.count("*").alias("degree")).where(F.col("degree") > LIST).select(dst), "hubs")
    n_hubs = hubs.count()
    few, rest, hard = one, wanted, None
    if n_hubs:
        few = one.join(hinted(hubs, n_hubs), dst, "left_anti")
        of_hubs = lambda end: wanted.join(hinted(hubs.select(F.col(dst).alias(end)), n_hubs), end, "left_semi").select("a", "b")
        hard = materialize(of_hubs("a").unionByName(of_hubs("b")).distinct(), "hub-pairs")
        for end in ("a", "b"):
            rest = rest.join(hinted(hubs.select(F.col(dst).alias(end)), n_hubs), end, "left_anti")
    lists = few.groupBy(dst).agg(F.array_sort(F.collect_list(F.col(src).cast("bigint"))).alias("near"))
    lists = materialize(lists.select(dst, packed(F.col("near")).alias("near")), "lists")
    of = lambda end: lists.select(F.col(dst).alias(end), F.col("near").alias(f"near_{end}"))
    met = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", shared(F.col("near_a"), F.col("near_b")).alias("both"))
    return met if hard is None else met.unionByName(walked_pairs(one, hard, src, dst))


def walked_pairs(one: DataFrame, wanted: DataFrame, src: str, dst: str) -> DataFrame:
    """(a, b, both) of distinct pairs over distinct edges, row by row.

    Each pair looks the neighbours of its end of lower degree up among the edges of the other, so a hub's list is walked only for
    pairs of hubs; edges meet the pairs' keys in joins that AQE splits, never as a list in one row.
    """
    degree = one.groupBy(dst).agg(F.count("*").alias("degree"))
    of = lambda end: degree.select(F.col(dst).alias(end), F.col("degree").alias(f"degree_{end}"))
    sized = wanted.join(of("a"), "a").join(of("b"), "b")  # a pair with an end that has no edges shares none
    least = F.col("degree_a") <= F.col("degree_b")
    walked = sized.select("a", "b", F.when(least, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(least, F.col("b")).otherwise(F.col("a")).alias("many"))
    steps = walked.join(one.select(F.col(dst).alias("few"), F.col(src).alias("via")), "few")
    met = steps.join(one.select(F.col(dst).alias("many"), F.col(src).alias("via")), ["many", "via"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    met = met.select(F.col("a").alias("x"), F.col("b").alias("y"), "both")
    return wanted.join(met, F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y")), "left").select("a", "b", F.coalesce("both", F.lit(0)).alias("both"))


def term_entity_rows(rows: DataFrame, term: str, entity: str, value: str, least: int = 1) -> DataFrame:
    """(term, entity, value, n): the values of each pair as rows, with the pair's number, for pairs too large for a list; terms of fewer than ``least`` pairs go."""
    counts = rows.groupBy(term, entity).agg(F.count("*").alias("n"))
    enough = counts.groupBy(term).agg(F.count("*").alias("entities")).where(F.col("entities") >= least).select(term)
    return rows.select(term, entity, value).join(counts.join(enough, term, "left_semi"), [term, entity])


def link_relatedness(edges: DataFrame, src: str, dst: str, universe: Column) -> DataFrame:
    """Pairs with their link distance above 0, and one minus it. Edges bring their ends' degrees along, so pairs meet no further table."""
    one = distinct_edges(edges, src, dst).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    one = one.repartition(parts(one.sparkSession, one.count()), dst)
    sized = one.join(one.groupBy(dst).agg(F.count("*").alias("deg")), dst)
    rows = counted_pairs(materialize(sized, "sized-edges"), src, dst, "deg")
    rows = rows.withColumn("distance", F.round(relatedness(F.col("deg_a"), F.col("deg_b"), F.col("both"), universe), 6))
    return rows.where("distance > 0").select("a", "b", "both", "distance", F.round(1 - F.col("distance"), 6).alias("similarity"))


def redirects(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(page, target): pages without in-links and with one out-link, which stand for its target."""
    out = edges.groupBy(F.col(src).alias("page")).agg(F.countDistinct(dst).alias("n"), F.min(dst).alias("target")).where("n = 1")
    return out.join(edges.select(F.col(dst).alias("page")).distinct(), "page", "left_anti").select("page", "target")


def term_entity_edges(rows: DataFrame, term: str, entity: str, value: str, least: int = 1) -> DataFrame:
    """(term, entity, vals, n): values of each pair in order joined by ``:``; terms of fewer than ``least`` pairs go."""
    edges = rows.groupBy(term, entity).agg(F.concat_ws(":", F.array_sort(F.collect_list(F.col(value)))).alias("vals"), F.count("*").alias("n"))
    if least <= 1:
        return edges
    enough = edges.groupBy(term).agg(F.count("*").alias("entities")).where(F.col("entities") >= least).select(term)
    return edges.join(enough, term, "left_semi")


def numbered(df: DataFrame, *order: str, base: int = 0, name: str = "id") -> DataFrame:
    """Rows with consecutive numbers from base + 1 in an order, without one task that sees them all.

    A range sort gives the parts, which are written out so that they stay as they are when an executor is lost; each row's
    number is its place in its part plus the rows of earlier parts.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parts")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a part
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = parts.withColumn("_place", place).join(hinted(starts, most), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_place") + base).drop("_part", "_n", "_start", "_place")


def group_ordinals(rows: DataFrame, key: str, least: int = 1) -> DataFrame:
    """(key, ordinal, n): groups of at least ``least`` rows with their numbers, from 1, among all groups in order, the smaller ones counted too."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return numbered(counts, key, name="ordinal").where(F.col("n") >= least).select(key, "ordinal", "n")


def frontier_levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, level): least number of steps from the seeds, up to a depth; edges (src, dst), seeds (node).

    Each level is one join of the frontier and an anti join with what was seen. The distinct edges are worked out, by as many tasks
    as they ask for, and written out once, and levels one by one, so no plan grows with the depth; the traversal ends when a level is empty.
    """
    edges = distinct_edges(edges.where("src is not null and dst is not null"), "src", "dst")
    seen = seeds.select("node").where("node is not null").distinct().withColumn("level", F.lit(0))
    seen = frontier = materialize(seen, "level")
    for level in range(1, depth + 1):
        steps = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = materialize(steps.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
