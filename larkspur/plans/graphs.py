"""Queries over edges: order lines as a graph of orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import graph, tables
from larkspur.plans.common import Registry, table
from larkspur.sources import sinks

REGISTRY = Registry()


@REGISTRY.add("""
select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1995-01-01')
""")
def anti_join_processed(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))
    return tables.except_keys(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", done.select("o_custkey"))


@REGISTRY.add("""
with n as (select p_partkey from part where p_size < 20),
e as (select distinct l_suppkey as src, l_partkey as dst from lineitem where l_partkey in (select p_partkey from n) and l_suppkey in (select p_partkey from n))
select (row_number() over (order by src, dst))::bigint as id, src, dst from e
""")
def semi_join_graph(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    inner = graph.inner_edges(edges, table(spark, sf_dir, "part").where("p_size < 20"), "src", "dst", "p_partkey")
    return graph.numbered(inner, "src", "dst").select(F.col("id").cast("long").alias("id"), "src", "dst")


@REGISTRY.add("select l_orderkey as src, l_partkey as dst, 'out' as way from lineitem union all select l_partkey, l_orderkey, 'in' from lineitem")
def unnest_links(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_partkey").alias("links"))
    out = lists.select(F.col("l_orderkey").alias("src"), F.explode("links").alias("dst"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("in").alias("way"))
    return out.withColumn("way", F.lit("out")).unionByName(back)


@REGISTRY.add("""
select l_partkey, string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar) as neighbours, count(distinct l_suppkey)::int as degree from lineitem group by 1
""")
def adjacency_lists(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("s"))
    return graph.adjacency(edges, "l_partkey", "s").select("l_partkey", F.concat_ws(",", "neighbours").alias("neighbours"), "degree")


@REGISTRY.add("""
with e as (select distinct l_suppkey, l_partkey from lineitem), d as (select l_partkey, count(*) as degree from e group by 1)
select l_partkey, l_suppkey, degree from e join d using (l_partkey)
""")
def neighbour_rows(spark, sf_dir):
    return graph.neighbour_rows(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@REGISTRY.add("""
with e as (select distinct l_orderkey as src, l_partkey as dst from lineitem),
d as (select dst, count(*) as n from e group by 1), w as (select count(*)::double as w from part),
p as (select x.dst as a, y.dst as b, count(*) as both from e x join e y on x.src = y.src and x.dst < y.dst group by 1, 2),
r as (select a, b, p.both, round((ln(greatest(da.n, db.n)) - ln(p.both)) / (ln(w.w) - ln(least(da.n, db.n))), 6) as distance
  from p join d da on da.dst = a join d db on db.dst = b, w)
select a, b, r.both, distance, round(1 - distance, 6) as similarity from r where distance > 0
""")
def relatedness(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    universe = float(table(spark, sf_dir, "part").count())
    return graph.link_relatedness(edges, "src", "dst", F.lit(universe))


@REGISTRY.add("""
with e as (select distinct o_custkey as src, o_custkey + 1 as dst from orders where o_custkey % 4 <> 0)
select src as page, min(dst) as target from e where src not in (select dst from e) group by 1 having count(distinct dst) = 1
""")
def redirect_pages(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"))
    return graph.redirects(edges, "src", "dst")


@REGISTRY.add("""
with recursive e as (select distinct l_suppkey as src, 1000000000 + l_partkey as dst from lineitem),
g as (select src, dst from e union select dst, src from e),
f(node, level) as (select 1::bigint, 0 union select g.dst, f.level + 1 from f join g on g.src = f.node where f.level < 3)
select node, min(level)::int as level from f group by 1
""")
def frontier_levels(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.frontier_levels(both, spark.createDataFrame([(1,)], "node long"), 3)


@REGISTRY.add("""
select 0 as section, '<?xml version="1.0" encoding="UTF-8"?>' as line union all select 1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
union all select 2, '<key id="label" for="all" attr.name="label" attr.type="string"/>' union all select 3, '<graph id="G" edgedefault="directed">'
union all select 4, '<node id="' || n_nationkey || '"><data key="label">' || n_name || '</data></node>' from nation
union all select 4, '<node id="' || (100000000 + r_regionkey) || '"><data key="label">' || r_name || '</data></node>' from region
union all select 5, '<edge id="' || (200000000 + n_nationkey) || '" source="' || n_nationkey || '" target="' || (100000000 + n_regionkey) || '"><data key="label">in</data></edge>' from nation
union all select 6, '</graph>' union all select 7, '</graphml>'
""")
def graphml_lines(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nodes = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")).unionByName(
        region.select((F.col("r_regionkey") + graph.PAGE_OFFSET).alias("id"), F.col("r_name").alias("label"))
    )
    edges = nation.select(
        (F.col("n_nationkey") + graph.EDGE_OFFSET).alias("id"), F.col("n_nationkey").alias("source"), (F.col("n_regionkey") + graph.PAGE_OFFSET).alias("target"), F.lit("in").alias("label")
    )
    return sinks.graphml_lines(nodes, edges)
