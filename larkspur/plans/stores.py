"""Queries over stores, sorted runs, sketches, lookups and gauges: each writes what it needs below the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import graph, sketches
from larkspur.plans.common import Registry, table
from larkspur.sources import lookups, readers, runs, store
from larkspur.storage import new_folder
from larkspur.streaming import gauges, streams

REGISTRY = Registry()

COMMITTED = """
first as (select user_id, event_id, value from events where event_id % 3 <> 0),
second as (select user_id, event_id, value + 1 as value from events where user_id % 10 = 0),
merged as (select user_id, event_id, value from first where event_id not in (select event_id from second) union all select * from second)
"""


def committed(spark, sf_dir):
    """The path and schema of a store after a large commit and one of a tenth of the users."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    path = new_folder(spark, "store")
    store.commit(events.where("event_id % 3 <> 0"), path, "user_id", "event_id", buckets=16)
    store.commit(events.where("user_id % 10 = 0").withColumn("value", F.col("value") + 1), path, "user_id", "event_id", buckets=16)
    return path, events.schema


@REGISTRY.add(f"with {COMMITTED} select user_id, event_id, value from merged")
def store_commits(spark, sf_dir):
    path, schema = committed(spark, sf_dir)
    return store.stored(spark, path, schema)


@REGISTRY.add(f"with {COMMITTED} select user_id, count(*) as n from merged group by 1")
def store_counters(spark, sf_dir):
    """The counters that the commits kept up."""
    path, schema = committed(spark, sf_dir)
    return store.counters(spark, path, schema["user_id"])


@REGISTRY.add("select l_partkey, sum(n)::bigint as n from (select l_partkey, year(l_shipdate), count(*) as n from lineitem group by all) group by 1")
def merged_runs(spark, sf_dir):
    """A sorted run of counts for every third of the suppliers, compacted in rounds of two and read in buckets."""
    lines = table(spark, sf_dir, "lineitem")
    names = [runs.write_run(lines.where(F.col("l_suppkey") % 3 == i).groupBy("l_partkey").agg(F.count("*").alias("n")), "l_partkey", 8) for i in range(3)]
    return runs.run(spark, runs.compacted(spark, names, "l_partkey", "n", buckets=8, fan=2))


@REGISTRY.add("""
with a as (select l_partkey, count(*) as n from lineitem group by 1), b as (select l_partkey, max(l_quantity)::double as most from lineitem where l_quantity > 40 group by 1)
select l_partkey, n, most from a join b using (l_partkey)
""")
def joined_runs(spark, sf_dir):
    """Two sorted runs met bucket by bucket."""
    lines = table(spark, sf_dir, "lineitem")
    counts = runs.write_run(lines.groupBy("l_partkey").agg(F.count("*").alias("n")), "l_partkey", 8)
    most = runs.write_run(lines.where("l_quantity > 40").groupBy("l_partkey").agg(F.max("l_quantity").cast("double").alias("most")), "l_partkey", 8)
    return runs.joined(runs.run(spark, counts), runs.run(spark, most), "l_partkey").select("l_partkey", "n", "most")


@REGISTRY.add("select unnest(range(11))::int as place, count(*) as n, true as within from orders where o_totalprice is not null")
def sketched_bounds(spark, sf_dir):
    """Whether each bound of twelve ranges from one sketch has its rank within the sketch's error, by exact counts."""
    orders = table(spark, sf_dir, "orders")
    bounds = sketches.quantile_bounds(orders, "o_totalprice", 12)
    below = sketches.bucket_counts(orders, "o_totalprice", bounds)
    steps = [(r.bucket, r.n) for r in below.orderBy("bucket").collect()]  # twelve numbers
    n = sum(x for _, x in steps)
    ranks = [(b, n, abs(sum(x for c, x in steps if c <= b) / n - (b + 1) / 12) <= 2 * sketches.RANK_ERROR + 1 / n) for b, _ in steps[:-1]]
    return bounds.join(spark.createDataFrame(ranks, "place int, n long, within boolean"), F.col("at") == F.col("place")).select("place", "n", "within")


@REGISTRY.add("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0 and c_custkey is not null)")
def filtered_anti_join(spark, sf_dir):
    """Orders of customers without debts: most are told by a filter of the debtors, before any shuffle."""
    debtors = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sketches.anti_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), debtors, "o_custkey", debtors.count())


@REGISTRY.add("select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size = 1)")
def filtered_semi_join(spark, sf_dir):
    """Lines of parts of one size, of which a filter lets few others through to the join."""
    parts = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    return sketches.semi_join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey", parts.count())


@REGISTRY.add("""
with e as (select distinct l_suppkey as s, l_partkey as d from lineitem),
p as (select distinct l_partkey as a, 1 + (l_partkey * 7 + l_suppkey) % (select count(*) from part) as b from lineitem),
c as (select x.d as a, y.d as b, count(*) as n from p join e x on x.d = p.a join e y on y.d = p.b and y.s = x.s group by all)
select p.a as a, p.b as b, coalesce(n, 0) as both from p left join c on c.a = p.a and c.b = p.b
""")
def common_neighbours(spark, sf_dir):
    """How many suppliers two parts share, for pairs of parts that are given."""
    lines, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").count()
    edges = lines.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("d"))
    pairs = lines.select(F.col("l_partkey").alias("a"), (1 + (F.col("l_partkey") * 7 + F.col("l_suppkey")) % n).alias("b"))
    return graph.common_neighbours(edges, pairs, "s", "d")


@REGISTRY.add("""
with t as (select doc_id, lang, unnest(list_distinct(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'))) as term from documents where text is not null),
k as (select term, lang, count(*) as n from t where term <> '' group by all), e as (select term from k group by 1 having count(*) >= 2)
select t.term as term, t.lang as lang, t.doc_id as doc_id, k.n as n from t join k on k.term = t.term and k.lang is not distinct from t.lang join e on e.term = t.term where t.lang is not null
""")
def entity_rows(spark, sf_dir):
    """Words that documents of two languages have, a row for each document."""
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[ \\t\\n\\r\\f\\x0B]+")), lambda w: w != "")
    return graph.term_entity_rows(docs.select("doc_id", "lang", F.explode(words).alias("term")), "term", "lang", "doc_id", 2)


@REGISTRY.add("select o_orderkey, o_custkey from orders where o_orderkey in (select unnest(range(1, 60001, 601)))")
def sorted_lookup(spark, sf_dir):
    """A hundred keys looked up in a copy of the orders that is sorted for lookups."""
    path = new_folder(spark, "sorted")
    lookups.write_sorted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, "o_orderkey")
    return lookups.look_up(spark, path, "o_orderkey", list(range(1, 60001, 601)))


@REGISTRY.add("""
select 'stats.events.rows' as label, count(*) as value from events union all select 'stats.events.clicks', count(*) from events where event_type like 'c%'
""")
def stream_gauges(spark, sf_dir):
    """Counters of a stream's batches as the listener wrote them, summed."""
    path = new_folder(spark, "gauges")
    rows = gauges.observed(streams.table_stream(spark, sf_dir, "events").select("event_id", "event_type"), "events", clicks=F.col("event_type").startswith("c"))
    with gauges.gauging(spark, path):
        streams.run_to_files(rows, "append", new_folder(spark, "stream"))
    return gauges.gauge_rows(spark, path).where("label like 'stats.events.%'").groupBy("label").agg(F.sum("value").alias("value"))


@REGISTRY.add("""
with f as (select o_custkey as user_id, o_orderkey as follower_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos from orders where o_custkey is not null),
p as (select user_id, pos // 7 * 7 as cursor, count(*) as n, string_agg(follower_id::varchar, ',' order by pos) as ids from f group by 1, 2)
select user_id, cursor::bigint as cursor, (case when cursor + 7 <= last then cursor + 7 else 0 end)::bigint as next_cursor, n, ids
from p join (select user_id, max(pos) as last from f group by 1) using (user_id)
""")
def follower_pages(spark, sf_dir):
    """Orders as their customers' followers, all in pages of seven."""
    rows = table(spark, sf_dir, "orders").where("o_custkey is not null")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    followers = rows.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("follower_id"), place.cast("bigint").alias("pos"))
    return readers.follower_pages(followers, 7).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@REGISTRY.add("""
select term, ordinal, n from (
  select term, count(*) as n, row_number() over (order by term) as ordinal from (
    select unnest(list_distinct(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'))) as term from documents) where term <> '' group by term)
where n >= 2
""")
def group_ordinals(spark, sf_dir):
    """Words of two documents and more with their numbers among all words."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[ \\t\\n\\r\\f\\x0B]+")), lambda w: w != "")
    return graph.group_ordinals(table(spark, sf_dir, "documents").select(F.explode(words).alias("term")), "term", 2)


@REGISTRY.add("""
select l_partkey, string_agg(l_orderkey::varchar, ':' order by l_orderkey) as orders from lineitem where l_quantity > 45 group by 1
""")
def merged_lists(spark, sf_dir):
    """Lists of orders of each part in three sorted runs, merged bucket by bucket."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    lists = [lines.where(F.col("l_orderkey") % 3 == i).groupBy("l_partkey").agg(F.collect_list("l_orderkey").alias("orders")) for i in range(3)]
    names = [runs.write_run(x, "l_partkey", 8) for x in lists]
    return runs.merged_lists(spark, names, "l_partkey", "orders").withColumn("orders", F.array_join(F.col("orders").cast("array<string>"), ":"))


@REGISTRY.add(r"""
with t as (select doc_id, regexp_replace(text, '([.] )(\w)', '\1#\2', 'g') as t from documents where doc_id % 2 = 0 union all select doc_id, text from documents where doc_id % 2 = 1),
h as (select doc_id, list_filter(list_distinct(list_transform(regexp_extract_all(t, '#(\w+)', 1), lambda x: lower(x))), lambda x: x <> 'rt') as tags from t)
select doc_id, len(tags)::int as n from h where len(tags) > 0
""")
def tagged_documents(spark, sf_dir):
    """Documents with hashtags; every second one had a # put before the words that begin a sentence."""
    docs = table(spark, sf_dir, "documents")
    marked = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", r"([.] )(\w)", "$1#$2")).otherwise(F.col("text"))
    return docs.select("doc_id", text.hashtags(marked).alias("tags")).where(F.size("tags") > 0).select("doc_id", F.size("tags").alias("n"))


@REGISTRY.add("""
with p as (select page_id, regexp_replace(html, '<a href="/([^"]*)">', '<a href="/wiki/\\1" title="\\1">', 'g') as html from pages),
l as (select page_id, unnest(regexp_extract_all(html, '<a href="/wiki/[^"]*" title="([^"]*)">([^<]+)</a>', 2)) as anchor,
  unnest(regexp_extract_all(html, '<a href="/wiki/[^"]*" title="([^"]*)">([^<]+)</a>', 1)) as title from p)
select page_id, anchor, title, count(*) as n from l group by all
""")
def wiki_anchors(spark, sf_dir):
    """Links of all pages that have a title and no element inside, after titles were put into those to the host itself."""
    titled = F.regexp_replace("html", '<a href="/([^"]*)">', '<a href="/wiki/$1" title="$1">')
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(text.wiki_links(titled)).alias("l"))
    return rows.groupBy("page_id", "l.anchor", "l.title").agg(F.count("*").alias("n"))
