"""Queries over events and orders: terms, histograms, roll-ups, counters, latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.text import project_paths, response_status, sleep_seconds
from larkspur.operators import graph, jobs, tables
from larkspur.plans.common import Registry, table

REGISTRY = Registry()


@REGISTRY.add("""
select event_type as term, count(*) as n from events
where ts > timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-20 00:00:00'
group by 1 order by n desc, term limit 10
""")
def top_terms_in_range(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    inside = events.where(tables.between_open(F.col("ts"), "2024-01-05 00:00:00", "2024-01-20 00:00:00"))
    return tables.top_terms(inside, "event_type", 10)


@REGISTRY.add("select cast(date_trunc('day', ts) as date) as day, count(*) as n from events group by 1")
def daily_histogram(spark, sf_dir):
    return tables.histogram(table(spark, sf_dir, "events"), F.to_date("ts"), "day")


@REGISTRY.add("""
with w as (select unnest([5, 60, 600]) as width)
select w.width as width, (floor(epoch(ts) / w.width) * w.width)::bigint as bucket, sum(cast(value as decimal(18, 4))) as total
from events, w group by 1, 2
""")
def multi_resolution_rollup(spark, sf_dir):
    rolled = tables.roll_up(table(spark, sf_dir, "events"), "ts", F.col("value").cast("decimal(18,4)"), (5, 60, 600))
    return rolled.select("width", F.col("bucket").cast("long").alias("bucket"), F.col("total").cast("decimal(38,4)").alias("total"))


@REGISTRY.add("""
select event_type, count(*) as n, round(count(*) * 100.0 / (select count(*) from events), 6)::double as pct from events group by 1
""")
def share_of_total(spark, sf_dir):
    return tables.share_of_total(table(spark, sf_dir, "events"), "event_type").withColumn("pct", F.col("pct").cast("double"))


@REGISTRY.add("""
select o_orderstatus, count(*) as jobs, count(*) filter (where o_orderpriority = '1-URGENT') as urgent,
  count(*) filter (where o_orderpriority = '5-LOW') as low, sum(cast(o_totalprice as decimal(18, 2))) as total from orders group by 1
""")
def operation_counters(spark, sf_dir):
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "completed").when(F.col("o_orderpriority") == "5-LOW", "ongoing")
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", state.alias("state"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    counts = jobs.counters(rows, "o_orderstatus", "state", "value").withColumnsRenamed({"completed": "urgent", "ongoing": "low"})
    return counts.withColumn("total", F.col("total").cast("decimal(38,2)"))


@REGISTRY.add("select event_id, ts, user_id from events order by ts desc, event_id desc limit 301")
def recent_items(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return tables.ledger_tail(rows, 301, F.col("ts").desc(), F.col("event_id").desc())


@REGISTRY.add("""
select user_id, event_id, ts, event_type, value from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1
""")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return tables.latest(rows, "user_id", F.col("ts"), F.col("event_id"))


@REGISTRY.add("""
select conv_id, count(*) as total, min(turn) as first_turn, max(turn) as last_turn, arg_min(text, turn) as first_text,
  arg_max(text, turn) as last_text from conversations group by 1
""")
def first_row_per_group(spark, sf_dir):
    return tables.extents(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@REGISTRY.add("""
select event_id, coalesce(json_extract_string(props, '$.k'), '') || chr(9) || coalesce(json_extract_string(props, '$.none'), '') as line from events
""")
def path_projection(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", project_paths(F.col("props"), "k,none").alias("line"))


@REGISTRY.add("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_acctbal > 100")
def interesting_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 100").select("c_custkey", "c_name")


@REGISTRY.add("""
with a as (select o_orderkey, o_custkey, o_orderstatus, 0 as src from orders where o_orderkey % 3 <> 0),
b as (select o_orderkey, o_custkey, 'X' as o_orderstatus, 1 as src from orders where o_orderkey % 3 <> 1),
k as (select o_custkey from a intersect select o_custkey from b),
u as (select * from a union all select * from b)
select o_orderkey, o_custkey, o_orderstatus from (
  select *, row_number() over (partition by o_orderkey order by src desc) r from u where o_custkey in (select o_custkey from k)) where r = 1
""")
def merge_datasets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    old = orders.where("o_orderkey % 3 <> 0")
    new = orders.where("o_orderkey % 3 <> 1").withColumn("o_orderstatus", F.lit("X"))
    return tables.merge_latest(old, new, "o_orderkey", "o_custkey")


@REGISTRY.add("""
select l_orderkey, l_partkey from lineitem where l_linenumber <= 3 union select l_orderkey, l_partkey from lineitem where l_linenumber >= 3
""")
def union_distinct_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    low, high = rows.where("l_linenumber <= 3"), rows.where("l_linenumber >= 3")
    return graph.union_distinct(low.select("l_orderkey", "l_partkey"), high.select("l_orderkey", "l_partkey"))


@REGISTRY.add("""
select distinct user_id from events where ts >= timestamp '2024-01-02' and user_id not in (select user_id from events where ts < timestamp '2024-01-02')
""")
def new_additions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    day = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    return tables.new_keys(events.where(F.col("ts") < day), events.where(F.col("ts") >= day), "user_id")


@REGISTRY.add("""
with f as (select user_id, min(ts) as first from events group by 1),
b as (select (floor(epoch(first) / 300) * 300)::bigint as bucket, count(*) as fresh from f group by 1)
select bucket, fresh, (sum(fresh) over (order by bucket))::bigint as total from b
""")
def running_distinct_count(spark, sf_dir):
    return tables.running_distinct(table(spark, sf_dir, "events"), "user_id", "ts", 300).withColumn("bucket", F.col("bucket").cast("long"))


@REGISTRY.add("""
with s as (select event_id, cast(json_extract_string(props, '$.k') as int) as k, user_id from events)
select event_id, case when k % 7 = 0 then 'ban' when 400 + k % 110 between 500 and 503 then 'limit' when 400 + k % 110 = 401 then 'notauth'
  when 400 + k % 110 = 404 then 'notfound' when 400 + k % 110 = 200 then 'ok' else 'unk' end as status, greatest(k - user_id + 1, 4) as wait from s
""")
def response_classes(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", k.alias("k"))
    status = response_status(400 + F.col("k") % 110, F.col("k") % 7)
    return rows.select("event_id", status.alias("status"), sleep_seconds(F.col("k"), F.col("user_id")).cast("long").alias("wait"))


FOLD = """
with e as (select user_id, ts, event_id, case event_type when 'click' then 'assign' when 'view' then 'requeue' when 'purchase' then 'complete'
  when 'error' then 'error' else 'assign' end as kind from events),
l as (select user_id, arg_max(kind, (ts, event_id)) as last, count(*) filter (where kind = 'error') as errors, count(*) as events from e group by 1)
select user_id, case last when 'assign' then 'ongoing' when 'complete' then 'completed' when 'requeue' then 'queued' when 'error' then 'error'
  else 'queued' end as state, errors, events from l
"""
KINDS = {"click": "assign", "view": "requeue", "purchase": "complete", "error": "error"}


def job_events(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return table(spark, sf_dir, "events").withColumn("kind", F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("assign")))


@REGISTRY.add(FOLD)
def job_state_fold(spark, sf_dir):
    return jobs.fold_states(job_events(spark, sf_dir), "user_id", "kind", "ts", "event_id")


@REGISTRY.add("""
select distinct o_custkey from orders where o_orderstatus = 'O' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')
""")
def lost_jobs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    open_, done = orders.where("o_orderstatus = 'O'").select("o_custkey").distinct(), orders.where("o_orderstatus = 'F'")
    return jobs.lost_jobs(open_, done, "o_custkey")


@REGISTRY.add("""
select case o_orderstatus when 'T' then 'F' when 'F' then 'A' end as op, o_custkey as user_id, case o_orderstatus when 'T' then '-1' else '0' end as cursor
from orders where o_orderstatus in ('T', 'F')
""")
def job_chain(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("op"), F.col("o_custkey").alias("user_id"))
    return jobs.chain(done, ("T", "F", "A"))


@REGISTRY.add("""
with s as (select * from conversations where turn <= 2), m as (select conv_id, max(turn) as mark from s group by 1)
select conv_id, turn, text from s union all
select c.conv_id, c.turn, c.text from conversations c left join m using (conv_id) where m.mark is null or c.turn > m.mark
""")
def delta_update(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return tables.delta_update(rows.where("turn <= 2"), rows, "conv_id", "turn")


@REGISTRY.add("""
with m as (select conv_id, min(turn) as mark from conversations where turn >= 3 group by 1)
select c.conv_id, c.turn, c.text from conversations c join m using (conv_id) where c.turn <= m.mark - 1
""")
def resume_older(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return tables.resume_older(rows.where("turn >= 3"), rows, "conv_id", "turn")


@REGISTRY.add("""
select c_custkey, case when c_custkey % 2 = 0 then 'new' else c_name end as c_name from customer
union all select c_custkey + 1000000000, 'new' from customer where c_custkey % 10 = 0
""")
def upsert_rows(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    changed = old.where("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("c_name"))
    added = old.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), F.lit("new").alias("c_name"))
    return tables.upsert(old, changed.unionByName(added), "c_custkey")


@REGISTRY.add("""
select o_orderkey + 1 as o_orderkey, (select count(*) from orders y where y.o_orderkey = x.o_orderkey + 1) > 0 as found from orders x
""")
def found_or_missing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    wanted = orders.select((F.col("o_orderkey") + 1).alias("o_orderkey"))
    return tables.found_or_missing(orders, "o_orderkey", wanted)


@REGISTRY.add("""
select count(*) as workers, count(*) filter (where c_acctbal > 0) as active, floor(count(*) filter (where c_acctbal > 0) * 100 / count(*))::bigint as pct from customer
""")
def worker_utilisation(spark, sf_dir):
    state = F.when(F.col("c_acctbal") > 0, "working").otherwise("idle")
    return jobs.utilisation(table(spark, sf_dir, "customer").select(state.alias("state")), "state")


@REGISTRY.add("select c_custkey, c_name from customer where c_custkey > 500 order by c_custkey limit 100")
def keyset_page(spark, sf_dir):
    return tables.page_after(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 500, 100)


@REGISTRY.add("""
select event_type || ' ' || cast(floor(value) as bigint)::varchar || ' ' || cast(floor(epoch(ts)) as bigint)::varchar as value from events
""")
def metric_lines(spark, sf_dir):
    from larkspur.sources.sinks import metric_lines as lines

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.floor("value").alias("value"), "ts")
    return lines(rows)


@REGISTRY.add("""
select (floor(epoch(ts) / 3600) * 3600)::bigint as bucket, sum(cast(value as decimal(18, 4))) as total from events where event_type like '%c%' group by 1
""")
def series_sum(spark, sf_dir):
    rolled = tables.series_sum(table(spark, sf_dir, "events"), "event_type", "*c*", "ts", F.col("value").cast("decimal(18,4)"), 3600)
    return rolled.select(F.col("bucket").cast("long").alias("bucket"), F.col("total").cast("decimal(38,4)").alias("total"))


@REGISTRY.add("""
select event_id, ts from events where event_type = 'click' and ts > timestamp '2024-01-03' and ts < timestamp '2024-01-25'
order by ts desc, event_id desc limit 10
""")
def search_newest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("terms", F.array("event_type"))
    found = tables.search_newest(rows, "terms", "click", "ts", "2024-01-03 00:00:00", "2024-01-25 00:00:00", 10, "event_id")
    return found.select("event_id", "ts")


@REGISTRY.add("""
select count(*) as n, count(*) filter (where o_orderstatus = 'F') as hits, round(count(*) filter (where o_orderstatus = 'F') * 100.0 / count(*), 6)::double as pct
from orders
""")
def completed_share(spark, sf_dir):
    found = tables.completed_share(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")
    return found.withColumn("pct", F.col("pct").cast("double"))
