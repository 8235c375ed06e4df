"""Streaming queries: each runs a stream over the table that is there and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.plans.common import Registry, table
from larkspur.plans.series import FOLD, KINDS
from larkspur.sources import pages
from larkspur.storage import new_folder
from larkspur.streaming import monitor, streams

REGISTRY = Registry()


def checkpoint(spark) -> str:
    """A fresh checkpoint folder that driver and executors share."""
    return new_folder(spark, "stream")


@REGISTRY.add("select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n from events group by 1, 2")
def stream_window_counts(spark, sf_dir):
    counts = streams.window_counts(streams.table_stream(spark, sf_dir, "events"), "ts", "1 day", "event_type")
    found = streams.run_available(counts, "complete", checkpoint(spark))
    return found.select(F.to_date(F.col("start")).alias("day"), "event_type", "n")


@REGISTRY.add("""
select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1
""")
def stream_latest_user(spark, sf_dir):
    rows = streams.table_stream(spark, sf_dir, "events")
    last = streams.latest_values(rows, "user_id", F.struct("ts", "event_id"), "event_id", "value")
    return streams.run_to_files(last, "complete", checkpoint(spark))


@REGISTRY.add("select event_id, user_id from events where event_type like 'c%'")
def stream_filter(spark, sf_dir):
    rows = streams.channel(streams.table_stream(spark, sf_dir, "events"), "event_type", "c*").select("event_id", "user_id")
    return streams.run_to_files(rows, "append", checkpoint(spark))


@REGISTRY.add("select count(distinct user_id) as n from events")
def stream_distinct_users(spark, sf_dir):
    rows = streams.distinct_events(streams.table_stream(spark, sf_dir, "events").select("user_id"), "user_id")
    return streams.run_to_files(rows, "append", checkpoint(spark)).agg(F.count("*").alias("n"))


def job_stream(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return streams.table_stream(spark, sf_dir, "events").withColumn("kind", F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("assign")))


@REGISTRY.add(FOLD)
def stream_job_machine(spark, sf_dir):
    """The state machine with a state of its own for each job."""
    rows = job_stream(spark, sf_dir).select(F.col("user_id").alias("job"), "kind", "ts", F.col("event_id").alias("seq"))
    return streams.run_updates(streams.job_machine(rows), "job", checkpoint(spark)).withColumnRenamed("job", "user_id")


@REGISTRY.add("""
with w as (select unnest([5, 60, 600]) as width)
select w.width as width, (floor(epoch(ts) / w.width) * w.width)::bigint as bucket, sum(cast(value as decimal(18, 4))) as total
from events, w group by 1, 2
""")
def stream_roll_ups(spark, sf_dir):
    rows = streams.table_stream(spark, sf_dir, "events")
    rolled = streams.roll_ups(rows, "ts", F.col("value").cast("decimal(18,4)"), (5, 60, 600))
    found = streams.run_to_files(rolled, "complete", checkpoint(spark))
    return found.select("width", "bucket", F.col("total").cast("decimal(38,4)").alias("total"))


@REGISTRY.add("select doc_id, lang from documents where text is not null and lang = 'en' and length(text) > 100")
def stream_documents(spark, sf_dir):
    """A filter over a stream of documents, appended to files."""
    rows = streams.table_stream(spark, sf_dir, "documents").where("text is not null and lang = 'en' and length(text) > 100")
    return streams.run_to_files(rows.select("doc_id", "lang"), "append", checkpoint(spark))


@REGISTRY.add(FOLD)
def stream_job_states(spark, sf_dir):
    rows = job_stream(spark, sf_dir)
    return streams.run_to_files(streams.job_states(rows, "user_id", "kind", "ts", "event_id"), "complete", checkpoint(spark))


GROWTH = """
with p as (select o_orderkey % 7 as user_id, o_custkey as follower_id, epoch(o_orderdate)::bigint as seen from orders where o_custkey is not null and o_orderdate is not null),
f as (select user_id, follower_id, floor(min(seen) / 604800)::bigint * 604800 as bucket from p group by all),
s as (select user_id, bucket, count(*) as fresh from f group by all)
"""


@REGISTRY.add(f"""{GROWTH}
select user_id, bucket, fresh, sum(fresh) over (partition by user_id order by bucket)::bigint as total from s
""")
def stream_follower_growth(spark, sf_dir):
    """Polls of seven users' followers, in batches in the order of a hash: new ones by week and running totals, from state."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    shuffled = orders.repartition(6, F.xxhash64("o_orderkey"))
    folder = checkpoint(spark)
    shuffled.write.parquet(f"{folder}/polls.parquet")
    polls = streams.table_stream(spark, folder, "polls", files_per_batch=2)
    polls = polls.select((F.col("o_orderkey") % 7).alias("user_id"), F.col("o_custkey").alias("follower_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    monitor.store_changes(monitor.follower_changes(polls, 7 * 24 * 3600), folder).awaitTermination()
    return monitor.growth(monitor.stored_changes(spark, folder))


@REGISTRY.add("select event_id, user_id, event_type from events where event_type like 'c%'")
def stream_timeline_pages(spark, sf_dir):
    """The pages of a stored table through the library's own source, filtered and appended to files."""
    rows = pages.page_stream(spark, f"{sf_dir}/events.parquet", "event_id long, user_id long, event_type string")
    return streams.run_to_files(streams.channel(rows, "event_type", "c*"), "append", checkpoint(spark))
