"""Table operators: latest rows, merges, set operations, sorts, samples, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import fits

#: Rows of a side that may be broadcast after they were counted; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Rows that a task of a shuffle gets whose rows were counted, so that its memory doesn't grow with the table.
TASK_ROWS = 300_000


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def parts(spark: SparkSession, rows: int) -> int:
    """Tasks of a shuffle of so many rows: the session's number, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key in the given order, by a grouped maximum: partial aggregates, no sort of groups."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c != key]
    found = df.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("row"))
    return found.select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def extents(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Number of rows of each key with the first and last values of columns in an order."""
    aggregates = [F.count("*").alias("total"), F.min(order).alias(f"first_{order}"), F.max(order).alias(f"last_{order}")]
    for c in columns:
        aggregates += [F.min_by(c, order).alias(f"first_{c}"), F.max_by(c, order).alias(f"last_{c}")]
    return df.groupBy(key).agg(*aggregates)


def between_open(ts: Column, low: str, high: str) -> Column:
    """Inside an open range of times; literals, so that it reaches the scan."""
    return (ts > F.lit(low).cast("timestamp_ntz")) & (ts < F.lit(high).cast("timestamp_ntz"))


def top_terms(df: DataFrame, term: str, n: int) -> DataFrame:
    """The n most frequent terms, ties by name."""
    return df.groupBy(F.col(term).alias("term")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(n)


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Count of each key and its percentage of all rows; 0 without rows. One row a key under the window."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.when(total > 0, F.round(F.col("n") * 100.0 / total, 6)).otherwise(F.lit(0.0)))


def roll_up(df: DataFrame, ts: str, value: Column, seconds: tuple[int, ...]) -> DataFrame:
    """Sums in windows of several widths, in long form. One pass: the finest windows are summed up into the wider ones."""
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    finest = df.groupBy((F.floor(at / seconds[0]) * seconds[0]).alias("at")).agg(F.sum(value).alias("value"))
    widths = F.explode(F.array(*[F.lit(s) for s in seconds])).alias("width")
    spread = finest.select("at", "value", widths).withColumn("bucket", F.col("at") - F.pmod(F.col("at"), F.col("width")))
    return spread.groupBy("width", "bucket").agg(F.sum("value").alias("total"))


def merge_latest(old: DataFrame, new: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows of owners present in both; a key in both counts as in the second."""
    both = old.select(owner).intersect(new.select(owner))
    rows = old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    return latest(rows.join(both, owner, "left_semi"), key, F.col("src")).drop("src")


def new_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of the second that the first hasn't."""
    return new.select(key).distinct().join(old.select(key).distinct(), key, "left_anti")


def except_keys(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key is in none of the others, each of which has the key as its only column."""
    known = others[0]
    for other in others[1:]:
        known = known.union(other)
    return df.join(known.toDF(key).distinct(), key, "left_anti")


def histogram(df: DataFrame, bucket: Column, name: str) -> DataFrame:
    """Number of rows of each bucket."""
    return df.groupBy(bucket.alias(name)).agg(F.count("*").alias("n"))


def running_distinct(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Number of keys first seen in each window of time, and up to it. Keys are reduced before the running sum."""
    first = df.groupBy(key).agg(F.min(ts).alias("first"))
    bucket = F.floor(F.unix_timestamp(F.col("first").cast("timestamp")) / seconds) * seconds
    seen = first.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("fresh"))
    # One row a window of time.
    return seen.withColumn("total", F.sum("fresh").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def global_sort(df: DataFrame, *order: Column) -> DataFrame:
    """A sort by sampled ranges over all tasks."""
    return df.orderBy(*order)


def sort_distinct(df: DataFrame, key: str, then: Column) -> DataFrame:
    """One row for each key, the last by ``then``, in descending order of keys."""
    return latest(df, key, then).orderBy(F.col(key).desc())


def range_bounds(df: DataFrame, key: str, parts: int) -> DataFrame:
    """(at, bound): the parts - 1 exact quantiles that cut a key into ranges, interpolated; nulls are left out.

    Rows are numbered in a range sort and looked up by their numbers, so no task sees all keys.
    """
    from larkspur.operators.graph import numbered

    rows = numbered(df.select(F.col(key).cast("double").alias("value")).where("value is not null"), "value", base=-1, name="rank")
    n = rows.count()
    places = [(at, (n - 1) * (at + 1) / parts) for at in range(parts - 1)] if n else []
    ends = [(at, int(p) + side, abs(1 - side - (p - int(p)))) for at, p in places for side in (0, 1) if side == 0 or p > int(p)]
    wanted = df.sparkSession.createDataFrame(ends, "at int, rank long, share double")  # two rows a bound
    return rows.join(hinted(wanted, len(ends)), "rank").groupBy("at").agg(F.sum(F.col("value") * F.col("share")).alias("bound"))


def sample(df: DataFrame, key: str, n: int, seed: int | None = None) -> DataFrame:
    """n rows: in the order of a hash of the key (always the same ones), or at random from a seed."""
    return df.orderBy(F.md5(F.col(key).cast("string")) if seed is None else F.rand(seed), key).limit(n)


def ledger_tail(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The newest n rows: each task keeps n."""
    return df.orderBy(*order).limit(n)


def page_after(df: DataFrame, key: str, last: int, n: int) -> DataFrame:
    """Keyset paging: the next n rows after a key; a page of one row is a page like others."""
    return df.where(F.col(key) > last).orderBy(key).limit(n)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; a key in both counts as in the second."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new)


def delta_update(stored: DataFrame, fetched: DataFrame, owner: str, key: str, complete: Column | None = None) -> DataFrame:
    """Stored rows and those fetched rows that are newer than the owner's newest; owners whose fetch isn't complete keep theirs."""
    marks = stored.groupBy(owner).agg(F.max(key).alias("mark"))
    fresh = fetched.where(complete) if complete is not None else fetched
    fresh = fresh.join(marks, owner, "left").where(F.col("mark").isNull() | (F.col(key) > F.col("mark"))).drop("mark")
    return stored.unionByName(fresh.select(*stored.columns))


def resume_older(stored: DataFrame, available: DataFrame, owner: str, key: str) -> DataFrame:
    """Available rows older than the owner's oldest stored one."""
    marks = stored.groupBy(owner).agg(F.min(key).alias("mark"))
    return available.join(marks, owner).where(F.col(key) <= F.col("mark") - 1).drop("mark")


def series_sum(df: DataFrame, label: str, pattern: str, ts: str, value: Column, seconds: int) -> DataFrame:
    """Sum over all series whose label fits a ``*`` pattern, in windows of time."""
    bucket = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds) * seconds
    return df.where(fits(F.col(label), pattern)).groupBy(bucket.alias("bucket")).agg(F.sum(value).alias("total"))


def search_newest(df: DataFrame, terms: str, term: str, ts: str, low: str, high: str, n: int, key: str) -> DataFrame:
    """The newest n rows inside an open range of times whose array of terms has a term; ties by key."""
    hits = df.where(F.array_contains(terms, term) & between_open(F.col(ts), low, high))
    return hits.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def completed_share(df: DataFrame, state: Column) -> DataFrame:
    """One row: how many rows, how many in a state, and their percentage; 0 without rows."""
    counts = df.agg(F.count("*").alias("n"), F.count_if(state).alias("hits"))
    return counts.withColumn("pct", F.when(F.col("n") > 0, F.round(F.col("hits") * 100.0 / F.col("n"), 6)).otherwise(F.lit(0.0)))


def found_or_missing(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The wanted keys with their rows, and whether there is one: a key without a row has nulls and false."""
    known = df.withColumn("found", F.lit(True))
    return wanted.select(key).distinct().join(known, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
