"""Job state: a fold over an event log, counters, recovery, chaining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may follow an operation, by the operations that are on.
NEXT = {"T": "F", "F": "A"}


def serialize(op: Column, user_id: Column, cursor: Column) -> Column:
    """``op,user_id,cursor``."""
    return F.concat_ws(",", op, user_id.cast("string"), cursor)


def deserialize(job: Column) -> Column:
    """Struct of op, user_id and cursor, which stays a string."""
    part = F.split(job, ",", 3)
    return F.struct(part[0].alias("op"), part[1].cast("bigint").alias("user_id"), part[2].alias("cursor"))


def fold_states(events: DataFrame, job: str, kind: str, *order: str) -> DataFrame:
    """Final state of each job from its last event, with how often it failed: one grouped maximum."""
    last = F.max_by(kind, F.struct(*order))
    state = (
        F.when(last == "assign", "ongoing").when(last == "complete", "completed").when(last == "requeue", "queued")
        .when(last == "error", "error").otherwise("queued")
    )
    return events.groupBy(job).agg(state.alias("state"), F.count_if(F.col(kind) == "error").alias("errors"), F.count("*").alias("events"))


def lost_jobs(assigned: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Assigned jobs that were never completed: they go back to the queue."""
    return assigned.join(completed.select(key).distinct(), key, "left_anti")


def chain(done: DataFrame, enabled: tuple[str, ...]) -> DataFrame:
    """Jobs that follow completed ones (op, user_id), among the operations that are on."""
    table = {op: nxt for op, nxt in NEXT.items() if nxt in enabled or (nxt == "F" and "A" in enabled)}
    following = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")
    cursor = F.when(F.col("next") == "F", F.lit("-1")).otherwise(F.lit("0"))
    return done.select(F.try_element_at(following, F.col("op")).alias("next"), "user_id").where("next is not null").select(
        F.col("next").alias("op"), "user_id", cursor.alias("cursor")
    )


def counters(jobs: DataFrame, op: str, state: str, value: str) -> DataFrame:
    """Jobs, finished ones and the sum of values of each operation."""
    return jobs.groupBy(op).agg(
        F.count("*").alias("jobs"), F.count_if(F.col(state) == "completed").alias("completed"), F.count_if(F.col(state) == "ongoing").alias("ongoing"),
        F.sum(value).alias("total"),
    )


def utilisation(workers: DataFrame, state: str) -> DataFrame:
    """One row: workers, those at work, and their whole percentage; null without workers."""
    active = F.count_if(F.col(state) == "working")
    return workers.agg(F.count("*").alias("workers"), active.alias("active")).withColumn(
        "pct", F.when(F.col("workers") > 0, F.floor(F.col("active") * 100 / F.col("workers")))
    )


def finished(jobs: DataFrame, state: str) -> DataFrame:
    """One row: whether nothing is queued or ongoing."""
    return jobs.agg((F.count_if(F.col(state).isin("queued", "ongoing")) == 0).alias("finished"))
