"""Stores that commits touch in part, sorted runs, sketches, lookups, neighbour intersections, gauges."""

import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.operators import graph, sketches
from larkspur.sources import lookups, runs, store
from larkspur.storage import new_folder
from larkspur.streaming import gauges, streams

SCHEMA = "owner long, key long, value string, seq int"


def files_of(spark, path):
    return {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}


def test_commits_touch_only_their_buckets(spark, tmp_path):
    path, schema = f"file://{tmp_path}/s", spark.createDataFrame([], SCHEMA).schema
    assert store.stored(spark, path, schema).collect() == []
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert store.commit(make(), path, "owner", "key", buckets=8) == []
    rows = [(o, k, f"{o}-{k}", 0) for o in [*range(20), None] for k in range(5)]
    assert len(store.commit(make(*rows, (3, 2, "later", 9)), path, "owner", "key", F.col("seq"), buckets=8)) == 8
    before = files_of(spark, f"{path}/rows")
    (touched,) = store.commit(make((3, 2, "new", 0), (3, 99, "x", 0), (3, 99, "y", 1)), path, "owner", "key", F.col("seq"), buckets=8)
    after = files_of(spark, f"{path}/rows")
    assert {f for f in before - after} == {f for f in before if f"bucket={touched}/" in f} and {f for f in after - before} == {f for f in after if f"bucket={touched}/" in f}
    want = {(o, k): v for o, k, v, _ in rows} | {(3, 2): "new", (3, 99): "y"}
    assert sorted(((r.owner, r.key), r.value) for r in store.stored(spark, path, schema).where("owner is not null").collect()) == sorted(x for x in want.items() if x[0][0] is not None)
    assert store.stored(spark, path, schema).count() == len(want)
    assert {r.owner: r.n for r in store.counters(spark, path, schema["owner"]).collect()} == Counter(o for o, _ in want)
    owners = spark.createDataFrame([(3,), (77,)], "owner long")
    found = store.stored(spark, path, schema, owners, "owner", 8)
    assert sorted(r.key for r in found.collect()) == [0, 1, 2, 3, 4, 99]
    assert len(found.inputFiles()) and "PartitionFilters: [bucket" in found._jdf.queryExecution().toString()


def test_two_commits_at_once_lose_nothing_or_one_fails(spark, tmp_path):
    path, schema = f"file://{tmp_path}/s", spark.createDataFrame([], SCHEMA).schema
    failed, stop = [], []

    def put(low, wait):
        try:
            store.commit(spark.createDataFrame([(o, low, "v", 0) for o in range(8)], SCHEMA), path, "owner", "key", buckets=4, wait=wait)
        except store.Busy:
            failed.append(low)
        stop.append(low)

    threads = [threading.Thread(target=put, args=(i, 60)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and store.stored(spark, path, schema).count() == 24
    with store.held(spark, path, [0, 1, 2, 3]):
        put(9, 0)
    assert failed == [9] and store.stored(spark, path, schema).count() == 24
    put(9, 0)
    assert store.stored(spark, path, schema).count() == 32


def test_sorted_runs_merge_without_exchange_or_sort(spark):
    random.seed(29)
    others = {t.name for t in spark.catalog.listTables()}
    parts = [[(random.choice([*"abcdefghij", None]), 1) for _ in range(200)] for _ in range(5)]
    names = [runs.write_run(spark.createDataFrame(p, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")), "k", 4) for p in parts]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sums = runs.merged(spark, names, "k", "n")
        assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
        want = Counter(k for p in parts for k, _ in p)
        assert {r.k: r.n for r in sums.collect()} == want
        both = runs.joined(runs.run(spark, names[0]), runs.run(spark, names[1]).withColumnRenamed("n", "m"), "k")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan
        one, two = (Counter(k for k, _ in p if k) for p in parts[:2])
        assert {r.k: (r.n, r.m) for r in both.collect()} == {k: (one[k], two[k]) for k in one if k in two}
        name = runs.compacted(spark, names, "k", "n", buckets=4, fan=2)
        assert {r.k: r.n for r in runs.run(spark, name).collect()} == want
        assert {t.name for t in spark.catalog.listTables()} - others == {name}
        runs.drop(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(runs.ORDERED[0])


def test_sketched_bounds_are_within_their_error(spark):
    random.seed(31)
    values = [random.gauss(0, 1) if i % 3 else 0.5 for i in range(60_000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(7)
    found = [(r["at"], r.bound) for r in sketches.quantile_bounds(df, "v", 12).orderBy("at").collect()]
    assert [at for at, _ in found] == list(range(11))
    n, slack = len(values), 2 * sketches.RANK_ERROR
    for at, bound in found:
        low, high = sum(v < bound for v in values) / n, sum(v <= bound for v in values) / n
        assert low - slack <= (at + 1) / 12 <= high + slack
    bounds = spark.createDataFrame(found, "at int, bound double")
    counts = {r.bucket: r.n for r in sketches.bucket_counts(df, "v", bounds).collect()}
    cuts = [b for _, b in found]
    want = Counter(sum(v >= c for c in cuts) for v in values)
    want[11] += 1  # the NaN
    assert counts == {b: want[b] for b in range(12)}
    assert "Exchange" not in sketches.bucket_counts(df, "v", bounds)._jdf.queryExecution().optimizedPlan().toString()
    assert sketches.quantile_bounds(df.where("v is null"), "v", 12).collect() == []


def test_filters_take_rows_out_before_the_join(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 3000 if i % 50 else None, i) for i in range(6000)], "k long, v long").repartition(4)
    keys = spark.createDataFrame([(i * 20,) for i in range(200)] * 2 + [(None,)], "k long")
    known = {i * 20 for i in range(200)}
    semi = sorted(r.v for r in sketches.semi_join(rows, keys, "k", 200).collect())
    anti = sorted(r.v for r in sketches.anti_join(rows, keys, "k", 200).collect())
    data = [(i % 3000 if i % 50 else None, i) for i in range(6000)]
    assert semi == [v for k, v in data if k in known] and anti == [v for k, v in data if k not in known]
    passed = sketches.KeyFilter(keys, "k", 200).tagged(rows, "k").where("_maybe").count()
    assert len(semi) <= passed <= len(semi) + 0.05 * 6000
    monkeypatch.setattr(sketches, "hinted", lambda df, n: df)  # a filter that is too large
    assert sorted(r.v for r in sketches.anti_join(rows, keys, "k", 200).collect()) == anti
    assert sorted(r.v for r in sketches.semi_join(rows, keys, "k", 0).collect()) == semi
    assert sketches.semi_join(rows, keys.where("false"), "k", 0).count() == 0 and sketches.anti_join(rows, keys.where("false"), "k", 0).count() == 6000


def test_filter_lets_few_others_through(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    found = sketches.KeyFilter(keys, "k", 20_000).tagged(spark.range(1_000_000, 1_100_000).withColumnRenamed("id", "k"), "k")
    assert found.where("_maybe").count() / 100_000 < 2 * sketches.FALSE_POSITIVES


def rows_read(spark, df):
    """Rows that the scan handed on while df was worked out."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return sum(found)


def test_lookups_read_few_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") * 7).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    lookups.write_sorted(rows, str(tmp_path / "t"), "k", 128 << 10)
    keys = [7 * i for i in range(150_000, 150_100)] + [5, -1]
    found = lookups.look_up(spark, str(tmp_path / "t"), "k", keys)
    got = found.collect()
    assert [r.k for r in got] == keys[:100]
    assert 100 <= rows_read(spark, found) < 0.05 * 200_000
    assert lookups.look_up(spark, str(tmp_path / "t"), "k", []).collect() == []
    with pytest.raises(ValueError):
        lookups.look_up(spark, str(tmp_path / "t"), "k", list(range(lookups.MOST_KEYS + 1)))


def test_shared_neighbours_of_a_hub_are_dealt_by_its_degree(spark, monkeypatch):
    random.seed(37)
    edges = [(0, d) for d in range(120)] + [(random.randint(1, 9), random.randint(0, 130)) for _ in range(200)] + [(None, 1), (1, None)]
    df = spark.createDataFrame(edges, "s long, d long")
    back = {}
    for s, d in set(edges):
        back.setdefault(d, set()).add(s)
    nodes = sorted(d for d in back if d is not None)
    want = {(a, b): n for a in nodes for b in nodes if a < b and (n := len((back[a] & back[b]) - {None}))}
    monkeypatch.setattr(graph, "SHARE", 10)
    assert {(r.a, r.b): r.both for r in graph.shared_neighbours(df, "s", "d").collect()} == want
    pairs = [(random.randint(0, 140), random.randint(0, 140)) for _ in range(300)] + [(1, 2), (1, 2), (None, 3), (0, 1)]
    found = {(r.a, r.b): r.both for r in graph.common_neighbours(df, spark.createDataFrame(pairs, "a long, b long"), "s", "d").collect()}
    assert found == {(a, b): len((back.get(a, set()) & back.get(b, set())) - {None}) if a is not None else 0 for a, b in pairs}


def test_term_entity_rows_agree_with_the_lists(spark):
    rows = spark.createDataFrame([("t", "e", "2"), ("t", "e", "1"), ("t", "f", "9"), ("u", "e", "5")], "t string, e string, v string")
    lists = {(r.t, r.e): (r.vals, r.n) for r in graph.term_entity_edges(rows, "t", "e", "v", 2).collect()}
    found = {}
    for r in graph.term_entity_rows(rows, "t", "e", "v", 2).collect():
        found.setdefault((r.t, r.e), []).append((r.v, r.n))
    assert {k: (":".join(sorted(v for v, _ in x)), x[0][1]) for k, x in found.items()} == lists == {("t", "e"): ("1:2", 2), ("t", "f"): ("9", 1)}


def test_gauges_of_a_stream_of_two_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(2):
        (source / f"{i}.json").write_text("\n".join(f'{{"k": {k}}}' for k in range(10 * (i + 1))))
    rows = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).json(str(source))
    rows = gauges.observed(rows, "crawl", included=F.col("k") % 2 == 0)
    told, path = [], str(tmp_path / "gauges")
    with gauges.gauging(spark, path, lambda name, batch, n: told.append((batch, n))):
        streams.run_to_files(rows, "append", new_folder(spark, "gauged"))
    found = {(r.label, r.batch): r.value for r in gauges.gauge_rows(spark, path).collect()}
    assert sum(v for (label, _), v in found.items() if label == "stats.crawl.rows") == 30
    assert sum(v for (label, _), v in found.items() if label == "stats.crawl.included") == 15
    assert len(found) == 4 and sum(n for _, n in told) == 30
    assert gauges.gauge_rows(spark, str(tmp_path / "none")).collect() == []


def test_counters_and_times_of_batch_work(spark):
    counted, counters = gauges.with_counters(spark.range(10), even=F.col("id") % 2 == 0)
    seen = []
    with gauges.timed("scan", lambda name, s: seen.append((name, s >= 0))):
        assert counted.count() == 10
    assert counters() == {"rows": 10, "even": 5} and seen == [("scan", True)]


def test_all_pages_are_fetched_once(spark):
    from larkspur.sources import readers

    followers = spark.createDataFrame([(1, 100 + i, i) for i in range(23)] + [(2, 5, 0)], "user_id long, follower_id long, pos long")
    asked = []

    def page(cursor):
        asked.append(cursor)
        return readers.follower_page(followers, 1, cursor, 5)

    assert sorted(r.follower_id for r in readers.fetch_all(page).collect()) == list(range(100, 123)) and asked == [0, 5, 10, 15, 20]
    assert sorted(r.follower_id for r in readers.fetch_all(page, 15).collect()) == list(range(115, 123))
    assert readers.fetch_all(lambda c: readers.follower_page(followers, 9, c, 5)).collect() == []
    with pytest.raises(ValueError):
        readers.fetch_all(page, most=2)
    found = {(r.user_id, r.cursor): (r.next_cursor, r.n, r.ids) for r in readers.follower_pages(followers, 5).collect()}
    assert found == {(1, c): (c + 5 if c < 20 else 0, min(5, 23 - c), list(range(100 + c, min(105 + c, 123)))) for c in range(0, 23, 5)} | {(2, 0): (0, 1, [5])}


def test_a_user_of_many_followers_is_written_by_several_tasks(spark, tmp_path):
    from larkspur.sources import packed

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).select(F.lit(77).alias("user_id"), (F.col("id") * 3).alias("follower_id"), F.col("id").alias("pos"))
        packed.write_followers(rows, str(tmp_path))
        assert len(list((tmp_path / "77").glob("*.fws"))) > 1
        assert [(r.pos, int(r.follower_id)) for r in packed.read_followers(spark, str(tmp_path)).orderBy("pos").collect()] == [(i, 3 * i) for i in range(5000)]
        packed.write_followers(rows.where("pos < 3"), str(tmp_path), append=False)
        assert [int(r.follower_id) for r in packed.read_followers(spark, str(tmp_path)).orderBy("pos").collect()] == [0, 3, 6]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_common_neighbours_take_packed_lists_and_walk_hubs(spark, monkeypatch):
    random.seed(41)
    ends = (-(1 << 63), (1 << 63) - 1, -1, 0, 127, 128, 1 << 40)
    edges = [(random.choice(ends), random.randint(0, 30)) for _ in range(200)] + [(s, 99) for s in range(40)] + [(s, 98) for s in range(20, 300)] + [(None, 1)]
    back = {}
    for s, d in edges:
        back.setdefault(d, set()).add(s)
    pairs = [(random.randint(0, 32), random.randint(0, 32)) for _ in range(100)] + [(99, 98), (98, 1), (1, 99), (99, 99), (98, 500), (None, 99), (None, None)]
    frames = spark.createDataFrame(edges, "s long, d long"), spark.createDataFrame(pairs, "a long, b long")
    want = {(a, b): len((back.get(a, set()) & back.get(b, set())) - {None}) if a is not None else 0 for a, b in pairs}
    for most in (1000, 30):  # without hubs, and with two
        monkeypatch.setattr(graph, "LIST", most)
        met = graph.common_neighbours(*frames, "s", "d")
        found = met.collect()
        assert len(found) == len(want) and {(r.a, r.b): r.both for r in found} == want
        if most == 1000:  # pairs bring their lists along: no row for each neighbour
            assert "ArrowEvalPython" in met._jdf.queryExecution().toString()
    names = frames[0].select(F.col("s").cast("string").alias("s"), "d")
    assert {(r.a, r.b): r.both for r in graph.common_neighbours(names, frames[1], "s", "d").collect()} == want
