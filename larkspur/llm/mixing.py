"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every document falls into a bucket of its source by a hash of its id and text. A bucket, once for each time that the mix goes
through the source, is a block; the blocks that a source gives are its exact quota. A binary tree deals the quotas of
all sources among output shards: each node gives its left half as many blocks of each source as a multivariate
hypergeometric draw says (one source after another, each a hypergeometric draw given what is left), so that shards have
equal numbers of blocks and every dealing of blocks is equally likely. Each shard then takes its number of blocks of
each source off that source's permutation, so no block is drawn twice, and is shuffled locally.

A source's target is a whole number of passes and a rest. The rest takes the documents of the least hashes: a bucket
whole or not at all, but for one, which is looked through at two finer levels. All of it is DataFrame code; windows go
over buckets of one source or over one row a source, never over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import by_place, materialize, small

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Hex digits of a bucket at least: 4096 buckets a source; one more for each 16 times as many words.
DIGITS, MOST_DIGITS = 3, 6
#: Words of a bucket on average in the largest source, at most.
BUCKET_WORDS = 50_000_000
#: Words of a shard; there are at most MOST_SHARDS of them, a power of two, and beyond that they grow.
SHARD_WORDS = 4_000_000
MOST_SHARDS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column, seed: str) -> Column:
    """The document's place in its source's permutation: 32 hex digits, by its id and text."""
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text), F.lit(""))))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size) with its index by code point (null last), target, whole passes and the rest in words.

    Targets share the sum of all sizes by weight, none above ``most`` times its source's size: min(cap, level * weight)
    for the one level that makes the sum right. One row a source, so the window without keys stays small.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    rows = (
        sizes.withColumn("at", F.row_number().over(ordered) - 1)
        .withColumn("weight", pick)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (
        rows.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("open"))
    )
    # The first that fits in the order of caps has the level; those before it stop at their caps.
    first = Window.partitionBy()
    rank = F.row_number().over(by_ratio)
    rows = rows.withColumn("rank", rank).withColumn("first", F.min(F.when(F.col("fits"), F.col("rank"))).over(first))
    at_first = lambda c: F.max(F.when(F.col("rank") == F.col("first"), F.col(c))).over(first)
    rows = rows.withColumn("level_left", at_first("left")).withColumn("level_open", at_first("open"))
    share = F.col("level_left").cast("double") * F.col("weight") / F.col("level_open")
    target = F.when(F.col("rank") < F.col("first"), F.col("cap").cast("double")).otherwise(share)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    return (
        rows.withColumn("target", target)
        .withColumn("passes", F.least(passes, F.lit(most)))
        .withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
        .select("source", "source_size", "at", "target", "passes", "rest")
    )


def boundary(rows: DataFrame, plan: DataFrame, start: int, length: int) -> DataFrame:
    """The plan with the last group of keys (``length`` digits from ``start``) that begins below the rest.

    Adds its digits to ``prefix`` and takes the words before it off ``rest``. Sources without such a group go.
    """
    group = F.substring("key", start, length)
    sums = rows.groupBy("at", group.alias("digits")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("at").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # Groups of one source: 4096 at most, or the documents that share 24 bits of the hash.
    last = (
        sums.join(plan.select("at", "rest"), "at")
        .where(F.col("before") < F.col("rest"))
        .groupBy("at")
        .agg(F.max(F.struct("digits", "before", "words")).alias("last"))
    )
    return plan.select("at", "prefix", "rest").join(last, "at").select(
        "at", F.concat("prefix", "last.digits").alias("prefix"), (F.col("rest") - F.col("last.before")).alias("rest"),
        F.col("last.words").alias("words"),
    )


def cutoffs(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """(at, cutoff): the extra pass takes documents whose key is at most the cutoff; sources without one aren't there.

    The last group counts if that brings the words nearer to the rest.
    """
    wanted = plan.where("rest > 0").select("at", "rest", F.lit("").alias("prefix"))
    level, rows = wanted, slim
    for start, length in ((1, 3), (4, 3), (7, 32)):
        level = materialize(boundary(rows, level, start, length), "cutoffs")
        digits = start + length - 1
        inside = small(level.select("at", F.col("prefix").alias("own")), level.count())  # one row a source
        rows = slim.join(inside, "at").where(F.substring("key", 1, digits) == F.col("own")).drop("own")
    # "~" is above every hex digit; without the last group the cutoff is just below it.
    taken = F.col("words") < 2 * F.col("rest")
    return level.select("at", F.when(taken, F.col("prefix")).otherwise(F.concat(F.lit("<"), F.col("prefix"))).alias("cutoff"))


def in_rest(key: Column, cutoff: Column) -> Column:
    """Whether the extra pass takes a key."""
    below = F.substring(cutoff, 1, 1) == "<"
    return F.coalesce(F.when(below, key < F.substring(cutoff, 2, 32)).otherwise(key <= cutoff), F.lit(False))


def hypergeometric(total: Column, own: Column, drawn: Column, u: Column) -> Column:
    """How many of ``own`` blocks are among ``drawn`` of ``total``: the distribution's inverse at u.

    Probabilities follow from one another by their ratios; ten deviations on both sides hold all that doubles resolve.
    """
    low, high = F.greatest(F.lit(0), drawn - (total - own)), F.least(drawn, own)
    share = own / total
    mean = drawn * share
    dev = F.sqrt(F.greatest(mean * (F.lit(1.0) - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    a = F.greatest(low, F.floor(mean - dev * 10 - 3)).cast("int")
    b = F.least(high, F.ceil(mean + dev * 10 + 3)).cast("int")
    steps = F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))

    def ratio(k: Column) -> Column:
        above = (own - k).cast("double") * (drawn - k)
        return above / ((k + 1).cast("double") * (total - own - drawn + k + 1))

    def weigh(state: Column, k: Column) -> Column:
        w = state["w"] * ratio(k)
        return F.struct(w.alias("w"), (state["sum"] + w).alias("sum"))

    one = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"))
    whole = F.aggregate(steps, one, weigh, lambda s: s["sum"])

    def count(state: Column, k: Column) -> Column:
        w = state["w"] * ratio(k)
        more = F.when(state["sum"] < state["goal"], k + 1).otherwise(state["x"])
        return F.struct(w.alias("w"), (state["sum"] + w).alias("sum"), more.alias("x"), state["goal"].alias("goal"))

    begin = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), a.alias("x"), (u * whole).alias("goal"))
    return F.when(total > 0, F.aggregate(steps, begin, count, lambda s: s["x"])).otherwise(F.lit(0))


def split(nodes: DataFrame, level: int, seed: str) -> DataFrame:
    """(node, at, n) of the two halves of each node."""

    def draw(state: Column, x: Column) -> Column:
        left = hypergeometric(state["total"], x["n"], state["drawn"], x["u"])
        # Bound by an array of one, so that the draw is worked out once.
        def halves(k: Column) -> Column:
            pair = [F.struct(F.lit(side).alias("side"), x["at"].alias("at"), n.alias("n")) for side, n in ((0, k), (1, x["n"] - k))]
            return F.struct(
                (state["total"] - x["n"]).alias("total"), (state["drawn"] - k).alias("drawn"), F.concat(state["out"], F.array(*pair)).alias("out")
            )

        return F.transform(F.array(left), halves)[0]

    u = uniform(F.lit(seed), F.lit(level), F.col("node"), F.col("at"))
    grouped = nodes.groupBy("node").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("at", "n", u.alias("u")))).alias("all")
    )  # one entry a source
    empty = F.array().cast("array<struct<side:int,at:int,n:int>>")
    start = F.struct(F.col("total").alias("total"), (F.col("total") - F.floor(F.col("total") / 2)).cast("long").alias("drawn"), empty.alias("out"))
    dealt = grouped.select("node", F.inline(F.aggregate("all", start, draw, lambda s: s["out"])))
    return dealt.select((F.col("node") * 2 + F.col("side")).alias("node"), "at", "n")


def deal(blocks: DataFrame, shards: int, seed: str) -> DataFrame:
    """The blocks (at, pass, bucket) with their shards."""
    permuted = Window.partitionBy("at").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "at", "pass", "bucket")), "pass", "bucket")
    ranked = blocks.withColumn("rank", F.row_number().over(permuted) - 1)  # buckets x passes of one source
    nodes = blocks.groupBy("at").agg(F.count("*").cast("int").alias("n")).select(F.lit(0).alias("node"), "at", "n")
    for level in range(shards.bit_length() - 1):
        nodes = materialize(split(nodes, level, seed), "tree")
    before = Window.partitionBy("at").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    quotas = nodes.where("n > 0").select(
        F.col("at").alias("own"), F.col("node").alias("shard"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    inside = (F.col("at") == F.col("own")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    return ranked.join(quotas, inside).select("at", "pass", "bucket", "shard")


def shards_for(words: int, shard_words: int = SHARD_WORDS) -> int:
    """A power of two of shards of about ``shard_words`` words."""
    n = 1
    while n < MOST_SHARDS and n * shard_words < words:
        n *= 2
    return n


def digits_for(words: int) -> int:
    """Hex digits of a bucket for a largest source of so many words."""
    digits = DIGITS
    while digits < MOST_DIGITS and words > BUCKET_WORDS << (4 * digits):
        digits += 1
    return digits


def numbered_copies(rows: DataFrame, repeated: DataFrame, n_repeated: int) -> DataFrame:
    """rows (mix_base, source, ...) with mix_number: 0, or the row's number among those of a base and source that are repeated.

    Repeated rows are numbered in their parts, and parts follow one another, so that a group of any size has no task of its own.
    """
    if not n_repeated:
        return rows.withColumn("mix_number", F.lit(0).cast("long"))
    few = small(repeated.select(F.col("mix_base").alias("mix_again"), F.col("source").alias("mix_from")), n_repeated)
    same = (F.col("mix_base") == F.col("mix_again")) & F.col("source").eqNullSafe(F.col("mix_from"))
    single = rows.join(few, same, "left_anti").withColumn("mix_number", F.lit(0).cast("long"))
    again = materialize(rows.join(few, same, "left_semi").withColumn("mix_part", F.spark_partition_id()), "repeated")
    keys = ("mix_base", "source", "mix_part")
    counts = again.groupBy(*keys).agg(F.count("*").alias("mix_n"))
    before = Window.partitionBy("mix_base", "source").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = counts.select(*[F.col(c).alias(f"{c}_own") for c in keys], F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_start"))
    met = again.withColumn("mix_place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))).join(
        starts, (F.col("mix_base") == F.col("mix_base_own")) & F.col("source").eqNullSafe(F.col("source_own")) & (F.col("mix_part") == F.col("mix_part_own"))
    )
    return single.unionByName(met.withColumn("mix_number", F.col("mix_start") + F.col("mix_place") - 1).select(*rows.columns, "mix_number"))


def with_copies(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target, mix_key and mix_shards; docs must have none of these names.

    mix_shards has the shard of each copy that the mix takes: one for each pass, none to ``MOST_PASSES``. A null text
    has size 0 and, with the others of its bucket, still goes along; a null source is a source of its own. A document's
    place comes from its id and its text, so those without an id, or of one id, are apart; rows that agree in both are numbered,
    so a source of such rows meets its target too, though which of them are taken may change. An empty table gives none.
    """
    based = docs.withColumn("mix_size", size_of(F.col("text"))).withColumn("mix_base", key_of(F.col("doc_id"), F.col("text"), seed))
    slim = materialize(based.select("source", "mix_size", "mix_base"), "sizes")
    repeated = materialize(slim.groupBy("mix_base", "source").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    n_repeated = repeated.count()

    def placed(rows: DataFrame) -> DataFrame:
        key = F.when(F.col("mix_number") > 0, F.md5(F.concat("mix_base", F.lit("|"), F.col("mix_number").cast("string")))).otherwise(F.col("mix_base"))
        return numbered_copies(rows, repeated, n_repeated).withColumn("mix_key", key).drop("mix_base", "mix_number")

    keyed = placed(based)
    slim = placed(slim).select("source", F.col("mix_size").alias("size"), F.col("mix_key").alias("key"))
    slim = materialize(slim, "sizes") if n_repeated else slim
    plan = materialize(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    n_sources = plan.count()
    total = int(plan.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    indexed = slim.join(
        small(plan.select(F.col("source").alias("mix_source"), "at"), n_sources), F.col("source").eqNullSafe(F.col("mix_source"))
    ).select("at", "size", "key")
    indexed = materialize(indexed, "indexed")
    cut = materialize(cutoffs(indexed, plan), "cut")
    plan = plan.join(cut, "at", "left")
    digits = digits_for(plan.agg(F.coalesce(F.max("source_size"), F.lit(0))).first()[0])
    buckets = indexed.groupBy("at", F.substring("key", 1, digits).alias("bucket")).agg(F.min("key").alias("least"))
    passes = F.filter(F.sequence(F.lit(1), F.lit(MOST_PASSES)), lambda p: (p <= F.col("passes")) | ((p == F.col("passes") + 1) & in_rest(F.col("least"), F.col("cutoff"))))
    blocks = (
        buckets.join(small(plan.select("at", "passes", "cutoff"), n_sources), "at")
        .select("at", F.explode(passes).alias("pass"), "bucket")
    )
    dealt = deal(materialize(blocks, "blocks"), shards_for(total, shard_words), seed)
    by_bucket = materialize(
        dealt.groupBy("at", "bucket").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("mix_all")), "dealt"
    )
    n_buckets = by_bucket.count()
    plan = plan.select(
        F.col("source").alias("mix_source"), F.col("at").alias("mix_at"), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), F.col("passes").alias("mix_passes"), F.col("cutoff").alias("mix_cutoff"),
    )
    by_bucket = by_bucket.select(F.col("at").alias("mix_b_at"), F.col("bucket").alias("mix_bucket"), "mix_all")
    extra = in_rest(F.col("mix_key"), F.col("mix_cutoff"))
    own = F.filter("mix_all", lambda x: (x["pass"] <= F.col("mix_passes")) | extra)
    joined = (
        keyed.join(small(plan, n_sources), F.col("source").eqNullSafe(F.col("mix_source")))
        .join(
            small(by_bucket, n_buckets),
            (F.col("mix_at") == F.col("mix_b_at")) & (F.substring("mix_key", 1, digits) == F.col("mix_bucket")),
            "left",
        )
        .withColumn("mix_shards", F.coalesce(F.transform(own, lambda x: x["shard"]), F.array().cast("array<int>")))
    )
    return joined.select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_key", "mix_shards")


def mix_table(docs: DataFrame, seed: str = "mix", shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken and the copies' shards of every document."""
    rows = with_copies(docs.select("doc_id", "text", "source"), seed, shard_words=shard_words)
    return rows.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.size("mix_shards") * F.col("mix_size")).cast("long").alias("taken"), F.array_join(F.col("mix_shards").cast("array<string>"), ",").alias("shards"),
    )


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, with docs' columns, whatever their names, shard by shard, shuffled within."""

    def dealt(rows: DataFrame) -> DataFrame:
        copies = with_copies(rows, seed).select(*rows.columns, "mix_key", F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
        spread = copies.withColumn("mix_place", F.xxhash64(F.lit(seed), "mix_key", "mix_copy")).repartitionByRange("mix_shard", "mix_place")
        return spread.sortWithinPartitions("mix_shard", "mix_place")

    return by_place(docs, dealt, ("doc_id", "text", "source"))
