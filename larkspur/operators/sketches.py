"""Mergeable sketches: quantiles of a column by KLL, and Bloom filters that take rows out before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.tables import hinted
from larkspur.storage import materialize

#: KLL's size: ranks are within RANK_ERROR of the truth, each with 99% certainty.
KLL_SIZE, RANK_ERROR = 2048, 0.0014
#: Bits of a filter for each key, bits that a key sets in its word of 64, and what share of other keys passes, about.
BITS_PER_KEY, BITS_SET, FALSE_POSITIVES = 16, 4, 0.01


def quantile_bounds(df: DataFrame, key: str, parts: int) -> DataFrame:
    """(at, bound): the parts - 1 bounds that cut a numeric key into ranges of about equal rows, from one sketch a task; one pass, no sort.

    Each bound's rank is within RANK_ERROR of its share. Nulls and NaNs are left out; a column without numbers has no bounds.
    """
    value = F.col(key).cast("double")
    sketch = df.where(value.isNotNull() & ~F.isnan(value)).agg(F.kll_sketch_agg_double(value, F.lit(KLL_SIZE)).alias("sketch"), F.count("*").alias("n")).where("n > 0")
    shares = F.array(*[F.lit((at + 1) / parts) for at in range(parts - 1)])
    bounds = F.kll_sketch_get_quantile_double("sketch", shares)
    return sketch.select(F.posexplode(bounds).alias("at", "bound"))


def bucket_counts(df: DataFrame, key: str, bounds: DataFrame) -> DataFrame:
    """(bucket, n): rows of each range between bounds (at, bound), which are few: those below the first are in bucket 0, each bound belongs to the range above.

    Nulls are left out, NaNs are above all; ranges without rows have 0.
    """
    cuts = [r.bound for r in bounds.orderBy("at").collect()]  # parts - 1 numbers
    value = F.col(key).cast("double")
    at = sum([F.when(value >= F.lit(c), 1).otherwise(0) for c in cuts], F.lit(0))
    found = df.where(value.isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def mask_of(key: Column) -> Column:
    """BITS_SET bits of a word of 64, by a hash of their own."""
    hashed = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for bit in [F.shiftright(hashed, 6 * i).bitwiseAND(63).cast("int") for i in range(BITS_SET)]:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def word_of(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("word")), F.lit(words))


class KeyFilter:
    """A Bloom filter of a table's keys in words of 64 bits: a table (word, mask), made by partial aggregation.

    ``maybe`` keeps the rows whose key may be among the keys, and some FALSE_POSITIVES of the others. The table is broadcast if
    it is small (as counted rows); beyond that the filter lets all rows through, and the exact join alone decides.
    """

    def __init__(self, keys: DataFrame, key: str, n_keys: int):
        self.words = max(1, n_keys * BITS_PER_KEY // 64)
        table = keys.where(F.col(key).isNotNull()).groupBy(word_of(F.col(key), self.words).alias("_word")).agg(F.bit_or(mask_of(F.col(key))).alias("_mask"))
        self.table = materialize(table, "bloom")
        self.n = self.table.count()

    @property
    def used(self) -> bool:
        return hinted(self.table, self.n) is not self.table

    def tagged(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with ``_maybe``: whether the key may be among the keys."""
        if not self.used:
            return rows.withColumn("_maybe", F.lit(True))
        mask = mask_of(F.col(key))
        tested = rows.withColumn("_word", word_of(F.col(key), self.words)).join(hinted(self.table, self.n), "_word", "left")
        return tested.withColumn("_maybe", F.coalesce(F.col("_mask").bitwiseAND(mask) == mask, F.lit(False)) & F.col(key).isNotNull()).drop("_word", "_mask")


def semi_join(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """rows whose key is among keys (key): only those that the filter lets through are shuffled. n_keys is about how many keys there are."""
    known = keys.select(key)
    maybe = KeyFilter(known, key, n_keys).tagged(rows, key).where("_maybe").drop("_maybe")
    return maybe.join(known.distinct(), key, "left_semi").select(*rows.columns)


def anti_join(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """rows whose key isn't among keys (key), null keys among them: those that the filter takes out stay without a shuffle, the others meet the keys."""
    known = keys.select(key)
    tagged = KeyFilter(known, key, n_keys).tagged(rows, key)
    sure = tagged.where("not _maybe").select(*rows.columns)
    return sure.unionByName(tagged.where("_maybe").join(known.distinct(), key, "left_anti").select(*rows.columns))
