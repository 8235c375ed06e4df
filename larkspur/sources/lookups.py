"""Point lookups in stored tables: rows sorted by key in small row groups with Bloom filters, of which a lookup reads those that may have its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, and keys that are pushed down as a list; more are met by a join.
GROUP_BYTES = 1 << 20
MOST_KEYS = 10_000


def write_sorted(rows: DataFrame, path: str, key: str, group_bytes: int = GROUP_BYTES, page_rows: int = 1000) -> None:
    """Rows in ranges of the key, sorted, with row groups of about so many bytes, page indexes and a Bloom filter of the key for each."""
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    options = {
        "parquet.block.size": str(group_bytes), "parquet.block.size.row.check.min": "1000", "parquet.page.row.count.limit": str(page_rows),
        f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.max.bytes": str(64 << 10),
    }
    ordered.write.mode("overwrite").options(**options).parquet(path)


def look_up(spark: SparkSession, path: str, key: str, keys: list) -> DataFrame:
    """The stored rows of some keys, in the order of the key: files, row groups and pages without them are skipped. A key without rows has none.

    The list goes to the scan as it is, so it may hold MOST_KEYS keys.
    """
    if len(keys) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: join with a table of keys instead")
    # Beyond this number Spark hands on the list's least and greatest key alone, which skips little.
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(MOST_KEYS))
    return spark.read.parquet(path).where(F.col(key).isin(list(keys))).orderBy(key)
