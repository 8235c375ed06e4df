"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors of one length are packed into blocks. A vector is cut into segments; of each it keeps the mean and the
deviation. For two vectors the inner product of a segment of L places is at most ``L * (mean * mean + dev * dev)``
(Cauchy-Schwarz on what is left after the means), which is the same as a lower bound on their distance. The bounds are
taken coarse to fine: candidates whose bound is below the k-th best exact score so far are dropped at each resolution,
and survivors are scored exactly in integers.

Every block of queries is held against every block of candidates, first by their outlines: vectors are put into blocks in
the order of their coarse statistics, and a block knows the least and greatest of each. The same bound, on outlines, says
what a pair of blocks can reach. Each block of queries meets the candidate blocks that promise most, which gives its queries
a k-th best score; only pairs of blocks that can reach the least of these are shuffled and searched.

Candidate blocks are dealt into shares by a hash; a unit of work is a block of queries and a share. A unit meets its candidate
blocks one after another and keeps each query's k best so far, so that the bounds drop more and more; it returns at
most k rows for each query, and the shares of a query meet in a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import give_back, materialize

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
#: Segments at each resolution, coarse to fine.
SEGMENTS = (4, 16)
K = 5
#: Candidate blocks of a share.
SHARE_BLOCKS = 32
#: Queries that are bounded together; a share of one in so many open pairs makes products of whole matrices worth while.
TOGETHER, MANY = 64, 16
#: Share of a bound added against rounding.
SLACK = 1e-9
#: Candidate blocks that a block of queries meets first.
FIRST = 2
#: Parts of the range of a statistic by which vectors are ordered into blocks.
GRID = 8
BLOCK = "part int, number int, dim int, ids binary, vectors binary, n int, low array<double>, high array<double>"
#: Components and scores stop at the ends of 64 bits.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: neither is null, all components are finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .where("vec_id is not null and embedding is not null and size(embedding) > 0")
        .where(finite)
    )


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) in the narrowest integers that hold all values; values beyond 64 bits become its ends."""
    values = np.floor(256 * vectors.astype(float))
    most = float(np.abs(values).max(initial=0))
    if most < 1 << 31:
        return values.astype("<i2" if most < 1 << 15 else "<i4")
    out = np.where(values > 0, MOST, LEAST)
    inside = np.abs(values) < float(1 << 63)
    out[inside] = values[inside].astype(np.int64)
    return out.astype("<i8")


def packed(vectors: np.ndarray) -> bytes:
    """A letter for the width of the integers, and their bytes."""
    values = integers(vectors)
    return b"%d" % values.itemsize + values.tobytes()


def unpacked(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[:1].decode()}", offset=1).reshape(rows, -1)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 64 bits become its ends."""
    most = int(np.abs(vectors.astype(float)).max(initial=0)) * int(np.abs(query.astype(float)).max(initial=0)) * len(query)
    if most < 1 << 62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    exact = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(x, LEAST), MOST) for x in exact], np.int64)


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """BLOCK rows: up to ``most`` vectors of one length in integers; a block is known by its task and its number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        part = TaskContext.get().partitionId()
        numbers = count()

        def block(dim: int, some: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            raw = packed(np.stack([v for _, v in some]))
            outline = segment_features(unpacked(raw, len(some)), SEGMENTS[0])
            ids = np.array([i for i, _ in some], "<i8").tobytes()
            row = (part, next(numbers), dim, ids, raw, len(some), outline.min(axis=0).tolist(), outline.max(axis=0).tolist())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            for i, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                values = vector.values.to_numpy(zero_copy_only=False)
                some = held.setdefault(len(values), [])
                some.append((i, values))
                if len(some) == most:
                    yield block(len(values), held.pop(len(values)))
        for dim, some in held.items():
            yield block(dim, some)
        give_back()

    return rows.mapInArrow(run, BLOCK)


def segment_features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that the inner product of two rows is the bound."""
    parts = np.array_split(vectors.astype(float), min(segments, vectors.shape[1]), axis=1)
    columns = []
    for part in parts:
        root = part.shape[1] ** 0.5
        columns += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(columns, axis=1)


def cells(rows: DataFrame) -> list[Column]:
    """Where a vector lies, coarsely: its segments' means by GRID parts of their ranges, and its deviation. Rows in this order make blocks of small outlines."""
    at = lambda i: F.floor(F.size("embedding") * i / SEGMENTS[0]).cast("int")
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    means = [total(F.slice("embedding", at(i) + 1, at(i + 1) - at(i))) / F.greatest(at(i + 1) - at(i), F.lit(1)) for i in range(SEGMENTS[0])]
    bounds = rows.agg(*[f(m).alias(f"{name}{i}") for i, m in enumerate(means) for name, f in (("low", F.min), ("high", F.max))]).first()
    out = [F.size("embedding")]
    for i, m in enumerate(means):
        low, high = bounds[f"low{i}"], bounds[f"high{i}"]
        if low is not None and 0 < high - low < float("inf"):
            out.append(F.floor((m - F.lit(low)) / F.lit((high - low) / GRID)))
    return out


def in_cells(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows in ranges of their cells, in order within a task; ties by a hash of the id, so that one cell may be many tasks'."""
    keys = [*cells(rows), F.xxhash64("vec_id")]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def reach(low: str, high: str, q_low: str, q_high: str) -> Column:
    """The greatest bound that outlines allow: of each statistic the greatest product of two ends."""
    ends = F.arrays_zip(F.col(low).alias("a"), F.col(high).alias("b"), F.col(q_low).alias("c"), F.col(q_high).alias("d"))
    most = lambda s, x: s + F.greatest(x["a"] * x["c"], x["a"] * x["d"], x["b"] * x["c"], x["b"] * x["d"])
    norm = lambda a, b: F.sqrt(F.aggregate(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), F.lit(0.0), lambda s, x: s + F.greatest(x["a"] * x["a"], x["b"] * x["b"])))
    # The same allowance for rounding as for single vectors, by the longest vectors that the outlines allow.
    return F.aggregate(ends, F.lit(0.0), most) + norm(low, high) * norm(q_low, q_high) * SLACK + 1


class Search:
    """The k best of each query of a block among the candidates seen so far, ties to the smaller vec_id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.features = [segment_features(queries, s) for s in SEGMENTS]
        self.floats = queries.astype(float)
        self.norms = np.linalg.norm(self.floats, axis=1)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Takes a block of candidates in, some queries at a time."""
        features = [segment_features(vectors, s) for s in SEGMENTS]
        floats = vectors.astype(float)
        norms = np.linalg.norm(floats, axis=1)
        largest = int(np.abs(floats).max(initial=0)) * int(np.abs(self.floats).max(initial=0)) * vectors.shape[1]
        whole = largest < 1 << 52  # then every partial sum is a whole number that a double holds

        def scored(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Exact scores of pairs of a query and a candidate."""
            if whole:
                return np.einsum("ij,ij->i", self.floats[i], floats[j]).astype(np.int64)
            parts = [products(vectors[j[i == q]], self.queries[q]) for q in np.unique(i)]
            return np.concatenate(parts) if parts else np.zeros(0, np.int64)

        for low in range(0, len(self.ids), TOGETHER):
            own = np.arange(low, min(low + TOGETHER, len(self.ids)))
            pad = SLACK * self.norms[own][:, None] * norms + 1
            bound = self.features[0][own] @ features[0].T + pad
            open_ = ids != self.ids[own][:, None]
            for row in np.flatnonzero([len(self.best[i][1]) < self.k for i in own]):
                # Candidates of the greatest bounds come first, so that there is a k-th best score.
                order = np.where(open_[row], -bound[row], np.inf)
                lead = np.argpartition(order, min(4 * self.k, len(order)) - 1)[: 4 * self.k]
                lead = lead[open_[row, lead]]
                self.take(own[row], ids[lead], scored(np.full(len(lead), own[row]), lead))
                open_[row, lead] = False
            least = np.array([self.best[i][1][-1] if len(self.best[i][1]) == self.k else LEAST for i in own], np.int64)
            open_ &= bound >= least[:, None]
            for level in range(1, len(SEGMENTS)):
                if MANY * open_.sum() > open_.size:
                    open_ &= self.features[level][own] @ features[level].T + pad >= least[:, None]
                else:
                    i, j = np.nonzero(open_)
                    fine = np.einsum("ij,ij->i", self.features[level][own[i]], features[level][j]) + pad[i, j]
                    open_[i, j] = fine >= least[i]
            if whole and MANY * open_.sum() > open_.size:
                scores = self.floats[own] @ floats.T
                i, j = np.nonzero(open_ & (scores >= least[:, None]))
                found = scores[i, j].astype(np.int64)
            else:
                i, j = np.nonzero(open_)
                found = scored(own[i], j)
                good = found >= least[i]
                i, j, found = i[good], j[good], found[good]
            cut = np.searchsorted(i, np.arange(len(own) + 1))
            for row in np.flatnonzero(cut[1:] > cut[:-1]):
                part = slice(cut[row], cut[row + 1])
                self.take(own[row], ids[j[part]], found[part])

    def take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merges candidates into a query's best."""
        ids, scores = np.concatenate((self.best[i][0], ids)), np.concatenate((self.best[i][1], scores))
        order = np.lexsort((ids, ~scores))[: self.k]
        self.best[i] = ids[order], scores[order]

    def rows(self) -> pa.RecordBatch:
        """(query_id, vec_id, score) of all queries."""
        query = np.repeat(self.ids, [len(v) for v, _ in self.best])
        columns = [query, *(np.concatenate([x[j] for x in self.best]) for j in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def numbered(packed_blocks: DataFrame) -> DataFrame:
    """Materialized blocks with ``unit``, numbered from 0: a running sum over one row a task, then the number in the task."""
    parts = packed_blocks.groupBy("part").agg(F.count("*").alias("n_blocks"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n_blocks").over(before), F.lit(0)).alias("first"))
    return packed_blocks.join(starts, "part").withColumn("unit", (F.col("first") + F.col("number")).cast("int"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows other than itself.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do null vec_ids; only
    vectors of equal length are compared. Rows with the query's vec_id count as its own; other repeated rows each take
    a place. A repeated query is answered once, with the vector of the least value. Components and scores that pass 64
    bits stop at its ends. An empty table gives none.
    """
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = asked.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, known = in_cells(asked, -(-n // QUERY_ROWS)), in_cells(usable(rows))
    query_blocks = numbered(materialize(blocks(asked, QUERY_ROWS), "queries"))
    candidate_blocks = numbered(materialize(blocks(known, BLOCK_ROWS), "candidates"))
    query_blocks = materialize(query_blocks.select("unit", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("low").alias("q_low"), F.col("high").alias("q_high")), "queries")
    candidate_blocks = materialize(candidate_blocks.select(F.col("unit").alias("block"), "dim", "ids", "vectors", "low", "high"), "candidates")
    pairs = block_pairs(query_blocks, candidate_blocks)
    first = Window.partitionBy("unit").orderBy(F.col("reach").desc(), "block")
    begun = materialize(pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= FIRST).select("unit", "block"), "first-pairs")
    found = searched(begun, query_blocks, candidate_blocks, k)
    kth = found.groupBy("unit", "query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))  # at most FIRST * k scores
    goal = kth.groupBy("unit").agg(F.min(F.coalesce(F.get("scores", F.lit(k - 1)), F.lit(LEAST))).alias("goal"), F.count("*").alias("n_met"))
    sized = query_blocks.select("unit", (F.octet_length("q_ids") / 8).cast("long").alias("n_own"))
    # A block in which a query has met nothing has no goal.
    goal = materialize(sized.join(goal, "unit", "left").select("unit", F.when(F.col("n_met") == F.col("n_own"), F.col("goal")).otherwise(F.lit(LEAST)).alias("goal")), "goals")
    left = materialize(pairs.join(goal, "unit").where(F.col("reach") >= F.col("goal")).select("unit", "block"), "pairs")
    found = searched(left, query_blocks, candidate_blocks, k).select("query_id", "vec_id", "score")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_pairs(query_blocks: DataFrame, candidate_blocks: DataFrame) -> DataFrame:
    """(unit, block, reach) of all pairs of a block of queries and one of candidates of its length, from their outlines alone.

    This is the stated queries against all rows, a row for thousands of vectors' pairs: outlines are some hundred bytes.
    """
    asked = query_blocks.select("unit", "q_dim", "q_low", "q_high")
    shares = max(1, -(-asked.count() // SHARE_BLOCKS))
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(shares)).cast("int")
    spread = candidate_blocks.select("block", "dim", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    met = spread.join(asked.withColumn("share", number("unit")), "share")
    return met.where("dim = q_dim").select("unit", "block", reach("low", "high", "q_low", "q_high").alias("reach"))


def searched(pairs: DataFrame, query_blocks: DataFrame, candidate_blocks: DataFrame, k: int) -> DataFrame:
    """(unit, query_id, vec_id, score): the k best of each query in each share of its block's candidate blocks, for pairs (unit, block)."""
    shared = pairs.withColumn("share", F.floor((F.row_number().over(Window.partitionBy("unit").orderBy("block")) - 1) / SHARE_BLOCKS).cast("int"))
    own = shared.select("unit", "share").distinct().join(query_blocks.select("unit", "q_ids", "q_vectors"), "unit")
    met = shared.join(candidate_blocks.select("block", "ids", "vectors"), "block").join(own, ["unit", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, search = None, None

        def result() -> pa.RecordBatch:
            out = search.rows()
            return pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, unit[0], np.int32)), *out.columns], names=["unit", *out.schema.names])

        for batch in batches:
            for row in batch.to_pylist():
                if unit != (row["unit"], row["share"]):
                    if search:
                        yield result()
                    unit, ids = (row["unit"], row["share"]), np.frombuffer(row["q_ids"], "<i8")
                    search = Search(ids, unpacked(row["q_vectors"], len(ids)), k)
                ids = np.frombuffer(row["ids"], "<i8")
                search.meet(ids, unpacked(row["vectors"], len(ids)))
        if search:
            yield result()
        give_back()

    # If a unit is split, its parts are like further shares.
    columns = met.select("unit", "share", "ids", "vectors", "q_ids", "q_vectors")
    return columns.sortWithinPartitions("unit", "share").mapInArrow(run, "unit int, query_id long, vec_id long, score long")


def top_k_table(rows: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """Queries: rows whose vec_id is divisible by ``every``; candidates: all rows."""
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
