"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on statistics of a bounded sample of labelled documents. Every path from a root to a
node is a conjunctive rule; a logistic model with a lasso penalty weighs the rules and drops most of them. What is left
is compiled into one Spark column expression over the statistics, so that scoring is plain Spark SQL.

The statistics of a text come from one vectorised pass over its bytes. Documents never shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow, utf8

#: Most labelled rows to learn from, in the order of a hash of their ids.
SAMPLE = 20_000
TREES = 40
DEPTH = 3
BINS = 32
SHRINKAGE = 0.3
#: Least sum of second derivatives in a leaf, and the lasso's penalty.
LEAF = 2.0
PENALTY = 2e-4

STATISTICS = (
    "n_chars", "n_words", "word_chars", "upper_share", "digit_share", "punct_share", "symbol_share", "mark_share",
    "bar_share", "line_chars", "repeated_lines", "longest_word", "other_share", "blank_share", "upper_words", "repeats",
)

# Classes of bytes: 1 upper, 2 lower, 3 digit, 4 blank, 5 newline, 6 plain punctuation, 7 marks, 8 bar, 9 other ASCII
# symbols, 10 lead byte of a longer character, 11 further byte of it.
CLASSES = np.full(256, 9, np.uint8)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58] = 1, 2, 3
CLASSES[[9, 11, 12, 13, 32]], CLASSES[10] = 4, 5
CLASSES[[ord(c) for c in ".,;:'\"()-?"]], CLASSES[ord("!")], CLASSES[ord("|")] = 6, 7, 8
CLASSES[0xC0:], CLASSES[0x80:0xC0] = 10, 11


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


#: A number for each byte, and the base of the words' hashes; it is odd, so that its powers can be divided out.
BYTE_MARKS = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)
BASE = 0x2545F4914F6CDD1D


def word_hashes(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of all bytes of each word, from sums over the bytes before each place."""
    n = len(data)
    powers, back, before = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    powers[1:], back[1:] = BASE, pow(BASE, -1, 1 << 64)
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(back, out=back)
    np.cumsum(BYTE_MARKS[data] * powers[:n], out=before[1:])
    return (before[stops] - before[begins]) * back[begins]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; nulls count as empty, empty texts have zeros."""
    data, offsets = utf8(column)
    n = len(column)
    out = np.zeros((n, len(STATISTICS)))
    if not len(data):
        return out
    kind = CLASSES[data]
    count = {k: sums(kind == k, offsets) for k in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11)}
    blank = (kind == 4) | (kind == 5)
    starts = ~blank
    starts[1:] &= blank[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    starts[inner] = ~blank[inner]
    begins = np.flatnonzero(starts)
    word_count = sums(starts, offsets)
    size = np.diff(offsets).astype(float)
    chars = size - count[11]
    full = np.maximum(chars, 1)
    word_full = np.maximum(word_count, 1)
    solid = chars - count[4] - count[5]
    # Ends of words: the next blank or the text's end.
    stops = np.flatnonzero(np.concatenate((starts[1:] | (blank[1:] & ~blank[:-1]), [True])) & ~blank) + 1
    owner = np.searchsorted(offsets, begins, side="right") - 1
    longest = np.zeros(n)
    repeats = np.zeros(n)
    capital = np.zeros(n)
    if len(begins) and len(begins) == len(stops):
        length = stops - begins
        np.maximum.at(longest, owner, length)
        upper = np.concatenate(([0], np.cumsum(kind == 1)))
        capital = np.bincount(owner, (upper[stops] - upper[begins]) * 2 > length, n)
        mark = word_hashes(data, begins, stops)
        mark = (mark * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64)) ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        ordered = np.unique(mark, return_index=True)[1]
        repeats = 1 - np.bincount(owner[ordered], minlength=n) / word_full
        repeats[word_count == 0] = 0
    lines = [x.split("\n") for x in column.to_pylist() if x is not None]
    filled = np.array([x is not None for x in column.to_pylist()])
    repeated = np.zeros(n)
    repeated[filled] = [1 - len(set(x)) / len(x) for x in lines]
    shares = (count[1] / full, count[3] / full, count[6] / full, count[9] / full, count[7] / full, count[8] / full)
    columns = (
        chars, word_count, solid / word_full, *shares, chars / (count[5] + 1), repeated, longest, count[10] / full,
        (count[4] + count[5]) / full, capital / word_full, repeats,
    )
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each row and its statistics."""
    held = docs.select(*dict.fromkeys((*keep, "text")))
    names = list(keep)
    fields = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in names] + [f"stat_{s} double" for s in STATISTICS])

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        table = statistics(part.column("text"))
        made = [pa.array(table[:, i]) for i in range(table.shape[1])]
        return pa.RecordBatch.from_arrays(
            [part.column(c) for c in names] + made, names=[*names, *(f"stat_{s}" for s in STATISTICS)]
        )

    return map_arrow(held, one, schema)


Rule = tuple[tuple[int, bool, float], ...]


def grow(binned: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """Rules of one tree's paths, and its value for each row, by second-order gain over binned statistics."""
    rules: list[Rule] = []
    value = np.zeros(len(slope))

    def split(rows: np.ndarray, path: Rule, left: int) -> None:
        g, h = slope[rows].sum(), curve[rows].sum()
        if path:
            rules.append(path)
        best = (1e-6, -1, -1)
        if left:
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                gj = np.bincount(binned[rows, j], slope[rows], len(cut) + 1).cumsum()[:-1]
                hj = np.bincount(binned[rows, j], curve[rows], len(cut) + 1).cumsum()[:-1]
                gain = gj**2 / (hj + 1) + (g - gj) ** 2 / (h - hj + 1) - g**2 / (h + 1)
                gain[(hj < LEAF) | (h - hj < LEAF)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (gain[k], j, k)
        if best[1] < 0:
            value[rows] = -g / (h + 1)
            return
        _, j, k = best
        low = binned[rows, j] <= k
        split(rows[low], (*path, (j, True, float(cuts[j][k]))), left - 1)
        split(rows[~low], (*path, (j, False, float(cuts[j][k]))), left - 1)

    split(np.arange(len(slope)), (), depth)
    return rules, value


def applies(rule: Rule, table: np.ndarray) -> np.ndarray:
    """For which rows the rule holds."""
    out = np.ones(len(table), bool)
    for j, low, cut in rule:
        out &= (table[:, j] <= cut) if low else (table[:, j] > cut)
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = x.shape
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias, w = float(np.log(mean / (1 - mean))), np.zeros(m)
    norm = np.ones(m)
    for _ in range(20):  # the largest eigenvalue of x'x / n
        norm = x.T @ (x @ norm) / n
        size = np.linalg.norm(norm)
        norm /= max(size, 1e-12)
    step = 1 / (0.25 * (size + 1) + 1e-9)
    ahead_b, ahead_w, t = bias, w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ahead_b + x @ ahead_w, -30, 30)))
        new_b = ahead_b - step * (p - y).mean()
        new_w = ahead_w - step * (x.T @ (p - y) / n)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_b, ahead_w = new_b + (t - 1) / after * (new_b - bias), new_w + (t - 1) / after * (new_w - w)
        bias, w, t = new_b, new_w, after
    return bias, w


@dataclass
class RuleModel:
    """Intercept and weighted rules."""

    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The probability of label 1 as an expression over the columns ``stat_*``.

        Weights are added up pairwise: the plan of a sum one after another is as deep as there are rules, and the driver's
        work on it grows with their square.
        """
        parts = [F.lit(self.bias)]
        for rule, weight in self.rules:
            stats = [(F.col(f"stat_{STATISTICS[j]}"), low, cut) for j, low, cut in rule]
            holds = reduce(and_, [(stat <= cut) if low else (stat > cut) for stat, low, cut in stats])
            parts.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(parts) > 1:
            parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
        total = parts[0]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(table: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules from boosted trees, weighed by the lasso. Without both labels, or with too few rows for a rule, the model is a constant."""
    if not len(y) or y.min() == y.max():
        return RuleModel(0.0 if not len(y) else (4.0 if y[0] else -4.0), [])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in table.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, table.T)]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, table.T)], axis=1)
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rules, value = grow(binned, cuts, p - y, p * (1 - p), DEPTH)
        score += SHRINKAGE * value
        found.update(dict.fromkeys(rules))
    names = list(found)
    if not names:
        return RuleModel(float(score[0]), [])
    x = np.stack([applies(r, table) for r in names], axis=1).astype(float)
    bias, w = lasso(x, y, PENALTY)
    return RuleModel(bias, [(r, float(v)) for r, v in zip(names, w) if abs(v) > 1e-6])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample`` labelled rows whose crc32(doc_id) mod 3 isn't 1."""
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .select("doc_id", F.col("quality").cast("int").alias("label"))
        .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers. Of several texts of one id the one of the least MD5 is taken.
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.md5("text")).alias("text"))
    rows = with_statistics(own, ("doc_id", "label")).toPandas().sort_values("doc_id")
    return rows[[f"stat_{s}" for s in STATISTICS]].to_numpy(float), rows["label"].to_numpy(float)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """The rule model of the labelled sample."""
    return fit(*labelled_sample(docs, labels, sample))


def score_quality(docs: DataFrame, model: RuleModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each row with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5)."""
    score = with_statistics(docs, keep).select(*keep, model.column().alias("score"))
    return score.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    held_out marks rows whose crc32(doc_id as text) mod 3 is 1, of which no label is learned (a null doc_id counts as
    an empty text). Null texts count as empty and get a score too. Repeated rows each give a row; of repeated labels
    the highest counts. An empty table gives an empty result; further columns are left out.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return score_quality(docs, train(docs, labels)).select("doc_id", held.alias("held_out"), "score", "predicted")
