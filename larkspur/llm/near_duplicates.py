"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Texts become sets of five-word shingles; equal word sequences form a class that is handled once. Each class has a
   MinHash signature of ``HASHES`` values.
2. Candidates share one of ``BANDS`` runs of the signature. A pair of Jaccard similarity 0.8 shares none with a
   probability of 5e-8.
3. Inside a bucket the signatures of two classes are compared ``STEP`` values at a time; a pair is dropped as soon as
   the posterior probability of reaching the threshold, given the matches so far, falls below ``TOLERANCE``. Buckets
   are cut into chunks and each pair of chunks is a unit of work of bounded size; a unit returns a spanning forest of
   the pairs that stay, so its output is linear in its rows.
4. Components of these forests hold all links. In a component of up to ``EXACT`` classes every pair is compared once
   more, first by length and signature as before, and the rest verified exactly on the shingle sets. In a larger one
   the units of the buckets are taken again, a pair counting where its first common band is. Where a unit has few
   pairs that stay (``FEW`` a row, as in long chains), the pairs meet their sets one by one; where it has many, its rows
   bring their sets along. Either way the work follows the pairs that stay, not the square of the component.
   Each row's number of links and a forest of the links come back.
5. The classes of the result are the components of the links.

Only where they are few for their rows are pairs written out, and no group is held by one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WORD_BYTES, by_place, give_back, labels_of_edges, map_arrow, materialize, release, slices, small, utf8, whole_groups
from larkspur.llm.components import components

WORDS = 5
#: The threshold as a fraction, so that the exact test is in integers.
THRESHOLD = (4, 5)
HASHES = 128
BAND = 4
BANDS = HASHES // BAND
STEP = 32
TOLERANCE = 1e-6
#: Rows of a chunk when signatures are compared; classes of a component whose shingle sets are compared together.
CHUNK = 512
EXACT = 128
#: Pairs a row that are few.
FEW = 8
#: Pairs compared at a time, and bytes of words that are hashed at a time.
PAIRS = 1 << 16
PIECE = 1 << 18

SIGNED = "doc_id long, key binary, n_shingles int, signature binary"
_random = np.random.default_rng(20240229)
MULTIPLIERS = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
OFFSETS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
WORD_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base modulo 2^64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out[:n]


#: Powers of the base that words are hashed with, and of its inverse, for the places of a piece.
POWERS = powers(int(WORD_BASE), PIECE)
INVERSES = powers(pow(int(WORD_BASE), -1, 1 << 64), PIECE)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts (UTF-8 bytes one after another) in order, and each one's text.

    Words are those of the licence scan: A-Z lower-cased, runs of 0-9, a-z and non-ASCII. A word's hash is a polynomial in
    its bytes, from running sums over pieces of the bytes; the place in the piece is taken out by the inverse power, and
    the part of a word that goes on in the next piece is carried over.
    """
    table = np.frombuffer(WORD_BYTES, np.uint8)
    words, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    sizes = [np.zeros(0, np.uint64)]
    carried: tuple[int, int, int] | None = None  # hash, size and text of a word that reached the last piece's end
    for low in range(0, len(data), PIECE):
        part = table[data[low : low + PIECE]]
        n = len(part)
        solid = part != 32
        # A text's first byte begins a word even if the text before ends in one.
        edge = np.zeros(n + 1, bool)
        edge[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, low + n, side="right")] - low] = True
        begins = np.flatnonzero(solid & ~(np.concatenate(([False], solid[:-1])) & ~edge[:-1]))
        stops = np.flatnonzero(solid & ~(np.concatenate((solid[1:], [False])) & ~edge[1:])) + 1
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * POWERS[:n])))
        word = (running[stops] - running[begins]) * INVERSES[begins]
        size = (stops - begins).astype(np.uint64)
        owner = np.searchsorted(offsets, low + begins, side="right") - 1
        if carried is not None:
            if solid[0] and not edge[0]:
                word[:1] = np.uint64(carried[0]) + np.uint64(pow(int(WORD_BASE), carried[1], 1 << 64)) * word[:1]
                size[0] += np.uint64(carried[1])
            else:
                words.append(np.array([carried[0]], np.uint64))
                sizes.append(np.array([carried[1]], np.uint64))
                owners.append(np.array([carried[2]], np.int64))
            carried = None
        if len(word) and stops[-1] == n and low + n < len(data):
            carried = int(word[-1]), int(size[-1]), int(owner[-1])
            word, size, owner = word[:-1], size[:-1], owner[:-1]
        words.append(word)
        sizes.append(size)
        owners.append(owner)
    size = np.concatenate(sizes)
    return mix(np.concatenate(words) + size * np.uint64(0xD6E8FEB86659FD93)), np.concatenate(owners)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts (UTF-8 bytes one after another), and each one's text. Repeats are kept.

    A text of fewer than five words has one shingle of all its words, one without words none.
    """
    n = len(offsets) - 1
    word, owner = word_hashes(data, offsets)
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    size = np.minimum(count, WORDS)
    number = np.where(count > 0, count - size + 1, 0)
    text = np.repeat(np.arange(n), number)
    start = np.repeat(first - np.cumsum(number) + number, number) + np.arange(len(text))
    padded = np.concatenate((word, np.zeros(WORDS, np.uint64)))
    short = size[text] < WORDS
    value = np.zeros(len(text), np.uint64)
    for j in range(WORDS):
        value = value * np.uint64(0x9FB21C651E98DF25) + np.where(short & (j >= size[text]), np.uint64(j + 1), padded[start + j])
        value ^= value >> np.uint64(29)
    return mix(value), text


def signatures(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A row of HASHES 16-bit MinHash values for each text; rows without shingles are zero."""
    out = np.zeros((n, HASHES), np.uint16)
    if not len(values):
        return out
    small_values = (values >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    rows = text[starts]
    for k in range(HASHES):
        hashed = small_values * MULTIPLIERS[k] + OFFSETS[k]
        least = np.minimum.reduceat(hashed, starts)
        out[rows, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def sign(docs: DataFrame) -> DataFrame:
    """SIGNED rows: the class's key (a hash of the word sequence), the number of shingles and the signature."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(part.column("text"))
        values, text = shingles(data, offsets)
        n = part.num_rows
        table = signatures(values, text, n)
        raw = data.tobytes().translate(WORD_BYTES)
        keys = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        count = np.bincount(text, minlength=n)
        rows = [row.tobytes() if c else None for row, c in zip(table, count.tolist())]
        columns = [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(count, pa.int32()), pa.array(rows, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_shingles", "signature"])

    return map_arrow(docs.select("doc_id", "text"), one, SIGNED)


def least_matches(hashes: int, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among so many hashes for which reaching the threshold still has the tolerated posterior.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), whose upper tail at t is the
    probability of at most m successes among n + 1 trials of chance t.
    """
    t, below = THRESHOLD[0] / THRESHOLD[1], 0.0
    for m in range(hashes + 1):
        below += math.comb(hashes + 1, m) * t**m * (1 - t) ** (hashes + 1 - m)
        if below >= tolerance:
            return m
    return hashes


LIMITS = tuple((n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP))


def first_common(rows: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Whether the first band in which the signatures of each pair agree is the given one."""
    words = rows.view(np.uint64)  # four 16-bit values: a band
    same = words[a] == words[b]
    return same.any(axis=1) & (same.argmax(axis=1) == band)


def likely(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows stay, compared STEP hashes at a time."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, least in LIMITS:
        part = slice(n - STEP, n)
        matches = matches + (table[a[left], part] == table[b[left], part]).sum(axis=1)
        on = matches >= least
        left, matches = left[on], matches[on]
        if not len(left):
            break
    return left


def pairs_of(unit: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of each unit (rows are sorted by unit): within a unit of one chunk, across in one of two.

    side is 0 for rows of a unit of one chunk, 1 and 2 for the two chunks. Runs of at most about PAIRS pairs come at a
    time.
    """
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    stops = np.append(starts[1:], len(unit))
    # Row i meets the rows after it in its unit; across chunks, rows of the other side only.
    end = np.repeat(stops, stops - starts)
    ahead = end - np.arange(len(unit)) - 1
    total = np.cumsum(ahead)
    i = 0
    while i < len(unit):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        rows = np.arange(i, j)
        a = np.repeat(rows, ahead[i:j])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(ahead[i:j]) - ahead[i:j], ahead[i:j])
        ok = side[a] + side[b] != 2 * np.where(side[a] > 0, side[a], -1)
        yield a[ok], b[ok]
        i = j


def chunked(members: DataFrame, group: str, size: str, chunk: int) -> DataFrame:
    """members once for each unit that they belong to, (group, low chunk, high chunk), with the side in it.

    A row's chunk is drawn by a hash of its key, so chunks are alike in size.
    """
    chunks = F.ceil(F.col(size) / chunk).cast("int")
    rows = members.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(7)), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
    return rows.select(
        F.xxhash64(group, low, high).alias("unit"), side.alias("side"), *[c for c in members.columns if c not in (group, size)]
    )


def candidate_forests(table: pa.Table) -> pa.RecordBatch:
    """Edges (a, b) of spanning forests of the pairs that stay in each unit."""
    key = table.column("key").to_pylist()
    unit = table.column("unit").to_numpy()
    side = table.column("side").to_numpy()
    rows = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(key), HASHES)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    label = np.arange(len(key))
    for a, b in pairs_of(unit, side):
        stay = likely(rows, a, b)
        # Only what joins two trees so far need be kept.
        stay = stay[label[a[stay]] != label[b[stay]]]
        if len(stay):
            left.append(a[stay])
            right.append(b[stay])
            label = labels_of_edges(len(key), np.concatenate((np.arange(len(key)), a[stay])), np.concatenate((label, b[stay])))
    moved = np.flatnonzero(label != np.arange(len(key)))
    return pa.RecordBatch.from_arrays(
        [pa.array([key[i] for i in moved], pa.binary()), pa.array([key[label[i]] for i in moved], pa.binary())], names=["a", "b"]
    )


def exact_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    both = np.zeros(len(a), np.int64)
    used = np.unique(np.concatenate((a, b)))
    if len(a) > 8 * len(used):
        # Many pairs of few sets: count common shingles by products of incidence matrices, some columns at a time.
        values = np.concatenate([sets[i] for i in used])
        row = np.repeat(np.arange(len(used)), size[used])
        distinct, column, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        counts = np.zeros((len(used), len(used)), np.float32)
        width, total = 4096, int(shared.sum())
        for start in range(0, total, width):
            i, j = np.searchsorted(column, (start, start + width))
            block = np.zeros((len(used), min(width, total - start)), np.float32)
            block[row[i:j], column[i:j] - start] = 1
            counts += block @ block.T
        at = np.searchsorted(used, a), np.searchsorted(used, b)
        both = counts[at].round().astype(np.int64)
    else:
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            both[k] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    return both * THRESHOLD[1] >= THRESHOLD[0] * (size[a] + size[b] - both)


class Rows:
    """Rows of a table of units: keys, units, sides, signatures."""

    def __init__(self, table: pa.Table):
        self.key = table.column("key").to_pylist()
        self.unit = table.column("unit").to_numpy()
        self.side = table.column("side").to_numpy()
        self.signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(self.key), HASHES)
        # Rows of a larger component's units: the pairs of a unit count if its band is their first common one.
        self.band = table.column("band").to_numpy() if "band" in table.column_names else None

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that count here and stay likely."""
        for a, b in pairs_of(self.unit, self.side):
            stay = likely(self.signatures, a, b)
            a, b = a[stay], b[stay]
            if self.band is not None and len(a):
                own = first_common(self.signatures, a, b, self.band[a])
                a, b = a[own], b[own]
            yield a, b


def link_forests(table: pa.Table) -> pa.RecordBatch:
    """For each row of each unit its number of links there (copies counted) and its root in the forest of links."""
    rows = Rows(table)
    copies = table.column("copies").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    links = np.zeros(len(sets), np.int64)
    label = np.arange(len(sets))
    for a, b in rows.pairs():
        fits = np.minimum(size[a], size[b]) * THRESHOLD[1] >= np.maximum(size[a], size[b]) * THRESHOLD[0]
        a, b = a[fits], b[fits]
        if not len(a):
            continue
        # Runs of one unit, so that a product of matrices is of one group's sets.
        bounds = np.flatnonzero(np.concatenate(([True], rows.unit[a][1:] != rows.unit[a][:-1], [True])))
        ok = np.concatenate([exact_links(sets, a[i:j], b[i:j]) for i, j in zip(bounds[:-1], bounds[1:])])
        a, b = a[ok], b[ok]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        label = labels_of_edges(len(sets), np.concatenate((np.arange(len(sets)), a)), np.concatenate((label, b)))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows.key, pa.binary()), pa.array([rows.key[i] for i in label], pa.binary()), pa.array(links)], names=["key", "root", "links"]
    )


def few_or_many(table: pa.Table) -> pa.RecordBatch:
    """Pairs (a, b) that stay of units that have few for their rows; of others the unit's number alone."""
    rows = Rows(table)
    pairs = [np.zeros((2, 0), np.int64)]
    unit, first, size = np.unique(rows.unit, return_index=True, return_counts=True)
    met = np.zeros(len(unit), np.int64)
    for a, b in rows.pairs():
        at = np.searchsorted(unit, rows.unit[a])
        met += np.bincount(at, minlength=len(unit))
        few = met[at] <= FEW * size[at]
        pairs.append(np.stack((a[few], b[few])))
    a, b = np.concatenate(pairs, axis=1)
    many = met > FEW * size
    few = ~many[np.searchsorted(unit, rows.unit[a])]
    a, b = a[few].tolist(), b[few].tolist()
    none = [None] * int(many.sum())
    columns = [pa.array([rows.key[i] for i in a] + none, pa.binary()), pa.array([rows.key[i] for i in b] + none, pa.binary())]
    units = pa.array([None] * len(a) + unit[many].tolist(), pa.int64())
    return pa.RecordBatch.from_arrays([*columns, units], names=["a", "b", "unit"])


def by_unit(rows: DataFrame, columns: tuple[str, ...], step, schema: str) -> DataFrame:
    """step over whole units, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit"):
            yield step(table)
        give_back()

    dealt = rows.select("unit", "side", *columns).repartition("unit").sortWithinPartitions("unit", "side", "key")
    return dealt.mapInArrow(run, schema)


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, band, bucket, members) of classes in buckets of two or more."""
    at = F.sequence(F.lit(0), F.lit(BANDS - 1))
    bands = F.transform(at, lambda k: F.xxhash64(k, F.substring(F.col("signature"), k * (2 * BAND) + 1, F.lit(2 * BAND))))
    buckets = classes.where("signature is not null").select("key", F.posexplode(bands).alias("band", "bucket"))
    full = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    members = materialize(buckets.join(small(full, full.count()), "bucket").select("key", F.col("band").cast("short").alias("band"), "bucket", "members"), "members")
    release(full)
    return members


def candidates(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root): components of the pairs that share a band and stay likely."""
    signed = classes.select("key", "signature")
    units = chunked(members.select("key", "bucket", "members").join(signed, "key"), "bucket", "members", CHUNK)
    return components(by_unit(units, ("key", "signature"), candidate_forests, "a binary, b binary"))


LINKS = "key binary, root binary, links long"


def links_of_large(members: DataFrame, large: DataFrame, sets: DataFrame) -> DataFrame:
    """LINKS rows of the pairs of larger components: large has (key, signature, copies), sets (key, shingles)."""
    rows = members.join(large, "key")
    units = materialize(chunked(rows, "bucket", "members", CHUNK), "units")
    found = materialize(by_unit(units, ("key", "signature", "band"), few_or_many, "a binary, b binary, unit long"), "pairs")
    many = found.where("unit is not null").select("unit").distinct()
    brought = units.join(small(many, many.count()), "unit").join(sets, "key")
    dense = by_unit(brought, ("key", "signature", "band", "copies", "shingles"), link_forests, LINKS)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "a_set"):
                own, other = ([np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist()] for c in ("a_set", "b_set"))
                n = part.num_rows
                ok = pa.array(exact_links([*own, *other], np.arange(n), np.arange(n, 2 * n)))
                kept = part.select(["a", "b", "a_copies", "b_copies"]).filter(ok)
                a, b = kept.column("a"), kept.column("b")
                # Each row has the other's copies as links; the edge goes with one of the two.
                yield pa.RecordBatch.from_arrays([a, b, kept.column("b_copies")], names=["key", "root", "links"])
                yield pa.RecordBatch.from_arrays([b, b, kept.column("a_copies")], names=["key", "root", "links"])
        give_back()

    side = large.select("key", "copies").join(sets, "key")
    pairs = found.where("unit is null").select("a", "b")
    for c in ("a", "b"):
        pairs = pairs.join(side.select(F.col("key").alias(c), F.col("copies").alias(f"{c}_copies"), F.col("shingles").alias(f"{c}_set")), c)
    return dense.unionByName(pairs.select("a", "b", "a_copies", "b_copies", "a_set", "b_set").mapInArrow(verify, LINKS))


def with_shingles(docs: DataFrame) -> DataFrame:
    """docs (key, text) with their sorted distinct shingles as 64-bit integers."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        values, text = shingles(*utf8(part.column("text")))
        cut = np.searchsorted(text, np.arange(part.num_rows + 1))
        sets = [np.unique(values[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return map_arrow(docs.select("key", "text"), one, "key binary, shingles binary")


def word_key(docs: DataFrame) -> DataFrame:
    """docs with the class key of each text, as in sign()."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(part.column("text"))
        raw = data.tobytes().translate(WORD_BYTES)
        keys = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=[*part.schema.names, "near_key"])

    return map_arrow(docs, one, ", ".join([*fields, "near_key binary"]))


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SIGNED rows of docs, and (key, class_id, root, n_links, copies, rep_id) of every class of equal words."""
    signed = materialize(sign(docs), "signed")
    classes = materialize(
        signed.groupBy("key").agg(
            F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")
        ),
        "classes",
    )
    buckets = bucket_members(classes)
    groups = materialize(candidates(buckets, classes), "groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    members = materialize(
        groups.join(sizes, "root").withColumnRenamed("node", "key").join(classes, "key").select("key", "root", "members", "copies", "signature", "rep_id"),
        "grouped",
    )
    release(groups)
    n, n_large = members.agg(F.count("*"), F.count_if(F.col("members") > EXACT)).first()
    wanted = small(members.select(F.col("key").alias("near_key"), F.col("rep_id")), n)
    # The texts of the classes in question, one of each.
    texts = (
        word_key(docs.select("doc_id", "text"))
        .join(wanted, "near_key")
        .where(F.col("doc_id").eqNullSafe(F.col("rep_id")))
        .select(F.col("near_key").alias("key"), "text")
        .dropDuplicates(["key"])  # also parts the two Python steps, so that a task has one worker at a time
    )
    sets = materialize(with_shingles(texts), "sets")
    columns = ("key", "signature", "copies", "shingles")
    units = members.where(F.col("members") <= EXACT).join(sets, "key").select(F.xxhash64("root").alias("unit"), F.lit(0).alias("side"), *columns)
    found = by_unit(units, columns, link_forests, LINKS)
    if n_large:
        large = members.where(F.col("members") > EXACT).select("key", "signature", "copies")
        found = found.unionByName(links_of_large(buckets, large, sets))
    found = materialize(found, "links")
    release(buckets, sets, members)
    linked = components(found.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links")).where("links > 0")
    known = linked.withColumnRenamed("node", "key").join(classes.select("key", "rep_id"), "key")
    least = known.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    named = known.join(least, "root").select("key", "root", "class_id").join(links, "key", "left")
    named = materialize(named, "named")
    table = classes.select("key", "rep_id", "copies", "n_shingles").join(named, "key", "left")
    # Texts without words have no shingles: they are linked to nothing, copies of them neither.
    own = F.when(F.col("n_shingles") > 0, F.col("copies") - 1).otherwise(0)
    return signed, table.select(
        "key", F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "rep_id")).alias("class_id"), F.coalesce("root", "key").alias("root"),
        (own + F.coalesce("links", F.lit(0))).alias("n_links"), "copies", "rep_id", "n_shingles",
    )


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document.

    class_id is the least doc_id of all documents that links join, directly or through others; n_links is the number of
    documents whose Jaccard similarity on five-word shingles is 0.8 or more, exact copies included; n_copies of them
    have the same words. A null or wordless text is linked to nothing: its class is its own doc_id. A null doc_id is a
    row like others, but names no class unless all of the class are null. Repeated rows count as copies of one another.
    An empty table gives an empty result; further columns are left out.
    """
    signed, table = classes_and_links(docs)
    rows = signed.select("doc_id", "key").join(table.select("key", "class_id", "n_links", "copies", "n_shingles"), "key")
    return rows.select(
        "doc_id", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.col("n_links").cast("long").alias("n_links"),
        F.when(F.col("n_shingles") > 0, F.col("copies") - 1).otherwise(0).cast("long").alias("n_copies"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, that of the least doc_id; wordless texts all stay.

    Of rows of that id and the same words one stays, that of the least hash of all its columns. Further columns stay as they
    are, whatever their names.
    """
    return by_place(docs, one_of_each, ("doc_id", "text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """drop_near_duplicates() of docs whose columns have none of the names that are used here."""
    signed, table = classes_and_links(docs)
    grouped = table.where("n_shingles > 0 and n_links > 0").select("key", "root", "rep_id")
    grouped = materialize(grouped, "grouped")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "key")).alias("first"))
    fate = grouped.join(first, "root").select(
        F.col("key").alias("near_fate"), (F.col("key") == F.col("first.key")).alias("near_kept"), F.col("rep_id").alias("near_rep")
    )
    fate = materialize(fate, "fate")
    rows = word_key(docs).join(small(fate, fate.count()), F.col("near_key") == F.col("near_fate"), "left")
    rows = rows.where(F.col("near_fate").isNull() | F.col("near_kept") & F.col("doc_id").eqNullSafe(F.col("near_rep")))
    # Rows of one id among copies: rare, so only those that the signed table shows twice are told apart by a grouping.
    same = signed.groupBy("key", "doc_id").agg(F.count("*").alias("times")).where("times > 1")
    twice = same.join(fate.where("near_kept"), (F.col("key") == F.col("near_fate")) & F.col("doc_id").eqNullSafe(F.col("near_rep")))
    twice = materialize(twice.select(F.col("key").alias("near_twice")), "twice")
    n = twice.count()
    if n:
        rows = rows.join(small(twice, n), F.col("near_key") == F.col("near_twice"), "left")
        single = rows.where("near_twice is null").select(*docs.columns)
        whole = F.struct(*docs.columns)
        again = rows.where("near_twice is not null").groupBy("near_key").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("near_row"))
        return single.unionByName(again.select("near_row.*"))
    return rows.select(*docs.columns)
