"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and which of them go together in a corpus.

Both tokenizers cut the same bytes of a text. Two pointers over the cumulative ends of their tokens, a merge of two
sorted lists, give the groups (up to an end that both have) and the links (each stretch between neighbouring ends is the
overlap of exactly one token of either side). That happens inside mapInArrow, for all texts of a slice at once; each text
gives its figures and its distinct pairs of ids with the number of their links.

Spark then sums the pairs over the corpus (partial sums before the shuffle), takes each id's greatest count and brings both
back to the texts' pairs. Pairs that hold at least 1 / HEAVY of all links are HEAVY at most, so they are broadcast; the
others meet their counts in a shuffled join, in which no pair has a large share of the rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import documents, give_back, materialize, slices, small, utf8
from larkspur.llm.token_files import CHUNKS, ChunkTable, Coder

#: Pairs that hold at least one in so many of all links are met by a broadcast.
HEAVY = 20_000
#: Characters of a text that are aligned together; a longer one is cut where both tokenizers cut.
LONG = 1 << 20
#: Between letters a blank begins a token of either side.
BETWEEN = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: Width of what stands for bytes that a tokenizer doesn't give back: more than any text has.
BROKEN = 1 << 40

ALIGNED = (
    "doc_id bigint, at bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<struct<pair:bigint,times:int>>"
)
LINKS = "doc_id bigint, at bigint, part int, a_place bigint, b_place bigint, a_id int, b_id int, grouped bigint"


class PlainCoder(Coder):
    """A byte-level BPE of the tokenizers library for which special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        found, length = self.encode(column, 0)
        keep = np.ones(len(found), bool)
        keep[np.cumsum(length) - 1] = False  # the end ids
        return found[keep], length - 1


class PieceCoder(Coder):
    """A sentencepiece model; chunks that it has seen are looked up.

    No piece of the usual models has a blank behind another character, so a text is cut before each run of blanks, and
    chunks are encoded on their own. Where a model has such a piece, texts go whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.width = np.array([*map(len, self.bytes), BROKEN], np.int64)
        self.cuts = not any(re.search("[^▁]▁", x) for x in names)
        self.blank = self.model.piece_to_id("▁")
        self.table = ChunkTable()

    def learn(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, each of which begins with the blank that the library adds, and how many each has."""
        chunks = [data[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist())]
        found = self.model.encode([x[1:].decode() for x in chunks], num_threads=1)
        found = [ids if x != b" " else [self.blank] for ids, x in zip(found, chunks)]  # the library adds no blank to nothing
        found = [ids if b"".join([self.bytes[i] for i in ids]) == x else [len(self.bytes)] for ids, x in zip(found, chunks)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), "<u4", int(count.sum())), count

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, which begin with a blank, one after another, and how many each has."""
        data, offsets = utf8(column)
        raw = data.tobytes()
        begins = data == 32 if self.cuts else np.zeros(len(data), bool)
        begins[1:] &= data[:-1] != 32
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(raw))
        data = np.concatenate((data, np.zeros(16, np.uint8)))
        found = [self.look_up(data, raw, starts[k : k + CHUNKS], stops[k : k + CHUNKS]) for k in range(0, len(starts), CHUNKS)]
        if not found:
            return np.zeros(0, "<u4"), np.zeros(len(column), np.int64)
        total = np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in found]))))
        return np.concatenate([x for x, _ in found]), np.diff(total[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def coders(a_path: str, b_path: str) -> tuple[PlainCoder, PieceCoder]:
    """Both coders, once a worker."""
    return PlainCoder(a_path), PieceCoder(b_path)


def named(n: int, mark: str) -> np.ndarray:
    """Each id's decimal name behind a mark."""
    return np.array([f"{mark}{i}" for i in range(n)], object)


@lru_cache(maxsize=2)
def names(a: int, b: int) -> tuple[np.ndarray, ...]:
    """Names of ids that follow in their group, or begin their side of it."""
    return named(a, ","), named(a, ";"), named(b, ","), named(b, "|")


class Aligned:
    """Tokens of a run of texts, cut into groups and links. ``ok`` says which texts have tokens.

    ids_a, ids_b: their tokens one after another; ends_a, ends_b: where they end in the bytes of those texts one after
    another. ends: where links end; common: where groups end. link_a, link_b: the two tokens of each link.
    """

    def __init__(self, column: pa.Array, a: PlainCoder, b: PieceCoder):
        n = len(column)
        size = np.diff(utf8(column)[1])
        ids_a, length_a = a.ids(column)
        ids_b, length_b = b.ids(column)
        row_a, row_b = np.repeat(np.arange(n), length_a), np.repeat(np.arange(n), length_b)
        whole = lambda row, ids, width: np.bincount(row, width[ids], n) == size
        self.ok = (size > 1) & whole(row_a, ids_a, a.width) & whole(row_b, ids_b, b.width)
        self.ids_a, self.ids_b = ids_a[self.ok[row_a]], ids_b[self.ok[row_b]]
        self.n_a, self.n_b = np.where(self.ok, length_a, 0), np.where(self.ok, length_b, 0)
        self.ends_a, self.ends_b = np.cumsum(a.width[self.ids_a]), np.cumsum(b.width[self.ids_b])
        both = np.concatenate((self.ends_a, self.ends_b))
        both.sort(kind="stable")  # merges the two sorted lists
        last = np.ones(len(both), bool)
        last[:-1] = both[1:] != both[:-1]
        self.ends, self.common = both[last], both[~last]
        self.link_a, self.link_b = np.searchsorted(self.ends_a, self.ends), np.searchsorted(self.ends_b, self.ends)
        bounds = np.cumsum(size * self.ok)
        self.row = np.searchsorted(bounds, self.ends)
        self.n_links = np.bincount(self.row, minlength=n)
        self.n_groups = np.bincount(np.searchsorted(bounds, self.common), minlength=n)
        self.sizes = len(a.width), len(b.width)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, a's id and b's id in one number) in order, and the number of their links."""
        pair = self.ids_a[self.link_a].astype(np.int64) << 32 | self.ids_b[self.link_b]
        order = np.lexsort((pair, self.row))
        row, pair = self.row[order], pair[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(first)
        return row[at], pair[at], np.diff(np.append(at, len(row)))

    def written(self) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        next_a, first_a, next_b, first_b = names(*self.sizes)
        group_a, group_b = np.searchsorted(self.common, self.ends_a), np.searchsorted(self.common, self.ends_b)
        begins = lambda group: np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
        out = np.empty(len(group_a) + len(group_b), object)
        out[np.arange(len(group_a)) + np.searchsorted(group_b, group_a)] = np.where(begins(group_a), first_a[self.ids_a], next_a[self.ids_a])
        out[np.arange(len(group_b)) + np.searchsorted(group_a, group_b, side="right")] = np.where(begins(group_b), first_b[self.ids_b], next_b[self.ids_b])
        cut = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        return ["".join(out[i:j].tolist())[1:] for i, j in zip(cut[:-1], cut[1:])]


def parts(text: str) -> Iterator[str]:
    """The text behind a blank, in parts of about LONG characters that end where both tokenizers cut."""
    whole, at = f" {text}", 0
    while len(whole) - at > LONG:
        found = BETWEEN.search(whole, at + LONG)
        if not found:
            break
        yield whole[at : found.start()]
        at = found.start()
    yield whole[at:]


def long_row(text: str, a: PlainCoder, b: PieceCoder) -> tuple[list[int], str, np.ndarray, np.ndarray]:
    """Figures, digest of the groups and counted pairs of a long text, part by part."""
    figures, digest, pair, times = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, part in enumerate(parts(text)):
        found = Aligned(pa.array([part], pa.large_string()), a, b)
        if not found.ok[0]:
            return [0, 0, 0, 0], "", pair[:0], times[:0]
        figures += [x[0] for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        digest.update((";" * (i > 0) + found.written()[0]).encode())
        _, own, n = found.pairs()
        pair, where = np.unique(np.concatenate((pair, own)), return_inverse=True)
        times = np.bincount(where, np.concatenate((times, n))).astype(np.int64)
    return figures.tolist(), digest.hexdigest(), pair, times


def aligned_rows(batch: pa.RecordBatch, a: PlainCoder, b: PieceCoder) -> pa.RecordBatch:
    """ALIGNED rows of documents (doc_id, at, text)."""
    text = pc.fill_null(batch.column("text"), "")
    long = pc.greater(pc.utf8_length(text), LONG).to_numpy(zero_copy_only=False)
    short = pc.if_else(pa.array(long), "", text)
    found = Aligned(pc.if_else(pc.equal(short, ""), "", pc.binary_join_element_wise(" ", short, "")), a, b)
    row, pair, times = found.pairs()
    digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found.written()]
    figures = np.stack((found.n_a, found.n_b, found.n_groups, found.n_links))
    if long.any():
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        each = [(pair[i:j], times[i:j]) for i, j in zip(cut[:-1], cut[1:])]
        for i in np.flatnonzero(long).tolist():
            figures[:, i], digests[i], *each[i] = long_row(text[i].as_py(), a, b)
        pair, times = (np.concatenate(x) for x in zip(*each))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x, _ in each])))
    else:
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
    counted = pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(times.astype(np.int32))], names=["pair", "times"])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), batch.column("at"), *[pa.array(x, pa.int64()) for x in figures], pa.array(digests, pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), counted),
        ],
        names=["doc_id", "at", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"],
    )


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and a number of each row."""
    return documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("at", F.monotonically_increasing_id())


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: its number ``at``, figures, the digest of its groups, and its pairs with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coders(a_path, b_path)
        for batch in batches:
            for part in slices(batch):
                yield aligned_rows(part, a, b)
        give_back()

    return numbered(docs).mapInArrow(run, ALIGNED)


def token_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every link as a row: the places and ids of its two tokens, and the number of the group that holds both.

    Places and groups count from 0 in each ``part`` of a text; texts of up to LONG characters have one part, 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coders(a_path, b_path)
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = [Aligned(pa.array([x], pa.large_string()), a, b) for x in parts(text)] if text else []
                for k, x in enumerate(found if all(x.ok[0] for x in found) else ()):
                    n = len(x.ends)
                    columns = [
                        pa.repeat(batch.column(c)[i], n) for c in ("doc_id", "at")
                    ] + [
                        pa.array(np.full(n, k, np.int32)), pa.array(x.link_a), pa.array(x.link_b), pa.array(x.ids_a[x.link_a].astype(np.int32)),
                        pa.array(x.ids_b[x.link_b].astype(np.int32)), pa.array(np.searchsorted(x.common, x.ends)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "part", "a_place", "b_place", "a_id", "b_id", "grouped"])
        give_back()

    return numbered(docs).mapInArrow(run, LINKS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, count, best_a, best_b): links of each pair in all aligned() rows, and whether no pair of its a's, or b's, id has more."""
    counts = rows.select(F.inline("pairs")).groupBy("pair").agg(F.sum("times").alias("count"))
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b_id"), "count")
    counts = materialize(counts, "pair-counts")
    most = lambda c: counts.groupBy(c).agg(F.max("count").alias(f"most_{c}"))
    both = counts.join(most("a_id"), "a_id").join(most("b_id"), "b_id")
    best = lambda c: (F.col("count") == F.col(f"most_{c}"))
    return both.select("pair", "a_id", "b_id", "count", best("a_id").alias("best_a"), best("b_id").alias("best_b"))


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(at, n_best, n_best_a, count_sum) of aligned() rows that have links, from pair_counts()."""
    known = materialize(counts.select("pair", "count", "best_a", "best_b"), "known")
    n, total = known.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    pairs = rows.select("at", F.inline("pairs"))
    least = total / HEAVY
    n_heavy = n if small(known, n) is not known else known.where(F.col("count") >= least).count()  # HEAVY at most
    if n_heavy == n:
        met = pairs.join(small(known, n), "pair")
    else:
        heavy = small(known.where(F.col("count") >= least), n_heavy)
        met = pairs.join(heavy, "pair").unionByName(pairs.join(heavy, "pair", "left_anti").join(known.where(F.col("count") < least), "pair"))
    links = lambda flag: F.sum(F.when(F.col(flag), F.col("times")).otherwise(0))
    return met.groupBy("at").agg(
        links("best_b").alias("n_best"), links("best_a").alias("n_best_a"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )


def alignment_table(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_a, count_sum, groups_sha256 of every document.

    a_path is a byte-level BPE of the tokenizers library, which encodes the text behind a blank; b_path a sentencepiece
    model, which adds that blank. A null or empty text, or one that the joined bytes of either side's tokens don't give
    back (such as one with U+2581), has no tokens: zeros and an empty digest; its tokens count nowhere. n_best has the
    links whose pair no other pair of its b's id exceeds in the corpus, ties included, n_best_a the same for a's id. Null
    doc_ids and repeated rows are rows like others, and each counts. An empty table gives an empty result; further
    columns are left out.
    """
    rows = materialize(aligned(docs, a_path, b_path), "aligned")
    sums = with_counts(rows, pair_counts(rows))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs").join(sums, "at", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("n_best_a"), none("count_sum"), "groups_sha256"
    )
