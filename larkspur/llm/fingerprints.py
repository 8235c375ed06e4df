"""Document fingerprints from prefix polynomial hashes.

Of a text's code points c the prefix array H[i] = sum of (c[j] + 1) * B^j for j < i, modulo a prime, gives the hash of
any span as (H[r] - H[l]) * B^-l: equal spans have equal hashes, so span equality is one comparison and the longest
common extension of two places a binary search. Two primes are used side by side.

A fingerprint has the number of code points, the hash of the whole text, and for each of 64 bins the least hash of the
spans of SPAN code points that fall into it. The likeness of two fingerprints is the share of bins that agree among
those that either fills: an estimate of the Jaccard similarity of the two texts' spans.

Documents are dealt by ranges of doc_id; each task walks its range in order and sees a document's successor next. Only
the first and last document of each task meet in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import give_back, in_order, materialize, slices

PRIMES = (2147483629, 2147483587)
BASES = (1103515245, 1299709187)
SPAN = 12
BINS = 64
EMPTY = 0xFFFF
NONE = np.uint64((1 << 64) - 1)
#: Bytes of texts that are hashed together.
SLICE = 128 << 10
#: Code points of a run: a longer text is hashed run by run, since prefix arrays take some hundred bytes a code point.
RUN = 1 << 16
DIGEST = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, kept_prefix long"
)
WALKED = "part int, first_text string, last_text string, " + DIGEST

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1), at least, modulo prime."""
    have = _powers.get((base, prime))
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), prime))
        have = np.concatenate((have, have * step % np.uint64(prime)))
    _powers[(base, prime)] = have
    return have


class Prefixes:
    """Prefix arrays of some texts, one after another."""

    def __init__(self, texts: list[str]):
        raw = "".join(texts).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, np.uint32).astype(np.uint64) + np.uint64(1)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.length) - self.length
        self.place = np.arange(len(codes)) - np.repeat(self.start, self.length)
        longest = int(self.length.max(initial=0)) + 1
        self.inverse, self.sums = [], []
        for base, prime in zip(BASES, PRIMES):
            power = powers(base, prime, longest)[self.place]
            self.inverse.append(powers(pow(base, -1, prime), prime, longest))
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * power % np.uint64(prime)))))

    def spans(self, text: np.ndarray, left: np.ndarray, right: np.ndarray, k: int = 0) -> np.ndarray:
        """Hashes modulo prime k of the spans [left, right) of the texts of these indices."""
        prime, at = np.uint64(PRIMES[k]), self.start[text]
        value = (self.sums[k][at + right] - self.sums[k][at + left]) % prime
        return value * self.inverse[k][left] % prime

    def equal(self, text, left, other: Prefixes, other_text, other_left, size) -> np.ndarray:
        """Whether spans of the given sizes are equal."""
        out = np.ones(len(size), bool)
        for k in range(len(PRIMES)):
            out &= self.spans(text, left, left + size, k) == other.spans(other_text, other_left, other_left + size, k)
        return out

    def common_extension(self, text, left, other: Prefixes, other_text, other_left) -> np.ndarray:
        """Sizes of the longest equal spans that start at the given places, by binary search."""
        low = np.zeros(len(text), np.int64)
        high = np.minimum(self.length[text] - left, other.length[other_text] - other_left)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(text, left, other, other_text, other_left, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def least(self) -> np.ndarray:
        """A row for each text with the least hash of the spans that fall into each of BINS bins; NONE where none does."""
        n = len(self.length)
        size = np.minimum(SPAN, self.length)
        room = np.repeat(self.length - size, self.length)
        text = np.repeat(np.arange(n), self.length)
        keep = np.flatnonzero(self.place <= room)
        text, left = text[keep], self.place[keep]
        value = self.spans(text, left, left + size[text]) + np.uint64(1)
        value ^= value << np.uint64(31)
        value *= np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        bins = (value >> np.uint64(58)).astype(np.int64)
        out = np.full(n * BINS, NONE, np.uint64)
        np.minimum.at(out, text * BINS + bins, value)
        return out.reshape(n, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing bins among those that either sketch fills; 1 if both are empty."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    return np.where(filled > 0, same / np.maximum(filled, 1), 1.0)


def strings(length: np.ndarray, whole: np.ndarray, sketches: np.ndarray) -> list[str]:
    """Fingerprints as text: code points, hash of the whole, sketch, in hexadecimal."""
    raw = np.ascontiguousarray(sketches.astype(">u2")).tobytes()
    width = 2 * BINS
    return [
        f"{n:x}-{a:08x}{b:08x}-{raw[i * width:(i + 1) * width].hex()}"
        for i, (n, (a, b)) in enumerate(zip(length.tolist(), whole.tolist()))
    ]


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, hashes of the wholes, and sketches (16 bits of each bin's least hash; EMPTY where no span falls into it).

    A long text is cut into runs that overlap by a span but one. A span's hash doesn't depend on its place, so the least
    ones are those of the whole; the whole's hash is the sum of the runs' by the power of their places.
    """
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    least, whole = np.full((len(texts), BINS), NONE, np.uint64), np.zeros((len(texts), len(PRIMES)), np.uint64)

    def take(parts: list[tuple[int, int]]) -> None:
        rows = np.array([i for i, _ in parts])
        prefixes = Prefixes([texts[i][at : at + RUN + SPAN - 1] for i, at in parts])
        own = prefixes.least()
        # The last run of a cut text may have no room for a span, and then none starts in it.
        own[(length[rows] >= SPAN) & (prefixes.length < SPAN)] = NONE
        np.minimum.at(least, rows, own)
        size = np.minimum(prefixes.length, RUN)
        for k, (base, prime) in enumerate(zip(BASES, PRIMES)):
            value = prefixes.spans(np.arange(len(parts)), np.zeros(len(parts), np.int64), size, k)
            place = np.array([pow(base, at, prime) for _, at in parts], np.uint64)
            np.add.at(whole[:, k], rows, value * place % np.uint64(prime))

    waiting: list[tuple[int, int]] = []
    size = 0
    for i, n in enumerate(length.tolist()):
        for at in range(0, max(n, 1), RUN):
            waiting.append((i, at))
            size += min(n - at, RUN)
            if size > 2 * RUN:
                take(waiting)
                waiting, size = [], 0
    if waiting:
        take(waiting)
    sketches = np.minimum(least & np.uint64(0xFFFF), np.uint64(EMPTY - 1)).astype(np.uint16)
    sketches[least == NONE] = EMPTY
    return length, whole % np.array(PRIMES, np.uint64), sketches


def fingerprint_batch(texts: list[str]) -> list[str]:
    """Fingerprints of texts."""
    return strings(*hashed(texts))


def common_starts(texts: list[str], others: list[str]) -> np.ndarray:
    """The longest common extension of each text and its other from their starts, run by run."""
    out = np.zeros(len(texts), np.int64)
    left, at = np.arange(len(texts)), 0
    while len(left):
        for k in range(0, len(left), 64):
            own, other = (Prefixes([x[i][at : at + RUN] for i in left[k : k + 64]]) for x in (texts, others))
            rows = np.arange(len(own.length))
            out[left[k : k + 64]] += own.common_extension(rows, np.zeros_like(rows), other, rows, np.zeros_like(rows))
        at += RUN
        left = left[out[left] == at]
    return out


def edited(text: str, after: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the other's."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def digests(ids: list, texts: list[str]) -> pa.RecordBatch:
    """DIGEST rows of all but the last text, each followed by the next."""
    n = len(texts) - 1
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    (length, own, own_sketch), (new_length, new, new_sketch) = hashed(texts), hashed(changed)
    columns = [
        pa.array(ids[:n], pa.int64()), pa.array(length[:n]),
        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed], pa.string()),
        pa.array(strings(length[:n], own, own_sketch), pa.string()), pa.array(strings(new_length, new, new_sketch), pa.string()),
        pa.array(likeness(own_sketch[:n], new_sketch)), pa.array(likeness(own_sketch[:n], own_sketch[1:])),
        pa.array(common_starts(texts[:n], changed)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in DIGEST.split(", ")])


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WALKED rows of a task's documents in order: digests, then the first text, and the last document as a whole."""
    part = TaskContext.get().partitionId()
    first, held_id, held_text = None, None, None

    def rows(made: pa.RecordBatch, first_text, last_text) -> pa.RecordBatch:
        n = made.num_rows
        head = [pa.array([part] * n, pa.int32()), pa.array(first_text, pa.string()), pa.array(last_text, pa.string())]
        return pa.RecordBatch.from_arrays(head + made.columns, names=["part", "first_text", "last_text", *made.schema.names])

    for batch in batches:
        for some in slices(batch, most=SLICE):
            ids = some.column("doc_id").to_pylist()
            texts = [x or "" for x in some.column("text").to_pylist()]
            if first is None:
                first = texts[0]
            else:
                ids, texts = [held_id, *ids], [held_text, *texts]
            held_id, held_text = ids[-1], texts[-1]
            if len(texts) > 1:
                made = digests(ids, texts)
                yield rows(made, [None] * made.num_rows, [None] * made.num_rows)
    if first is not None:
        made = digests([held_id], [held_text, ""])
        yield rows(made, [first], [held_text])
    give_back()


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, which ends as the next document by doc_id begins.

    A null text counts as empty: 0 code points, the fingerprint of an empty text. Null doc_ids come first, equal ones
    follow in the order of their texts' MD5; after the last document comes the first, which of a single document is itself.
    An empty table gives an empty result; further columns are left out. ``kept_prefix`` is the longest common
    extension of the text and its edited text from their starts.
    """
    walked = materialize(in_order(docs).mapInArrow(walk, WALKED), "fingerprints")
    names = [f.split()[0] for f in DIGEST.split(", ")]
    done = walked.where("last_text is null").select(names)
    # One row a task from here on.
    ends = walked.where("last_text is not null")
    parts = ends.select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    links = parts.select("part", following.alias("next_part"))
    heads = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"))
    last = ends.select("part", "doc_id", "last_text").join(links, "part").join(heads, "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield digests([row["doc_id"]], [row["last_text"], row["next_text"]])

    return done.unionByName(last.select("doc_id", "last_text", "next_text").mapInArrow(close, DIGEST))
