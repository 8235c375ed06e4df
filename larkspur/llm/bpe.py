"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

A text is cut by the pre-tokenizer's pattern; each distinct piece is encoded once. Pieces of similar length form a
padded matrix with one piece a row. In each round every row merges its leftmost pair of least rank; ranks come from an
open-addressing hash table of pairs; rows are compacted after a merge and leave once no pair of theirs has a rank.
Pieces beyond the longest bucket take an exact heap of pairs instead, as a round a merge would be quadratic there.

Each worker keeps a bounded memory of pieces that it has encoded. Documents never shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import documents, map_arrow

#: Bytes of the longest piece that is encoded in a matrix; rows of each bucket are padded to the next of these.
BUCKETS = (2, 4, 8, 16, 32, 64, 128, 256)
#: Cells of one matrix.
CELLS = 1 << 19
#: Chunks that a worker remembers before it starts anew, and the longest chunk that it remembers.
MEMORY = 120_000
MEMORY_CHARS = 64
NONE = np.int64(1) << 40
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Rank of the merge of two adjacent tokens, by open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int64)
        left_keys, left_values = np.array(keys, np.int64), np.array(values, np.int64)
        at = self.slot(left_keys)
        while len(left_keys):
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]] = left_keys[first], left_values[first]
            rest = np.ones(len(at), bool)
            rest[first] = False
            left_keys, left_values, at = left_keys[rest], left_values[rest], (at[rest] + 1) % size

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't merge or one side is padding (-1)."""
        out = np.full(left.shape, NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[todo] << 32) | right.ravel()[todo]
        at = self.slot(keys)
        flat = out.ravel()
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            flat[todo[hit]] = self.values[at[hit]]
            on = (found >= 0) & ~hit
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Encoder:
    """Encodes and decodes with one vocabulary and one pre-tokenizer pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.whole = ranks
        self.pairs = PairTable(ranks)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pieces = regex.compile(pattern).findall
        #: A blank after white space: there the pattern looks across blanks, so the text can't be cut at them.
        self.joined = re.compile(r"\s ").search
        self.memory: dict[str, tuple[str, int]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        by_bucket: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.whole.get(piece)
            if rank is not None:
                out[i] = [rank]
            elif len(piece) > BUCKETS[-1]:
                out[i] = self.encode_long(piece)
            elif piece:
                by_bucket.setdefault(next(b for b in BUCKETS if len(piece) <= b), []).append(i)
        for width, rows in by_bucket.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self.encode_matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def encode_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of at most ``width`` bytes, merged round by round."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, pieces), np.int64, n)
        cells = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], -1)
        done: list[list[int]] = [[]] * n
        row = np.arange(n)
        ranks = self.pairs.ranks(cells[:, :-1], cells[:, 1:])
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            best = ranks[here, at]
            over = best == NONE
            if over.any():
                for i, ids, k in zip(row[over].tolist(), cells[over].tolist(), length[over].tolist()):
                    done[i] = ids[:k]
                on = ~over
                row, cells, length, ranks, at, best = row[on], cells[on], length[on], ranks[on], at[on], best[on]
                if not len(row):
                    break
                most = int(length.max())
                cells, ranks = cells[:, :most], ranks[:, : most - 1]
                here = np.arange(len(row))
            w = cells.shape[1]
            columns = np.arange(w)
            source = np.minimum(columns + (columns > at[:, None]), w - 1)
            cells = np.take_along_axis(cells, source, 1)
            length = length - 1
            cells[here, at] = best
            cells[columns >= length[:, None]] = -1
            if w < 2:
                ranks = np.full((len(row), 1), NONE)
                continue
            source = np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), w - 2)
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[columns[1:] >= length[:, None]] = NONE
            for shift in (-1, 0):
                i = at + shift
                ok = np.flatnonzero((i >= 0) & (i < w - 1))
                ranks[ok, i[ok]] = self.pairs.ranks(cells[ok, i[ok]], cells[ok, i[ok] + 1])
        return done

    def encode_long(self, piece: bytes) -> list[int]:
        """Ids of a long piece: the leftmost pair of least rank comes off a heap, stale entries are passed over."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        first = self.pairs.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    r = int(self.pairs.ranks(np.array([ids[a]]), np.array([ids[b]]))[0])
                    if r < NONE:
                        heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def chunks(self, text: str) -> list[str]:
        """Parts of the text that the pattern cuts one by one as it cuts the whole: each begins with its blank."""
        if self.joined(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def encode(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """For each text its chunks as (ids joined by commas, number of ids, bytes of the decoded ids)."""
        cut = [self.chunks(text) for text in texts]
        if len(self.memory) > MEMORY:
            self.memory.clear()
        new = list(set().union(*cut).difference(self.memory))
        pieces = [self.pieces(chunk) for chunk in new]
        distinct = list({p for some in pieces for p in some})
        ids = dict(zip(distinct, self.encode_pieces([p.encode("utf-8", "replace") for p in distinct])))
        known = self.memory
        once: dict[str, tuple[str, int, bytes]] = {}
        for chunk, some in zip(new, pieces):
            own = [i for p in some for i in ids[p]]
            (known if len(chunk) <= MEMORY_CHARS else once)[chunk] = (",".join(map(str, own)), len(own), self.decode(own))
        if once:
            return [[once.get(c) or known[c] for c in some] for some in cut]
        get = known.__getitem__
        return [list(map(get, some)) for some in cut]

    def encode_ids(self, text: str) -> list[int]:
        """Ids of one text."""
        return [int(i) for joined, n, _ in self.encode([text])[0] if n for i in joined.split(",")]

    def decode(self, ids) -> bytes:
        """Bytes of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(read_ranks(path), pattern)


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: number of ids, SHA-256 of the ids in decimals with commas, SHA-256 of the decoded bytes.

    path is a vocabulary file that every executor can open (it comes with the installed package). A null text counts
    as empty: 0 ids, digests of no bytes. Repeated rows each give a row; further columns of docs are left out.
    """

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(path, pattern)
        n, ids, decoded = [], [], []
        for some in coder.encode([x or "" for x in part.column("text").to_pylist()]):
            some = [x for x in some if x[1]]
            n.append(sum(x[1] for x in some))
            joined = ",".join([x[0] for x in some])
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join([x[2] for x in some])).hexdigest())
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_arrow(documents(docs), one, SCHEMA)


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and its ids as an array of ints; a null text has an empty array."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(path, pattern)
        texts = [x or "" for x in part.column("text").to_pylist()]
        ids = [[int(i) for joined, n, _ in some if n for i in joined.split(",")] for some in coder.encode(texts)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(documents(docs), one, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded text of ``ids``; bytes that aren't UTF-8 become U+FFFD, a null array an empty text."""

    def run(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            texts = [coder.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
