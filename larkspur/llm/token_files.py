"""Token files: ids packed with Simple-8b words, and their reading back.

File format. A file set is a folder of Parquet files whose rows are segments; a segment holds the ids of a run of
documents in ascending doc_id order. Ids are cut into blocks of ``BLOCK`` values. Within a block each 64-bit little-
endian word has a selector in its upper 4 bits and as many equally wide values as the selector says in the lower 60;
selector 0 is an escape for one value of over 60 bits, which takes the next word whole. ``block_words`` has the first
word of each block, so that blocks, or all of them at once, are decoded on their own.

Documents are dealt by ranges of doc_id, so each task writes its own part in order; the only figures summed across
tasks are one count for each part and segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import give_back, in_order, slices, utf8
from larkspur.storage import new_folder

BLOCK = 128
#: Bytes of text in a segment.
SEGMENT_BYTES = 1 << 20
END_ID = 2

# Simple-8b's (values in a word, bits of each) by selector 1 to 14; selector 0 is the escape.
PACKS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)

#: Chunks and ids that a worker remembers before it starts anew, and the bits of the table of short ones.
MEMORY = 400_000
POOL = 4_000_000
SLOT_BITS = 20
#: Bytes of the longest chunk that the table holds, and of the longest one that is remembered at all.
SHORT = 16
LONGEST = 48
#: Chunks that are looked up together, and new ones that go to the tokenizer as one text.
CHUNKS = 1 << 18
TOGETHER = 400
#: Bytes that are cut together.
PIECE = 1 << 20

# ASCII's white space, and white space beyond it (with control characters that some patterns count as such).
SPACE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(6)
KIND = np.full(256, MARK, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]], KIND[ord("'")], KIND[128:] = SPACE, APOSTROPHE, OTHER
KIND[65:91] = KIND[97:123] = LETTER
KIND[48:58] = DIGIT
#: Between which kinds the pattern always cuts.
CUT = np.zeros((6, 6), bool)
CUT[LETTER, [DIGIT, MARK, APOSTROPHE]] = CUT[DIGIT, [LETTER, MARK, APOSTROPHE]] = CUT[MARK, [LETTER, DIGIT]] = True
OTHER_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
#: Masks of the first 0 to 8 bytes of a little-endian word.
KEPT_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

SEGMENTS = (
    "part int, segment int, doc_ids array<bigint>, lengths array<int>, n_ids bigint, words binary, block_words binary"
)
READ = "part int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


#: For each value below 2^16 the first selector less one, from the narrowest on, that is wide enough.
NARROWEST = np.searchsorted(np.array([1 << bits for _, bits in PACKS]), np.arange(1 << 16), side="right").astype(np.uint8)


def selectors(narrowest: np.ndarray) -> np.ndarray:
    """For each place of each block the selector that takes most of the values from there on; 0 is the escape.

    The widest of the next c values comes from the widest of runs of 1, 2, 4, ... values.
    """
    runs, size = {1: narrowest}, 1
    while size < 32:
        now = runs[size]
        runs[2 * size] = np.maximum(now[:, : now.shape[1] - size], now[:, size:])
        size *= 2
    best = np.zeros((len(narrowest), BLOCK), np.uint8)
    open_ = np.ones(best.shape, bool)
    top = int(narrowest.max())
    for s, (count, _) in enumerate(PACKS, 1):
        if s > top:
            fits = open_
        else:
            size = 1 << (count.bit_length() - 1)
            run = runs[min(size, 32)]
            back = count - min(size, 32)
            fits = open_ & (run[:, :BLOCK] < s) & (run[:, back : back + BLOCK] < s)
        best[fits] = s
        open_ &= ~fits
        if not open_.any():
            break
    return best


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values, and the first word of each block."""
    values = values.astype(np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    padded = np.zeros((blocks, BLOCK + 64), np.uint64)  # zeros beyond a block's end fit any selector
    padded[:, :BLOCK].flat[:n] = values
    if int(values.max()) < len(NARROWEST):
        narrowest = NARROWEST[padded.astype(np.uint16)]
    else:
        narrowest = np.searchsorted(np.array([1 << bits for _, bits in PACKS], np.uint64), padded, side="right").astype(np.uint8)
    best = selectors(narrowest)
    counts = np.array([1, *(c for c, _ in PACKS)])
    at, row = np.zeros(blocks, np.int64), np.arange(blocks)
    end = np.full(blocks, BLOCK)
    end[-1] = n - (blocks - 1) * BLOCK
    # All blocks go on by one word a round; an escape takes two words.
    offset = np.zeros(blocks, np.int64)
    picked: list[tuple[np.ndarray, ...]] = []
    while len(row):
        selector = best[row, at]
        picked.append((row, at, selector, offset[row]))
        offset[row] += 1 + (selector == 0)
        at = at + counts[selector]
        on = at < end[row]
        row, at = row[on], at[on]
    row, at, selector, place = (np.concatenate(x) for x in zip(*picked))
    first = np.cumsum(offset) - offset
    place = place + first[row]
    words = np.zeros(int(offset.sum()), np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == 0:
            words[place[mine] + 1] = padded[row[mine], at[mine]]
            continue
        count, bits = PACKS[s - 1]
        cell = row[mine] * padded.shape[1] + at[mine]
        word = np.full(len(mine), np.uint64(s) << np.uint64(60))
        for i in range(count):
            word |= padded.ravel()[cell + i] << np.uint64(i * bits)
        words[place[mine]] = word
    return words, first.astype(np.uint32)


def unpack(words: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """The n values of all blocks, decoded together."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0):
        if not raw[i]:
            raw[i + 1] = True
    counts = np.where(raw, 0, np.array([1, *(c for c, _ in PACKS), 0])[np.minimum(selector, 15)])
    before = np.cumsum(counts) - counts
    first = block_words.astype(np.int64)
    block = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    inside = before - before[first][block]
    start = block * BLOCK + inside
    end = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selector[~raw]):
        mine = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[start[mine]] = words[mine + 1]
            continue
        count, bits = PACKS[s - 1]
        mask = np.uint64((1 << bits) - 1)
        for i in range(count):
            ok = start[mine] + i < end[mine]
            out[start[mine][ok] + i] = (words[mine][ok] >> np.uint64(i * bits)) & mask
    return out


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The KIND of each byte; letters of two bytes in Latin-1 count as LETTER."""
    kind = KIND[data]
    first = np.flatnonzero(data[:-1] == 0xC3)
    first = first[(data[first + 1] != 0x97) & (data[first + 1] != 0xB7)]
    kind[first] = kind[first + 1] = LETTER
    return kind


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of texts (UTF-8 bytes one after another) start.

    The library's pattern cuts a text at these places whatever else the text holds, so chunks are encoded on their own: a
    run of characters other than white space with the blank before it; the white space before that blank; white space
    other than a blank that comes right before such a run, by itself; and white space that ends a text. Runs are cut on
    where letters, digits and marks meet, but not behind an apostrophe, as it may belong to a contraction.
    """
    starts = []
    for low in range(0, len(data), PIECE):
        # Two bytes before the piece, so that a letter of two bytes is seen whole, and one behind it.
        skip = min(low, 2)
        part = data[low - skip : low + PIECE + 2]
        kind = kinds_of(part)
        blank = kind == SPACE
        edges = offsets[np.searchsorted(offsets, low - skip) :]
        edges = edges[: np.searchsorted(edges, low - skip + len(part))] - (low - skip)
        edge = np.zeros(len(part), bool)
        edge[edges] = True
        after_blank = np.zeros(len(part), bool)
        after_blank[1:] = blank[:-1]
        after_blank &= ~edge
        begins = edge | (blank & ~after_blank)
        word = after_blank & ~blank
        begins[:-1] |= word[1:]
        begins[1:] |= word[1:] & (part[:-1] != 32)
        begins[1:] |= CUT[kind[:-1], kind[1:]]
        starts.append(np.flatnonzero(begins[skip : skip + PIECE]) + low)
    return np.concatenate(starts) if starts else np.zeros(0, np.int64)


class ChunkTable:
    """Which ids chunks have: an open-addressing table over the bytes of short chunks, a dictionary for long ones.

    Equal entries are equal in all bytes: a short chunk is held as two 64-bit words and its size.
    """

    def __init__(self):
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.low, self.high = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.size = np.zeros(1024, np.uint8)
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.n = 0
        self.long: dict[bytes, int] = {}
        self.pool = np.zeros(4096, "<u4")
        self.used = 0

    def full(self) -> bool:
        return self.n > MEMORY or self.used > POOL

    def append(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of new entries with these ids."""
        n, m = self.n + len(counts), self.used + len(ids)
        while n > len(self.first):
            for name in ("low", "high", "size", "first", "count"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros_like(old))))
        while m > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : m] = ids
        self.first[self.n : n] = self.used + np.cumsum(counts) - counts
        self.count[self.n : n] = counts
        made = np.arange(self.n, n)
        self.n, self.used = n, m
        return made

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Entries of short chunks; -1 where there is none."""
        entry = self.slots[slot]
        hit = (self.low[entry] == low) & (self.high[entry] == high) & (self.size[entry] == size) & (entry >= 0)
        out = np.where(hit, entry, -1)
        todo = np.flatnonzero((entry >= 0) & ~hit)
        at = slot[todo]
        while len(todo):
            at = (at + 1) & (len(self.slots) - 1)
            entry = self.slots[at]
            hit = (self.low[entry] == low[todo]) & (self.high[entry] == high[todo]) & (self.size[entry] == size[todo]) & (entry >= 0)
            out[todo[hit]] = entry[hit]
            on = (entry >= 0) & ~hit
            todo, at = todo[on], at[on]
        return out

    def put(self, made: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, slot: np.ndarray) -> None:
        """Names distinct new entries by short chunks."""
        self.low[made], self.high[made], self.size[made] = low, high, size
        at, left = slot, made
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            taken, first = np.unique(at[free], return_index=True)
            self.slots[taken] = left[free[first]]
            on = np.ones(len(left), bool)
            on[free[first]] = False
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)


class Coder:
    """Encodes with the tokenizers library; chunks that it has seen are looked up, all those of a batch together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings of added tokens, which the library looks for before it splits: a text that holds one isn't cut.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of each id: a token's name has one character for each of its bytes.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.width[np.fromiter(vocabulary.values(), np.int64)] = np.fromiter(map(len, vocabulary), np.int64)
        #: The character that stands for each byte in the names of tokens.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.names = np.zeros(256, "<u4")
        self.names[shown] = shown
        self.names[np.setdiff1d(np.arange(256), shown)] = np.arange(256, 256 + 256 - len(shown))
        self.table = ChunkTable()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def uncut(self, column: pa.Array) -> np.ndarray:
        """Which texts the library gets whole: those with added tokens or white space beyond ASCII, across which it looks."""
        out = pc.match_substring_regex(column, OTHER_SPACE)
        for x in self.added:
            out = pc.or_(out, pc.match_substring(column, x))
        return out.to_numpy(zero_copy_only=False)

    def learn(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of data one after another, and how many each has.

        Chunks of one kind of characters, which the pattern doesn't cut, go to the library's model. Others go through all
        of the library, many at a time with a newline between them, at which it always cuts, and are told apart by the
        bytes of their ids. White space by itself goes alone.
        """
        size = stops - starts
        count = np.zeros(len(starts), np.int64)
        # The byte behind each chunk is there, and becomes a newline.
        joined = data[spread(starts, size + 1)]
        stop = np.cumsum(size + 1) - 1
        begin = stop - size
        joined[stop] = 10
        kind = kinds_of(joined)
        kind[begin[joined[begin] == 32]] = SPACE
        last = kind[stop - 1]
        same = (kind == np.repeat(last, size + 1)).astype(np.int64)
        same = np.add.reduceat(same, begin) if len(begin) else same
        blank = (joined[begin] == 32) & (size > 1)
        single = (last >= LETTER) & (last <= MARK) & (same + blank == size)
        names = self.names[joined].tobytes().decode("utf-32-le")
        tokenize = self.tokenizer.model.tokenize
        plain, found = np.flatnonzero(single), []
        for i, j in zip(begin[plain].tolist(), stop[plain].tolist()):
            found.append([x.id for x in tokenize(names[i:j])])
        count[plain] = np.fromiter(map(len, found), np.int64, len(found))
        alone = np.flatnonzero(last == SPACE)
        spaces = self.whole([joined[a:b].tobytes().decode() for a, b in zip(begin[alone].tolist(), stop[alone].tolist())]) if len(alone) else []
        count[alone] = np.fromiter(map(len, spaces), np.int64, len(spaces))
        rest = np.flatnonzero(~single & (last != SPACE))
        groups = [rest[k : k + TOGETHER] for k in range(0, len(rest), TOGETHER)]
        texts = [joined[spread(begin[g], size[g] + 1)].tobytes().decode() for g in groups]
        parts = []
        for g, ids in zip(groups, self.whole(texts) if texts else ()):
            total, own = np.cumsum(self.width[ids]), np.cumsum(size[g] + 1) - 1
            a, b = np.searchsorted(total, own - size[g], side="right"), np.searchsorted(total, own, side="right")
            count[g] = b - a
            parts.append(ids[spread(a, b - a)])
        out = np.empty(int(count.sum()), "<u4")
        place = np.cumsum(count) - count
        for where, ids in (
            (plain, np.fromiter(chain.from_iterable(found), "<u4")),
            (alone, np.concatenate([np.zeros(0, "<u4"), *spaces])), (rest, np.concatenate([np.zeros(0, "<u4"), *parts])),
        ):
            out[spread(place[where], count[where])] = ids
        return out, count

    def look_up(self, data: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and how many each has. data has 16 bytes more than raw."""
        if self.table.full():
            self.table = ChunkTable()
        table = self.table
        size = stops - starts
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        low = words[starts] & KEPT_BYTES[np.minimum(size, 8)]
        high = words[starts + 8] & KEPT_BYTES[np.clip(size - 8, 0, 8)]
        hashed = (low ^ (high * np.uint64(0xD6E8FEB86659FD93)) ^ (size.astype(np.uint64) << np.uint64(56))) * np.uint64(0x9E3779B97F4A7C15)
        hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        slot = (hashed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        entry = table.find(low, high, size, slot)
        # Long chunks might agree with a short one in their first bytes, but never in size.
        long = np.flatnonzero(size > SHORT)
        if len(long):
            texts = [raw[a:b] for a, b in zip(starts[long].tolist(), stops[long].tolist())]
            new = {x: i for x, i in zip(texts, long.tolist()) if x not in table.long}
            where = np.fromiter(new.values(), np.int64, len(new))
            once = dict(zip(new, table.append(*self.learn(data, starts[where], stops[where])).tolist()))
            entry[long] = [once[x] if x in once else table.long[x] for x in texts]
            table.long.update((x, i) for x, i in once.items() if len(x) <= LONGEST)
        missing = np.flatnonzero(entry < 0)
        while len(missing):
            _, first = np.unique(hashed[missing], return_index=True)
            some = missing[first]
            made = table.append(*self.learn(data, starts[some], stops[some]))
            table.put(made, low[some], high[some], size[some], slot[some])
            entry[missing] = table.find(low[missing], high[missing], size[missing], slot[missing])
            missing = missing[entry[missing] < 0]  # another chunk of the same hash
        count = table.count[entry]
        return table.pool[spread(table.first[entry], count)], count

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with end_id behind it, and how many each has. Nulls are empty."""
        column = pc.fill_null(column, "")
        uncut = self.uncut(column)
        alone = self.whole(column.filter(pa.array(uncut)).to_pylist()) if uncut.any() else []
        data, offsets = utf8(pc.if_else(pa.array(uncut), "", column) if len(alone) else column)
        raw = data.tobytes()
        data = np.concatenate((data, np.zeros(16, np.uint8)))
        starts = chunk_starts(data[: len(raw)], offsets)
        stops = np.append(starts[1:], len(raw))
        found = [self.look_up(data, raw, starts[k : k + CHUNKS], stops[k : k + CHUNKS]) for k in range(0, len(starts), CHUNKS)]
        ids = np.concatenate([x for x, _ in found]) if found else np.zeros(0, "<u4")
        total = np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in found])))) if found else np.zeros(1, np.int64)
        cut = total[np.searchsorted(starts, offsets)]
        own = np.diff(cut)
        length = own + 1
        length[uncut] += np.fromiter(map(len, alone), np.int64, len(alone))
        first = np.cumsum(length) - length
        out = np.empty(int(length.sum()), "<u4")
        out[spread(first, own)] = ids
        out[first + length - 1] = end_id
        for i, x in zip(np.flatnonzero(uncut).tolist(), alone):
            out[first[i] : first[i] + len(x)] = x
        return out, length


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of each i, count[i] of them."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One coder a worker and vocabulary."""
    return Coder(path)


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> None:
    """Encodes all texts in ascending doc_id order (nulls first, ties by the text's MD5), appends end_id to each and writes them.

    path is a tokenizer file that every executor can open; folder is one that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        own = coder(path)
        for batch in batches:
            for some in slices(batch, most=SEGMENT_BYTES):
                ids, length = own.encode(some.column("text"), end_id)
                words, first = pack(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()), pa.array([segment], pa.int32()),
                        pa.array([some.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([length.tolist()], pa.list_(pa.int32())), pa.array([len(ids)], pa.int64()),
                        pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([first.astype("<u4").tobytes()], pa.binary()),
                    ],
                    names=["part", "segment", "doc_ids", "lengths", "n_ids", "words", "block_words"],
                )
                segment += 1
        give_back()

    in_order(docs).mapInArrow(run, SEGMENTS).write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def decode_segment(row: dict) -> list[np.ndarray]:
    """The ids of each document of a segment."""
    words, first = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_words"], "<u4")
    return np.split(unpack(words, first, row["n_ids"]).astype("<u4"), np.cumsum(row["lengths"])[:-1])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs = decode_segment(row)
                length = np.array(row["lengths"], np.int64)
                n = len(length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["segment"], np.int32)),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(np.cumsum(length) - length), pa.array(length),
                        pa.array([zlib.crc32(x.tobytes()) for x in docs], pa.int64()),
                    ],
                    names=["part", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.schema(SEGMENTS).parquet(folder)
    sizes = segments.groupBy("part", "segment").agg(F.sum("n_ids").alias("n_ids"))
    in_part = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # One row a part: as many as the tasks that wrote.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    starts = (
        sizes.withColumn("segment_start", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)))
        .join(parts, "part")
        .select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("first_id"))
    )
    read = segments.mapInArrow(run, READ)
    return read.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("first_id") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_table(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes token files into the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty: its end id alone. Null doc_ids come first; repeated rows follow one another, each with
    its own start. An empty table gives an empty result; further columns are left out.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    write_token_files(docs, path, folder, end_id)
    return read_token_files(spark, folder)
