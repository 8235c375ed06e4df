"""Counts of n-grams from packed runs of words: what the tasks of kb.ngram_counts() do, Arrow batch by batch.

A record is a run of words with the number of its places (starts of n-grams), the shortest n-gram that is counted at them and how often
the run was there. A place counts all lengths from that one to the run's end or the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words that are packed, unpacked or returned at once, about.
SPAN_BYTES = 8_000_000
#: Places that a task holds before it sums equal ones.
MOST_PLACES = 1_500_000
#: A word is looked at as a frequent one if it is one in so many words of a span.
FLOOR = 16_384
CODEC = pa.Codec("zstd", compression_level=1)
BLANK = 32
#: Whether a byte is white space as the JVM's patterns take it.
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The first columns of batches, joined to spans."""
    held, size = [], 0
    for batch in filter(len, batches):
        held.append(batch.column(0))
        size += batch.nbytes
        if size >= SPAN_BYTES:
            yield pa.concat_arrays(held)
            held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, each with a blank behind it, and how many each text has."""
    whole = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.binary()), b""), b"", b" ")
    offsets = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1)
    data = np.frombuffer(whole.buffers()[2], np.uint8, offsets[-1])
    space = SPACE[data]
    after = np.append(True, space[:-1])  # whether white space is before a byte
    lengths = np.add.reduceat(space & ~after, offsets[:-1], dtype=np.int64)
    return blank_ended(np.where(space, np.uint8(BLANK), data)[~(space & after)]), lengths


def blank_ended(data: np.ndarray) -> pa.Array:
    """Words with the blank behind each, from all their bytes."""
    offsets = np.append(0, np.flatnonzero(data == BLANK) + 1).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the words of texts or of lists of words, the end of each word's text, and the word of each code with a blank behind it."""
    if pa.types.is_list(texts.type):
        found, lengths = texts.flatten().cast(pa.binary()).dictionary_encode(), pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
        words = pc.binary_join_element_wise(found.dictionary, b"", b" ")
    else:
        found, lengths = split(texts)
        found = found.dictionary_encode()
        words = found.dictionary
    return found.indices.to_numpy(), np.repeat(np.cumsum(lengths), lengths), words


def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, cnt) of each span's frequent words, a blank behind them, and of all its words under null."""
    for lists in gathered(batches):
        codes, _, words = encoded(lists)
        counts = np.bincount(codes, minlength=len(words))
        often = np.flatnonzero(counts * FLOOR >= len(codes))
        names = pa.concat_arrays([words.take(pa.array(often)), pa.nulls(1, pa.binary())]).cast(pa.string())
        yield pa.record_batch([names, pa.array(np.append(counts[often], len(codes)))], ["word", "cnt"])


def mixed(*keys: np.ndarray) -> np.ndarray:
    """A 31-bit hash of rows of numbers."""
    h = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        h = (h ^ key) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h >> np.uint64(33)


def hashed(words: pa.Array) -> np.ndarray:
    """A number for each word, the same in all tasks."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]].astype(np.uint64) + np.uint64(1)
    length = np.diff(offsets)
    data *= mixed(np.arange(64, dtype=np.uint64))[(np.arange(len(data)) - np.repeat(offsets[:-1], length)) % 64]
    return mixed(np.where(length > 0, np.add.reduceat(np.append(data, np.uint64(0)), offsets[:-1]), np.uint64(0)))


def windows(codes: np.ndarray, at: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """For each of the words from places on, its code plus one; 0 where no word is left."""
    found = np.zeros((most, len(at)), np.int32)
    for k in range(most):
        whole = left > k
        found[k, whole] = codes[at[whole] + k] + 1
    return found


def ordered(columns: np.ndarray, top: int) -> np.ndarray:
    """The order of rows by columns of numbers up to a greatest, as many of them as fit as one key."""
    bits = max(int(top).bit_length(), 1)
    keys = []
    for k in range(0, len(columns), 63 // bits):
        key = columns[k].astype(np.int64)
        for column in columns[k + 1 : k + 63 // bits]:
            key = key << bits | column
        keys.append(key)
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def begins(columns: np.ndarray) -> np.ndarray:
    """For each column of sorted rows, whether a row differs from the one before there or in an earlier column."""
    new = np.ones(columns.shape, bool)
    new[:, 1:] = columns[:, 1:] != columns[:, :-1]
    return np.logical_or.accumulate(new, axis=0, out=new)


def distinct(columns: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of each kind, and how many there are."""
    if not columns.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = ordered(columns, top)
    first = np.flatnonzero(begins(columns[:, order])[-1])
    return order[first], np.diff(np.append(first, len(order)))


def records(codes: np.ndarray, left: np.ndarray, starts: int, rare: np.ndarray, hashes: np.ndarray, most: int, parts: int) -> list[np.ndarray]:
    """Records of the places before starts: first word, words, places, shortest n-gram, times, task.

    The words of all records are those of codes, and then those of all codes. Neighbouring places whose first two words have the same
    greatest number among rare go as one run. Where both are 0, as for frequent words, places are summed here and dealt by three words,
    and their pairs by themselves. Single words are summed as well.
    """
    own = codes[:starts]
    counts = np.bincount(own, minlength=len(hashes))
    single = np.flatnonzero(counts)
    one = np.ones_like(single)
    found = [[len(codes) + single, one, one, one, counts[single], mixed(hashes[single]) % np.uint64(parts)]]
    if most > 1:
        order = rare[codes]
        key = np.maximum(order, np.append(order[1:], order[:1]))[:starts]
        pair = left[:starts] >= 2
        part = mixed(key) % np.uint64(parts)
        plain = pair & (key > 0)
        on = np.zeros(starts + 1, bool)  # whether a place goes on with the run of the place before
        on[1:starts] = plain[1:] & plain[:-1] & (part[1:] == part[:-1])
        at = np.flatnonzero(plain & ~on[:-1])
        places = np.flatnonzero(plain & ~on[1:]) - at + 1
        found.append([at, np.minimum(places + most - 1, left[at]), places, np.full_like(at, 2), np.ones_like(at), part[at]])
        for low, high in ((2, 2), (3, most))[: most - 1]:
            at = np.flatnonzero(pair & (key == 0) & (left[:starts] >= low))
            kept, times = distinct(windows(codes, at, left[at], high), len(hashes))
            at, one = at[kept], np.ones_like(kept)
            dealt = mixed(*[hashes[codes[at + k]] for k in range(low)]) % np.uint64(parts)
            found.append([at, np.minimum(left[at], high), one, one * low, times, dealt])
    return [np.concatenate(x, dtype=np.int32, casting="unsafe") for x in zip(*found)]


def pack(batches: Iterator[pa.RecordBatch], most: int, frequent: list[str], heads: list[int]) -> Iterator[pa.RecordBatch]:
    """(head, size, data): the records of batches of texts or lists of words, compressed for each task, whose numbers are heads."""
    for lists in gathered(batches):
        codes, ends, words = encoded(lists)
        if not len(codes):
            continue
        hashes = hashed(words)
        often = pc.is_in(words, value_set=pa.array([w.encode() for w in frequent], pa.binary())).to_numpy(zero_copy_only=False)
        rare = np.where(often, np.uint64(0), hashes + np.uint64(1))
        upto = np.cumsum(pc.binary_length(words).to_numpy()[codes].astype(np.int64)) // SPAN_BYTES
        cuts = [0, *(np.flatnonzero(upto[1:] != upto[:-1]) + 1), len(codes)]  # long words make several spans
        for start, end in pairwise(cuts):
            own = codes[start : end + most - 1]
            left = ends[start : end + most - 1] - np.arange(start, start + len(own))
            yield from packed(records(own, left, end - start, rare, hashes, most, len(heads)), own, words, heads)


def packed(found: list[np.ndarray], codes: np.ndarray, words: pa.Array, heads: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of pack() of records, with the words as text."""
    order = np.argsort(found[-1].astype(np.min_scalar_type(len(heads))), kind="stable")
    at, length, places, low, times, part = [x[order] for x in found]
    upto = np.cumsum(length, dtype=np.int32)
    index = np.repeat(at - (upto - length), length) + np.arange(upto[-1], dtype=np.int32)
    texts = words.take(pa.array(np.append(codes, np.arange(len(words), dtype=codes.dtype))[index]))
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    bounds = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(part)]
    columns = [x.astype(np.min_scalar_type(x.max())) for x in (length, places, low, times)]
    head = np.array([0, *[x.itemsize for x in columns]], np.uint32)
    froms, tos = offsets[upto - length], offsets[upto]
    rows, size = [], 0
    for start, end in pairwise(bounds):
        head[0] = end - start
        raw = b"".join((head, *[x[start:end] for x in columns], data[froms[start] : tos[end - 1]]))
        rows.append((heads[part[start]], len(raw), CODEC.compress(raw, asbytes=True)))
        size += len(rows[-1][-1])
        if size >= SPAN_BYTES // 2 or end == bounds[-1]:
            kinds = (pa.int32(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["head", "size", "data"])
            rows, size = [], 0


Places = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]


def unpacked(raws: list[bytes], most: int) -> Places:
    """Of the places of packed records: distinct words, windows of their codes, shortest n-grams and times."""
    columns, texts = [[], [], [], []], []
    for raw in raws:
        head = np.frombuffer(raw, np.uint32, 5)
        pos = head.nbytes
        for column, width in zip(columns, head[1:]):
            column.append(np.frombuffer(raw, f"u{width}", head[0], pos).astype(np.int64))
            pos += int(head[0]) * int(width)
        texts.append(np.frombuffer(raw, np.uint8, -1, pos))
    length, places, low, times = map(np.concatenate, columns)
    found = blank_ended(np.concatenate(texts)).dictionary_encode()
    step = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
    at = np.repeat(np.cumsum(length) - length, places) + step
    columns = windows(found.indices.to_numpy(), at, np.repeat(length, places) - step, most)
    return found.dictionary, columns, np.repeat(low, places).astype(np.int32), np.repeat(times, places)


def joined(held: list[Places]) -> Places:
    """Places of several spans under the codes of all their words."""
    if len(held) == 1:
        return held[0]
    found = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
    codes, columns, start = found.indices.to_numpy(), [], 0
    for words, own, _, _ in held:
        columns.append(np.append(0, codes[start : start + len(words)] + 1).astype(np.int32)[own])
        start += len(words)
    return found.dictionary, np.concatenate(columns, axis=1), np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])


def summed(held: Places) -> Places:
    """Places with equal ones as one."""
    words, columns, low, times = held
    rows = np.concatenate([columns, low[None]])
    order = ordered(rows, max(len(words), int(low.max())))
    first = np.flatnonzero(begins(rows[:, order])[-1])
    kept = order[first]
    return words, columns[:, kept], low[kept], np.add.reduceat(times[order], first)


def count(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(n, ngram, cnt) of all records of a task. Equal places are summed whenever many are held."""
    held, raws, size, limit = [], [], 0, MOST_PLACES

    def taken() -> None:
        nonlocal held, raws, size, limit
        held, raws, size = [*held, unpacked(raws, most)], [], 0
        if sum(len(x[2]) for x in held) > limit:
            held = [summed(joined(held))]
            limit = max(MOST_PLACES, 2 * len(held[0][2]))

    for batch in batches:
        for n, data in zip(batch.column("size").to_pylist(), batch.column("data")):
            raws.append(CODEC.decompress(data.as_buffer(), n, asbytes=True))
            size += n
            if size >= 3 * SPAN_BYTES:
                taken()
    if raws:
        taken()
    if held:
        yield from counted(joined(held), most)


def counted(held: Places, most: int) -> Iterator[pa.RecordBatch]:
    """(n, ngram, cnt) of places; an n-gram stands beside those that it begins with."""
    words, columns, low, times = held
    order = ordered(columns, len(words))
    columns, low, times = columns[:, order], low[order], times[order]
    new, counts = begins(columns), np.zeros(columns.shape, np.int64)
    for k in range(most):
        first = np.flatnonzero(new[k])
        counts[k, first] = np.add.reduceat(np.where(low <= k + 1, times, 0), first)
    counts[columns == 0] = 0
    forms = pa.concat_arrays([words, pc.binary_slice(words, 0, -1)])  # with and without a blank at the end
    step = int(SPAN_BYTES // max(1.0, most * pc.sum(pc.binary_length(words)).as_py() / len(words) * most))
    for start in range(0, len(order), max(1, step)):
        own = np.ascontiguousarray(counts[:, start : start + max(1, step)].T)
        row, level = np.nonzero(own)
        if not len(row):
            continue
        upto = np.cumsum(level + 1)
        k = np.arange(upto[-1]) - np.repeat(upto - level - 1, level + 1)
        codes = columns[k, start + np.repeat(row, level + 1)] - 1
        codes[upto - 1] += len(words)
        texts = forms.take(pa.array(codes))
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)[np.append(0, upto)]
        ngrams = pa.Array.from_buffers(pa.string(), len(row), [None, pa.py_buffer(offsets), texts.buffers()[2]])
        yield pa.record_batch([pa.array(level + 1, pa.int32()), ngrams, pa.array(own[row, level])], ["n", "ngram", "cnt"])
