"""Dictionaries as automata in flat arrays: many patterns in texts, titles in runs of words.

An Aho-Corasick automaton over bytes finds every place of every pattern; a double-array trie over words finds the longest
title at each word. Both are built from a part of the dictionary of bounded size, sent to the executors once, and run over
Arrow batches, all places of a batch at once; documents aren't shuffled. A dictionary of more than one part takes a pass over
the documents for each, one beyond ``MOST_PARTS`` the equi-joins of kb.py, which have the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import kb
from larkspur.storage import materialize

#: Bytes of the arrays of a part, about, and parts at most.
PART_BYTES = 16 << 20
MOST_PARTS = 32
#: Bytes of text that are searched together, and of a stretch of it.
SLICE_BYTES = 512 << 10
STRETCH = 1024


@dataclass
class Automaton:
    """Aho-Corasick over bytes. States are numbered by depth, the root is 0.

    follow[state * classes + class]: the next state; fail[state]: the state of its longest proper suffix; ends[state]: the
    pattern that ends there or -1; output[state]: the next state on the way of suffixes at which a pattern ends, 0 if none.
    """

    classes: np.ndarray
    follow: np.ndarray
    ends: np.ndarray
    output: np.ndarray
    patterns: list[bytes]
    longest: int

    @property
    def width(self) -> int:
        return int(self.classes.max()) + 1


def automaton(patterns: list[bytes]) -> Automaton:
    """Built level by level: all patterns step on together."""
    patterns = sorted(set(patterns) - {b""})
    data = np.frombuffer(b"".join(patterns), np.uint8)
    size = np.fromiter(map(len, patterns), np.int64, len(patterns))
    begin = np.cumsum(size) - size
    used = np.unique(data)
    classes = np.zeros(256, np.int64)
    classes[used] = np.arange(1, len(used) + 1)
    width, state, n = len(used) + 1, np.zeros(len(patterns), np.int64), 1
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > depth)
        edge, which = np.unique(state[on] * width + classes[data[begin[on] + depth]], return_inverse=True)
        state[on] = n + which
        levels.append((edge // width, edge % width, np.arange(n, n + len(edge))))
        n += len(edge)
        over = on[size[on] == depth + 1]
        ends.append((state[over], over))
    follow, fail = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
    end, output = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for at, pattern in ends:
        end[at] = pattern
    for parent, kind, child in levels:
        # Rows of the parents' level are whole but for their own children; suffixes are shallower, so their rows are whole.
        fail[child] = np.where(parent > 0, follow[fail[parent], kind], 0)
        follow[parent, kind] = child
        output[child] = np.where(end[fail[child]] >= 0, fail[child], output[fail[child]])
        follow[child] = follow[fail[child]]
    return Automaton(classes, follow.ravel(), end, output, patterns, int(size.max(initial=0)))


def places(found: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte behind it, pattern) of each place of each pattern in texts that lie one after another.

    Texts are cut into stretches, each led in by as many bytes as a pattern may have before it, and all step on together.
    """
    stretch = max(STRETCH, 4 * found.longest)
    size = np.diff(offsets)
    count = -(-size // stretch)
    text = np.repeat(np.arange(len(size)), count)
    own = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * stretch
    stop = np.minimum(own + stretch, offsets[text + 1])
    begin = np.maximum(own - found.longest + 1, offsets[text])
    order = np.argsort(begin - stop, kind="stable")  # long ones first, so that those that are through drop off the end
    begin, own, stop = begin[order], own[order], stop[order]
    length = stop - begin
    state = np.zeros(len(begin), np.int64)
    width, hits = found.width, found.ends.shape[0]
    speaks = (found.ends >= 0) | (found.output > 0)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -step))
        at = begin[:n] + step
        state = found.follow[state[:n] * width + found.classes[data[at]]].astype(np.int64)
        hit = np.flatnonzero(speaks[state] & (at >= own[:n]))
        if len(hit):
            out.append((at[hit] + 1, state[hit]))
    if not out or not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, state = (np.concatenate(x) for x in zip(*out))
    behind, which = [], []
    while len(state):
        ends = found.ends[state]
        behind.append(at[ends >= 0])
        which.append(ends[ends >= 0])
        state = found.output[state]
        at, state = at[state > 0], state[state > 0]
    return np.concatenate(behind), np.concatenate(which)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the n + 1 offsets; nulls are empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` in size."""
    total, start = sizes.cumsum(), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def dealt(dictionary: DataFrame, column: str, size, deal) -> tuple[DataFrame, int]:
    """The dictionary's distinct entries with a part number, written out, and the number of parts; 0 parts if it is empty."""
    total = dictionary.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = int(-(-total // PART_BYTES))
    rows = dictionary.select(column, F.pmod(F.xxhash64(deal), F.lit(max(parts, 1))).cast("int").alias("part"))
    return (materialize(rows, "dictionary") if 0 < parts <= MOST_PARTS else rows), parts


def find_patterns(docs: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, pattern): every place of every pattern in the texts, in characters, inside words and overlapping too.

    A null text has no places; null and empty patterns are left out, repeated ones count once.
    """
    known = patterns.select("pattern").where("pattern != ''").distinct()
    # A byte of a pattern makes a state at most, of four bytes for each of some hundred classes of bytes.
    rows, parts = dealt(known, "pattern", F.octet_length("pattern") * 400, F.col("pattern"))
    if parts > MOST_PARTS:
        return kb.find_patterns(docs, patterns, key, text)
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = None
    for part in range(max(parts, 1)):
        entries = [r.pattern.encode() for r in rows.where(F.col("part") == part).select("pattern").collect()]  # bounded by PART_BYTES
        sent = docs.sparkSession.sparkContext.broadcast(automaton(entries))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = sent.value
            names = pa.array([p.decode() for p in found.patterns], pa.string())
            size = np.fromiter(map(len, found.patterns), np.int64, len(found.patterns))
            for batch in batches:
                lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
                for some in runs(batch, lengths, SLICE_BYTES):
                    data, offsets = text_bytes(some.column("text"))
                    behind, which = places(found, data, offsets)
                    start = behind - size[which]
                    row = np.searchsorted(offsets, start, side="right") - 1
                    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    at = chars[start] - chars[offsets[row]]
                    yield pa.RecordBatch.from_arrays(
                        [some.column("key").take(pa.array(row)), pa.array(at.astype(np.int32)), names.take(pa.array(which))], names=["key", "start", "pattern"]
                    )

        hits = slim.mapInArrow(search, f"key {kind}, start int, pattern string")
        out = hits if out is None else out.unionByName(hits)
    return out.withColumnRenamed("key", key)


@dataclass
class WordTrie:
    """A double-array trie over numbered words. State s goes on with word w to base[s] + w if that slot's owner is s.

    title[s]: the title that a window which ends in s has, or -1; near[s]: whether it is only similar.
    """

    words: list[str]
    base: np.ndarray
    owner: np.ndarray
    title: np.ndarray
    near: np.ndarray
    titles: list[str]
    depth: int


def word_trie(titles: list[str], context: int, threshold: float) -> WordTrie:
    """The trie of titles (words between single blanks), of as many levels as a window has words.

    A window that ends inside a longer title has that title too, if its words are more than ``threshold`` of the title's; the
    title itself comes before a longer one, of several longer ones the least.
    """
    titles = sorted(set(titles))
    split = [t.split(" ") for t in titles]
    words = sorted({w for ws in split for w in ws})
    number = {w: i for i, w in enumerate(words)}
    children: list[dict[int, int]] = [{}]
    held: list[tuple[int, int]] = [(2, -1)]  # (0 exact or 1 similar, title) of each node, the least
    for i, ws in enumerate(split):
        node = 0
        for n, w in enumerate(ws[:context], 1):
            node = children[node].setdefault(number[w], len(children))
            if node == len(children):
                children.append({})
                held.append((2, -1))
            if n == len(ws) or n > threshold * len(ws):
                held[node] = min(held[node], (int(n < len(ws)), i))
    # Slots: nodes of many children first, each at the first place where all of them fit; single children fill what is left.
    slot, base = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
    taken = np.zeros(len(words) + len(children) + 2, bool)
    taken[0] = True
    low = 1
    for node in sorted(range(len(children)), key=lambda x: -len(children[x])):
        own = np.fromiter(children[node], np.int64, len(children[node]))
        if not len(own):
            break
        while low < len(taken) and taken[low]:
            low += 1
        at = low - int(own.min())
        while True:
            top = at + int(own.max())
            if top >= len(taken):
                taken = np.concatenate((taken, np.zeros(max(len(taken), top), bool)))
            if not taken[at + own].any():
                break
            at += 1
        taken[at + own] = True
        base[node] = at
        slot[np.fromiter(children[node].values(), np.int64, len(own))] = at + own
    n = len(taken)
    trie = WordTrie(words, np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool), titles, context)
    trie.base[slot] = base
    trie.title[slot], trie.near[slot] = np.array([t for _, t in held]), np.array([k == 1 for k, _ in held])
    for node, own in enumerate(children):
        if own:
            trie.owner[slot[np.fromiter(own.values(), np.int64, len(own))]] = slot[node]
    return trie


def longest_titles(trie: WordTrie, words: pa.Array, offsets: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, number of words, title) of the longest window at each place of lists of words that has a title."""
    known = pc.fill_null(pc.index_in(words, value_set=pa.array(trie.words, words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.fill_null(pc.utf8_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    best, n = np.full(len(known), -1, np.int64), np.zeros(len(known), np.int64)
    at = np.flatnonzero(known >= 0)
    stop = np.repeat(offsets[1:], np.diff(offsets))[at]
    state, chars = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    for step in range(trie.depth):
        inside = at + step < stop
        at, stop, state, chars = at[inside], stop[inside], state[inside], chars[inside]
        word = known[at + step]
        to = trie.base[state] + word
        there = (word >= 0) & (to >= 0) & (to < len(trie.owner))
        there[there] = trie.owner[to[there]] == state[there]
        at, stop, state, chars = at[there], stop[there], to[there], chars[there] + size[at[there] + step] + 1
        hit = (trie.title[state] >= 0) & (chars >= least_chars)
        best[at[hit]], n[at[hit]] = trie.title[state[hit]], step + 1
    found = np.flatnonzero(best >= 0)
    return found, n[found], best[found]


def match_titles(tokens: DataFrame, titles: DataFrame, context: int = 5, threshold: float = 0.8, least_chars: int = 3) -> DataFrame:
    """(doc_id, start, n, spot, title): the longest window of up to ``context`` words at each start of (doc_id, words) that is a title.

    A window is similar to a title if the words that agree by their places are more than ``threshold`` of the longer one's. With
    windows this short a word that differs is too much, so what is left are equal words, and windows that begin a longer
    title (five of six words). Titles with other than single blanks between words never match. Windows below ``least_chars``
    characters are left out; starts may overlap; a null list has no windows, and null words are in no title.
    """
    if (context - 1) > threshold * context:
        raise ValueError("windows of that many words may differ in a word and still be similar")
    names = titles.select("title").where("title != ''").distinct()
    # Titles of one first word are in one part, so a start has its matches from one part.
    rows, parts = dealt(names, "title", F.octet_length("title") * 40, F.substring_index("title", " ", 1))
    if parts > MOST_PARTS:
        return kb.match_spots(tokens, titles, context, least_chars)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    out = None
    for part in range(max(parts, 1)):
        entries = [r.title for r in rows.where(F.col("part") == part).select("title").collect()]  # bounded by PART_BYTES
        sent = tokens.sparkSession.sparkContext.broadcast(word_trie(entries, context, threshold))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trie = sent.value
            names = pa.array(trie.titles, pa.string())
            for batch in batches:
                counts = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False)
                for some in runs(batch, counts, SLICE_BYTES // 8):
                    words = some.column("words").flatten()
                    offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(some.column("words")), 0).to_numpy(zero_copy_only=False))))
                    at, n, title = longest_titles(trie, words, offsets, least_chars)
                    row = np.searchsorted(offsets, at, side="right") - 1
                    texts = words.to_pylist() if len(at) else []
                    spots = [" ".join(texts[i : i + k]) for i, k in zip(at.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column("doc_id").take(pa.array(row)), pa.array((at - offsets[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                            pa.array(spots, pa.string()), names.take(pa.array(title)),
                        ],
                        names=["doc_id", "start", "n", "spot", "title"],
                    )

        hits = tokens.select("doc_id", "words").mapInArrow(search, f"doc_id {kind}, start int, n int, spot string, title string")
        out = hits if out is None else out.unionByName(hits)
    return out
