"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of characters given the characters before them inside the word, a word being framed by
blanks. N-grams are counted by Spark over a bounded sample of labelled documents (about ``SAMPLE`` of each language:
those whose hash is below a share of the range, so that it is the same at every run). A task for each language turns its
counts into sorted arrays of n-gram hashes with log probabilities, and of contexts with back-off weights, which are
searched by bisection. A text gets the language of the least cross-entropy for a character.

A text is rejected when it has no letter, or when its least cross-entropy is above its language's limit. Limits are
calibrated on a part of the sample that isn't counted (``HELD`` of it): nearly all texts of the language stay below
(``OWN_QUANTILE``), nearly all of the other languages are above under its model (``OTHER_QUANTILE``), and the limit is
midway between, or ``MARGIN`` times the first if that is more or nothing else is known.

A language's counts are bounded by its sample, and the model, the sum of its languages' arrays, by the number of languages,
not by the documents, so it travels with the tasks. Documents never shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow, materialize, release, small

ORDER = 5
#: Labelled documents of a language, about, that a model learns from, each of them whole.
SAMPLE = 1500
DISCOUNT = 0.75
#: The share of the sample that limits are calibrated on, of languages that have as many documents as this in it.
HELD, HELD_LEAST = 0.2, 50
OWN_QUANTILE, OTHER_QUANTILE, MARGIN = 0.999, 0.01, 1.5
UNDETERMINED = "und"
#: Characters of evidence that a score counts at most: neighbouring characters aren't independent.
EVIDENCE = 40
#: Words that a worker remembers before it starts anew.
MEMORY = 100_000
#: Characters of a text that are cut into words together.
PIECE = 1 << 18
#: Words are runs of letters with the marks that combine with them; all else parts words, numbers such as ½ or Ⅷ too.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
NO_LETTER = regex.compile(r"[^\p{L}\p{M}]").search


def pieces(text: str | None) -> Iterator[str]:
    """The text in parts of about PIECE characters that end where words do."""
    at, size = 0, len(text or "")
    while at < size:
        found = NO_LETTER(text, at + PIECE) if at + PIECE < size else None
        stop = found.start() if found else size
        yield text[at:stop]
        at = stop


def text_words(text: str) -> list[str]:
    """Runs of letters in lower case, with a blank on both sides."""
    return [f" {w} " for w in LETTERS(text.lower())]


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and each one's place in its word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.repeat(np.cumsum(length) - length, length)
    return codes, np.arange(len(codes)) - start


def gram_hashes(codes: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0 to order, the hash of the n characters that end at each place; 0 where the word has fewer."""
    out = [np.zeros(len(codes), np.uint64)]
    hashed = np.full(len(codes), 0xCBF29CE484222325, np.uint64)
    for n in range(1, order + 1):
        earlier = np.zeros(len(codes), np.uint64)
        earlier[n - 1 :] = codes[: max(0, len(codes) - n + 1)]
        hashed = (hashed ^ (earlier + np.uint64(n << 32))) * np.uint64(0x100000001B3)
        hashed ^= hashed >> np.uint64(29)
        mixed = hashed * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        out.append(np.where(place >= n - 1, mixed | np.uint64(1), np.uint64(0)))
    return out


def looked_up(keys: np.ndarray, values: np.ndarray, sought: np.ndarray, other) -> np.ndarray:
    """Values of the sought keys among sorted ones; ``other`` where a key is missing."""
    if not len(keys):
        return np.zeros(len(sought)) + other
    i = np.searchsorted(keys, sought)
    i[i == len(keys)] = 0
    return np.where(keys[i] == sought, values[i], other)


@dataclass
class Grams:
    """The distinct n-grams of some words, in order: level n has hashes, and the rows of prefix and suffix in level n - 1."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: For each character of the words the row of its longest n-gram, counted through all levels.
    rows: np.ndarray
    place: np.ndarray


def grams_of(words: list[str], order: int) -> Grams:
    codes, place = codes_of(words)
    hashes = gram_hashes(codes, place, order)
    below = rows = np.zeros(len(codes), np.int64)
    levels, earlier = [], 0
    for n in range(1, order + 1):
        fits = np.flatnonzero(place >= n - 1)
        grams, first, index = np.unique(hashes[n][fits], return_index=True, return_inverse=True)
        first = fits[first]
        levels.append((grams, below[first - 1], below[first]))
        below, rows = np.zeros(len(codes), np.int64), rows.copy()
        below[fits] = index
        rows[fits] = index + earlier
        earlier += len(grams)
    return Grams(levels, rows, place)


@dataclass
class Language:
    """Kneser-Ney tables of a language; values are in single precision, as every worker holds them.

    keys[n], logp[n]: sorted hashes of its n-grams and their log probabilities.
    contexts[n], backoff[n]: sorted hashes of contexts of n characters and their weights. floor: log probability of an unseen character.
    """

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float

    def scores(self, grams: Grams) -> np.ndarray:
        """Log probability of each character of the words given those before it; an n-gram that is missing is backed off."""
        out, values, weights = [], np.zeros(0), np.zeros(0)
        for n, (hashes, prefix, suffix) in enumerate(grams.levels, 1):
            lower = weights[prefix] + values[suffix] if n > 1 else self.floor
            values = looked_up(self.keys[n], self.logp[n], hashes, lower)
            out.append(values)
            if n < len(grams.levels):
                weights = looked_up(self.contexts[n], self.backoff[n], hashes, 0.0)
        return np.where(grams.place > 0, np.concatenate(out)[grams.rows], 0.0)


@dataclass
class Model:
    """The languages, by code point, with their tables.

    limits: for each language the cross-entropy beyond which a text is rejected.
    """

    languages: list[str]
    tables: list[Language]
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    memory: dict[str, int] = field(default_factory=dict)
    known: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}, "known": np.zeros((0, 0), np.float32)}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log probability in each language."""
        out = np.zeros((len(words), len(self.tables)))
        if words:
            grams = grams_of(words, ORDER)
            starts = np.flatnonzero(grams.place == 0)
            for k, own in enumerate(self.tables):
                out[:, k] = np.add.reduceat(own.scores(grams), starts)
        return out

    def cross_entropy(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: nats a character in each language; NaN without letters."""
        return self.measured(texts)[0]

    def measured(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of cross_entropy, and the characters of each text's words with the blanks around them."""
        out, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        chars = np.zeros(len(texts), np.int64)
        parts: list[tuple[int, list[str]]] = []
        waiting = 0
        for k, text in enumerate(texts):
            for piece in pieces(text):
                words = text_words(piece)
                if not words:
                    continue
                parts.append((k, words))
                n = sum(map(len, words))
                size[k] += n
                chars[k] += n - len(words)
                waiting += n
                if waiting > 4 * PIECE:
                    self.add_scores(parts, out)
                    parts, waiting = [], 0
        self.add_scores(parts, out)
        with np.errstate(invalid="ignore"):
            return np.where(chars[:, None] > 0, -out / chars[:, None], np.nan), size

    def add_scores(self, parts: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        """Adds the scores of words to the rows of their texts; words that were scored before are looked up."""
        if len(self.memory) > MEMORY or not self.memory:
            self.memory, self.known = {}, np.zeros((1024, len(self.languages)), np.float32)
        new = list(set().union(*[words for _, words in parts]).difference(self.memory))
        if new:
            n = len(self.memory)
            while n + len(new) > len(self.known):
                self.known = np.concatenate((self.known, np.zeros_like(self.known)))
            self.memory.update(zip(new, range(n, n + len(new))))
            self.known[n : n + len(new)] = self.word_scores(new)
        get = self.memory.__getitem__
        for k, words in parts:
            out[k] += self.known[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0, dtype=float)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, least cross-entropies (NaN: no letter) and whether texts are rejected."""
        if not self.languages:
            n = len(texts)
            return [UNDETERMINED] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        entropy, size = self.measured(texts)
        none = np.isnan(entropy[:, 0])
        filled = np.where(none[:, None], 0.0, entropy)
        best = filled.argmin(axis=1)
        least = filled.min(axis=1)
        chars = np.minimum(EVIDENCE, size)
        odds = np.exp(-(filled - least[:, None]) * chars[:, None])
        score = np.where(none, 0.0, 1 / odds.sum(axis=1))
        language = [UNDETERMINED if no else self.languages[i] for no, i in zip(none.tolist(), best.tolist())]
        return language, score, np.where(none, np.nan, least), none | (least > self.limits[best])


def gram_counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, n, gram, prefix, suffix, count) of character n-grams: hashes of the whole, without its last, its first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[str]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for piece in pieces(text):
                    seen.setdefault(lang, Counter()).update(text_words(piece))
        for lang, words in seen.items():
            if not words:
                continue
            codes, place = codes_of(list(words))
            times = np.repeat(np.fromiter(words.values(), np.int64), np.fromiter(map(len, words), np.int64))
            hashes = gram_hashes(codes, place, order)
            for n in range(1, order + 1):
                rows = np.flatnonzero((hashes[n] != 0) & (place >= max(1, n - 1)))
                if not len(rows):
                    continue
                prefix = np.concatenate(([np.uint64(0)], hashes[n - 1][:-1]))[rows]
                table = np.stack([hashes[n][rows], prefix, hashes[n - 1][rows]], axis=1)
                gram, first, inverse = np.unique(table[:, 0], return_index=True, return_inverse=True)
                total = np.bincount(inverse, times[rows]).astype(np.int64)
                columns = [table[first, k].view(np.int64) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(np.full(len(gram), n, np.int32)), *map(pa.array, columns), pa.array(total)],
                    names=["lang", "n", "gram", "prefix", "suffix", "count"],
                )

    schema = "lang string, n int, gram long, prefix long, suffix long, count long"
    return (
        sample.select("lang", "text")
        .mapInArrow(count, schema)
        .groupBy("lang", "n", "gram")
        .agg(F.first("prefix").alias("prefix"), F.first("suffix").alias("suffix"), F.sum("count").alias("count"))
    )


TABLES = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("context", pa.bool_()), ("hashes", pa.binary()), ("values", pa.binary())])


def kneser_ney(table: pa.Table) -> pa.Table:
    """A language's tables from its counts: interpolated probabilities of raw counts at the highest order, of numbers of continuations below.

    A row for n-grams (``context`` false) and one for contexts of each length, as sorted hashes and values; length 0 has the floor.
    """
    lang = table.column("lang")[0].as_py()
    of = lambda part, name: part.column(name).to_numpy()
    own = {n: table.filter(pc.equal(table.column("n"), n)) for n in range(1, ORDER + 2)}
    out: list[tuple[str, int, bool, bytes, bytes]] = []

    def keep(n: int, context: bool, hashes: np.ndarray, values: np.ndarray) -> None:
        out.append((lang, n, context, hashes.astype(np.uint64).tobytes(), values.astype(np.float32).tobytes()))

    grams, p = np.zeros(0, np.uint64), np.zeros(0)
    for n in range(1, ORDER + 1):
        part, above = own[n], own[n + 1]
        if not part.num_rows:
            break
        hashes, prefix, suffix = (of(part, name).view(np.uint64) for name in ("gram", "prefix", "suffix"))
        value = of(part, "count").astype(float)
        if above.num_rows:
            keys, continued = np.unique(of(above, "suffix").view(np.uint64), return_counts=True)
            kinds = looked_up(keys, continued, hashes, 0)
            value = np.where(kinds > 0, kinds, value)  # what begins a word has nothing before it: its count stays
        heads, where = np.unique(prefix if n > 1 else np.zeros_like(prefix), return_inverse=True)
        total = np.bincount(where, value)
        left = DISCOUNT * np.bincount(where) / total
        below = p[np.searchsorted(grams, suffix)] if n > 1 else 1.0 / (len(hashes) + 1)
        found = (value - DISCOUNT).clip(0) / total[where] + left[where] * below
        if n > 1:
            keep(n - 1, True, heads, np.log(left))
        else:
            keep(0, False, np.zeros(1), np.log(left / (len(hashes) + 1)))
        order = np.argsort(hashes)
        grams, p = hashes[order], found[order]
        keep(n, False, grams, np.log(p))
    return pa.Table.from_pylist([dict(zip(TABLES.names, row)) for row in out], TABLES)


def language_models(counts: DataFrame) -> Model:
    """The model of all languages of gram_counts(): a task for each, whose counts are bounded by its sample; only finished arrays come here."""
    rows = counts.groupBy("lang").applyInArrow(kneser_ney, "lang string, n int, context boolean, hashes binary, values binary").collect()  # 2 ORDER rows a language at most
    found = {(r["lang"], r["n"], r["context"]): (np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["values"], np.float32)) for r in rows}
    languages = sorted({lang for lang, _, _ in found})
    none = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
    tables = []
    for lang in languages:
        (keys, logp), (contexts, backoff) = (zip(*[found.get((lang, n, c), none) for n in range(ORDER + 1)]) for c in (False, True))
        tables.append(Language(list(keys), list(logp), list(contexts), list(backoff), float(logp[0][0])))
    return Model(languages, tables)


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """(lang, text, held): about ``sample`` rows of each language, and whether a row is for calibration.

    A row is taken if the hash of its key, language and text is below a share of the range, so nothing is ranked; equal rows count once.
    """
    usable = labelled.where("lang is not null and text is not null")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not sizes:
        return usable.select("lang", "text", F.lit(False).alias("held"))
    table = lambda value: F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], value(r["n"]))])
    share = F.try_element_at(table(lambda n: min(1.0, sample / n)), F.col("lang"))
    many = F.try_element_at(table(lambda n: min(n, sample) >= HELD_LEAST), F.col("lang"))
    place = lambda salt: F.pmod(F.xxhash64("key", "lang", "text", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    chosen = usable.where(place("taken") < share).withColumn("many", many)
    return chosen.select("lang", "text", (F.col("many") & (place("held") < HELD)).alias("held")).dropDuplicates(["lang", "text"])


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the languages in (lang, text, key), from about ``sample`` documents of each by a hash of key."""
    chosen = materialize(sampled(labelled, sample), "language-sample")
    model = language_models(gram_counts(chosen.where("not held"), ORDER))
    if model.languages:
        model.limits = calibrate(chosen, model)
    release(chosen)
    return model


def calibrate(sample: DataFrame, model: Model) -> np.ndarray:
    """For each language the cross-entropy beyond which a text is rejected.

    From the held rows, and from all rows of languages that are too few to hold any.
    """
    shared = sample.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            n = len(model.languages)
            entropy = model.cross_entropy(batch.column("text").to_pylist())
            known = pa.array(np.tile(np.array(model.languages, object), batch.num_rows), pa.string())
            own = pa.array(np.repeat(batch.column("lang").to_numpy(zero_copy_only=False), n), pa.string())
            yield pa.RecordBatch.from_arrays([known, pc.equal(known, own), pa.array(entropy.ravel())], names=["model", "own", "value"])

    many = sample.groupBy("lang").agg(F.max("held").alias("many"))
    languages = len(model.languages)
    judged = sample.join(small(many, languages), "lang").where("held or not many").select("lang", "text")
    found = (
        judged.mapInArrow(run, "model string, own boolean, value double")
        .where("not isnan(value)")
        .groupBy("model")
        .agg(
            F.percentile_approx(F.when(F.col("own"), F.col("value")), OWN_QUANTILE, 10_000).alias("own"),
            F.percentile_approx(F.when(~F.col("own"), F.col("value")), OTHER_QUANTILE, 10_000).alias("other"),
        )
    )
    limits = {}
    for r in found.collect():
        if r["own"] is not None:
            limits[r["model"]] = max(r["own"] * MARGIN, (r["own"] + (r["other"] or 0.0)) / 2)
    shared.destroy()
    return np.array([limits.get(x, np.inf) for x in model.languages])


def identify(docs: DataFrame, model: Model, also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``also`` of each row with lang_pred, score, cross_entropy and rejected.

    A null text or one without a letter is ``und``, rejected, with score 0 and null cross-entropy. Ties go to the
    first language by code point. Repeated rows each give a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    held = docs.select(*dict.fromkeys((*also, "text")))
    names = list(also)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields if f.name in names])
    schema += ", lang_pred string, score double, cross_entropy double, rejected boolean"

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        language, score, entropy, rejected = shared.value.predict(part.column("text").to_pylist())
        columns = [part.column(c) for c in names]
        made = [pa.array(language, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)]
        return pa.RecordBatch.from_arrays(columns + made, names=[*names, "lang_pred", "score", "cross_entropy", "rejected"])

    return map_arrow(held, one, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """(lang, text, key) of the rows that may be learned from: crc32 of doc_id mod 4 isn't 2."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("lang", "text", key.alias("key")).where(F.crc32(F.col("key")) % 4 != 2)


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), cross_entropy, rejected of every document.

    Trained on the rows whose crc32(doc_id) mod 4 isn't 2 (a null doc_id counts as an empty text there). Without
    labelled rows every text is ``und``. An empty table gives an empty result; further columns are left out.
    """
    model = train(learnable(docs))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return identify(docs.select("doc_id", "text"), model).withColumn("held_out", held)
