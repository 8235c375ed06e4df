"""Benchmark decontamination: where documents hold windows of benchmark items, as a prefix-filtered set join in DataFrame code.

An item's windows are its runs of ``window`` words (the whole item if it has fewer); a window's set is that of its
shingles of SHINGLE words at their places. Shingles are ordered by how often all documents have them. A document's run of
as many words as the window is a hit if it has at least ``threshold`` of the window's shingles at their places, so one of
the window's rarest ``size - needed + 1`` must be there (prefix filter), with room before and behind it in the document
(positional and length bounds); the run's own words then decide. With a threshold of 1 the prefix is one shingle, the
rarest, a window with a shingle that no document has can't occur, and the words must be equal.

Documents aren't shuffled, their texts even less: words are cut into pieces with some overlap, each place of a piece is
hashed and met with the items' shingles. Only places that have one go on, each with the words around it. What belongs to a
document is keyed by its text's digest, so exact copies share their hits, and a group of copies is one entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import by_place, materialize, small

WINDOW = 10
SHINGLE = 5
#: Words of a piece, besides its overlap.
PIECE = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that part words.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; none for null.

    Characters are exchanged and the text is split at blanks, which takes a sixth of what that pattern takes.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")



def shingle(words: Column, at: Column, size: int) -> Column:
    """64-bit hash of the words from a place (from 0) on; equal words have equal hashes, the words themselves decide."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(window_id, words, n) of distinct windows of items (item_id, text), and (window_id, item_id) of those that hold them."""
    parsed = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    runs = parsed.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    runs = materialize(runs.select("item_id", F.slice("words", F.col("at") + 1, F.lit(window)).alias("words")).withColumn("window_id", F.sha2(F.array_join("words", " "), 256)), "runs")
    windows = runs.groupBy("window_id").agg(F.any_value("words").alias("words")).withColumn("n", F.size("words"))
    return windows, runs.select("window_id", "item_id").distinct()


def window_shingles(windows: DataFrame, size: int) -> DataFrame:
    """(window_id, n, words, off, h): the shingles of windows at their places; of the whole window if it has fewer words."""
    out = None
    for k in range(1, size + 1):
        own = F.col("n") >= size if k == size else F.col("n") == k
        rows = windows.where(own).select("window_id", "n", "words", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("off"))
        rows = rows.withColumn("h", shingle(F.col("words"), F.col("off"), k))
        out = rows if out is None else out.unionByName(rows)
    return out


def pieces(docs: DataFrame, before: int, behind: int) -> DataFrame:
    """(digest, n_words, low, piece): words of each text in runs of PIECE, with those before and behind; low is the piece's first place."""
    parsed = docs.select("digest", "words", F.size("words").alias("n_words"))
    starts = parsed.withColumn("from", F.explode(F.expr(f"sequence(0, greatest(n_words - 1, 0), {PIECE})")))
    low = F.greatest(F.col("from") - before, F.lit(0))
    placed = starts.withColumn("low", low)
    return placed.select(
        "digest", "n_words", "low", (F.col("from") - F.col("low")).alias("own"), F.slice("words", F.col("low") + 1, F.col("from") - F.col("low") + PIECE + behind).alias("piece")
    )


def occurrences(docs: DataFrame, known: DataFrame, n_known: int, sizes: list[int], window: int) -> DataFrame:
    """(digest, n_words, at, h, lead, around): places of the items' shingles (h) in documents, with the words around them.

    around begins ``lead`` words before the place. A table of shingles that may be broadcast meets the places inside the
    scan; for a larger one each place takes its words along into a shuffled join.
    """
    cut = pieces(docs, window, window)
    hinted = small(known, n_known)
    lead = F.least(F.col("pos"), F.lit(window))
    around = F.slice("piece", F.col("pos") - F.col("lead") + 1, F.col("lead") + window)
    out = None
    for size in sizes:
        last = F.least(F.col("own") + PIECE - 1, F.col("n_words") - F.col("low") - size)
        places = cut.withColumn("last", last).where(F.col("last") >= F.col("own"))
        places = places.select("digest", "n_words", "low", "piece", F.explode(F.sequence("own", "last")).alias("pos"))
        hashed = places.select("digest", "n_words", "low", "piece", "pos", shingle(F.col("piece"), F.col("pos"), size).alias("h"))
        with_words = lambda rows: rows.withColumn("lead", lead).select("digest", "n_words", (F.col("low") + F.col("pos")).alias("at"), "h", "lead", around.alias("around"))
        rows = with_words(hashed.join(hinted, "h")) if hinted is not known else with_words(hashed).join(known, "h").select("digest", "n_words", "at", "h", "lead", "around")
        out = rows if out is None else out.unionByName(rows)
    return out


def found_windows(docs: DataFrame, windows: DataFrame, window: int, size: int, threshold: float) -> DataFrame:
    """(digest, start, n, window_id): runs of words of docs (digest, words) that hold windows."""
    shingles = materialize(window_shingles(windows, size), "shingles")
    known = materialize(shingles.select("h").distinct(), "known-shingles")
    n_known = known.count()
    sizes = [r.k for r in shingles.select(F.least("n", F.lit(size)).alias("k")).distinct().collect()]  # SHINGLE rows at most
    if not sizes:
        return docs.select("digest", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("window_id")).where("false")
    seen = materialize(occurrences(docs, known, n_known, sorted(sizes), window), "occurrences")
    often = seen.groupBy("h").agg(F.count("*").alias("times"))
    rarity = shingles.join(often, "h", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    # Windows are WINDOW words at most, so a window's shingles are few.
    rank = F.row_number().over(Window.partitionBy("window_id").orderBy("times", "h", "off"))
    count = F.count("*").over(Window.partitionBy("window_id"))
    ranked = rarity.withColumn("rank", rank).withColumn("of", count).withColumn("need", F.ceil(F.col("of") * F.lit(threshold) - 1e-9))
    prefix = materialize(ranked.where("rank <= of - need + 1 and times > 0").select("h", "off", "window_id", "n", F.col("words").alias("wanted"), "of", "need"), "prefix")
    n_prefix, n_bytes = prefix.agg(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("wanted", " "))), F.lit(0))).first()
    dictionary = F.broadcast(prefix) if n_prefix * 200 + n_bytes <= 8 << 20 else prefix
    start = (F.col("at") - F.col("off")).alias("start")
    met = seen.join(dictionary, "h").where((F.col("off") <= F.col("at")) & (F.col("at") - F.col("off") + F.col("n") <= F.col("n_words")))
    run = F.slice("around", F.col("lead") - F.col("off") + 1, F.col("n"))
    if threshold >= 1:
        hit = run == F.col("wanted")
    else:
        k = F.least(F.col("n"), F.lit(size))
        equal = lambda i: F.slice(run, i + 1, k) == F.slice("wanted", i + 1, k)
        hit = F.size(F.filter(F.sequence(F.lit(0), F.col("of") - 1), equal)) >= F.col("need")
    return met.where(hit).select("digest", start, "n", "window_id").distinct()


def covered(hits: DataFrame) -> DataFrame:
    """(digest, n_hit): words of a text inside any of its runs (digest, start, n)."""
    longest = hits.groupBy("digest", "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy("digest").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a text's places
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0))
    own = F.greatest(F.col("start") + F.col("n") - F.greatest(F.col("start"), F.col("reach")), F.lit(0))
    return longest.withColumn("reach", reach).groupBy("digest").agg(F.sum(own).alias("n_hit"))


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE, threshold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(digest, start, n, window_id) of hits in texts, by the SHA-256 of each text, and (window_id, item_id) of all windows."""
    windows, owners = item_windows(items, window)
    windows = materialize(windows, "windows")
    texts = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), words_of(F.col("text")).alias("words"))
    return materialize(found_windows(texts, windows, window, size, threshold), "hits"), owners


def decontamination_table(docs: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE, threshold: float = 1.0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    n_hit are the document's words inside any run that holds a window of an item; n_items the items with such a window, and
    items_sha256 the digest of their ids, sorted as strings and joined by commas (of nothing, if none). A null, empty or
    wordless text has zeros; an item without words has no windows. Rows of items that share an id are one item; one without
    an id hits words but isn't among the items. Null doc_ids and repeated rows are rows like others. Empty documents give an
    empty result, an empty benchmark no hits; further columns are left out.
    """
    hits, owners = benchmark_hits(docs, items, window, size, threshold)
    words = covered(hits)
    named = hits.select("digest", "window_id").distinct().join(owners.where("item_id is not null"), "window_id").select("digest", F.col("item_id").cast("string").alias("item")).distinct()
    listed = named.groupBy("digest").agg(F.sort_array(F.collect_list("item")).alias("all"))  # of one text: items that it holds
    found = words.join(listed, "digest", "left").select("digest", "n_hit", F.coalesce(F.size("all"), F.lit(0)).alias("n_items"), F.sha2(F.array_join("all", ","), 256).alias("items_sha256"))
    found = materialize(found, "found")
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(small(found, found.count()), "digest", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.greatest(F.coalesce("n_items", F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE, threshold: float = 1.0) -> DataFrame:
    """docs (all columns) without those that hold a window of an item."""
    hits, _ = benchmark_hits(docs, items, window, size, threshold)
    dirty = materialize(hits.select("digest").distinct(), "dirty")
    n = dirty.count()
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return by_place(docs, lambda rows: rows.withColumn("digest", digest).join(small(dirty, n), "digest", "left_anti"))
