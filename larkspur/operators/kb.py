"""Knowledge-base operators: anchors, titles, redirects, link probabilities, n-gram counts, portals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from larkspur.functions.text import normalized_title, portal_name, uri_title
from larkspur.operators import ngrams
from larkspur.operators.tables import BROADCAST_ROWS, hinted, parts
from larkspur.storage import materialize

#: Shares of the places of a pattern's head.
SALTS = 8
#: Places of n-grams that count as one row of a task, as they come packed.
PACKED = 2
#: What is between white space as the JVM's patterns take it, and words of a text that are sent on at once.
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
SPAN_ROWS = 20_000


def anchor_pages(links: DataFrame, anchor: str, page: str) -> DataFrame:
    """(anchor, pages): for each anchor ``page=count`` in ascending order of count, then page, joined by ``|``."""
    counts = links.groupBy(anchor, page).agg(F.count("*").alias("cnt"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cnt", page))), lambda x: F.concat_ws("=", x[page], x["cnt"].cast("string")))
    return counts.groupBy(anchor).agg(F.concat_ws("|", listed).alias("pages"), F.sum("cnt").alias("total"))


def summed_anchors(rows: DataFrame) -> DataFrame:
    """(anchor, page_id, cnt) with counts of repeated pairs summed."""
    return rows.groupBy("anchor", "page_id").agg(F.sum("cnt").alias("cnt"))


def with_titles(anchors: DataFrame, titles: DataFrame) -> DataFrame:
    """Anchors (title, ...) with ``page_id``, the page (id) of their normalized title, and whether they are skipped for having none."""
    keyed = anchors.withColumn("title_norm", normalized_title(F.col("title")))
    pages = titles.groupBy(normalized_title(F.col("title")).alias("title_norm")).agg(F.min("id").alias("page_id"))
    return keyed.join(pages, "title_norm", "left").withColumn("skipped", F.col("page_id").isNull())


def with_redirects(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Titles (title_norm, page_id) and those of aliases (uri, target_uri), whose blanks are underscores too."""
    named = aliases.select(
        normalized_title(uri_title(F.col("uri"))).alias("alias"), normalized_title(uri_title(F.col("target_uri"))).alias("title_norm")
    )
    return titles.unionByName(named.join(titles, "title_norm").select(F.col("alias").alias("title_norm"), "page_id"))


def disambiguation_anchors(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """(anchor, page_id, cnt = 1) of disambiguation titles (uri, target_uri) without their suffix."""
    rows = pages.select(uri_title(F.col("uri")).alias("anchor"), normalized_title(uri_title(F.col("target_uri"))).alias("title_norm"))
    return rows.join(titles, "title_norm").select("anchor", "page_id", F.lit(1).alias("cnt"))


def link_probabilities(senses: DataFrame, seen: DataFrame) -> DataFrame:
    """Senses (anchor, page, cnt) with commonness, and the anchor's link probability from (anchor, lp).

    Commonness is the share of the anchor's links; the probability is links over the most of lp, links and senses.
    """
    totals = senses.groupBy("anchor").agg(F.sum("cnt").alias("total"), F.count("*").alias("n_senses"))
    rows = senses.join(totals, "anchor").join(seen, "anchor")
    least = F.greatest(F.col("lp"), F.col("total"), F.col("n_senses"))
    return rows.select(
        "anchor", "page", "cnt", F.round(F.col("cnt") / F.col("total"), 6).alias("commonness"), F.round(F.col("total") / least, 6).alias("link_prob")
    )


def following_words(docs: DataFrame, words: str, most: int, *keep: str) -> DataFrame:
    """A row for each word of an array: the kept columns, ``start``, and ``w1`` to ``w<most>``, the word and those after it.

    Words beyond the end are null. The array is zipped with its own tails, so no n-gram is made before it is asked for.
    """
    names = [f"w{i}" for i in range(1, most + 1)]
    tails = [F.slice(words, F.lit(i), F.greatest(F.size(words) - (i - 1), F.lit(0))).alias(name) for i, name in enumerate(names, 1)]
    rows = docs.where(F.size(words) > 0).select(*keep, F.posexplode(F.arrays_zip(*tails)).alias("start", "w"))
    return rows.select(*keep, "start", *[F.col(f"w.{name}").alias(name) for name in names])


def window_text(n: int) -> Column:
    """The first n words of a row of following_words()."""
    return F.concat_ws(" ", *[F.col(f"w{i}") for i in range(1, n + 1)])


def window_structs(most: int) -> Column:
    """Array of (n, gram) of the windows of 1 to most words of following_words() rows; null where a window isn't whole."""
    whole = lambda n: F.struct(F.lit(n).alias("n"), window_text(n).alias("gram"))
    return F.array(*[F.when(F.col(f"w{n}").isNotNull(), whole(n)) for n in range(1, most + 1)])


def ngram_counts(docs: DataFrame, words: Column, most: int = 5) -> DataFrame:
    """(n, ngram, cnt) of all n-grams, up to a length, of arrays of words without blanks, or of texts' words between white space.

    All lengths at a place are counted by one task, which the rarer of its first two words names, so neighbouring places often go to the
    same one. They are sent as one run of words, and the runs of many texts compressed for each task, of which there are as many as the
    number of words asks for. Pairs of frequent words name no task: their places are summed before, and dealt by three words.
    """
    held, spark = docs.select(words.alias("words")), docs.sparkSession
    often = held.mapInArrow(ngrams.seen, "word string, cnt bigint").groupBy("word").agg(F.sum("cnt").alias("cnt"))
    often = often.orderBy(F.col("cnt").desc(), "word").limit(ngrams.FLOOR + 1).collect()
    total = next((r.cnt for r in often if r.word is None), 0)
    n_parts = parts(spark, total // PACKED)
    frequent = [r.word for r in often if r.word is not None and r.cnt * n_parts * 2 > total]
    named = spark.range(32 * n_parts).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n_parts)).alias("part")).agg(F.min("id").alias("id"))
    heads = {r.part: r.id for r in named.collect()}  # a number that Spark deals to each task
    pack = partial(ngrams.pack, most=most, frequent=frequent, heads=[heads.get(i, i) for i in range(n_parts)])
    runs = held.mapInArrow(pack, "head int, size bigint, data binary").repartition(n_parts, "head")
    return runs.mapInArrow(partial(ngrams.count, most=most), "n int, ngram string, cnt bigint")


def merged_counts(*runs: DataFrame) -> DataFrame:
    """Counts (n, ngram, cnt) of several runs, summed."""
    rows = runs[0]
    for run in runs[1:]:
        rows = rows.unionByName(run)
    return rows.groupBy("n", "ngram").agg(F.sum("cnt").alias("cnt"))


def best_senses(senses: DataFrame) -> DataFrame:
    """(anchor, pages): pages by descending count, then id."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), F.col("page"))))
    return senses.groupBy("anchor").agg(F.transform(ranked, lambda x: x["page"]).alias("pages"))


def portal_pages(templates: DataFrame) -> DataFrame:
    """(name, ids): pages of each portal template in order."""
    rows = templates.where(F.lower("template").startswith("portale:")).select("page_id", portal_name(F.col("template")).alias("name"))
    return rows.groupBy("name").agg(F.array_sort(F.collect_list("page_id")).alias("ids"))


def split_templates(pages: DataFrame) -> DataFrame:
    """id with its portal template ids and its other template ids, both sorted."""
    portal = lambda t: F.lower(t["name"]).startswith("portale:")
    ids = lambda keep: F.array_sort(F.transform(F.filter("templates", keep), lambda t: t["id"]))
    return pages.select("id", ids(portal).alias("portals"), ids(lambda t: ~portal(t)).alias("others"))


def word_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, start, stop): lower-case words between white space with offsets in characters, found text by text, without a shuffle."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = WORD.finditer(batch.column(1)[i].as_py() or "")
                while some := list(islice(found, SPAN_ROWS)):
                    keys = batch.column(0).take(pa.array([i] * len(some), pa.int32()))
                    words = pa.array([m[0] for m in some], pa.string())
                    starts, stops = (pa.array([m.span()[k] for m in some], pa.int32()) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([keys, words, starts, stops], names=["key", "word", "start", "stop"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([StructField("key", rows.schema["key"].dataType), *StructType.fromDDL("word string, start int, stop int")])
    return rows.mapInArrow(find, schema).select(F.col("key").alias(key), F.lower("word").alias("word"), "start", "stop")


def dictionary_hits(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, hits): how many words of (doc_id, words) are in a dictionary (word); documents without hits have 0.

    Words meet a small dictionary, which is counted, where they are; else they are counted within their document before they shuffle.
    """
    dictionary = materialize(dictionary.select("word").distinct(), "dictionary")
    if (n_words := dictionary.count()) <= BROADCAST_ROWS:
        hits = docs.select("doc_id", F.explode("words").alias("word")).join(hinted(dictionary, n_words), "word").groupBy("doc_id").agg(F.count("*").alias("hits"))
        return docs.select("doc_id").distinct().join(hits, "doc_id", "left").select("doc_id", F.coalesce("hits", F.lit(0)).alias("hits"))
    counts = docs.select("doc_id", F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    hits = counts.join(dictionary, "word").groupBy("doc_id").agg(F.sum("n").alias("hits"))
    return docs.select("doc_id").distinct().join(hits, "doc_id", "left").select("doc_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def match_spots(tokens: DataFrame, titles: DataFrame, most: int = 5, least_chars: int = 3) -> DataFrame:
    """(doc_id, start, n, spot, title): the longest dictionary match at each start of (doc_id, words); overlaps stay.

    A window of up to ``most`` words matches the same words, or, with five words, a six-word title that begins with them
    (five of six is above the similarity of 0.8). Only words that begin a title make windows, and only of lengths that
    titles have: equi-joins, no comparison of all pairs.
    """
    names = titles.select(F.col("title")).distinct()
    parts = F.split("title", " ")
    longer = names.where(F.size(parts) == 6).select(F.array_join(F.slice(parts, 1, 5), " ").alias("spot"), F.col("title"))
    keys = names.select(F.col("title").alias("spot"), "title").unionByName(longer)
    keys = keys.where(F.length("spot") >= least_chars).groupBy("spot").agg(
        F.min(F.struct((F.col("spot") != F.col("title")).alias("near"), "title")).alias("t")
    )
    keys = keys.select("spot", "t.title", F.size(F.split("spot", " ")).alias("n")).where(F.col("n") <= most)
    keys = materialize(keys, "spots")
    n_keys, longest = keys.agg(F.count("*"), F.max("n")).first()
    if not n_keys:
        return tokens.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("spot"), F.lit("").alias("title")).where("false")
    heads = keys.select(F.substring_index("spot", " ", 1).alias("w1")).distinct()
    begun = following_words(tokens, "words", longest, "doc_id").join(hinted(heads, n_keys), "w1", "left_semi")
    found = begun.select("doc_id", "start", F.explode(window_structs(longest)).alias("g")).where("g is not null")
    found = found.select("doc_id", "start", F.col("g.n").alias("n"), F.col("g.gram").alias("spot")).join(hinted(keys.select("spot", "title"), n_keys), "spot")
    best = found.groupBy("doc_id", "start").agg(F.max(F.struct("n", "spot", "title")).alias("best"))
    return best.select("doc_id", "start", "best.n", "best.spot", "best.title")


def dictionary_titles(titles: DataFrame, most_words: int = 3, least_chars: int = 3) -> DataFrame:
    """Titles short enough for a dictionary of spots."""
    return titles.where((F.size(F.split("title", " ")) <= most_words) & (F.length("title") >= least_chars)).select("title").distinct()


def find_patterns(docs: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, pattern): every place of every pattern in the texts, inside words too.

    Patterns are met on their first characters by equi-joins, those of each number of characters (1, 2, 4 or 8, the most
    that a pattern has) for themselves, then compared whole: no text is held against each pattern in turn. A head is
    dealt out by its place in the text as well (``SALTS``), so that a frequent one isn't one task's.
    """
    known = patterns.select("pattern").where("pattern != ''").distinct()
    size = F.length("pattern")
    width = F.when(size >= 8, 8).when(size >= 4, 4).when(size >= 2, 2).otherwise(1)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    heads = known.select("pattern", width.alias("width"), salts).withColumn("head", F.expr("substring(pattern, 1, width)"))
    used = known.groupBy(width.alias("width")).agg(F.max(size).alias("longest")).collect()  # four rows at most
    if not used:
        return docs.select(key, F.lit(0).alias("start"), F.lit("").alias("pattern")).where("false")
    widths = F.array(*[F.struct(F.lit(r["width"]).alias("width"), F.lit(r["longest"]).alias("longest")) for r in used])
    places = docs.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(1), F.length(text))).alias("at"))
    places = places.select(key, text, "at", F.explode(widths).alias("w")).where(F.col("at") + F.col("w.width") - 1 <= F.length(text))
    places = places.select(
        key, "at", F.col("w.width").alias("width"), F.substring(text, F.col("at"), F.col("w.width")).alias("head"),
        F.substring(text, F.col("at"), F.col("w.longest")).alias("tail"), F.pmod(F.col("at"), F.lit(SALTS)).alias("salt"),
    )
    found = places.join(heads, ["width", "head", "salt"]).where(F.startswith("tail", "pattern"))
    return found.select(key, (F.col("at") - 1).alias("start"), "pattern")


def resolved(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pages with the target of those that only stand for another: (page, target) as in graph.redirects."""
    return pages.join(aliases, "page", "left").select("page", F.coalesce("target", "page").alias("entity"))
