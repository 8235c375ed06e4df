"""Lexicon sentiment: words to lemmas to synsets to translations to scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import objectivity, translation_words, word_class
from larkspur.operators.tables import hinted


def lookup_chain(
    words: DataFrame, morphology: DataFrame, index: DataFrame, synsets: DataFrame, scores: DataFrame,
    classes: Callable[[Column], Column] = word_class, drop_unknown: bool = False,
) -> DataFrame:
    """A row for each score that a word leads to.

    words: (doc, pos, word); morphology: (word, lemma, features); index: (lemma, class, synsets: ids apart by blanks);
    synsets: (synset, words); scores: (term, class, pos_score, neg_score). A word without morphology is a noun of
    itself; one whose tag has no class is looked up in all classes, or goes if drop_unknown says so. ``classes`` gives the
    class of a tagger's features: text.word_class, or text.tag_class of another tagger. The tables of the lexicon are counted, so
    that words don't shuffle to meet small ones.
    """
    morphology, index, synsets, scores = (hinted(df, df.count()) for df in (morphology, index, synsets, scores))
    tagged = words.join(morphology, "word", "left").withColumn("lemma", F.coalesce("lemma", "word")).withColumn("cls", classes(F.col("features")))
    if drop_unknown:
        tagged = tagged.where("cls is not null")
    own = index.select("lemma", F.col("class").alias("i_cls"), F.explode(F.split("synsets", " ")).alias("synset"))
    found = tagged.join(own, "lemma").where(F.col("cls").isNull() | (F.col("cls") == F.col("i_cls")))
    terms = found.join(synsets.select("synset", F.explode(translation_words(F.col("words"))).alias("term")), "synset")
    values = scores.select("term", F.col("class").alias("s_cls"), "pos_score", "neg_score")
    rows = terms.join(values, "term").where(F.col("i_cls") == F.col("s_cls"))
    return rows.select("doc", "pos", "word", "synset", "term", "pos_score", "neg_score", objectivity(F.col("pos_score"), F.col("neg_score")).alias("obj_score"))


def scores_at(wanted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Scores of the wanted (pos, offset) pairs; those that the lexicon lacks go."""
    scored = lexicon.select("pos", "offset", "pos_score", "neg_score", objectivity(F.col("pos_score"), F.col("neg_score")).alias("obj_score"))
    return wanted.join(scored, ["pos", "offset"])


def scores_named(names: DataFrame, synsets: DataFrame, lexicon: DataFrame, pos: str | None = None) -> DataFrame:
    """Scores of the synsets (name, pos, offset, words) of the names' words (word), of one class or of all; those without scores go."""
    rows = synsets.where(F.col("pos") == pos) if pos else synsets
    rows = rows.select("name", "pos", "offset", F.explode("words").alias("word"))
    return scores_at(names.join(rows, "word"), lexicon)


def all_scores(synsets: DataFrame, lexicon: DataFrame) -> DataFrame:
    """All synsets that have scores."""
    return scores_at(synsets.select("name", "pos", "offset"), lexicon)


def word_scores(rows: DataFrame) -> DataFrame:
    """Mean scores of each word and the running means over the document's words up to it.

    Scores are summed for each word first, so the window holds one row a word of a document.
    """
    names = ("pos_score", "neg_score", "obj_score")
    sums = rows.groupBy("doc", "pos", "word").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names])
    so_far = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("n").over(so_far)
    return sums.select(
        "doc", "pos", "word",
        *[F.round(F.col(c) / F.col("n"), 6).alias(f"mean_{c}") for c in names],
        *[F.round(F.sum(c).over(so_far) / run, 6).alias(f"running_{c}") for c in names],
    )
