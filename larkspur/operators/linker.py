"""Dictionary-based entity linking: senses vote for one another inside a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def disambiguate(spots: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc, spot, page, rho): for each spot the sense that the document's other spots vote for.

    spots: (doc, spot, page, pr, lp), a row a sense; scores: (a, b, score) with a < b. A spot's vote for a sense is
    (sum of scores) * (sum of probabilities) / (number of senses); votes are averaged over the other spots, and rho is
    the mean of that and the link probability. Ties go to the more common sense, then the smaller page.
    """
    other = spots.select("doc", F.col("spot").alias("spot_b"), F.col("page").alias("page_b"), F.col("pr").alias("pr_b"))
    pairs = spots.join(other, "doc").where("spot != spot_b")
    low, high = F.least("page", "page_b"), F.greatest("page", "page_b")
    pairs = pairs.withColumn("a", low).withColumn("b", high).join(scores, ["a", "b"], "left")
    votes = pairs.groupBy("doc", "spot", "page", "pr", "lp", "spot_b").agg(
        (F.sum(F.coalesce("score", F.lit(0.0))) * F.sum("pr_b") / F.count("*")).alias("vote")
    )
    mean = votes.groupBy("doc", "spot", "page", "pr", "lp").agg(F.avg("vote").alias("vote"))
    alone = spots.join(mean, ["doc", "spot", "page", "pr", "lp"], "left")
    rho = alone.withColumn("rho", F.round((F.coalesce("vote", F.lit(0.0)) + F.col("lp")) / 2, 6))
    best = Window.partitionBy("doc", "spot").orderBy(F.col("rho").desc(), F.col("pr").desc(), "page")
    return rho.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("doc", "spot", "page", "rho")


def above_threshold(annotations: DataFrame, least: float = 0.15) -> DataFrame:
    """Annotation records with only the annotations of at least a rho."""
    return annotations.withColumn("annotations", F.filter("annotations", lambda a: a["rho"] >= least))


def flat_annotations(annotations: DataFrame) -> DataFrame:
    """(ht, page_id, rho, title): every hashtag of a record with each of its annotations."""
    return annotations.select(F.explode("hts").alias("ht"), "annotations").select("ht", F.explode("annotations").alias("a")).select(
        "ht", F.col("a.id").alias("page_id"), "a.rho", "a.title"
    )
