"""Sinks: sorted timelines, JSON lines, TSV, metric lines, GraphML, side outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.readers import shard_of


def write_timelines(tweets: DataFrame, path: str, user: str = "user_id", order: str = "tweet_id") -> None:
    """JSON lines by shard and user, newest first within a user; the committer makes the job all-or-nothing.

    Rows are dealt by ranges of shard, user and id, so a shard or a user of many rows is several tasks' and files'.
    """
    rows = tweets.withColumn("shard", shard_of(F.col(user)))
    keys = ("shard", user, F.col(order).desc())
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("shard").option("compression", "gzip").json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Gzip JSON lines with keys in order."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("compression", "gzip").json(path)


def write_json_and_tsv(rows: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """JSON lines of whole records and a tab-separated projection of them, from one persisted frame."""
    held = rows.persist()
    try:
        write_json_lines(held, f"{path}/json")
        held.select(*columns).write.mode("overwrite").option("sep", "\t").csv(f"{path}/tsv")
    finally:
        held.unpersist()


def metric_lines(metrics: DataFrame) -> DataFrame:
    """``label value unix_ts`` of (label, value, ts)."""
    return metrics.select(F.format_string("%s %d %d", "label", "value", F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Gzip text of a single string column."""
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def write_split(rows: DataFrame, path: str, outputs: dict[str, Column]) -> None:
    """One output folder for each filter, from one persisted frame."""
    held = rows.persist()
    try:
        for name, condition in outputs.items():
            held.where(condition).write.mode("overwrite").json(f"{path}/{name}")
    finally:
        held.unpersist()


def escape_xml(text: Column) -> Column:
    """Text for an XML attribute or element."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def graphml_lines(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(section, line) of a GraphML document from nodes (id, label) and edges (id, source, target, label).

    Sections are numbered in document order, so sorting by (section, line) gives a document; nothing is collected.
    """
    spark = nodes.sparkSession
    kind = "directed" if directed else "undirected"
    head = [
        (0, '<?xml version="1.0" encoding="UTF-8"?>'), (1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'),
        (2, '<key id="label" for="all" attr.name="label" attr.type="string"/>'), (3, f'<graph id="G" edgedefault="{kind}">'),
        (6, "</graph>"), (7, "</graphml>"),
    ]
    node = F.format_string('<node id="%d"><data key="label">%s</data></node>', F.col("id"), escape_xml(F.col("label")))
    edge = F.format_string(
        '<edge id="%d" source="%d" target="%d"><data key="label">%s</data></edge>', F.col("id"), F.col("source"), F.col("target"), escape_xml(F.col("label"))
    )
    frame = spark.createDataFrame(head, "section int, line string")
    return frame.unionByName(nodes.select(F.lit(4).alias("section"), node.alias("line"))).unionByName(
        edges.select(F.lit(5).alias("section"), edge.alias("line"))
    )


def report_rows(annotated: DataFrame) -> DataFrame:
    """An HTML table row for each annotation record: spans of the annotations in a tweet's text."""
    spans = F.array_join(
        F.transform("annotations", lambda a: F.concat(F.lit('<span title="'), F.format_string("%.3f", a["rho"]), F.lit('">'), escape_xml(a["title"]), F.lit("</span>"))),
        " ",
    )
    return annotated.select(F.concat(F.lit("<tr><td>"), escape_xml(F.col("tweet")), F.lit("</td><td>"), spans, F.lit("</td></tr>")).alias("value"))


def nested_spans(text: Column, annotations: Column) -> Column:
    """The text as HTML with a link around each annotation's span (start, end, spot, title, rho); inner ones lie inside outer ones.

    Tags are sorted by place: at one place ends come before starts, inner ends before outer ones, and outer starts before
    inner ones; text between them is escaped.
    """

    def opening(a: Column) -> Column:
        named = [F.lit("<a href='#' data-spot='"), escape_xml(a["spot"]), F.lit("' data-title='"), escape_xml(a["title"])]
        tag = F.concat(*named, F.lit("' data-rho='"), a["rho"].cast("string"), F.lit("'>"))
        return F.struct(a["start"].alias("at"), F.lit(1).alias("kind"), (-a["end"]).alias("rank"), tag.alias("tag"))

    def ending(a: Column) -> Column:
        return F.struct(a["end"].alias("at"), F.lit(0).alias("kind"), (-a["start"]).alias("rank"), F.lit("</a>").alias("tag"))

    tags = F.array_sort(F.concat(F.transform(annotations, opening), F.transform(annotations, ending)))

    def add(state: Column, tag: Column) -> Column:
        between = escape_xml(F.substring(text, state["at"] + 1, tag["at"] - state["at"]))
        return F.struct(F.concat(state["out"], between, tag["tag"]).alias("out"), tag["at"].alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda s: F.concat(s["out"], escape_xml(F.substring(text, s["at"] + 1, F.length(text))))
    return F.aggregate(tags, start, add, rest)


def snapshot(rows: DataFrame, sampled: DataFrame, key: str, path: str) -> None:
    """Writes the rows of sampled keys."""
    rows.join(sampled.select(key).distinct(), key, "left_semi").write.mode("overwrite").parquet(path)
