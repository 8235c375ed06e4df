"""Batch sources: timelines, target lists, triples, lexicons, encyclopedia records.

All of them are Spark readers with a fixed schema, so projections and filters reach the scan. Gzip files aren't
splittable: one file is one task until the first shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import geo_json, normalized_title, one_line, sort_time, tweet_time
from larkspur.sources.schemas import ANCHOR, SENTIMENT_LEXICON, TWEET, WIKI_PAGE
from larkspur.storage import materialize

#: Last path component without .gz, whose name before the dot is the user's id.
FILE_ID = r"([0-9]+)\.[a-z]+(?:\.gz)?$"


def file_user_id(path: Column) -> Column:
    """User id of a ``<first two digits>/<id>.twt[.gz]`` path; null for other names."""
    digits = F.regexp_extract(path, FILE_ID, 1)
    return F.when(digits != "", digits.cast("decimal(20,0)"))


def shard_of(user_id: Column) -> Column:
    """The folder of a user's files: the first two digits of the id."""
    return F.substring(user_id.cast("string"), 1, 2)


def json_lines(spark: SparkSession, path: str, schema: str, extension: str = "json", tolerant: bool = True) -> DataFrame:
    """JSON lines (gzip or not) below a folder. Lines that don't parse are left out; corrupt files too if tolerant."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}*")
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    # A filter on the corrupt column alone isn't allowed over raw JSON, one with data columns is.
    return reader.json(path).where("_corrupt is null").drop("_corrupt")


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    """Tweets of all ``.twt`` and ``.twt.gz`` files with the user's id from the file name. Bad lines are left out."""
    return json_lines(spark, path, TWEET, "twt").withColumn("file_user", file_user_id(F.input_file_name()))


def read_wiki_pages(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """Encyclopedia pages with their links, templates and categories; to go on where a run stopped, those after a page id."""
    pages = json_lines(spark, path, WIKI_PAGE)
    return pages if after is None else pages.where(F.col("id") > after)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(anchor, title, cnt): anchor records with one row a page."""
    return json_lines(spark, path, ANCHOR).select("anchor", F.explode("pages").alias("p")).select("anchor", "p.title", "p.cnt")


def user_files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """(user_id) of every file with the extension below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}*")
    return files.load(path).select(file_user_id(F.col("path")).alias("user_id")).where("user_id is not null").distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(user_id) of a list of one integer a line; other lines are skipped."""
    return spark.read.text(path).selectExpr("try_cast(trim(value) as bigint) as user_id").where("user_id is not null")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object) of N-Triples lines cut at blanks; comments and short lines are skipped."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where("not startswith(value, '#')").where(F.size(parts) >= 3)
    return rows.select(parts[0].alias("subject"), parts[1].alias("predicate"), parts[2].alias("object"))


def lexicon_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, row) of a tab-separated lexicon without comments and empty lines; row is null where a line doesn't fit the schema."""
    lines = spark.read.text(path).where("value != '' and not startswith(value, '#')")
    kinds = [part.split() for part in SENTIMENT_LEXICON.split(", ")]
    lines = lines.select(F.col("value").alias("line"), F.split("value", "\t").alias("parts"))
    fields = [F.try_element_at("parts", F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(kinds)]
    fit = F.size("parts") == len(kinds)
    for i, (_, kind) in enumerate(kinds):
        fit = fit & F.try_element_at("parts", F.lit(i + 1)).try_cast(kind).isNotNull()
    return lines.select("line", F.when(fit, F.struct(*fields)).alias("row"))


def read_sentiment_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tab-separated lexicon; lines that begin with # and malformed ones are left out."""
    return lexicon_lines(spark, path).where("row is not null").select("row.*")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a sentiment lexicon that read_sentiment_lexicon() leaves out, but for comments and empty lines."""
    return lexicon_lines(spark, path).where("row is null").select("line")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows with a given schema."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def timeline_page(tweets: DataFrame, user_id: int, since_id: int | None = None, max_id: int | None = None, size: int = 200) -> DataFrame:
    """One page of a user's timeline, newest first: ids above since_id and up to max_id."""
    rows = tweets.where(F.col("user_id") == user_id)
    if since_id is not None:
        rows = rows.where(F.col("tweet_id") > since_id)
    if max_id is not None:
        rows = rows.where(F.col("tweet_id") <= max_id)
    return rows.orderBy(F.col("tweet_id").desc()).limit(size)


def follower_page(followers: DataFrame, user_id: int, cursor: int = 0, size: int = 500) -> DataFrame:
    """One page of a user's followers from a cursor on, with the cursor of the next page; 0 after the last."""
    rows = followers.where((F.col("user_id") == user_id) & (F.col("pos") >= cursor)).orderBy("pos").limit(size + 1)
    ahead = F.max("pos").over(Window.partitionBy("user_id"))
    page = rows.withColumn("last", ahead).withColumn("next_cursor", F.when(F.col("last") >= cursor + size, F.lit(cursor + size)).otherwise(F.lit(0)))
    return page.where(F.col("pos") < cursor + size).drop("last")


def follower_pages(followers: DataFrame, size: int = 500) -> DataFrame:
    """(user_id, cursor, next_cursor, n, ids): all pages of all users at once, in the order of pos; next_cursor is 0 after the last.

    What a loop over follower_page() would fetch one by one: a page is a group of at most ``size`` rows, and a user of any number of
    followers is many groups. Places must be numbered from 0 within a user.
    """
    at = F.floor(F.col("pos") / size) * size
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "follower_id"))), lambda x: x["follower_id"])
    pages = followers.groupBy("user_id", at.cast("bigint").alias("cursor")).agg(F.count("*").alias("n"), ids.alias("ids"))
    last = followers.groupBy("user_id").agg(F.max("pos").alias("last"))
    after = F.when(F.col("cursor") + size <= F.col("last"), F.col("cursor") + size).otherwise(F.lit(0)).cast("bigint")
    return pages.join(last, "user_id").select("user_id", "cursor", after.alias("next_cursor"), "n", "ids")


def fetch_all(page: Callable[[int], DataFrame], cursor: int = 0, most: int = 10_000) -> DataFrame:
    """The rows of a source that gives pages by cursor, one after another until there is none behind: the loop of a crawl that starts at ``cursor``.

    page(cursor) gives a page with next_cursor. Each page is written out before the next one is asked for, so the source sees each
    cursor once, and a plan doesn't grow with the pages; a cursor that comes twice, or more than ``most`` pages, ends in an error.
    """
    seen: set[int] = set()
    out: DataFrame | None = None
    while out is None or cursor:
        if cursor in seen or len(seen) >= most:
            raise ValueError(f"cursor {cursor} comes again" if cursor in seen else f"more than {most} pages")
        seen.add(cursor)
        now = materialize(page(cursor), "page")
        out = now if out is None else out.unionByName(now)
        row = now.select("next_cursor").first()
        cursor = row.next_cursor if row else 0
    return out.drop("next_cursor")


def tweet_rows(tweets: DataFrame) -> DataFrame:
    """(id, time, epoch_ms, user, geo, text) of tweets, in UTC; text on one line, ids in full unsigned range."""
    at = tweet_time(F.col("created_at"))
    return tweets.select(
        F.col("id_str").cast("decimal(20,0)").alias("id"), sort_time(at).alias("time"), F.unix_millis(at).alias("epoch_ms"),
        F.col("user.screen_name").alias("user"), geo_json(F.col("geo.coordinates")).alias("geo"), one_line(F.col("text")).alias("text"),
    )


def search_documents(tweets: DataFrame) -> DataFrame:
    """(id, screen_name, text, created_at, hashtags, location) of tweets, as a search table holds them."""
    place = F.when(F.size("geo.coordinates") == 2, F.struct(F.col("geo.coordinates")[0].alias("lat"), F.col("geo.coordinates")[1].alias("lon")))
    return tweets.select(
        F.col("id_str").cast("decimal(20,0)").alias("id"), F.col("user.screen_name").alias("screen_name"), "text",
        tweet_time(F.col("created_at")).alias("created_at"), F.transform("entities.hashtags", lambda h: h["text"]).alias("hashtags"), place.alias("location"),
    )


def page_mapping(pages: DataFrame) -> DataFrame:
    """(title_norm, id, title, length): one row a page."""
    return pages.select(normalized_title(F.col("title")).alias("title_norm"), "id", "title", "length")
