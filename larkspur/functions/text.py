"""Text functions as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that aren't hashtags, and the length from which a retweet may be cut.
HASHTAG_STOPWORDS = ("rt",)
TRIMMED_FROM = 135
URL = r"https?://\S+"
MENTION = r"@\w+"
# Patterns of retweet marks and of tokens without content.
RETWEET_MARK = r"^RT\s*(:\s*)*"
NOISE = r"(?i)\s?\W(#rt|XD|rt)\W?\s?"


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def hashtags(text: Column, entities: Column | None = None, stopwords: tuple[str, ...] = HASHTAG_STOPWORDS) -> Column:
    """Distinct lower-case hashtags in order, from entities where there are any, else from the text."""
    found = F.regexp_extract_all(text, F.lit(r"#(\w+)"), 1)
    if entities is not None:
        found = F.coalesce(F.transform(entities, lambda e: e["text"]), found)
    lower = F.array_distinct(F.transform(found, F.lower))
    return F.array_sort(F.array_except(lower, F.array(*[F.lit(w) for w in stopwords])))


def without(words: Column, stopwords: tuple[str, ...]) -> Column:
    """Distinct words in order without stop words."""
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in stopwords])))


def interesting(text: Column, lang: Column, wanted: str, hits: Column, total: Column, tags: Column) -> Column:
    """Whether a tweet has a text, a user of the wanted language, words of that language, and more than one hashtag."""
    return text.isNotNull() & (lang == wanted) & valid_language(hits, total) & (F.size(tags) > 1)


def sanitize(text: Column) -> Column:
    """A tweet without URLs, mentions, retweet marks and repeated blanks; a cut retweet loses its last word."""
    was_cut = text.startswith("RT") & (F.length(text) >= TRIMMED_FROM)
    clean = F.regexp_replace(F.regexp_replace(text, URL, ""), MENTION, "")
    clean = F.regexp_replace(clean, RETWEET_MARK, "")
    clean = F.regexp_replace(clean, NOISE, " ")
    clean = F.regexp_replace(clean, r"\s+", " ")
    cut = F.regexp_extract(clean, r"^(.*) [^ ]* (?:\.\.\.|…)$", 1)
    return F.when(was_cut & (cut != ""), cut).otherwise(F.trim(clean))


def strip_word(word: Column) -> Column:
    """A word without punctuation at its edges."""
    return F.regexp_replace(F.regexp_replace(word, r"""^['":;,.]+""", ""), r"""['":,.]+$""", "")


# Morphology tags and the lexicon classes that they stand for.
WORD_CLASSES = {"VER": "v", "DET-INDEF": "a", "NOUN-M": "n", "NOUN-F": "n"}


# First letters of a second tagger's tags and the lexicon classes that they stand for.
TAG_LETTERS = {"V": "v", "A": "a", "S": "n", "B": "r"}


def tag_class(tag: Column) -> Column:
    """Lexicon class of a tag by its first letter; null for other tags."""
    table = F.create_map(*[F.lit(x) for pair in TAG_LETTERS.items() for x in pair])
    return F.try_element_at(table, F.upper(F.substring(tag, 1, 1)))


def word_class(features: Column) -> Column:
    """Lexicon class of ``TAG:...`` features; null for other tags, so that all classes are looked up. No features: noun."""
    tag = F.substring_index(features, ":", 1)
    table = F.create_map(*[F.lit(x) for pair in WORD_CLASSES.items() for x in pair])
    return F.when(features.isNull(), F.lit("n")).otherwise(F.try_element_at(table, tag))


def normalized_title(title: Column) -> Column:
    """A title trimmed, in lower case, with underscores for blanks."""
    return F.replace(F.lower(F.trim(title)), F.lit(" "), F.lit("_"))


def uri_title(uri: Column) -> Column:
    """Title at the end of a resource URI: lower case, blanks for underscores, without the disambiguation suffix."""
    tail = F.replace(F.regexp_replace(F.substring_index(uri, "/resource/", -1), ">$", ""), F.lit("_"), F.lit(" "))
    return F.regexp_replace(F.lower(tail), r" \(disambigua\)$", "")


def tweet_time(created_at: Column) -> Column:
    """Timestamp of ``Sun Apr 22 16:11:51 +0000 2012``; null if it doesn't parse."""
    return F.try_to_timestamp(F.substring(created_at, 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))


def sort_time(ts: Column) -> Column:
    """``yyyy/MM/dd HH:mm:ss``."""
    return F.date_format(ts, "yyyy/MM/dd HH:mm:ss")


def log_time(ts: Column) -> Column:
    """``HH:mm:ss`` with the zone's offset."""
    return F.date_format(ts, "HH:mm:ssZ")


def links(html: Column) -> Column:
    """Array of (href, anchor) of links whose content has no element."""
    hrefs = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"[^>]*>([^<]*)</a>'), 1)
    texts = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"[^>]*>([^<]*)</a>'), 2)
    return F.arrays_zip(hrefs.alias("href"), texts.alias("anchor"))


def wiki_links(html: Column) -> Column:
    """Array of (anchor, title) of links to /wiki/ pages that have a title and no element inside."""
    pattern = F.lit(r'<a (?=[^>]*href="/wiki/)[^>]*title="([^"]*)"[^>]*>([^<]+)</a>')
    return F.arrays_zip(F.regexp_extract_all(html, pattern, 2).alias("anchor"), F.regexp_extract_all(html, pattern, 1).alias("title"))


def plain_text(html: Column) -> Column:
    """Lower-case text of HTML: no scripts, styles, tags, edit marks or repeated blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    bare = F.replace(F.lower(bare), F.lit("[modifica]"), F.lit(""))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def one_line(text: Column, carriage: bool = False) -> Column:
    """Text without newlines and tabs (and carriage returns)."""
    return F.regexp_replace(text, r"[\n\t\r]" if carriage else r"[\n\t]", "")


def portal_name(name: Column) -> Column:
    """A portal template's name without prefix and icon suffix."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)^portale:", ""), r"(?i)/?icona?[^/]*$", ""))


def geo_json(geo: Column) -> Column:
    """Coordinates as JSON text, ``null`` where there are none."""
    return F.coalesce(F.to_json(geo), F.lit("null"))


def translation_words(words: Column) -> Column:
    """Words of a translation cell: cut at blanks, blanks for underscores, no empty ones."""
    return F.filter(F.transform(F.split(words, " "), lambda w: F.trim(F.replace(w, F.lit("_"), F.lit(" ")))), lambda w: w != "")


def project_paths(record: Column, expression: str) -> Column:
    """A comma list of paths (``a/b`` descends) into a JSON text, joined by tabs; a missing path is empty."""
    paths = ["$." + p.strip().replace("/", ".") for p in expression.split(",")]
    return F.concat_ws("\t", *[F.coalesce(F.get_json_object(record, p), F.lit("")) for p in paths])


def valid_language(hits: Column, total: Column) -> Column:
    """Whether a phrase is in the word list's language: 3 hits among up to 4 words, else more than half."""
    return F.when(total <= 4, hits >= 3).otherwise(hits > total / 2)


def fits(name: Column, pattern: str) -> Column:
    """Whether a name fits a pattern in which ``*`` stands for anything and all else for itself."""
    return name.like(pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def relatedness(a: Column, b: Column, both: Column, universe: Column) -> Column:
    """Link distance of two pages with a and b in-links, both of them shared; 0 without shared ones."""
    top = F.log(F.greatest(a, b)) - F.log(both)
    return F.when(both > 0, top / (F.log(universe) - F.log(F.least(a, b)))).otherwise(F.lit(0.0))


def objectivity(pos: Column, neg: Column) -> Column:
    """What is neither positive nor negative."""
    return F.lit(1.0) - (pos + neg)


def response_status(status: Column, remaining: Column) -> Column:
    """Class of a response; an empty allowance counts before the status."""
    return (
        F.when(remaining == 0, "ban").when(status.between(500, 503), "limit").when(status == 401, "notauth")
        .when(status == 404, "notfound").when(status == 200, "ok").otherwise("unk")
    )


def sleep_seconds(reset: Column, now: Column) -> Column:
    """Seconds to wait for a new allowance."""
    return F.greatest(reset - now + 1, F.lit(4))


def pack_u64(value: Column) -> Column:
    """Eight big-endian bytes of an unsigned integer."""
    return F.unhex(F.lpad(F.conv(value.cast("string"), 10, 16), 16, "0"))


def pack_u32(value: Column) -> Column:
    """Four big-endian bytes of an unsigned integer below 2^32; null for others."""
    return F.when(value.between(0, (1 << 32) - 1), F.unhex(F.lpad(F.hex(value.cast("bigint")), 8, "0")))


def unpack_u32(raw: Column) -> Column:
    """The unsigned integer of four big-endian bytes."""
    return F.conv(F.hex(raw), 16, 10).cast("bigint")


def unpack_f32(raw: Column) -> Column:
    """The number of four big-endian bytes of an IEEE 754 single; infinities and NaNs are null."""
    bits = unpack_u32(raw)
    exponent, part = F.shiftright(bits, 23).bitwiseAND(0xFF), bits.bitwiseAND(0x7FFFFF)
    sign = F.when(bits >= 1 << 31, F.lit(-1.0)).otherwise(F.lit(1.0))
    normal = (F.lit(1.0) + part / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), exponent - 127)
    small = part / F.lit(float(1 << 23)) * F.lit(2.0**-126)
    return F.when(exponent == 255, F.lit(None)).otherwise(sign * F.when(exponent == 0, small).otherwise(normal))


def pack_f32(value: Column) -> Column:
    """Four big-endian bytes of the IEEE 754 single that the number is cast to; null for infinities, NaN and subnormal ones."""
    x = value.cast("float").cast("double")
    size = F.abs(x)
    exponent = F.floor(F.log2(size))
    exponent = exponent + F.when(F.pow(F.lit(2.0), exponent + 1) <= size, 1).when(F.pow(F.lit(2.0), exponent) > size, -1).otherwise(0)
    part = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 23)).cast("bigint")
    bits = F.when(x == 0, F.lit(0).cast("bigint")).otherwise((exponent.cast("bigint") + 127) * (1 << 23) + part)
    bits = bits + F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0))
    return F.when((size == 0) | (size >= 2.0**-126) & (size < float("inf")), pack_u32(bits))


def unpack_u64(raw: Column) -> Column:
    """The unsigned integer of eight big-endian bytes."""
    return F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")
