"""Queries over documents and pages: tokens, n-grams, anchors, titles, spots, sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import automata, graph, kb, linker, sentiment, tables
from larkspur.plans.common import Registry, table

REGISTRY = Registry()

# A small word list of one language, and stop words.
WORD_LIST = ("the", "of", "and", "to", "in", "is", "that", "was", "for", "on", "are", "with", "as", "be", "by")
#: Documents that must have a word before it counts as the language's.
LIST_LEAST = 20
STOPWORDS = ("the", "of", "and", "to", "in", "a", "is")
TOKENS = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')"


def listed(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@REGISTRY.add("""
select doc_id, regexp_replace(text, '[\\n\\t]', '', 'g') as line from documents order by doc_id desc
""")
def global_sort_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.one_line(F.col("text")).alias("line"))
    return tables.sort_distinct(docs, "doc_id", F.col("line"))


@REGISTRY.add("""
select unnest(range(11))::int as at,
  unnest(quantile_cont(o_totalprice, [1/12, 2/12, 3/12, 4/12, 5/12, 6/12, 7/12, 8/12, 9/12, 10/12, 11/12]))::double as bound from orders
""")
def range_partition_bounds(spark, sf_dir):
    return tables.range_bounds(table(spark, sf_dir, "orders"), "o_totalprice", 12).select("at", F.col("bound").cast("double").alias("bound"))


@REGISTRY.add("select doc_id, lang from documents where n_chars > 100 order by md5(cast(doc_id as varchar)), doc_id limit 100")
def deterministic_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars > 100").select("doc_id", "lang")
    return tables.sample(docs, "doc_id", 100)


@REGISTRY.add(r"""
with p as (select doc_id, regexp_extract_all(text, '[ \t\n\r\f\x0B]+|[^ \t\n\r\f\x0B]+') as parts from documents),
u as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as i from p),
o as (select doc_id, part, sum(length(part)) over (partition by doc_id order by i) as stop from u)
select doc_id, lower(part) as word, (stop - length(part))::int as start, stop::int as stop from o where regexp_matches(part, '[^ \t\n\r\f\x0B]')
""")
def token_offsets(spark, sf_dir):
    """Words with their offsets, whole texts."""
    return kb.word_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.add(f"""
with t as (select doc_id, {TOKENS} as words from documents),
c as (select doc_id, len(words) as total, len(list_filter(words, lambda w: w in ({listed(WORD_LIST)}))) as hits from t)
select doc_id, hits::int as hits, total::int as total, case when total <= 4 then hits >= 3 else hits > total / 2 end as valid from c
""")
def language_check(spark, sf_dir):
    words = text.tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    hits = F.size(F.filter("words", lambda w: w.isin(*WORD_LIST)))
    rows = rows.select("doc_id", hits.alias("hits"), F.size("words").alias("total"))
    return rows.withColumn("valid", text.valid_language(F.col("hits"), F.col("total")))


@REGISTRY.add(f"""
with t as (select {TOKENS} as w from documents), g as (
""" + " union all ".join(f"select {n} as n, array_to_string(w[i:i+{n - 1}], ' ') as ngram from (select w, unnest(range(1, len(w) - {n - 2})) as i from t)" for n in range(1, 6)) + """
) select n, ngram, count(*) as cnt from g group by 1, 2
""")
def ngram_counts(spark, sf_dir):
    return kb.ngram_counts(table(spark, sf_dir, "documents"), F.lower("text"))


@REGISTRY.add(f"""
with t as (select doc_id, {TOKENS} as w from documents)
select doc_id, array_to_string(list_sort(list_filter(list_distinct(w), lambda x: x not in ({listed(STOPWORDS)}))), ' ') as words from t
""")
def stopword_filter(spark, sf_dir):
    words = text.without(text.tokens(F.col("text")), STOPWORDS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("words"))


@REGISTRY.add(r"""
select doc_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(t, '#(\w+)', 1), lambda x: lower(x))), lambda x: x <> 'rt')), ',') as tags
from (select doc_id, regexp_replace(text, '([.] )(\w)', '\1#\2', 'g') as t from documents)
""")
def hashtags_of_documents(spark, sf_dir):
    """Hashtags of all documents, after a # was put before the words that begin a sentence."""
    marked = F.regexp_replace("text", r"([.] )(\w)", "$1#$2")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.hashtags(marked), ",").alias("tags"))


RAW_TWEET = r"'RT ' || replace(replace(text, '. ', '. @a http://x.y/z '), ', ', ' #rt ')"


@REGISTRY.add(r"""
with a as (select doc_id, """ + RAW_TWEET + r""" as t from documents),
b as (select doc_id, t, regexp_replace(regexp_replace(regexp_replace(t, 'https?://\S+', '', 'g'), '@\w+', '', 'g'), '^RT\s*(:\s*)*', '') as c from a),
c as (select doc_id, t, regexp_replace(regexp_replace(c, '(?i)\s?\W(#rt|XD|rt)\W?\s?', ' ', 'g'), '\s+', ' ', 'g') as c from b),
d as (select doc_id, t, c, regexp_extract(c, '^(.*) [^ ]* (?:\.\.\.|…)$', 1) as cut from c)
select doc_id, case when starts_with(t, 'RT') and length(t) >= 135 and cut <> '' then cut else trim(c) end as clean from d
""")
def sanitized_documents(spark, sf_dir):
    """All documents cleaned, after a retweet mark, mentions, URLs and noise were put into them."""
    raw = F.replace(F.replace("text", F.lit(". "), F.lit(". @a http://x.y/z ")), F.lit(", "), F.lit(" #rt "))
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitize(F.concat(F.lit("RT "), raw)).alias("clean"))


@REGISTRY.add(f"""
with t as (select doc_id, lang, {TOKENS} as words, list_distinct(regexp_extract_all(text, '[a-z]+[.]')) as tags from documents where text is not null),
o as (select doc_id, unnest(words) as word from t),
l as (select word from o where doc_id in (select doc_id from t where lang = 'en') group by word having count(distinct doc_id) >= {LIST_LEAST}),
h as (select doc_id, count(*) as hits from o join l using (word) group by doc_id),
c as (select *, len(words) as total from t left join h using (doc_id))
select doc_id from c where lang = 'en' and (case when total <= 4 then coalesce(hits, 0) >= 3 else coalesce(hits, 0) > total / 2 end) and len(tags) > 1
""")
def interesting_documents(spark, sf_dir):
    """The four-part filter of tweets over documents. The word list has what enough English documents have; sentence ends stand for hashtags."""
    docs = table(spark, sf_dir, "documents").where("text is not null and lang = 'en'")
    words = docs.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word"))
    known = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LIST_LEAST).select("word")
    tags = F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]+[.])"), 1))
    asked = docs.where(F.size(tags) > 1).select("doc_id", text.tokens(F.col("text")).alias("words"))
    hits = kb.dictionary_hits(asked, known)
    rows = asked.select("doc_id", F.size("words").alias("total")).join(hits, "doc_id")
    return rows.where(text.valid_language(F.col("hits"), F.col("total"))).select("doc_id")


ANCHORS = """
select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1)) as href,
  unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2)) as anchor from pages
"""


def anchor_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("l"))
    return rows.select("page_id", "l.href", "l.anchor")


@REGISTRY.add(ANCHORS)
def anchor_extract(spark, sf_dir):
    return anchor_rows(spark, sf_dir)


@REGISTRY.add(f"""
with a as ({ANCHORS}), c as (select anchor, href, count(*) as cnt from a group by 1, 2)
select anchor, string_agg(href || '=' || cnt, '|' order by cnt, href) as pages, sum(cnt)::bigint as total from c group by 1
""")
def anchor_page_counts(spark, sf_dir):
    return kb.anchor_pages(anchor_rows(spark, sf_dir), "anchor", "href")


BARE = r"regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&")):
    BARE = f"replace({BARE if _a != '&lt;' else f'''regexp_replace({BARE}, '(?s)<[^>]*>', ' ', 'g')'''}, '{_a}', '{_b}')"


@REGISTRY.add(f"""
select page_id, length(t)::int as n_chars, t as text
from (select page_id, trim(regexp_replace(replace(lower({BARE}), '[modifica]', ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) as t from pages)
""")
def html_to_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("text"))
    return rows.select("page_id", F.length("text").alias("n_chars"), "text")


@REGISTRY.add("""
with t as (select replace(lower(trim(p_name)), ' ', '_') as title_norm, min(p_partkey) as page_id from part group by 1),
n as (select p_partkey as aid, upper(p_name) as title from part union all select -s_suppkey, s_name from supplier),
a as (select aid, replace(lower(trim(title)), ' ', '_') as title_norm from n)
select a.aid, t.page_id, t.page_id is null as skipped from a left join t using (title_norm)
""")
def title_join(spark, sf_dir):
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    titles = part.select(F.col("p_name").alias("title"), F.col("p_partkey").alias("id"))
    anchors = part.select(F.col("p_partkey").alias("aid"), F.upper("p_name").alias("title"))
    others = supplier.select((-F.col("s_suppkey")).alias("aid"), F.col("s_name").alias("title"))  # these have no page
    return kb.with_titles(anchors.unionByName(others), titles).select("aid", "page_id", "skipped")


@REGISTRY.add(f"""
with a as ({ANCHORS}), s as (select anchor, href as page, count(*) as cnt from a group by 1, 2),
l as (select anchor, count(distinct page_id) * 2 as lp from a group by 1),
t as (select anchor, sum(cnt) as total, count(*) as n_senses from s group by 1)
select anchor, page, cnt, round(cnt / total, 6) as commonness, round(total / greatest(lp, total, n_senses), 6) as link_prob
from s join t using (anchor) join l using (anchor)
""")
def link_probability_join(spark, sf_dir):
    rows = anchor_rows(spark, sf_dir)
    senses = rows.groupBy("anchor", F.col("href").alias("page")).agg(F.count("*").alias("cnt"))
    seen = rows.groupBy("anchor").agg((F.countDistinct("page_id") * 2).alias("lp"))
    return kb.link_probabilities(senses, seen)


@REGISTRY.add(f"""
with a as ({ANCHORS}), s as (select anchor, href as page, count(*) as cnt from a group by 1, 2)
select anchor, string_agg(page, '|' order by cnt desc, page) as pages from s group by 1
""")
def best_senses(spark, sf_dir):
    senses = anchor_rows(spark, sf_dir).groupBy("anchor", F.col("href").alias("page")).agg(F.count("*").alias("cnt"))
    return kb.best_senses(senses).select("anchor", F.concat_ws("|", "pages").alias("pages"))


@REGISTRY.add(f"""
with t as (select doc_id, unnest(list_distinct({TOKENS})) as term from documents),
e as (select term, l.quality * 2 + l.toxic as entity, t.doc_id from t join labels l on l.doc_id = t.doc_id),
g as (select term, entity, string_agg(doc_id::varchar, ':' order by doc_id::varchar) as vals, count(*) as n from e group by 1, 2),
k as (select term from g group by 1 having count(*) >= 2)
select term, entity, vals, n from g where term in (select term from k)
""")
def entity_edges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = docs.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("entity"))
    rows = terms.join(labels, "doc_id").withColumn("value", F.col("doc_id").cast("string"))
    return graph.term_entity_edges(rows, "term", "entity", "value", 2)


@REGISTRY.add(f"""
with t as (select distinct unnest({TOKENS}) as term from documents)
select term, (100000000 + row_number() over (order by term))::bigint as id from t
""")
def dense_node_ids(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return graph.numbered(terms, "term", base=graph.PAGE_OFFSET).select("term", F.col("id").cast("long").alias("id"))


#: Lengths of the titles that begin at the words of an item, in turn.
TITLE_WORDS = ((1, 3, 6), (2, 4), (6,))


@REGISTRY.add(f"""
with v as (select {TOKENS} as w from benchmark),
b as (
  select distinct array_to_string(w[i:i + n - 1], ' ') as title, n
  from (select w, i, unnest(case i % 3 when 0 then [1, 3, 6] when 1 then [2, 4] else [6] end) as n from (select w, unnest(range(1, len(w) + 1)) as i from v))
  where i + n - 1 <= len(w)),
t as (
  select title, array_to_string(string_split(title, ' ')[1:5], ' ') as spot, true as near from b where n = 6
  union all select title, title, false from b where n <= 5),
k as (select spot, arg_min(title, (near, title)) as title from t where length(spot) >= 3 group by spot),
w as (select doc_id, {TOKENS} as words from documents),
g as (
""" + " union all ".join(f"select doc_id, i - 1 as start, {n} as n, array_to_string(words[i:i+{n - 1}], ' ') as spot from (select doc_id, words, unnest(range(1, len(words) - {n - 2})) as i from w)" for n in range(1, 6)) + """
), m as (select g.*, k.title, row_number() over (partition by doc_id, start order by n desc) r from g join k on g.spot = k.spot)
select doc_id, start::int as start, n::int as n, spot, title from m where r = 1
""")
def spot_match(spark, sf_dir):
    """Titles of one to six words from every item; the longest at each word, five words standing for a title of six."""
    items = table(spark, sf_dir, "benchmark").select(text.tokens(F.col("text")).alias("words"))
    lengths = F.array(*[F.array(*[F.lit(n) for n in some]) for some in TITLE_WORDS])
    begun = items.select("words", F.posexplode("words").alias("i", "word"))
    begun = begun.select("words", "i", F.explode(F.get(lengths, (F.col("i") + 1) % 3)).alias("n")).where(F.col("i") + F.col("n") <= F.size("words"))
    titles = begun.select(F.array_join(F.slice("words", F.col("i") + 1, F.col("n")), " ").alias("title"))
    tokens = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))
    return automata.match_titles(tokens, titles).select("doc_id", "start", "n", "spot", "title")



SENSES = """
senses as (select page_id as doc, anchor as spot, (1 + length(anchor) * k % 11)::bigint as page, 1.0 / k as pr, 1.0 / length(anchor) as lp
  from (select distinct page_id, anchor from anchors where length(anchor) > 2), (select unnest([1, 2, 3]) as k)),
sense as (select doc, spot, page, max(pr) as pr, max(lp) as lp from senses group by 1, 2, 3),
scores as (select a, b, ((a * 7 + b * 3) % 10) / 10.0 as score from (select unnest(range(1, 12)) as a), (select unnest(range(1, 12)) as b) where a < b)
"""


@REGISTRY.add(f"""
with anchors as ({ANCHORS}), {SENSES},
pairs as (select x.doc, x.spot, x.page, x.pr, x.lp, y.spot as spot_b, coalesce(s.score, 0) as score, y.pr as pr_b
  from sense x join sense y on x.doc = y.doc and x.spot <> y.spot left join scores s on s.a = least(x.page, y.page) and s.b = greatest(x.page, y.page)),
votes as (select doc, spot, page, spot_b, sum(score::double) * sum(pr_b::double) / count(*) as vote from pairs group by all),
mean as (select doc, spot, page, avg(vote) as vote from votes group by all),
rho as (select x.doc, x.spot, x.page, x.pr, round((coalesce(m.vote, 0) + x.lp::double) / 2, 6) as rho from sense x left join mean m using (doc, spot, page))
select doc, spot, page, rho from (select *, row_number() over (partition by doc, spot order by rho desc, pr desc, page) r from rho) where r = 1
""")
def disambiguate(spark, sf_dir):
    names = anchor_rows(spark, sf_dir).select(F.col("page_id").alias("doc"), F.col("anchor").alias("spot")).distinct().where(F.length("spot") > 2)
    senses = names.select("doc", "spot", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    senses = senses.groupBy("doc", "spot", (1 + F.length("spot") * F.col("k") % 11).cast("long").alias("page")).agg(
        F.max(1.0 / F.col("k")).alias("pr"), F.max(1.0 / F.length("spot")).alias("lp")
    )
    ids = spark.range(1, 12)
    pairs = ids.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(11)).cast("array<bigint>")).alias("b")).where("a < b")
    scores = pairs.withColumn("score", ((F.col("a") * 7 + F.col("b") * 3) % 10) / 10.0)
    return linker.disambiguate(senses, scores)


# A small lexicon.
MORPHOLOGY = (("was", "be", "VER:past"), ("is", "be", "VER:pres"), ("are", "be", "VER:pres"), ("on", "on", "ADV"), ("that", "that", None))
INDEX = (("be", "v", "v1 v2"), ("on", "r", "r1"), ("on", "a", "a1"), ("that", "n", "n1"), ("with", "n", "n2"))
SYNSETS = (("v1", "exist be_there"), ("v2", "equal"), ("r1", "onward"), ("a1", "active"), ("n1", "thing"), ("n2", "company thing"))
SCORES = (
    ("exist", "v", 0.25, 0.0), ("be there", "v", 0.125, 0.0), ("equal", "v", 0.5, 0.125), ("onward", "r", 0.375, 0.0), ("active", "a", 0.625, 0.125),
    ("thing", "n", 0.0, 0.25), ("company", "n", 0.5, 0.0),
)


def sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@REGISTRY.add(f"""
with m(word, lemma, features) as (values {sql_rows(MORPHOLOGY)}), i(lemma, class, synsets) as (values {sql_rows(INDEX)}),
s(synset, words) as (values {sql_rows(SYNSETS)}), v(term, class, pos_score, neg_score) as (values {sql_rows(SCORES)}),
w as (select doc_id as doc, unnest(range(len(words))) as pos, unnest(words) as word from (select doc_id, {TOKENS} as words from documents)),
t as (select w.*, coalesce(m.lemma, w.word) as lemma, case when m.features is null then 'n' when split_part(m.features, ':', 1) = 'VER' then 'v' end as cls
  from w left join m using (word)),
x as (select lemma, class, unnest(string_split(synsets, ' ')) as synset from i), y as (select synset, replace(unnest(string_split(words, ' ')), '_', ' ') as term from s),
r as (select t.doc, t.pos, t.word, v.pos_score::double as p, v.neg_score::double as g, 1 - (v.pos_score + v.neg_score)::double as o
  from t join x on x.lemma = t.lemma and (t.cls is null or t.cls = x.class) join y using (synset) join v on v.term = y.term and v.class = x.class),
z as (select doc, pos, word, count(*) as n, sum(p) as p, sum(g) as g, sum(o) as o from r group by all)
select doc, pos::int as pos, word, round(p / n, 6) as mean_pos_score, round(g / n, 6) as mean_neg_score, round(o / n, 6) as mean_obj_score,
  round(sum(p) over k / sum(n) over k, 6) as running_pos_score, round(sum(g) over k / sum(n) over k, 6) as running_neg_score,
  round(sum(o) over k / sum(n) over k, 6) as running_obj_score from z window k as (partition by doc order by pos)
""")
def sentiment_scores(spark, sf_dir):
    make = spark.createDataFrame
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(text.tokens(F.col("text"))).alias("pos", "word"))
    rows = sentiment.lookup_chain(
        words, make(MORPHOLOGY, "word string, lemma string, features string"), make(INDEX, "lemma string, class string, synsets string"),
        make(SYNSETS, "synset string, words string"), make(SCORES, "term string, class string, pos_score double, neg_score double"),
    )
    return sentiment.word_scores(rows)


@REGISTRY.add("""
with p as (select o_orderkey, 40 + (o_orderkey % 1000) / 100.0::double as lat, 5 + (o_orderkey % 997) / 100.0::double as lon from orders),
k as (select o_orderkey, 2 * 6371.0::double * asin(sqrt(pow(sin(radians(lat - 45.46) / 2), 2) + cos(radians(45.46)) * cos(radians(lat)) * pow(sin(radians(lon - 9.19) / 2), 2))) as km from p)
select o_orderkey, round(km, 3)::double as km from k where km <= 200
""")
def orders_within(spark, sf_dir):
    """Orders whose place, made of their key, is within 200 km of a point."""
    lat, lon = F.lit(40.0) + F.col("o_orderkey") % 1000 / 100.0, F.lit(5.0) + F.col("o_orderkey") % 997 / 100.0
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.haversine_km(F.lit(45.46), F.lit(9.19), lat, lon).alias("km"))
    return rows.where("km <= 200").select("o_orderkey", F.round("km", 3).alias("km"))


@REGISTRY.add(f"""
with recursive v as (select text, string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+') as w from benchmark),
p as (select distinct pattern from (select text as pattern from v union all select unnest(w) from v) where length(pattern) >= 7),
x(doc_id, text, pattern, place) as (
  select doc_id, text, pattern, strpos(text, pattern) from documents, p where contains(text, pattern)
  union all
  select doc_id, text, pattern, place + strpos(substr(text, place + 1), pattern) from x where strpos(substr(text, place + 1), pattern) > 0)
select doc_id, (place - 1)::int as start, pattern from x
""")
def find_patterns(spark, sf_dir):
    """Every place in all documents of the items of the benchmark and of their words of seven characters and more."""
    items = table(spark, sf_dir, "benchmark").select("text", F.split("text", "[ \\t\\n\\r\\f\\x0B]+").alias("w"))
    patterns = items.select(F.explode(F.concat(F.array("text"), F.col("w"))).alias("pattern")).where(F.length("pattern") >= 7)
    return automata.find_patterns(table(spark, sf_dir, "documents"), patterns, "doc_id", "text")
