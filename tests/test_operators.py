"""Operators on small inline rows: edge cases and quirks."""

import struct

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import automata, graph, jobs, kb, linker, sentiment, tables
from larkspur.sources import packed, readers, sinks


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_hashtags_from_entities_or_text(spark):
    df = spark.createDataFrame(
        [("#B #a #rt #A", None), ("#x", [("Hello",), ("RT",)])], "text string, entities array<struct<text:string>>"
    )
    assert rows(df.select(F.array_join(text.hashtags(F.col("text"), F.col("entities")), ","))) == [("a,b",), ("hello",)]


def test_sanitize(spark):
    long = "RT @b: " + "parola " * 20 + "trimm…"
    cut = "RT @b: " + "parola " * 20 + "trimm …"
    df = spark.createDataFrame([("RT: see http://t.co/x @me  now ",), (long,), (cut,), ("",), (None,)], "t string")
    found = [r[0] for r in df.select(text.sanitize(F.col("t"))).collect()]
    assert "http" not in found[0] and "@me" not in found[0] and found[0].endswith("now")
    assert found[2].endswith("parola") and found[3] == "" and found[4] is None


def test_word_spans_keep_last_short_word(spark):
    df = spark.createDataFrame([("  Ab c\td ",), ("",), ("x",)], "t string")
    found = rows(kb.word_spans(df, "t", "t"), "t", "start")
    assert found == [("  Ab c\td ", "ab", 2, 4), ("  Ab c\td ", "c", 5, 6), ("  Ab c\td ", "d", 7, 8), ("x", "x", 0, 1)]


def test_token_offsets_match_brute_force(spark):
    from larkspur import catalog

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()}
    found = catalog.QUERIES["token_offsets"](spark, "/root/testdata/sf0.001").where(F.col("doc_id").isin(list(docs))).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.stop, r.word))
    import re

    for i, t in docs.items():
        assert sorted(by_doc.get(i, [])) == [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^ \t\n\r\f\x0b]+", t)]


def test_strip_word_and_titles(spark):
    df = spark.createDataFrame([("\"'word.,",)], "t string")
    assert df.select(text.strip_word(F.col("t"))).first()[0] == "word"
    uri = spark.createDataFrame([("<http://it.dbpedia.org/resource/Roma_(disambigua)>",)], "u string")
    assert uri.select(text.uri_title(F.col("u"))).first()[0] == "roma"
    assert spark.sql("select ' Roma Antica ' t").select(text.normalized_title(F.col("t"))).first()[0] == "roma_antica"


def test_tweet_time_is_utc(spark):
    df = spark.createDataFrame([("Sun Apr 22 16:11:51 +0000 2012",), ("bad",), (None,)], "c string")
    assert [r[0] for r in df.select(text.sort_time(text.tweet_time(F.col("c")))).collect()] == ["2012/04/22 16:11:51", None, None]


@pytest.mark.parametrize(("hits", "total", "valid"), [(2, 4, False), (3, 4, True), (2, 5, False), (3, 5, True), (3, 6, False), (0, 0, False)])
def test_language_rule(spark, hits, total, valid):
    df = spark.createDataFrame([(hits, total)], "h int, n int")
    assert df.select(text.valid_language(F.col("h"), F.col("n"))).first()[0] is valid


def test_geo_either_side_of_200_km(spark):
    df = spark.createDataFrame([(45.0, 9.0, 46.79, 9.0), (45.0, 9.0, 46.81, 9.0)], "a double, b double, c double, d double")
    near = [r[0] for r in df.select(text.haversine_km(*map(F.col, "abcd")) <= 200).collect()]
    assert near == [True, False]


def test_packed_u64_round_trip(spark):
    top = 18446744073709551615
    df = spark.createDataFrame([(str(top),), ("0",), ("258",)], "v string").select(F.col("v").cast("decimal(20,0)").alias("v"))
    assert [int(r[0]) for r in df.select(text.unpack_u64(text.pack_u64(F.col("v")))).collect()] == [top, 0, 258]


def test_packed_followers(spark, tmp_path):
    top = 18446744073709551615
    (tmp_path / "12").mkdir()
    (tmp_path / "12" / "123.fws").write_bytes(struct.pack("!3Q", top, 5, 7))
    found = rows(packed.read_followers(spark, str(tmp_path), 1), "pos")
    assert [(int(a), int(b), c) for a, b, c in found] == [(123, 5, 1), (123, 7, 2)]
    more = spark.createDataFrame([(123, 9, 3), (45, 1, 0)], "user_id long, follower_id long, pos long")
    packed.write_followers(more, str(tmp_path))
    found = rows(packed.read_followers(spark, str(tmp_path)), "user_id", "pos")
    assert [(int(a), int(b)) for a, b, _ in found] == [(45, 1), (123, top), (123, 5), (123, 7), (123, 9)]


def test_followers_from_text(spark, tmp_path):
    (tmp_path / "f.txt").write_text("5\nx\n18446744073709551615\n\n7\n")
    found = rows(packed.followers_from_text(spark, str(tmp_path / "f.txt"), 3), "pos")
    assert [int(b) for _, b, _ in found] == [5, 18446744073709551615, 7]


def test_timelines_skip_bad_lines_and_read_gzip(spark, tmp_path):
    import gzip

    (tmp_path / "12").mkdir()
    (tmp_path / "12" / "123.twt").write_text('{"id_str": "2", "text": "a"}\nnot json\n{"id_str": "1", "text": "b"}\n')
    with gzip.open(tmp_path / "12" / "124.twt.gz", "wt") as f:
        f.write('{"id_str": "9", "text": "c"}\n')
    df = readers.read_timelines(spark, str(tmp_path))
    assert [(int(u), i) for u, i in rows(df.select("file_user", "id_str"), "file_user", "id_str")] == [(123, "1"), (123, "2"), (124, "9")]
    assert {int(r[0]) for r in readers.user_files(spark, str(tmp_path), "twt").collect()} == {123, 124}


def test_single_row_timeline_has_a_last_row(spark):
    df = spark.createDataFrame([(1, 5, "x")], "u int, id int, t string")
    assert rows(tables.extents(df, "u", "id", "t")) == [(1, 1, 5, 5, "x", "x")]


def test_read_ids_and_triples(spark, tmp_path):
    (tmp_path / "ids").write_text("1\nx\n 22 \n")
    assert rows(readers.read_ids(spark, str(tmp_path / "ids"))) == [(1,), (22,)]
    (tmp_path / "t").write_text("# no\n<a> <b> <c> .\nshort\n")
    assert rows(readers.read_triples(spark, str(tmp_path / "t"))) == [("<a>", "<b>", "<c>")]


def test_timeline_and_follower_pages(spark):
    tweets = spark.range(1, 11).select(F.lit(7).alias("user_id"), F.col("id").alias("tweet_id"))
    assert [r[1] for r in readers.timeline_page(tweets, 7, since_id=2, max_id=8, size=3).collect()] == [8, 7, 6]
    followers = spark.range(5).select(F.lit(7).alias("user_id"), (F.col("id") * 10).alias("follower_id"), F.col("id").alias("pos"))
    first = readers.follower_page(followers, 7, 0, 4).orderBy("pos").collect()
    assert len(first) == 4 and {r.next_cursor for r in first} == {4}
    last = readers.follower_page(followers, 7, 4, 4).collect()
    assert [(r.pos, r.next_cursor) for r in last] == [(4, 0)]


def test_merge_is_idempotent_and_second_wins(spark):
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "only")], "id int, user int, t string")
    b = spark.createDataFrame([(2, 1, "B"), (4, 1, "d")], "id int, user int, t string")
    one = tables.merge_latest(a, b, "id", "user")
    assert rows(one, "id") == [(1, 1, "a"), (2, 1, "B"), (4, 1, "d")]
    assert rows(tables.merge_latest(one, b, "id", "user"), "id") == rows(one, "id")


def test_delta_update_all_or_nothing(spark):
    old = spark.createDataFrame([(1, 5), (2, 5)], "u int, id int")
    new = spark.createDataFrame([(1, 6, True), (1, 4, True), (2, 9, False), (3, 1, True)], "u int, id int, ok boolean")
    assert rows(tables.delta_update(old, new, "u", "id", F.col("ok")), "u", "id") == [(1, 5), (1, 6), (2, 5), (3, 1)]


def test_relatedness_is_symmetric_and_needs_distinct_edges(spark):
    edges = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 10), (2, 11), (3, 11)], "s int, d int")
    assert rows(graph.shared_neighbours(edges, "s", "d")) == [(10, 11, 2)]
    back = edges.select("s", (F.lit(21) - F.col("d")).alias("d"))
    one = graph.link_relatedness(edges, "s", "d", F.lit(100.0)).first()
    other = graph.link_relatedness(back, "s", "d", F.lit(100.0)).first()
    assert one.distance == other.distance


def test_frontier_visits_each_node_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4)], "src int, dst int")
    found = graph.frontier_levels(edges, spark.createDataFrame([(1,)], "node int"), 5)
    assert rows(found, "node") == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_five_words_match_a_six_word_title(spark):
    tokens = spark.createDataFrame([(1, "a b c d e x".split()), (2, "foo bar foo".split())], "doc_id int, words array<string>")
    titles = spark.createDataFrame([("a b c d e f",), ("foo bar",), ("foo",), ("bar foo",), ("xy",)], "title string")
    for match in (kb.match_spots, automata.match_titles):
        found = rows(match(tokens, titles).select("doc_id", "start", "n", "title"), "doc_id", "start")
        assert found == [(1, 0, 5, "a b c d e f"), (2, 0, 2, "foo bar"), (2, 1, 2, "bar foo"), (2, 2, 1, "foo")]


def test_anchor_counts_credit_the_page(spark):
    links = spark.createDataFrame([("x", "p"), ("x", "q"), ("x", "q")], "a string, p string")
    assert rows(kb.anchor_pages(links, "a", "p")) == [("x", "p=1|q=2", 3)]


def test_redirect_titles_with_blanks_match(spark):
    titles = spark.createDataFrame([("roma_antica", 1)], "title_norm string, page_id int")
    aliases = spark.createDataFrame([("<http://x/resource/Urbe_Eterna>", "<http://x/resource/Roma_Antica>")], "uri string, target_uri string")
    assert rows(kb.with_redirects(titles, aliases), "title_norm") == [("roma_antica", 1), ("urbe_eterna", 1)]


def test_disambiguation_breaks_ties_by_commonness(spark):
    spots = spark.createDataFrame(
        [("d", "s", 1, 0.4, 0.5), ("d", "s", 2, 0.6, 0.5), ("d", "t", 3, 1.0, 0.5)], "doc string, spot string, page int, pr double, lp double"
    )
    none = spark.createDataFrame([], "a int, b int, score double")
    assert rows(linker.disambiguate(spots, none), "spot") == [("d", "s", 2, 0.25), ("d", "t", 3, 0.25)]
    votes = spark.createDataFrame([(1, 3, 0.9)], "a int, b int, score double")
    assert rows(linker.disambiguate(spots, votes), "spot")[0] == ("d", "s", 1, 0.7)


def test_annotation_threshold_and_flattening(spark):
    df = spark.createDataFrame(
        [("1", "t", ["a", "b"], [(1, 0.15, "x"), (2, 0.1, "y")])], "id string, tweet string, hts array<string>, annotations array<struct<id:long,rho:double,title:string>>"
    )
    assert rows(linker.flat_annotations(linker.above_threshold(df)), "ht") == [("a", 1, 0.15, "x"), ("b", 1, 0.15, "x")]
    assert "x</span>" in sinks.report_rows(df).first()[0]


def test_jobs(spark):
    df = spark.createDataFrame([("T", 1, None), ("A", 2, "c,d")], "op string, user_id long, cursor string")
    text_form = df.select(jobs.serialize(F.col("op"), F.col("user_id"), F.coalesce("cursor", F.lit(""))).alias("j"))
    assert [tuple(r[0]) for r in text_form.select(jobs.deserialize(F.col("j"))).collect()] == [("T", 1, ""), ("A", 2, "c,d")]
    done = spark.createDataFrame([("T", 1), ("F", 2), ("A", 3)], "op string, user_id long")
    assert rows(jobs.chain(done, ("T", "A")), "user_id") == [("F", 1, "-1"), ("A", 2, "0")]
    states = spark.createDataFrame([("queued",), ("completed",)], "state string")
    assert jobs.finished(states, "state").first()[0] is False


def test_running_mean_and_top_terms_on_empty(spark):
    empty = spark.createDataFrame([], "k string")
    assert tables.top_terms(empty, "k", 3).count() == 0 and tables.share_of_total(empty, "k").count() == 0


def test_sinks_write(spark, tmp_path):
    df = spark.createDataFrame([(123, 2, "x"), (123, 1, "y")], "user_id int, tweet_id int, text string")
    sinks.write_timelines(df, str(tmp_path / "t"))
    sinks.write_json_and_tsv(df, str(tmp_path / "d"), ("user_id", "text"))
    sinks.write_split(df, str(tmp_path / "s"), {"one": F.col("tweet_id") == 1})
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    assert spark.read.csv(str(tmp_path / "d" / "tsv"), sep="\t").count() == 2
    assert spark.read.json(str(tmp_path / "s" / "one")).count() == 1


def test_numbered_without_one_task(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    assert rows(graph.numbered(df, "v", base=5), "v") == [(i, i + 6) for i in range(1000)]


def test_patterns_inside_words_and_none(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (2, ""), (3, None), (4, "xabx")], "k int, t string")
    patterns = spark.createDataFrame([("abc",), ("ab",), ("bca",), ("",)], "pattern string")
    want = [(1, 0, "ab"), (1, 0, "abc"), (1, 1, "bca"), (1, 3, "ab"), (1, 3, "abc"), (4, 1, "ab")]
    for find in (kb.find_patterns, automata.find_patterns):
        assert rows(find(docs, patterns, "k", "t"), "k", "start", "pattern") == want
        assert find(docs, patterns.where("false"), "k", "t").count() == 0


def test_tweet_rows(spark):
    from larkspur.sources.schemas import TWEET

    text = '{"id_str": "18446744073709551615", "text": "a\\tb", "created_at": "Sun Apr 22 16:11:51 +0000 2012", "user": {"screen_name": "u"}}'
    df = spark.createDataFrame([(text,)], "v string").select(F.from_json("v", TWEET).alias("t")).select("t.*")
    row = readers.tweet_rows(df).first()
    assert (int(row.id), row.time, row.epoch_ms, row.user, row.geo, row.text) == (18446744073709551615, "2012/04/22 16:11:51", 1335111111000, "u", "null", "ab")
    assert readers.search_documents(df).first().location is None


def test_short_dictionary_and_resolution(spark):
    titles = spark.createDataFrame([("a b c d",), ("ab",), ("abc",)], "title string")
    assert rows(kb.dictionary_titles(titles)) == [("abc",)]
    pages, aliases = spark.createDataFrame([(1,), (2,)], "page int"), spark.createDataFrame([(1, 9)], "page int, target int")
    assert rows(kb.resolved(pages, aliases), "page") == [(1, 9), (2, 2)]


def test_follower_files_in_splits_and_appends(spark, tmp_path, monkeypatch):
    import gzip

    (tmp_path / "12").mkdir()
    (tmp_path / "12" / "123.fws.gz").write_bytes(gzip.compress(struct.pack("!3Q", 1, 2, 3)))
    (tmp_path / "12" / "124.fws").write_bytes(struct.pack("!5Q", *range(5)) + b"cut")
    monkeypatch.setattr(packed, "SPLIT", 16)
    assert len(packed.PackedReader(str(tmp_path)).partitions()) == 4
    for value in (7, 8):
        packed.write_followers(spark.createDataFrame([(123, value, 0)], "user_id long, follower_id long, pos long"), str(tmp_path))
    found = rows(packed.read_followers(spark, str(tmp_path)), "user_id", "pos")
    assert [(int(a), int(b), c) for a, b, c in found] == [(123, v, i) for i, v in enumerate((1, 2, 3, 7, 8))] + [(124, i, i) for i in range(5)]
    packed.write_followers(spark.createDataFrame([(123, 9, 0)], "user_id long, follower_id long, pos long"), str(tmp_path), append=False)
    assert [int(b) for a, b, _ in rows(packed.read_followers(spark, str(tmp_path)), "user_id", "pos") if int(a) == 123] == [9]


def test_nested_spans(spark):
    df = spark.createDataFrame(
        [("a <b> cd", [(0, 8, "s", "outer", 0.5), (2, 5, "t", "in&", 0.25), (6, 8, "u", "end", 1.0)]), ("plain", [])],
        "t string, a array<struct<start:int,end:int,spot:string,title:string,rho:double>>",
    )
    link = lambda spot, title, rho, inner: f"<a href='#' data-spot='{spot}' data-title='{title}' data-rho='{rho}'>{inner}</a>"
    inner = f"a {link('t', 'in&amp;', 0.25, '&lt;b&gt;')} {link('u', 'end', 1.0, 'cd')}"
    assert [r[0] for r in df.select(sinks.nested_spans(F.col("t"), F.col("a"))).collect()] == [link("s", "outer", 0.5, inner), "plain"]


def test_packed_words_and_singles(spark):
    df = spark.createDataFrame([(0,), (1,), (4294967295,), (4294967296,), (-1,), (None,)], "v long")
    packed_ = [r[0] for r in df.select(text.pack_u32(F.col("v"))).collect()]
    assert [None if x is None else bytes(x) for x in packed_] == [struct.pack("!I", 0), struct.pack("!I", 1), struct.pack("!I", 4294967295), None, None, None]
    values = [0.0, 1.0, -2.5, 0.1, 3.4e38, 1.2e-38, -7.75e10, 1 / 3, 2.0**40]
    singles = spark.createDataFrame([(v,) for v in values], "v double").select(text.pack_f32(F.col("v")).alias("p"))
    assert [bytes(r[0]) for r in singles.collect()] == [struct.pack("!f", v) for v in values]
    back = [r[0] for r in singles.select(text.unpack_f32(F.col("p"))).collect()]
    assert back == [struct.unpack("!f", struct.pack("!f", v))[0] for v in values]


def test_sentiment_lookups_and_other_tagger(spark):
    lexicon = spark.createDataFrame([("n", 1, 0.5, 0.25), ("v", 2, 0.0, 1.0)], "pos string, offset int, pos_score double, neg_score double")
    synsets = spark.createDataFrame([("a.n.01", "n", 1, ["a", "b"]), ("b.v.01", "v", 2, ["b"]), ("c.n.01", "n", 9, ["c"])], "name string, pos string, offset int, words array<string>")
    wanted = spark.createDataFrame([("n", 1), ("n", 7)], "pos string, offset int")
    assert rows(sentiment.scores_at(wanted, lexicon)) == [("n", 1, 0.5, 0.25, 0.25)]
    names = spark.createDataFrame([("b",), ("c",), ("zz",)], "word string")
    assert [r[3] for r in rows(sentiment.scores_named(names, synsets, lexicon).select("pos", "offset", "word", "name"), "name")] == ["a.n.01", "b.v.01"]
    assert sentiment.scores_named(names, synsets, lexicon, "v").count() == 1
    assert sentiment.all_scores(synsets, lexicon).count() == 2
    tags = spark.createDataFrame([("VER",), ("s",), ("Bx",), ("X",), (None,)], "t string")
    assert [r[0] for r in tags.select(text.tag_class(F.col("t"))).collect()] == ["v", "n", "r", None, None]
    words = spark.createDataFrame([(1, 0, "b"), (1, 1, "q")], "doc int, pos int, word string")
    morphology = spark.createDataFrame([("b", "b", "S"), ("q", "q", "X")], "word string, lemma string, features string")
    index = spark.createDataFrame([("b", "n", "1"), ("q", "n", "1")], "lemma string, class string, synsets string")
    terms = spark.createDataFrame([("1", "b")], "synset string, words string")
    scores = spark.createDataFrame([("b", "n", 0.5, 0.0)], "term string, class string, pos_score double, neg_score double")
    found = sentiment.lookup_chain(words, morphology, index, terms, scores, text.tag_class, drop_unknown=True)
    assert [r.word for r in found.collect()] == ["b"]


def test_four_part_filter(spark):
    df = spark.createDataFrame(
        [("t", "it", 3, 4, ["a", "b"]), (None, "it", 3, 4, ["a", "b"]), ("t", "en", 3, 4, ["a", "b"]), ("t", "it", 2, 4, ["a", "b"]), ("t", "it", 3, 4, ["a"])],
        "t string, l string, h int, n int, g array<string>",
    )
    assert df.where(text.interesting(F.col("t"), F.col("l"), "it", F.col("h"), F.col("n"), F.col("g"))).count() == 1


def test_series_patterns_are_literal_but_for_stars(spark):
    df = spark.createDataFrame([("a_b.x",), ("acb.x",), ("a%b.x",), ("a_b",)], "l string")
    assert [r[0] for r in df.where(text.fits(F.col("l"), "a_b*")).collect()] == ["a_b.x", "a_b"]
    assert [r[0] for r in df.where(text.fits(F.col("l"), "a%b.*")).collect()] == ["a%b.x"]


def test_lexicon_reports_malformed_lines_and_pages_restart(spark, tmp_path):
    (tmp_path / "lex").write_text("# c\nn\t1\t0.5\t0.25\ta#1\tgloss\nbroken line\n")
    assert readers.read_sentiment_lexicon(spark, str(tmp_path / "lex")).count() == 1
    assert [r[0] for r in readers.malformed_lines(spark, str(tmp_path / "lex")).collect()] == ["broken line"]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "p.json").write_text('{"id": 1, "title": "A b", "length": 3}\n{"id": 2, "title": "C", "length": 4}\n')
    pages = readers.read_wiki_pages(spark, str(tmp_path / "pages"), after=1)
    assert [r.id for r in pages.collect()] == [2]
    assert rows(readers.page_mapping(pages)) == [("c", 2, "C", 4)]


def test_anchor_and_template_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"anchor": "x", "pages": [{"title": "P", "cnt": 2}, {"title": "Q", "cnt": 1}]}\n')
    assert rows(readers.read_anchors(spark, str(tmp_path)), "title") == [("x", "P", 2), ("x", "Q", 1)]
    counts = spark.createDataFrame([("x", 1, 2), ("x", 1, 3), ("y", 1, 1)], "anchor string, page_id int, cnt int")
    assert rows(kb.summed_anchors(counts), "anchor") == [("x", 1, 5), ("y", 1, 1)]
    runs = spark.createDataFrame([(1, "a", 2), (2, "a b", 1)], "n int, ngram string, cnt int")
    assert rows(kb.merged_counts(runs, runs), "n") == [(1, "a", 4), (2, "a b", 2)]
    templates = spark.createDataFrame([(2, "Portale:Roma/icona"), (1, "portale:Roma"), (3, "Other")], "page_id int, template string")
    assert [(n, i) for n, i in rows(kb.portal_pages(templates), "name")] == [("Roma", [1, 2])]
    pages = spark.createDataFrame([(1, [(5, "Portale:A"), (3, "x"), (2, "portale:B")])], "id int, templates array<struct<id:int,name:string>>")
    assert rows(kb.split_templates(pages)) == [(1, [2, 5], [3])]
    titles = spark.createDataFrame([("roma", 1)], "title_norm string, page_id int")
    named = spark.createDataFrame([("<http://x/resource/Urbe_(disambigua)>", "<http://x/resource/Roma>")], "uri string, target_uri string")
    assert rows(kb.disambiguation_anchors(titles, named)) == [("urbe", 1, 1)]


def test_windows_of_following_words(spark):
    df = spark.createDataFrame([(1, "a b c".split()), (2, []), (3, None), (4, ["z"])], "k int, words array<string>")
    found = rows(kb.following_words(df, "words", 2, "k"), "k", "start")
    assert found == [(1, 0, "a", "b"), (1, 1, "b", "c"), (1, 2, "c", None), (4, 0, "z", None)]


def test_ngram_counts_equal_brute_force(spark):
    from collections import Counter

    texts = ["a b a b c", "b a", "", None, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter()
    for t in texts:
        w = (t or "").split()
        want.update((n, " ".join(w[i : i + n])) for n in range(1, 6) for i in range(len(w) - n + 1))
    assert {(r.n, r.ngram): r.cnt for r in kb.ngram_counts(df, text.tokens(F.col("text"))).collect()} == dict(want)


def test_range_bounds_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 3)] + [(None,)], "v double")
    assert rows(tables.range_bounds(df, "v", 4), "at") == [(0, 2.0), (1, 3.0), (2, 4.0)]
    assert tables.range_bounds(df.where("v is null"), "v", 4).count() == 0


def test_keys_found_or_missing(spark):
    df = spark.createDataFrame([(1, "a")], "k int, t string")
    wanted = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert rows(tables.found_or_missing(df, "k", wanted), "k") == [(1, "a", True), (2, None, False)]


def test_utilisation(spark):
    df = spark.createDataFrame([("working",), ("idle",), ("idle",)], "s string")
    assert tuple(jobs.utilisation(df, "s").first()) == (3, 1, 33)
    assert tuple(jobs.utilisation(df.where("false"), "s").first()) == (0, 0, None)


def test_snapshot_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    sinks.snapshot(df, df.where("k = 2"), "k", str(tmp_path / "s"))
    sinks.write_lines(df.select("t"), str(tmp_path / "l"))
    assert rows(spark.read.parquet(str(tmp_path / "s"))) == [(2, "b")]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a", "b"]
    (tmp_path / "x").write_text("1\ta\n2\t\n")
    assert rows(readers.read_tsv(spark, str(tmp_path / "x"), "k int, t string"), "k") == [(1, "a"), (2, None)]


def test_gzip_lists_of_several_members_are_read_whole(spark, tmp_path):
    import gzip

    (tmp_path / "12").mkdir()
    members = [gzip.compress(struct.pack("!2Q", 1, 2)), gzip.compress(struct.pack("!Q", 3) + b"\0\0"), gzip.compress(struct.pack("!Q", (1 << 64) - 1)[2:] + b"cut")]
    (tmp_path / "12" / "123.fws.gz").write_bytes(b"".join(members))
    (tmp_path / "12" / "123.000001.fws").write_bytes(struct.pack("!Q", 9))
    (tmp_path / "12" / "124.fws.gz").write_bytes(gzip.compress(b""))
    found = sorted((int(r.user_id), r.pos, int(r.follower_id)) for r in packed.read_followers(spark, str(tmp_path)).collect())
    assert found == [(123, 0, 1), (123, 1, 2), (123, 2, 3), (123, 3, 0xFFFFFFFFFFFF), (123, 4, 9)]
    rows = spark.createDataFrame([("123", str((1 << 64) - 1), 0), ("77", "5", 0)], "user_id string, follower_id string, pos bigint")
    packed.write_followers(rows, f"file://{tmp_path}")
    found = sorted((int(r.user_id), r.pos, int(r.follower_id)) for r in packed.read_followers(spark, f"file://{tmp_path}").where("pos >= 4 or user_id = 77").collect())
    assert found == [(77, 0, 5), (123, 4, 9), (123, 5, (1 << 64) - 1)]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_long_ngrams_shuffle_once_a_place(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    texts = ["a b c d e f g " * 20, "a b c", "a b c d", "a b"]
    want = Counter()
    for t in texts:
        w = t.split()
        want.update((n, " ".join(w[i : i + n])) for n in range(1, 6) for i in range(len(w) - n + 1))
    found = kb.ngram_counts(spark.createDataFrame([(t,) for t in texts], "text string"), text.tokens(F.col("text")))
    rows_ = found.collect()
    assert len(rows_) == len(want) and {(r.n, r.ngram): r.cnt for r in rows_} == dict(want)
    plan = plan_of(found)
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(head" in plan  # as many tasks as the words ask for, one row a place


def grams(words, most):
    return [(n, " ".join(words[i : i + n])) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def shuffled(spark):
    """Bytes of all shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()  # local: the driver is the only one


def test_ngrams_shuffle_a_small_multiple_of_the_text(spark):
    from collections import Counter
    from random import Random

    random = Random(1)
    names = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(names[int(5000 * random.random() ** 3)] for _ in range(500)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    start = shuffled(spark)
    found = kb.ngram_counts(df, text.tokens(F.col("text"))).collect()
    took = shuffled(spark) - start
    assert {(r.n, r.ngram): r.cnt for r in found} == Counter(g for t in texts for g in grams(t.split(), 5))
    assert took < 4 * sum(map(len, texts))  # 9 times before n-grams of all lengths went as packed runs of words


@pytest.mark.parametrize("most", [1, 2, 3, 5, 7])
@pytest.mark.parametrize("listed", [False, True])
def test_packed_ngrams_in_small_spans_equal_brute_force(monkeypatch, most, listed):
    import re
    from collections import Counter, defaultdict
    from random import Random

    import pyarrow as pa

    from larkspur.operators import ngrams

    monkeypatch.setattr(ngrams, "SPAN_BYTES", 200)
    monkeypatch.setattr(ngrams, "MOST_PLACES", 50)
    random = Random(most)
    texts = [None, "", " \t", "x", "  the\nof ", "a " * 90, "w" * 700 + " the the", "é\u00a0ß 漢字\x0bthe\x1cof\f\rof", "the of " * 40]
    texts += [" ".join(random.choice(["the", "of", "and", *(f"v{random.randint(0, 30)}" for _ in range(4))]) for _ in range(random.randint(0, 60))) for _ in range(40)]
    cut = [None if t is None else [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w] for t in texts]
    rows = pa.array(cut, pa.list_(pa.string())) if listed else pa.array(texts)
    batches = [pa.record_batch([rows.slice(i, 7)], ["words"]) for i in range(0, len(rows) + 7, 7)]
    sums = Counter()
    for batch in ngrams.seen(iter(batches)):
        for word, n in zip(*batch.to_pydict().values()):
            sums[word] += n
    assert sums[None] == sum(len(w or []) for w in cut) and sums["the "] == sum((w or []).count("the") for w in cut)
    tasks = defaultdict(list)
    for batch in ngrams.pack(iter(batches), most, ["the ", "of ", "a ", "not there "], [7, 5, 3]):
        for i, head in enumerate(batch.column("head").to_pylist()):
            tasks[head].append(batch.slice(i, 1))
    found = [x for rows in tasks.values() for batch in ngrams.count(iter(rows), most) for x in zip(*batch.to_pydict().values())]
    want = Counter(g for w in cut for g in grams(w or [], most))
    assert set(tasks) <= {7, 5, 3} and len(found) == len(want) and {(n, g): cnt for n, g, cnt in found} == want


def test_edges_and_pairs_take_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 3)
    plans, write = {}, graph.materialize

    def noted(df, name):
        plans[name] = plan_of(df)
        return write(df, name)

    monkeypatch.setattr(graph, "materialize", noted)
    edges = spark.createDataFrame([(i, i + d) for i in range(12) for d in (1, 2, 2)] + [(None, 1), (1, None)], "src long, dst long")
    found = graph.frontier_levels(edges, spark.createDataFrame([(0,)], "node long"), 3)
    assert rows(found, "node") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3)]
    assert "REPARTITION_BY_NUM" in plans["distinct-edges"]
    near = graph.link_relatedness(edges, "src", "dst", F.lit(100.0))
    want = {(i + 1, i + 2): 1 for i in range(12)}
    assert {(r.a, r.b): r.both for r in near.collect()} == {k: n for k, n in want.items() if k not in ((1, 2), (12, 13))} | {(1, 2): 1, (12, 13): 1}
    assert plan_of(near).count("REPARTITION_BY_NUM") >= 3 and "[a#" not in "".join(x for x in plan_of(near).splitlines() if "MergeJoin" in x)


def test_word_spans_and_lexicon_lookups_do_not_shuffle_words(spark):
    from larkspur import catalog

    df = spark.createDataFrame([(7, "x y  \U0001f600z\x0bW\n"), (8, None)], "k int, t string")
    spans = kb.word_spans(df, "k", "t")
    assert rows(spans, "start") == [(7, "x y", 0, 3), (7, "\U0001f600z", 5, 7), (7, "w", 8, 9)] and spans.schema["k"].dataType.typeName() == "integer"
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()
    scored = catalog.QUERIES["sentiment_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in scored and "SortMergeJoin" not in scored


def test_dictionary_hits_of_small_and_large_dictionaries(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "doc_id int, words array<string>")
    words = spark.createDataFrame([("a",), ("b",), ("a",)], "word string")
    small = kb.dictionary_hits(docs, words)
    assert "BroadcastHashJoin" in plan_of(small) and "hashpartitioning(word" not in plan_of(small)
    assert rows(small, "doc_id") == [(1, 3), (2, 0), (3, 0)]
    monkeypatch.setattr(kb, "BROADCAST_ROWS", 0)
    assert rows(kb.dictionary_hits(docs, words), "doc_id") == [(1, 3), (2, 0), (3, 0)]
