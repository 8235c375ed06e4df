"""Operators of the llm subpackage: brute force, round trips, edge cases."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import (
    bpe, common, components, fingerprints, html_text, langid, licenses, mixing, near_duplicates, quality, queries, token_files, topk,
)

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, words string"
ROWS = [
    (1, "The MIT License, and the mit\nlicense.", "en", "a"), (2, "", "en", "a"), (3, None, None, None), (4, "word", "de", "b"),
    (4, "word", "de", "b"), (None, "no id here at all", "en", "b"), (5, "x " * 40_000, "en", "a"), (6, "é中😀 \x1c\x85 tab\there", "fr", "c"),
    (7, " ", None, "c"), (8, "!!! ??? 123", "en", None),
]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 0, "k", 0.5, "w") for r in ROWS], EXTRA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary("byte_bpe_multi_50k.tiktoken")


def in_order(r):
    """Ascending doc_id, nulls first, ties by the text's MD5."""
    return (r.doc_id is not None, r.doc_id or 0, "" if r.text is None else hashlib.md5(r.text.encode()).hexdigest())


def keyed(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


# Licence scan


def scan_by_force(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    starts = [i for phrase, _ in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.encode().split()]
    return len(w), len(starts), min(starts, default=None), max(starts, default=None)


def test_license_places_equal_brute_force(spark, docs):
    found = keyed(licenses.license_scan(docs), "n_words", "n_base", "first_word", "last_word")
    assert found == {r.doc_id: scan_by_force(r.text) for r in docs.collect()}


def test_license_edge_cases(spark):
    rows = licenses.license_scan(odd(spark)).collect()
    assert len(rows) == len(ROWS)
    one = next(r for r in rows if r.doc_id == 1)
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels) == (7, 2, 1, 5, "mit")
    assert all((r.n_words, r.labels, r.score, r.first_word) == (0, "", 0.0, None) for r in rows if r.doc_id in (2, 3, 7))
    assert licenses.license_scan(empty(spark)).count() == 0


def test_license_notice_with_words_changed(spark):
    text = "x y z this work is licensed under a creative commons attribution licence thanks"
    df = spark.createDataFrame([(1, text), (2, "the work is under way in the commons")], "doc_id long, text string")
    found = keyed(licenses.license_scan(df), "labels", "base_labels")
    assert found == {1: ("cc-by", ""), 2: ("", "")}


LICENSED = (
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("CC BY-NC-SA 3.0", "cc-by-nc-sa"), ("see (CC BY 4.0)", "cc-by"), ("cc: by Friday", ""),
    ("released under the apache license", "apache"), ("released under the new license", ""), ("released under the MIT license", "mit"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"), ("the Eclipse Public License v2", "epl"), ("the ISC license", "isc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies.", "isc"),
)


def test_license_short_forms_and_names(spark):
    df = spark.createDataFrame([(i, f"a b c {t} d e f") for i, (t, _) in enumerate(LICENSED)], "doc_id long, text string")
    found = keyed(licenses.license_scan(df), "labels")
    assert found == {i: (label,) for i, (_, label) in enumerate(LICENSED)}


def test_license_lesser_and_affero_notices(spark):
    text = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public License"
    df = spark.createDataFrame([(1, text.format("Lesser")), (2, text.format("Affero"))], "doc_id long, text string")
    found = licenses.license_scan(df, base=())
    assert keyed(found, "labels") == {1: ("lgpl",), 2: ("agpl",)}


def test_containment_finds_every_block(spark):
    random.seed(3)
    vocabulary = "abcdefgh"
    notices = (("a b c d e", "n1"), ("f g h a", "n2"))
    texts = [" ".join(random.choices(vocabulary, k=random.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = keyed(licenses.license_scan(df, base=(), notices=notices, threshold=0.75), "labels")
    for i, text in enumerate(texts):
        w, want = text.split(), set()
        for phrase, label in notices:
            own = set(phrase.split())
            size = len(phrase.split())
            need = -(-3 * len(own) // 4)
            if any(len(own & set(w[b : b + 2 * size])) >= need for b in range(0, len(w), size)):
                want.add(label)
        assert found[i][0] == ",".join(sorted(want))


# N-gram Jaccard join


def links_by_force(rows):
    sets = []
    for text in rows:
        w = common.words(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def classes_by_force(n, links):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    return label


def near_copies():
    random.seed(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(random.choices(words, k=60)) for _ in range(30)]
    base = random.choices(words, k=100)
    for _ in range(60):  # a large group of near copies, some within the threshold of others
        own = list(base)
        for _ in range(random.randint(0, 3)):
            own[random.randrange(100)] = random.choice(words)
        texts.append(" ".join(own))
    passage = " ".join(random.choices(words, k=50))
    texts += [passage + " " + " ".join(random.choices(words, k=60)) for _ in range(20)]
    return texts + [texts[0], texts[0].upper(), "a b c", "A, b. c", "", None]


@pytest.mark.parametrize("chunk, few", [(8, 8), (8, 0), (512, 10**6), (512, 8)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, chunk, few):
    monkeypatch.setattr(near_duplicates, "CHUNK", chunk)
    monkeypatch.setattr(near_duplicates, "EXACT", 8)
    monkeypatch.setattr(near_duplicates, "FEW", few)
    texts = near_copies()
    links = links_by_force(texts)
    label, count = classes_by_force(len(texts), links), Counter(i for pair in links for i in pair)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = keyed(near_duplicates.near_duplicate_table(df), "class_id", "n_links")
    assert found == {i: (label[i], count[i]) for i in range(len(texts))}


def test_near_duplicates_in_one_component(spark):
    assert near_duplicates.EXACT >= 66  # then a group of 66 is one unit
    texts = near_copies()
    links = links_by_force(texts)
    label, count = classes_by_force(len(texts), links), Counter(i for pair in links for i in pair)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert keyed(near_duplicates.near_duplicate_table(df), "class_id", "n_links") == {i: (label[i], count[i]) for i in range(len(texts))}


@pytest.mark.parametrize("piece", [7, 64, 1 << 18])
def test_word_hashes_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(near_duplicates, "PIECE", piece)
    random.seed(6)
    texts = ["".join(random.choices(["a", "B", "é", " ", ".", "xyz", "\n", "0"], k=random.randint(0, 40))) for _ in range(200)] + ["w" * 500, "", "tail"]
    raw = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    found, owner = near_duplicates.word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    want = [(i, w) for i, x in enumerate(texts) for w in common.words(x)]
    assert owner.tolist() == [i for i, _ in want]
    # Equal words have equal hashes, others others.
    assert len(set(zip(found.tolist(), (w for _, w in want)))) == len(set(found.tolist())) == len({w for _, w in want})


def test_near_duplicate_edge_cases(spark):
    rows = near_duplicates.near_duplicate_table(odd(spark)).collect()
    assert len(rows) == len(ROWS)
    assert [(r.class_id, r.n_links, r.n_copies) for r in rows if r.doc_id == 4] == [(4, 1, 1)] * 2
    assert near_duplicates.near_duplicate_table(empty(spark)).count() == 0


def test_drop_near_duplicates_keeps_one_of_each(spark):
    texts = near_copies()
    label = classes_by_force(len(texts), links_by_force(texts))
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, near_key string")
    df = df.withColumnRenamed("near_key", "key")
    assert sorted(r.doc_id for r in near_duplicates.drop_near_duplicates(df).collect()) == sorted(set(label))
    kept = near_duplicates.drop_near_duplicates(odd(spark)).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 2, 3, 4, None, 5, 6, 7, 8])
    assert kept[0].asDict().keys() == odd(spark).first().asDict().keys()
    assert near_duplicates.drop_near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (7, 7), (500, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = dict(tuple(r) for r in components.components(df).collect())
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in (100, 200, 300, 500)}


# Byte-level BPE


def test_bpe_equals_library(spark, docs, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for df in (docs, odd(spark)):
        for r, got in zip(*(sorted(x.collect(), key=lambda r: (r.doc_id is None, r.doc_id)) for x in (df, bpe.bpe_digests(df, path, pattern)))):
            ids = known.encode_ordinary(r.text or "")
            assert got.n_tokens == len(ids)
            assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.bpe_digests(empty(spark), path, pattern).count() == 0


def test_bpe_random_texts_and_long_pieces(vocabulary):
    import tiktoken

    path, pattern = vocabulary
    coder = bpe.encoder(path, pattern)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.whole, special_tokens={})
    random.seed(1)
    alphabet = [*"ab e\n\t   \x1c\x1d\x85'sS1٣é中😀,.!?  ", "hello", "the", "  ", "\r\n", "<|endoftext|>", "'ll"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 20))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 3000, "é" * 777, "thequick" * 200, "x" * 257]
    assert [coder.encode_ids(t) for t in texts] == [known.encode_ordinary(t) for t in texts]


def test_bpe_round_trip_frames(spark, docs, vocabulary):
    path, pattern = vocabulary
    back = bpe.bpe_decode(bpe.bpe_encode(docs, path, pattern), path, pattern)
    assert keyed(back, "text") == {r.doc_id: (r.text,) for r in docs.collect()}


def test_numbers_are_no_letters_and_marks_stay_in_words(spark):
    assert [langid.text_words(t) for t in ("½ ² ① Ⅷ ٣", "नमस्ते दुनिया", "cafe\u0301s, x_y")] == [[], [" नमस्ते ", " दुनिया "], [" cafe\u0301s ", " x ", " y "]]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd_ones = spark.createDataFrame([(10_000, "½ ² ①", "en"), (10_001, "Ⅷ 12 _", None), (None, "x", None)], docs.schema)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_table(docs.unionByName(odd_ones)).collect() if r.doc_id is None or r.doc_id >= 10_000}
    assert found[10_000] == found[10_001] == ("und", 0.0) and found[None][0] != "und"


# Mixing


MIX_SQL = """
with b as (select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
  md5('mix|' || coalesce(doc_id::varchar, '') || '|' || coalesce(md5(text), '')) as base, row_number() over (partition by doc_id, text, source) - 1 as number from docs),
d as (select *, case when number > 0 then md5(base || '|' || number) else base end as key from b),
s as (select source, sum(size)::bigint as source_size from d group by 1),
r as (select *, row_number() over (order by source nulls last) - 1 as place from s)
select doc_id, d.source, size, source_size, place, key from d join r on d.source is not distinct from r.source
"""


def targets_by_force(sizes):
    total, weights = sum(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i] + 1e-9]
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def mix_by_force(df):
    docs = df.select("doc_id", "text", "source").toPandas()  # noqa: F841  read by the SQL
    docs["doc_id"] = docs["doc_id"].astype("Int64")
    rows = duckdb.sql(MIX_SQL).fetchall()
    by_source = {}
    for doc_id, source, size, source_size, at, key in rows:
        by_source.setdefault(at, (source_size, []))[1].append((key, size, doc_id))
    order = sorted(by_source)
    target = targets_by_force([by_source[at][0] for at in order])
    out = Counter()
    for at, goal in zip(order, target):
        source_size, own = by_source[at]
        passes = min(3, int(goal // source_size)) if source_size else 0
        rest, so_far = goal - passes * source_size, 0
        for key, group in itertools.groupby(sorted(own, key=lambda x: x[0]), key=lambda x: x[0]):
            group = list(group)
            words = sum(s for _, s, _ in group)
            extra = 2 * so_far + words < 2 * rest
            so_far += words
            for _, size, doc_id in group:
                out[doc_id, size, source_size, round(goal, 6), (passes + extra) * size] += 1
    return out


def mixed(df):
    return Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_mix_equals_brute_force(spark, docs):
    assert mixed(mixing.mix_table(docs)) == mix_by_force(docs)


def test_mix_caps_and_edge_cases(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "a"), (900, "b"), (50, "c"), (0, "d"), (40, None), (7, None)] * 3)]
    df = spark.createDataFrame([*rows, (None, "x y", "a"), (3, "w " * 50, "c"), (99, None, "e")], "doc_id long, text string, source string")
    found = mixing.mix_table(df)
    assert mixed(found) == mix_by_force(df)
    assert all(r.taken <= 3 * r["size"] for r in found.collect())
    assert mixing.mix_table(empty(spark)).count() == 0
    assert mixing.mix_table(odd(spark)).count() == len(ROWS)


@pytest.mark.parametrize("alike", [False, True])
def test_mix_of_rows_without_ids_meets_its_target(spark, alike):
    """Texts that differ, or whole rows that agree, all without an id or all of one id."""
    rows = [(None if i % 2 else 7, "b b b" if alike else f"word w{i} x", "b") for i in range(400)]
    rows += [(1000 + i, "a " * 20, "a") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix_table(df).collect()
    assert len(found) == len(rows) and all(r.taken <= 3 * r["size"] for r in found)
    target = next(r.target for r in found if r.doc_id is None)
    assert abs(sum(r.taken for r in found if r.doc_id in (None, 7)) - target) <= 3
    assert Counter((r.doc_id, r.taken) for r in mixing.mix_table(df.repartition(3)).collect()) == Counter((r.doc_id, r.taken) for r in found)


def test_mix_buckets_follow_the_largest_source():
    assert [mixing.digits_for(x) for x in (0, mixing.BUCKET_WORDS << 12, (mixing.BUCKET_WORDS << 12) + 1, 1 << 60)] == [3, 3, 4, 6]


def test_mix_deals_equal_shards_without_repeats(spark, docs):
    rows = mixing.mix_table(docs, shard_words=10_000).collect()
    shards = Counter(s for r in rows for s in r.shards.split(",") if s)
    assert len(shards) == 8
    again = mixing.mix_table(docs.repartition(5), shard_words=10_000).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    copies = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert {r.doc_id: r.taken for r in rows if r.taken} == {r.doc_id: copies[r.doc_id] * r["size"] for r in rows if copies[r.doc_id]}


def test_hypergeometric_draws(spark):
    draws = spark.range(4000).select(
        mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), mixing.uniform(F.lit("t"), F.col("id"))).alias("x")
    )
    found = Counter(r.x for r in draws.collect())
    mean = sum(k * v for k, v in found.items()) / 4000
    var = sum((k - mean) ** 2 * v for k, v in found.items()) / 4000
    assert abs(mean - 4) < 0.1 and abs(var - 10 * 0.4 * 0.6 * 40 / 49) < 0.15 and min(found) >= 0 and max(found) <= 10
    edge = spark.range(1).select(*[mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(d), F.lit(0.7)) for n, k, d in ((5, 5, 3), (5, 0, 3), (5, 2, 5), (0, 0, 0))])
    assert list(edge.first()) == [3, 0, 2, 0]


# Quality


def test_quality_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    found = quality.quality_table(docs, labels)
    judged = found.where("held_out").join(labels, "doc_id")
    right, n = judged.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert right / n > 0.95
    assert found.where("score < 0 or score > 1 or score is null").count() == 0


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (1, 1)], "doc_id long, quality int")
    assert quality.quality_table(odd(spark), labels).where("score between 0 and 1").count() == len(ROWS)
    assert quality.quality_table(empty(spark), labels).count() == 0
    assert quality.quality_table(odd(spark), labels.where("false")).count() == len(ROWS)


def test_statistics_equal_plain_counts():
    import pyarrow as pa

    random.seed(21)
    alphabet = [*"abzAZ059 .,!|*#\n\t-é中", "Word", "the the", "\n\n", "  "]
    texts = ["".join(random.choices(alphabet, k=random.randint(1, 60))) for _ in range(300)]
    table = quality.statistics(pa.array(texts))
    at = {name: i for i, name in enumerate(quality.STATISTICS)}
    for text, row in zip(texts, table):
        n = len(text)
        share = lambda chars: sum(c in chars for c in text) / n
        found = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
        sizes = [len(w.encode()) for w in found]
        want = {
            "n_chars": n, "n_words": len(found), "upper_share": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit_share": share("0123456789"),
            "punct_share": share(".,;:'\"()-?"), "mark_share": share("!"), "bar_share": share("|"), "symbol_share": share("*#"),
            "other_share": sum(ord(c) > 127 for c in text) / n, "blank_share": share(" \t\n"), "line_chars": n / (text.count("\n") + 1),
            "repeated_lines": 1 - len(set(text.split("\n"))) / len(text.split("\n")), "longest_word": max(sizes, default=0),
            "word_chars": sum(map(len, found)) / max(len(found), 1),
            "repeats": 1 - len(set(found)) / len(found) if found else 0,
            "upper_words": sum(2 * sum(c.isascii() and c.isupper() for c in w) > len(w.encode()) for w in found) / max(len(found), 1),
        }
        assert {k: pytest.approx(float(v)) for k, v in want.items()} == {k: row[at[k]] for k in want}, text
    assert set(want) == set(quality.STATISTICS)


def test_rule_columns_equal_plain_rules(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    names = [f"stat_{s}" for s in quality.STATISTICS]
    rows = quality.with_statistics(docs).select("doc_id", *names, model.column().alias("score")).collect()
    assert model.rules
    for r in rows:
        total = model.bias
        for rule, weight in model.rules:
            if all(r[names[j]] <= cut if low else r[names[j]] > cut for j, low, cut in rule):
                total += weight
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)))


def test_statistics_by_hand():
    import pyarrow as pa

    table = quality.statistics(pa.array(["Ab cd\nAB!", None, "", "é 1|*"]))
    at = {name: i for i, name in enumerate(quality.STATISTICS)}
    assert table[0, at["n_chars"]] == 9 and table[0, at["n_words"]] == 3 and table[0, at["longest_word"]] == 3
    assert table[3, at["n_chars"]] == 5 and table[3, at["other_share"]] == 0.2 and table[3, at["bar_share"]] == 0.2
    assert not table[1].any() and not table[2].any()


# Language ID


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.98


def test_language_edge_cases(spark):
    found = langid.language_table(odd(spark)).collect()
    assert len(found) == len(ROWS)
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 7, 8)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)
    assert langid.language_table(empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.language_table(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_learns_and_scores_whole_texts(spark):
    rows = [("xx", "abab abc bca " * 2000 + "zebu zebu zebu", "1"), ("yy", "zz zy yz " * 2000 + "okapi okapi", "2")]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string, key string"))
    text = "abab abc bca cab abc abc bca"
    found = model.predict([text, "1 " * 300 + text, "zebu zebu", "okapi okapi"])
    assert found[0] == ["xx", "xx", "xx", "yy"]
    assert found[1][1] == pytest.approx(found[1][0]) and found[1][0] > 0.9


def kneser_ney_by_force(texts, order=langid.ORDER, discount=langid.DISCOUNT):
    """A function of (character, characters before it in its word) that gives the interpolated probability, from plain counts."""
    grams = [Counter() for _ in range(order + 1)]
    for text in texts:
        for word in langid.text_words(text):
            for n in range(1, order + 1):
                for i in range(max(1, n - 1), len(word)):
                    grams[n][word[i - n + 1 : i + 1]] += 1
    value = [Counter() for _ in range(order + 1)]
    for n in range(1, order + 1):
        kinds = Counter(g[1:] for g in grams[n + 1]) if n < order else Counter()
        for g, count in grams[n].items():
            value[n][g] = kinds[g] or count  # what begins a word has nothing before it: its count stays
    letters = len(value[1])

    def p(c, before):
        if not before:
            total = sum(value[1].values())
            below = 1 / (letters + 1)
            return max(value[1][c] - discount, 0) / total + discount * letters / total * below if value[1][c] else discount * letters / total * below
        n = len(before) + 1
        after = [v for g, v in value[n].items() if g[:-1] == before]
        if not after:
            return p(c, before[1:])
        return max(value[n][before + c] - discount, 0) / sum(after) + discount * len(after) / sum(after) * p(c, before[1:])

    return p


def test_language_scores_equal_brute_force(spark):
    texts = {"xx": ["abab abc bca cab aab", "caba Bac"], "yy": ["zz zy yz azz", "yzzy z"]}
    rows = [(lang, t, f"{lang}{i}") for lang, own in texts.items() for i, t in enumerate(own)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string, key string"))
    for k, lang in enumerate(model.languages):
        p = kneser_ney_by_force(texts[lang])
        for text in ("abc", "zzz q", "cab yz Ab", "é1a"):
            total = chars = 0
            for word in langid.text_words(text):
                for i in range(1, len(word)):
                    total -= np.log(p(word[i], word[max(0, i - langid.ORDER + 1) : i]))
                    chars += 1
            assert model.cross_entropy([text])[0, k] == pytest.approx(total / chars, rel=1e-5)


def test_language_pieces_change_nothing(spark, monkeypatch):
    model = langid.train(spark.createDataFrame([("xx", "abab abc bca cab aab", "1"), ("yy", "zz zy yz", "2")], "lang string, text string, key string"))
    texts = ["abc zy " * 50, "a" * 40 + " zz", "", None, "1 2 3", "ab"]
    whole = model.cross_entropy(texts)
    monkeypatch.setattr(langid, "PIECE", 5)
    assert np.allclose(model.cross_entropy(texts), whole, equal_nan=True)


def test_language_rejects_by_calibrated_limits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.language_table(docs).where("held_out")
    assert found.where("rejected and lang_pred != 'und'").count() <= 0.01 * found.count()
    model = langid.train(langid.learnable(docs))
    foreign = ["Tämä on suomenkielinen lause, joka kertoo kissasta ja koirasta metsässä.", "To jest zdanie po polsku o kocie i psie w lesie.",
               "Это предложение на русском языке о кошке и собаке.", "xkqz wvbn plmt rrtg hhjk zzxc qwpo"]
    assert model.predict(foreign)[3].all()


def test_language_tables_depend_on_their_own_language_only(spark):
    letters = [chr(0x61 + k) + chr(0x3B1 + k) + chr(0x430 + k) + "e" for k in range(24)]
    rows = [(f"l{k:02}", " ".join(a + b + c for a in own for b in own for c in own[: 1 + i]), f"{k}.{i}") for k, own in enumerate(letters) for i in range(4)]
    df = spark.createDataFrame(rows, "lang string, text string, key string")
    size = lambda t: sum(x.nbytes for some in (t.keys, t.logp, t.contexts, t.backoff) for x in some)
    model = langid.train(df)
    assert model.languages == [f"l{k:02}" for k in range(24)]
    for k in (0, 17):
        alone = langid.train(df.where(F.col("lang") == f"l{k:02}")).tables[0]
        assert size(alone) == size(model.tables[k]) and alone.floor == model.tables[k].floor
        for mine, there in ((alone.keys, model.tables[k].keys), (alone.contexts, model.tables[k].contexts), (alone.logp, model.tables[k].logp)):
            assert all((a == b).all() for a, b in zip(mine, there))
    assert sum(map(size, model.tables)) <= 24 * max(map(size, model.tables))
    assert model.predict([f"{own[0]}{own[1]}{own[2]}" for own in letters])[0] == model.languages


def test_kneser_ney_sums_to_one(spark):
    df = spark.createDataFrame([("xx", "abab abc bca cab aab", "1"), ("yy", "zz zy yz", "2")], "lang string, text string, key string")
    model = langid.train(df)
    letters = "abc "
    for head in ("", "a", "ab", "b"):
        words = [f" {head}{c}" for c in letters]
        before = model.word_scores([f" {head}"])[0] if head else np.zeros(2)
        p = np.exp(model.word_scores(words)[:, 0] - before[0])
        assert 0.8 < p.sum() < 1.0 + 1e-9


# Token files


@pytest.mark.parametrize("values", [[], [0] * 500, [5], list(range(1000)), [1 << 63, 5, (1 << 60) - 1, 0, 1 << 61, (1 << 64) - 1], [3, 70000] * 200])
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    words, first = token_files.pack(values)
    assert (token_files.unpack(words, first, len(values)) == values).all()
    for b in range(len(first)):  # each block on its own
        stop = first[b + 1] if b + 1 < len(first) else len(words)
        own = values[b * token_files.BLOCK : (b + 1) * token_files.BLOCK]
        assert (token_files.unpack(words[first[b] : stop], np.zeros(1, np.uint32), len(own)) == own).all()


def test_token_files_equal_library(spark, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")[0]
    tokenizer = Tokenizer.from_file(path)
    for df in (docs, odd(spark)):
        rows = sorted(df.collect(), key=in_order)
        found = sorted(token_files.token_table(df, path).collect(), key=lambda r: r.start)
        start = 0
        for r, got in zip(rows, found, strict=True):
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert token_files.token_table(empty(spark), path).count() == 0


def test_token_files_equal_unmodified_library_on_added_tokens(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")[0]
    tokenizer = Tokenizer.from_file(path)
    mark = "<|endoftext|>"
    texts = [f"x {mark} y", mark, f"a{mark}b c", f"one two\n {mark}{mark}", "<|endof text|> y", "plain words here", f"x y {mark[:-1]} >", f" {mark} "]
    found = token_files.token_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    found, start = sorted(found.collect(), key=lambda r: r.doc_id), 0
    for text, got in zip(texts, found, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


# Top-k


def test_top_k_equals_sql(spark):
    duckdb.sql("create or replace view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    want = sorted(duckdb.sql(queries.ORACLE_SQL["op8_exact_top_k"]).fetchall())
    found = topk.top_k_table(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_top_k_edge_cases(spark):
    random.seed(4)
    rows = [(i, [random.choice((-0.5, 0.0, 0.5, 1.0)) for _ in range(6)], "x", 1) for i in range(120)]
    rows += [(7, rows[3][1], "x", 1), (200, None, "x", 1), (250, [0.1, None], "x", 1), (300, [float("nan")] * 6, "x", 1), (None, [1.0] * 6, "x", 1)]
    rows += [(350, [], "x", 1), (400, [1.0, 2.0], "x", 1), (401, [1.0, 1.0], "x", 1), (50, rows[50][1], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score int").repartition(4)
    usable = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in usable if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, topk.top_k_table(df).collect())) == sorted(want)
    assert topk.top_k_table(df.where("false")).count() == 0


def test_top_k_across_units_and_at_the_ends_of_64_bits(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 8), ("QUERY_ROWS", 2), ("SHARE_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, value)
    random.seed(14)
    rows = [(i, [random.gauss(0, 1) * random.choice((1, 1, 100, 1e6)) for _ in range(5)]) for i in range(300)]
    rows += [(400 + i, [random.choice((-1e30, 1e30, 1e17, -3e16, 0.0)) for _ in range(5)]) for i in range(60)]
    rows += [(0, [1.0, 2.0, 3.0, 4.0, 5.0]), (0, [0.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    end = 1 << 63
    whole = [(i, [min(max(int(np.floor(256 * x)), -end), end - 1) for x in v]) for i, v in rows]
    asked = {}
    for (i, v), (_, raw) in zip(whole, rows):
        if i % 50 == 0 and (i not in asked or raw < asked[i][0]):
            asked[i] = raw, v
    want = []
    for q, (_, v) in asked.items():
        scored = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -end), end - 1), i) for i, w in whole if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, topk.top_k_table(df).collect())) == sorted(want)


# Fingerprints


def fingerprint_by_force(text):
    """The number of code points, two hashes of the whole, and the least span hash of each bin, one span at a time."""
    mask = (1 << 64) - 1
    whole = [sum((ord(c) + 1) * pow(base, i, prime) for i, c in enumerate(text)) % prime for base, prime in zip(fingerprints.BASES, fingerprints.PRIMES)]
    base, prime = fingerprints.BASES[0], fingerprints.PRIMES[0]
    size = min(fingerprints.SPAN, len(text))
    least = {}
    for at in range(len(text) - size + 1 if text else 0):
        x = sum((ord(c) + 1) * pow(base, i, prime) for i, c in enumerate(text[at : at + size])) % prime + 1
        x ^= x << 31 & mask
        x = x * 0x9E3779B97F4A7C15 & mask
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 32
        least[x >> 58] = min(least.get(x >> 58, mask), x)
    sketch = [min(least[k] & 0xFFFF, 0xFFFE) if k in least else 0xFFFF for k in range(fingerprints.BINS)]
    return f"{len(text):x}-{whole[0]:08x}{whole[1]:08x}-" + "".join(f"{x:04x}" for x in sketch), sketch


def likeness_by_force(a, b):
    filled = [k for k in range(len(a)) if a[k] != 0xFFFF or b[k] != 0xFFFF]
    return sum(a[k] == b[k] for k in filled) / len(filled) if filled else 1.0


@pytest.mark.parametrize("run", [16, 50, 1 << 16])
def test_fingerprints_equal_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(fingerprints, "RUN", run)
    random.seed(11)
    texts = ["".join(random.choices("ab é😀\n", k=n)) for n in (0, 1, 11, 12, 13, 15, 16, 17, 27, 28, 32, 48, 60, 100, 300)] + ["x" * 200, None]
    random.shuffle(texts)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(3)
    found = sorted(fingerprints.fingerprint_table(df).collect(), key=lambda r: r.doc_id)
    texts = [t or "" for t in texts]
    for r, a, b in zip(found, texts, texts[1:] + texts[:1], strict=True):
        half = len(a) // 2
        changed = a[: len(a) - half] + b[:half]
        (own, sketch), (new, new_sketch), (_, after) = map(fingerprint_by_force, (a, changed, b))
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(a), own, new)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness_by_force(sketch, new_sketch)) and r.near_next == pytest.approx(likeness_by_force(sketch, after))
        assert r.kept_prefix == len(os.path.commonprefix([a, changed]))


def test_fingerprints_equal_direct_computation(spark, docs):
    for df in (docs.repartition(3), odd(spark)):
        rows = sorted(df.collect(), key=in_order)
        texts = [r.text or "" for r in rows]
        want = Counter()
        for r, a, b in zip(rows, texts, texts[1:] + texts[:1]):
            half = len(a) // 2
            changed = a[: len(a) - half] + b[:half]
            own, new = fingerprints.fingerprint_batch([a, changed])
            want[r.doc_id, len(a), hashlib.sha256(changed.encode()).hexdigest(), own, new] += 1
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
        found = fingerprints.fingerprint_table(df).collect()
        assert Counter(tuple(r[c] for c in names) for r in found) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert fingerprints.fingerprint_table(empty(spark)).count() == 0
    assert fingerprints.fingerprint_table(docs.limit(1)).first().near_next == 1.0


def test_spans_and_extensions():
    random.seed(2)
    texts = ["".join(random.choices("ab", k=random.randint(0, 60))) for _ in range(40)]
    p = fingerprints.Prefixes(texts)
    for _ in range(300):
        i, j = random.randrange(40), random.randrange(40)
        a, b = random.randint(0, len(texts[i])), random.randint(0, len(texts[j]))
        n = 0
        while a + n < len(texts[i]) and b + n < len(texts[j]) and texts[i][a + n] == texts[j][b + n]:
            n += 1
        found = p.common_extension(np.array([i]), np.array([a]), p, np.array([j]), np.array([b]))
        assert found[0] == n


def test_near_likeness_orders(spark):
    random.seed(1)
    words = [f"word{i}" for i in range(500)]
    texts = [" ".join(random.choices(words, k=200)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.near_edited > 0.15 > r.near_next for r in fingerprints.fingerprint_table(df).collect())


# HTML


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header>'
    '<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">Cookies</div>{open}<h1>Head &amp; more</h1>'
    "<p>One <b>bold</b>\n  text.<br>Next<p>Last &#233;&nbsp;{own}</p>{close}<aside>Side</aside><div id=\"comments\"><p>First!</p></div>"
    "<form><input name=q>Search</form><footer>&copy; x</footer></body></html>"
)


def test_html_article_and_differencing(spark):
    with_article = PAGE.format(open="<article>", close="</article>", own="mine")
    without = [PAGE.format(open="<p>Template line</p>", close="", own=f"own{i}") for i in range(2)]
    rows = [(1, "http://a/x/1", with_article), (2, "http://a/x/2", with_article), (3, "http://b/y/1", without[0]), (4, "http://b/y/2", without[1]),
            (5, "http://c/1", None), (6, None, ""), (7, "http://d/1", "plain < text"), (8, "http://d/9", "<p>cut"), (9, "http://e/1", without[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit("x")).repartition(3)
    found = {r.page_id: r for r in html_text.extract_table(df).collect()}
    whole = "Head & more One bold text. Next Last é mine"
    assert found[1].text == found[2].text == whole and found[1].n_chars == len(whole)
    assert (found[3].text, found[4].text) == ("Last é own0", "Last é own1")
    assert found[5].text == found[6].text == "" and found[7].text == "plain < text" and found[8].text == "cut"
    assert found[9].text.startswith("Template line Head & more")
    assert html_text.extract_table(df.where("false")).count() == 0


def text_of(page, *near):
    return html_text.main_text(html_text.page_lines(page), list(near))[0]


@pytest.mark.parametrize("mark", ["page with-sidebar", "search-results", "share-layout", "no-banner", "sidebar"])
def test_html_classes_around_and_inside_an_article(mark):
    page = (
        f'<div class="{mark}"><p>Menu</p><article><h1>Head</h1><p class="related-work">Work</p><div class="ad">Buy</div></article><p>End</p></div>'
        '<div class="comments"><article><p>First!</p></article></div>'
    )
    assert text_of(page) == "Head Work"


HTML_TEXTS = (
    ("<head><title>t</title><body><p>hello", "hello"), ("<title>t</title><p>hello", "hello"),
    ('<p data-class="ad">a</p><p data-id="menu">b</p><p id=menu>c</p>', "a b"),
    ('<article><section class="related-work">work</section><p class="promo">ad<div>real</div></article>', "work real"),
    ("<main>around<article>long article text</article></main><article>no</article>", "long article text"),
    ("<article>post text here<article>a comment</article></article>", "post text here"),
    ('<article>post<div class="comments"><p>c</p></div><footer>by</footer></article>', "post"),
    ("<form><article>in a form</article></form><form>Search</form>", "in a form"),
    ("wo<span hidden>x</span>rd a<b>b</b>c &lt;p&gt; &#0000065; &#x1F600; &#99999999999;", "word abc <p> A 😀 �"),
    ("a < b <3 c<!-- x > y -->d<![CDATA[<e>]]></ x>f<br>g", "a < b <3 cd<e>f g"), ("text <a href='cut", "text"),
    ("<ul><li class=ad>x<li>y<ul><li>z</ul></ul><table><tr class=ad><td>x<tr><td>w</table>", "y z w"),
    ("<script>if (a</script>x<style>p{}</style><textarea><p>t</p></textarea><svg><text>s</text></svg>y", "xy"), ("", ""), (None, ""),
    ('<p style="display: none">x</p><div role="navigation">m</div><div aria-label="cookie notice">n</div><p>y', "y"),
    ('<div class="site-footer">f</div><div class="article-header">h</div><div class="top-menu">m</div>', "h"),
)


@pytest.mark.parametrize("page, text", HTML_TEXTS)
def test_html_structure(page, text):
    assert text_of(page) == text


def test_html_articles_of_the_test_pages(spark):
    """The pages' articles as a plain parser of the standard library reads them."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag not in ("b", "a", "i", "em", "strong", "span"):
                self.out.append(" ")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag not in ("b", "a", "i", "em", "strong", "span"):
                self.out.append(" ")

        def handle_data(self, data):
            if self.inside:
                self.out.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html or "")
        parser.close()
        want[r.page_id] = " ".join("".join(parser.out).split())
    found = html_text.extract_table(pages).collect()
    assert {r.page_id: r.text for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found)


def difference_by_force(rows):
    """(page_id, text) of pages of ``<p>`` lines that are told apart by their text alone."""
    out = {}
    hosts = {}
    for i, url, lines in rows:
        host, path = url.removeprefix("http://").split("/", 1)
        hosts.setdefault(host, []).append(("/" + path, url, i, lines))
    for own in hosts.values():
        own.sort(key=lambda x: x[:3])
        for k, (path, _, i, lines) in enumerate(own):
            near = [own[j] for j in (k - 1, k + 1) if 0 <= j < len(own)]
            near.sort(key=lambda x: -len(os.path.commonprefix([x[0], path])))
            gone = [x for x in lines if near and x in near[0][3]]
            if len(near) > 1 and 2 * sum(map(len, gone)) >= sum(map(len, lines)):
                gone = [x for x in gone if x in near[1][3]]
            out[i] = " ".join([x for x in lines if x not in gone] or lines)
    return out


def test_html_differencing_equals_brute_force(spark):
    random.seed(8)
    rows = []
    for i in range(240):
        host = random.choice(("a", "a", "a", "b", "c", f"h{i}"))
        # Lines in alphabetic order, each once, so that common lines are one common subsequence.
        own = [f"own {i} {k}" for k in range(random.randint(0, 4))] + [f"copied {host} {i // 7}"] * random.randint(0, 1)
        lines = sorted({*random.sample([f"template {host} {k}" for k in range(8)], random.randint(0, 8)), *own})
        rows.append((i, f"http://{host}/{random.choice('xy')}/{random.randint(0, 99)}", lines))
    df = spark.createDataFrame([(i, url, "".join(f"<p>{x}" for x in lines)) for i, url, lines in rows], "page_id long, url string, html string")
    found = html_text.extract_table(df.repartition(5)).collect()
    assert {r.page_id: r.text for r in found} == difference_by_force(rows)
    assert sum(r.n_shared > 0 for r in found) > 100
    assert all(r.n_protected == r.n_marked == 0 for r in found)


def test_html_odd_rows_and_long_pages(spark):
    hostile = "<a " * 300_000, "<div>" * 100_000 + "</span>" * 100_000, '<a x=">" ' * 100_000, "<ul><li>" + "<b>" * 50_000 + "<li></li>" * 50_000, "&#" + "9" * 100_000
    rows = [(i, "http://a/1", page, "l", 1) for i, page in enumerate(hostile)]
    rows += [(None, "http://a/1", "<p>x", "l", 1), (None, "http://a/1", "<p>x", "l", 1), (7, None, None, "l", 1), (8, "http://b/", "<p>word " * 200_000, "l", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lines string, part int").repartition(3)
    found = html_text.extract_table(df).collect()
    assert len(found) == len(rows)
    assert [r.text for r in found if r.page_id is None] == ["x", "x"]
    assert [r.n_chars for r in found if r.page_id == 8] == [200_000 * 5 - 1]


def test_longest_common_lines(monkeypatch):
    random.seed(9)
    for _ in range(300):
        a, b = random.choices("abcd", k=random.randint(0, 30)), random.choices("abcd", k=random.randint(0, 30))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        for cells in (1 << 26, 8):  # in one table, and halved
            monkeypatch.setattr(html_text, "CELLS", cells)
            found = html_text.shared_lines(a, b)
            assert sum(found) == table[-1][-1]
            rest = iter(b)
            assert all(x in rest for x, s in zip(a, found) if s)


def test_html_same_for_any_partitioning(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    once = sorted(map(tuple, html_text.extract_table(pages).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, html_text.extract_table(pages).collect())) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_top_k_of_clusters_shuffles_few_block_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 20
    centres[:, 4:] = centres[:, :4].repeat(3, axis=1)  # segments' means tell the clusters apart
    vectors = centres[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    monkeypatch.setattr(topk, "SEGMENTS", (16, 16))
    monkeypatch.setattr(topk, "GRID", 64)
    met, searched = [], topk.searched

    def counted(pairs, *more):
        met.append(pairs.count())
        return searched(pairs, *more)

    monkeypatch.setattr(topk, "searched", counted)
    queries = df.where("vec_id % 10 = 0")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, queries).collect()}
    whole = np.floor(256 * vectors).astype(np.int64)
    for q in range(0, 4000, 10):
        scores = whole @ whole[q]
        order = [int(i) for i in np.lexsort((np.arange(4000), -scores)) if i != q][:5]
        assert [found[q, k + 1] for k in range(5)] == [(i, int(scores[i])) for i in order]
    every = -(-400 // 10) * (4000 // 20)
    assert sum(met) <= every / 4, (met, every)


# Pipeline


def stages_of(spark, docs):
    """(name, input rows, output) of each stage over docs."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF), "test")
        yield name, docs, out
        docs = out


def test_few_labels_give_a_constant():
    model = quality.fit(np.arange(3 * len(quality.STATISTICS), dtype=float).reshape(3, -1), np.array([1.0, 0.0, 1.0]))
    assert not model.rules and abs(model.bias - np.log(2)) < 1e-9


CLASHING = ("near_key", "near_kept", "near_fate", "near_rep", "near_twice", "mix_size", "mix_key", "mix_base", "mix_shards", "mix_number", "at_0", "copies", "cross_entropy")


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    for i, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), "doc_id"))
    docs = common.materialize(docs, "clashing")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, SF), "clashing")
        assert out.columns == docs.columns and out.count() > 0
        assert all(r[name] == f"{i}-{r.doc_id}" for r in out.collect() for i, name in enumerate(CLASHING))
        docs = out


def test_pipeline_stages_equal_brute_force(spark, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit(1))
    for name, before, out in stages_of(spark, docs):
        rows, kept = before.collect(), out.collect()
        if name != "byte-level BPE":
            assert out.columns == docs.columns
            assert {tuple(r) for r in kept} <= {tuple(r) for r in rows}
        if name == "language ID":  # what has letters of a learned language stays
            assert {r.doc_id for r in kept} == {r.doc_id for r in rows if langid.LETTERS(r.text or "")}
        elif name == "quality classifier":
            ids = {r.doc_id for r in kept}
            judged = [(labels[r.doc_id] == 1) == (r.doc_id in ids) for r in rows if labels.get(r.doc_id) is not None]
            assert len(judged) > 20 and sum(judged) >= 0.9 * len(judged)
        elif name == "n-gram Jaccard join":
            rows.sort(key=lambda r: r.doc_id)
            classes = classes_by_force(len(rows), links_by_force([r.text for r in rows]))
            assert sorted(r.doc_id for r in kept) == sorted({rows[k].doc_id for k in classes})
        elif name == "mixing sources":
            words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
            copies = Counter(r.doc_id for r in kept)
            assert {(i, copies[i] * words[i]) for i in words} == {(key[0], key[4]) for key in mix_by_force(before)}
        else:
            found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept)
            want = Counter()
            for r in rows:
                ids = known.encode_ordinary(r.text or "")
                want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
            assert found == want


def test_pipeline_takes_odd_rows_and_none(spark):
    rows = odd(spark).unionByName(spark.createDataFrame([(90 + i, f"some words of text number {i} in a plain sentence here", "en", "a", 0, "k", 0.5, "w") for i in range(5)], EXTRA))
    ids = {r.doc_id for r in rows.collect()}
    for name, before, out in stages_of(spark, rows):
        if name != "byte-level BPE":
            assert out.columns == rows.columns
        assert {r.doc_id for r in out.collect()} <= ids
    for _, _, out in stages_of(spark, empty(spark)):
        assert out.count() == 0
