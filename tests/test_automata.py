"""Automata against brute force, in one part and in several."""

import random

import numpy as np
import pytest

from larkspur.operators import automata, kb


def all_places(texts, patterns):
    out = []
    for k, text in texts:
        for p in {p for p in patterns if p}:
            out += [(k, i, p) for i in range(len(text or "")) if text.startswith(p, i)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def many():
    random.seed(17)
    some = lambda n: "".join(random.choices(["a", "b", "é", "中", "😀", " "], k=n))
    texts = [(i, some(random.choice([0, 3, 40, 400]))) for i in range(40)] + [(40, None), (None, "aaaa"), (41, "ab" * 3000), (41, "ab" * 3000)]
    return texts, [some(random.randint(1, 6)) for _ in range(60)] + ["", None, "a", "aa", "aaa", "ab" * 700, "b" + "ab" * 40]


@pytest.mark.parametrize("parts", [1, 5])
def test_patterns_equal_brute_force(spark, many, monkeypatch, parts):
    texts, patterns = many
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in texts], "k long, t string, key string, start int").repartition(3)
    if parts > 1:
        total = sum(len(p.encode()) * 400 for p in set(patterns) - {"", None})
        monkeypatch.setattr(automata, "PART_BYTES", total // parts)
    monkeypatch.setattr(automata, "STRETCH", 50)
    found = automata.find_patterns(docs, spark.createDataFrame([(p,) for p in patterns], "pattern string"), "k", "t")
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == all_places(texts, set(patterns) - {None})


def test_a_dictionary_of_too_many_parts_takes_joins(spark, monkeypatch):
    monkeypatch.setattr(automata, "PART_BYTES", 100)
    monkeypatch.setattr(automata, "MOST_PARTS", 2)
    docs = spark.createDataFrame([(1, "abcab"), (2, None)], "k int, t string")
    found = automata.find_patterns(docs, spark.createDataFrame([("ab",), ("b",), ("ca",)], "pattern string"), "k", "t")
    assert sorted(map(tuple, found.collect())) == [(1, 0, "ab"), (1, 1, "b"), (1, 2, "ca"), (1, 3, "ab"), (1, 4, "b")]
    tokens = spark.createDataFrame([(1, ["foo", "bar", "foo"])], "doc_id int, words array<string>")
    found = automata.match_titles(tokens, spark.createDataFrame([("foo bar",), ("foo",)], "title string"))
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2, "foo bar", "foo bar"), (1, 2, 1, "foo", "foo")]


def similar(window, title):
    return sum(a == b for a, b in zip(window, title)) / max(len(window), len(title))


def longest_by_force(docs, titles, context, threshold, least):
    split, out = sorted((t, t.split(" ")) for t in titles if t), []
    for k, words in docs:
        for start in range(len(words or [])):
            for n in range(min(context, len(words) - start), 0, -1):
                window = words[start : start + n]
                if None in window or len(" ".join(window)) < least:
                    continue
                near = [(similar(window, ws) < 1, t) for t, ws in split if similar(window, ws) > threshold]
                if near:
                    out.append((k, start, n, " ".join(window), min(near)[1]))
                    break
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_titles_equal_brute_force(spark, monkeypatch, parts):
    random.seed(19)
    vocabulary = ["ab", "c", "déf", "ghij", "k", "l"]
    some = lambda n: random.choices(vocabulary, k=n)
    titles = {" ".join(some(random.randint(1, 8))) for _ in range(150)} | {"a  b", " c", "ab ", ""}
    docs = [(i, some(random.randint(0, 60)) + ["zz"]) for i in range(30)] + [(30, None), (31, ["ab", None, "c"]), (None, [])]
    docs += [(32, next(t for t in sorted(titles) if len(t.split(" ")) == 6).split(" ")[:5] + ["zz"])]
    if parts > 1:
        monkeypatch.setattr(automata, "PART_BYTES", sum(len(t.encode()) * 40 for t in titles) // parts)
    tokens = spark.createDataFrame(docs, "doc_id long, words array<string>").repartition(3)
    found = automata.match_titles(tokens, spark.createDataFrame([(t,) for t in titles] + [(None,)], "title string"))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = longest_by_force(docs, titles, 5, 0.8, 3)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert any(len(t.split(" ")) == 6 for *_, t in want)
    assert sorted(map(tuple, kb.match_spots(tokens.where("words is not null and doc_id <> 31"), spark.createDataFrame([(t,) for t in titles - {"a  b", " c", "ab ", ""}], "title string")).collect()), key=str) == [x for x in want if x[0] != 31]


def test_windows_that_may_differ_are_refused(spark):
    with pytest.raises(ValueError):
        automata.match_titles(spark.createDataFrame([], "doc_id int, words array<string>"), spark.createDataFrame([], "title string"), 6)


def test_a_trie_of_nothing_and_an_automaton_of_nothing():
    found = automata.automaton([])
    assert [len(x) for x in automata.places(found, np.frombuffer(b"abc", np.uint8), np.array([0, 3]))] == [0, 0]
    assert automata.word_trie([], 5, 0.8).titles == []
