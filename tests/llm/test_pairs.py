"""Token alignment, decontamination and conversation repair: brute force, SQL, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import alignment, conversations, decontamination, queries

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, at long, digest string, words string, pairs string"
TEXTS = [
    "The MIT License, and the mit\nlicense.", "", None, "word", "word", " ", "  a  b ", "a▁b", "é中😀 \x1c\x85 tab\there", "<|endoftext|> <s> </s> <unk> <0x41>",
    "x " * 3000, "don't  stop　now", "\x00\x7f", "१२३ नमस्ते", "é ﬁ ①",
]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i if i != 3 else None, t, 0, "d", "w", "p") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0]], EXTRA).repartition(3)


# Token alignment


@pytest.fixture(scope="module")
def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries(paths):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def encode(text):
        """(id, bytes) of the tokens of both sides."""
        found = a.encode(f" {text}", add_special_tokens=False)
        own = [(i, bytes(byte[c] for c in x)) for i, x in zip(found.ids, found.tokens)]
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        return own, [(i, bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode()) for i, x in pieces]

    return encode


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def by_force(texts, encode):
    """Contract's columns of each text, by comparing all pairs of tokens."""
    found = []
    for text in texts:
        a, b = encode(text) if text else ([], [])
        whole = f" {text}".encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append(None)
            continue
        a, b = spans(a), spans(b)
        links, low = [], 0
        for i, s, e in a:
            while b[low][2] <= s:
                low += 1
            k = low
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in (a, b)) if len(cuts) < 200 else None)
            start = cut
        found.append((len(a), len(b), len(cuts), links, groups))
    count = Counter(x for f in found if f for x in f[3])
    best = {}
    for (_, i), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        digest = hashlib.sha256(";".join(f[4]).encode()).hexdigest() if None not in f[4] else None
        out.append((f[0], f[1], f[2], len(f[3]), sum(count[x] == best[x[1]] for x in f[3]), sum(count[x] for x in f[3]), digest))
    return out


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def same(rows, texts, encode):
    want = sorted(zip([str(t) for t in texts], by_force(texts, encode)), key=str)
    got = sorted(((str(r.text), tuple(r[c] for c in FIGURES)) for r in rows), key=str)
    for (t, w), (u, g) in zip(want, got, strict=True):
        assert t == u and g[:6] == w[:6] and (w[6] is None or g[6] == w[6]), t[:50]


def with_text(docs, table):
    texts = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    return table.join(texts, table.doc_id.eqNullSafe(texts.doc_id)).select("text", *FIGURES).collect()


def test_alignment_equals_brute_force(spark, paths, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500 or text is null")
    same(with_text(docs, alignment.alignment_table(docs, *paths)), [r.text for r in docs.collect()], libraries)
    same(with_text(odd(spark), alignment.alignment_table(odd(spark), *paths)), [*TEXTS, TEXTS[0]], libraries)
    assert alignment.alignment_table(odd(spark).limit(0), *paths).collect() == []


def test_alignment_of_parts_and_of_shuffled_counts(spark, paths, libraries, monkeypatch):
    docs = odd(spark)
    want = sorted(alignment.alignment_table(docs, *paths).collect(), key=str)
    monkeypatch.setattr(alignment, "small", lambda df, n: df)
    monkeypatch.setattr(alignment, "HEAVY", 20)
    assert sorted(alignment.alignment_table(docs, *paths).collect(), key=str) == want
    a, b = alignment.coders(*paths)
    text = "some words, and more. " * 40 + "x" * 50
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "at": [0, 1], "text": [text, "short"]})
    whole = alignment.aligned_rows(batch, a, b).to_pylist()
    monkeypatch.setattr(alignment, "LONG", 100)
    assert len(list(alignment.parts(text))) > 5 and "".join(alignment.parts(text)) == f" {text}"
    assert alignment.aligned_rows(batch, a, b).to_pylist() == whole


def test_pieces_of_chunks_equal_the_library(paths, libraries):
    random.seed(5)
    letters = ["a", "b", " ", "  ", "\n", "▁", "é", "中", "1", ".", " ", "the", " ing"]
    texts = ["".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(500)]
    _, b = alignment.coders(*paths)
    ids, length = b.ids(pa.array([f" {t}" for t in texts]))
    at = 0
    for text, n in zip(texts, length.tolist()):
        if "▁" not in text:
            assert ids[at : at + n].tolist() == [i for i, _ in libraries(text)[1]], text
        at += n


def test_token_links_are_the_overlaps(spark, paths, libraries):
    docs = spark.createDataFrame([(1, "unbelievable things, really"), (2, None), (3, "a▁")], "doc_id long, text string")
    rows = alignment.token_links(docs, *paths).orderBy("a_place", "b_place").collect()
    a, b = (spans(x) for x in libraries("unbelievable things, really"))
    want = [(i, k) for i, x in enumerate(a) for k, y in enumerate(b) if max(x[1], y[1]) < min(x[2], y[2])]
    assert [(r.a_place, r.b_place) for r in rows] == want and {r.doc_id for r in rows} == {1}
    assert [(r.a_id, r.b_id) for r in rows] == [(a[i][0], b[k][0]) for i, k in want]


# Decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(decontamination.UPPER, decontamination.LOWER)))


def hit_by_force(texts, items, window, size, threshold):
    out = []
    for text in texts:
        w, hit, held = words(text), set(), set()
        for item, t in items:
            own = words(t)
            n = min(len(own), window)
            for i in range(len(own) - n + 1) if n else ():
                part, k = own[i : i + n], min(n, size)
                for s in range(len(w) - n + 1):
                    equal = sum(w[s + j : s + j + k] == part[j : j + k] for j in range(n - k + 1))
                    if equal >= threshold * (n - k + 1) - 1e-9:
                        hit |= set(range(s, s + n))
                        held |= {str(item)} - {"None"}
        out.append((len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("threshold", [1.0, 0.5])
@pytest.mark.parametrize("shuffled", [False, True])
def test_windows_equal_brute_force(spark, monkeypatch, threshold, shuffled):
    random.seed(7)
    monkeypatch.setattr(decontamination, "PIECE", 7)
    if shuffled:
        monkeypatch.setattr(decontamination, "small", lambda df, n: df)
    some = lambda n: " ".join(random.choices("abcdE", k=n))
    items = [(i, some(random.choice([1, 2, 4, 6, 9]))) for i in range(8)] + [(3, "a b c d e"), (None, "d c b a"), (50, ""), (51, None), (10, "A b-c D  E")]
    texts = [some(random.randint(0, 40)) for _ in range(60)] + [None, "", "...", "a b c d e a b c d e", "É a B é"]
    docs = spark.createDataFrame([(i, t, 0, "d", "w", "p") for i, t in enumerate(texts)], EXTRA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.decontamination_table(docs, bench, 6, 3, threshold).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == hit_by_force(texts, items, 6, 3, threshold)


def test_decontamination_edge_cases(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = decontamination.decontamination_table(odd(spark), bench).collect()
    assert len(rows) == len(TEXTS) + 1 and not any(r.contaminated for r in rows)
    assert decontamination.decontamination_table(odd(spark).limit(0), bench).collect() == []
    assert {r.n_items for r in decontamination.decontamination_table(odd(spark), bench.limit(0)).collect()} == {0}
    item = bench.where("item_id = 3").first().text
    docs = spark.createDataFrame([(1, f"Before. {item} After.", "x", "y"), (2, item, "x", "y"), (3, "clean", "x", "y")], "doc_id long, text string, digest string, at_0 string")
    assert [r.doc_id for r in decontamination.clean_documents(docs, bench).collect()] == [3]
    long = "x y z " * 20_000 + item
    found = decontamination.decontamination_table(spark.createDataFrame([(1, long)], "doc_id long, text string"), bench).first()
    assert (found.n_words, found.n_hit, found.n_items) == (60_000 + len(words(item)), len(words(item)), 1)


# Conversation repair


def cheapest_by_force(turns):
    """Least (cost, audit) over all edits, layer by layer; turns are (initial, fault)."""
    best = {"": (0, "")}
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}

    def grown(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                for r in set(grammar[state]) - {"s"}:
                    best[r] = min(best.get(r, (10**9, "")), (cost + 3, audit + "I"))
        return best

    for initial, fault in turns:
        after = {}
        for state, (cost, audit) in grown(best).items():
            moves = [(state, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                moves += [(r, cost + extra, "K") for r in grammar[state] if r == initial] + [(r, cost + extra + 3, "R") for r in set(grammar[state]) - {"s"}]
            for r, c, letter in moves:
                after[r] = min(after.get(r, (10**9, "")), (c, audit + letter))
        best = after
    return min(v for k, v in grown(best).items() if k in ("", "a"))


FAULTS = ("", "truncated", "blank", "duplicate")


def test_cheapest_edits_equal_brute_force(monkeypatch):
    random.seed(11)
    for n in (0, 1, 2, 3, 5, 8, 30):
        for _ in range(60):
            turns = [(random.choice("sua?"), random.choice(FAULTS)) for _ in range(n)]
            codes = bytes("sua?".index(i) * 4 + FAULTS.index(f) for i, f in turns)
            want = cheapest_by_force(turns)
            assert conversations.cheapest(codes) == want
            monkeypatch.setattr(conversations, "SHORT", 0)
            assert conversations.cheapest(codes) == want
            monkeypatch.undo()
    turns = [(random.choice("sua"), random.choice(FAULTS)) for _ in range(3000)]
    assert conversations.cheapest(bytes("sua".index(i) * 4 + FAULTS.index(f) for i, f in turns)) == cheapest_by_force(turns)


def repair_by_force(rows):
    """Contract's columns of a conversation's rows (turn, role, text) in order."""
    seen, turns = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        turns.append((role[:1], fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
    cost, audit = cheapest_by_force(turns)
    state, out, at = "", [], 0
    for edit in audit:
        if edit == "I":
            state = "a" if state == "u" else "u"
            out.append({"u": "user:", "a": "assistant:"}[state])
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "K":
            state = role[0]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = "a" if state == "u" else "u"
            out.append({"u": "user:", "a": "assistant:"}[state] + text)
    count = Counter(f for _, f in turns)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, "\n".join(out)


def damaged_by_force(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        if hit:
            out += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    digest = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, digest(x)))


def conversations_of(spark):
    random.seed(13)
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Yes.", "What?\n"]
    rows = [
        (random.choice([*range(25), None]), random.choice([*range(9), None]), random.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), random.choice(texts))
        for _ in range(400)
    ]
    rows += [(100, t, r, x) for t, r, x in ((1, "user", "Hi."), (-(1 << 63), "user", "a."), ((1 << 63) - 1, "assistant", "b."))]
    rows += [(200, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(1500)]
    extra = "conv_id long, turn long, role string, text string, head string, code long, digest string, audit string"
    return rows, spark.createDataFrame([(*r, "h", 1, "d", "a") for r in rows], extra).repartition(3)


def test_repair_equals_brute_force(spark):
    rows, df = conversations_of(spark)
    found = {r.conv_id: tuple(r)[1:] for r in conversations.repair_table(conversations.damage(df)).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv in found:
        *figures, body = repair_by_force(damaged_by_force([r for r in rows if r[0] == conv]))
        figures[0] = min(figures[0], (1 << 63) - 1)
        assert found[conv] == (*figures, hashlib.sha256(body.encode()).hexdigest()), conv


def test_repaired_turns_and_empty_tables(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Well"), (3, 0, "system", " "), (None, 0, "user", "a.")],
        "conv_id long, turn long, role string, text string",
    )
    found = sorted((tuple(r) for r in conversations.repaired_turns(df).collect()), key=str)
    assert found == sorted([(1, 0, "user", "Hi."), (1, 1, "assistant", ""), (1, 2, "user", "There?"), (1, 3, "assistant", "Yes."), (None, 0, "user", "a."), (None, 1, "assistant", "")], key=str)
    assert conversations.repair_table(conversations.damage(df.limit(0))).collect() == []
    assert conversations.repaired_turns(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op12_decontamination", "op13_conversation_repair"])
def test_new_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert got.where(F.col(want.columns[0]).isNotNull()).count()
