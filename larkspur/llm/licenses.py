"""Licence scan: exact containment join of text blocks with licence templates.

A template of T distinct words owns a grid of blocks of 2T words, one every T words, so that each span of up to T
words lies whole in a block. A block meets a template when it holds at least ``ceil(threshold * T)`` of its words.
Words are put in order of their frequency over all documents, rarest first. A block that meets the threshold must
hold one of the template's first ``T - need + 1`` words (prefix filter); blocks with too few words are passed over
(length filter), and a block is given up as soon as the words left in the order can't reach the need (positional
filter). What is left is counted exactly. Base phrases are templates with a threshold of 1, whose places are then
read off in order.

Templates are a fixed table of a few dozen rows, so they travel with the task; documents never shuffle. The only
thing gathered is one count for each template word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import documents, map_arrow, slices, words

#: Share of a notice's words that a block must hold.
THRESHOLD = 0.8
#: Most templates that a scan takes: they travel with every task.
MAX_TEMPLATES = 1000

# Phrases whose places are counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Words of common public licence notices, their labels, and the licence's name, which a block must hold in order.
NOTICES = (
    ("released under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "mit",
    ),
    ("licensed under the apache license version 2 0", "apache", "apache license"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0", "apache", "apache license",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl", "gnu general public license"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl",
        "gnu general public license",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "lgpl", "gnu lesser general public license",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "agpl", "gnu affero general public license",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution", "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies", "isc",
    ),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla public license"),
    (
        "this program and the accompanying materials are made available under the terms of the eclipse public license", "epl",
        "eclipse public license",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
    ("this work is licensed under a creative commons attribution license", "cc-by", "creative commons attribution"),
)

# Short forms, which are needed whole and in order, and their labels.
SHORT = (
    ("gnu lesser general public license", "lgpl"), ("gnu library general public license", "lgpl"), ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"), ("eclipse public license", "epl"), ("isc license", "isc"),
    ("bsd license", "bsd"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("cc0 1 0", "cc0"), ("creative commons zero", "cc0"),
    ("creativecommons org publicdomain zero", "cc0"),
    *((f"spdx license identifier {x}", x) for x in ("mit", "apache", "gpl", "lgpl", "agpl", "isc", "mpl", "epl", "unlicense")),
    *((f"spdx license identifier bsd {x} clause", "bsd") for x in (2, 3)),
    *((f"cc by {x}", "cc-by") for x in ("1 0", "2 0", "2 5", "3 0", "4 0")), ("licensed under cc by", "cc-by"), ("creativecommons org licenses by", "cc-by"),
    ("creative commons attribution", "cc-by"),
    *(
        (phrase, "cc-by-" + x.replace(" ", "-"))
        for x, names in (
            ("nc", ("noncommercial", "non commercial")), ("sa", ("sharealike", "share alike")), ("nd", ("noderivatives", "noderivs", "no derivatives")),
            ("nc sa", ("noncommercial sharealike", "noncommercial share alike", "non commercial share alike", "non commercial sharealike")),
            ("nc nd", ("noncommercial noderivatives", "noncommercial noderivs", "noncommercial no derivatives", "non commercial no derivatives")),
        )
        for phrase in (f"cc by {x}", f"licensed under cc by {x}", f"creativecommons org licenses by {x}", *(f"creative commons attribution {y}" for y in names))
    ),
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, n_blocks long"
)


class Template(NamedTuple):
    """phrase: its words in order; order: its distinct words, rarest first; need: so many of them must be there.

    name: words that must be there in order, at a place where none of the names in longer begins.
    """

    phrase: tuple[bytes, ...]
    label: str
    base: bool
    order: tuple[bytes, ...]
    need: int
    name: tuple[bytes, ...] = ()
    longer: tuple[tuple[bytes, ...], ...] = ()

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.order[: len(self.order) - self.need + 1]


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the (small, fixed) vocabulary occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    if text:
                        seen.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())}
        )

    found = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in found.collect()}


def prepare(docs: DataFrame, base=BASE, notices=NOTICES, threshold: float = THRESHOLD, short=SHORT) -> list[Template]:
    """Templates with their words in the order of global frequency; a notice's third item, if any, is its licence's name."""
    rows = [(tuple(words(p)), label, True, (), 1.0) for p, label in base]
    rows += [(tuple(words(p)), label, False, tuple(words(name[0])) if name else (), threshold) for p, label, *name in notices]
    rows += [(tuple(words(p)), label, False, tuple(words(p)), 1.0) for p, label in short]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    counts = word_counts(docs, frozenset(w for phrase, _, _, name, _ in rows for w in phrase + name))
    names = sorted({name for *_, name, _ in rows if name})
    out = []
    for phrase, label, is_base, name, share in rows:
        order = tuple(sorted(set(phrase), key=lambda w: (counts.get(w, 0), w)))
        need = len(order) if is_base else math.ceil(share * len(order) - 1e-9)
        longer = tuple(x for x in names if name and len(x) > len(name) and x[: len(name)] == name)
        out.append(Template(phrase, label, is_base, order, need, name, longer))
    return out


def named(template: Template, found: list[bytes], places: dict[bytes, list[int]], block: int) -> bool:
    """Whether a block holds the template's name, not as the start of a longer one."""
    name, start, stop = template.name, block * len(template.phrase), (block + 2) * len(template.phrase)
    return any(
        start <= i <= stop - len(name) and tuple(found[i : i + len(name)]) == name
        and not any(tuple(found[i : i + len(x)]) == x for x in template.longer)
        for i in places.get(name[0], ())
    )


def overlap(template: Template, found: set[bytes]) -> int:
    """How many of the template's words are found; 0 as soon as the need is out of reach."""
    have, missing = 0, 0
    for w in template.order:
        if w in found:
            have += 1
        else:
            missing += 1
            if len(template.order) - missing < template.need:
                return 0
    return have


def blocks(template: Template, places: dict[bytes, list[int]], n_words: int) -> Iterator[tuple[int, int]]:
    """(block, overlap) of every block that meets the template; block b holds words b*T to b*T + 2T - 1."""
    size = len(template.phrase)
    candidates = {b for w in template.prefix for i in places.get(w, ()) for b in (i // size, i // size - 1) if b >= 0}
    if not candidates:
        return
    held: dict[int, set[bytes]] = defaultdict(set)
    for w in template.order:
        for i in places.get(w, ()):
            for b in (i // size, i // size - 1):
                if b in candidates:
                    held[b].add(w)
    for b in sorted(candidates):
        if n_words - b * size < template.need or len(held[b]) < template.need:
            continue
        if n := overlap(template, held[b]):
            yield b, n


def scan(text: str | None, templates: list[Template], vocabulary: frozenset[bytes], prefixes: frozenset[bytes]) -> tuple:
    """The result's columns of one text."""
    found = words(text) if text else []
    if not found or prefixes.isdisjoint(found):
        return len(found), 0, None, None, "", "", 0.0, 0
    places: dict[bytes, list[int]] = defaultdict(list)
    for i, w in enumerate(found):
        if w in vocabulary:
            places[w].append(i)
    starts: set[int] = set()
    base_labels, labels, score, n_blocks, n_base = set(), set(), 0.0, 0, 0
    for t in templates:
        size = len(t.phrase)
        for b, n in blocks(t, places, len(found)):
            if t.base:
                own = [i for i in range(b * size, (b + 1) * size) if tuple(found[i : i + size]) == t.phrase]
                if not own:
                    continue
                n_base += len(own)
                starts.update(own)
                base_labels.add(t.label)
            elif t.name and not named(t, found, places, b):
                continue
            labels.add(t.label)
            n_blocks += 1
            score = max(score, n / len(t.order))
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(found), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, n_blocks


def license_scan(docs: DataFrame, base=BASE, notices=NOTICES, threshold: float = THRESHOLD, short=SHORT) -> DataFrame:
    """One row per document: words, places of the base phrases, labels, best containment and blocks met.

    A null or empty text has no words, no labels (empty strings) and score 0; a null doc_id stays null. Repeated rows
    each give a row. An empty table gives an empty result. Further columns of docs are left out.
    """
    templates = prepare(docs, base, notices, threshold, short)
    vocabulary = frozenset(w for t in templates for w in t.order + t.name)
    prefixes = frozenset(w for t in templates for w in t.prefix)
    names = [part.split()[0] for part in SCHEMA.split(", ")][1:]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(scan(x, templates, vocabulary, prefixes) for x in part.column("text").to_pylist())))
        columns = [part.column("doc_id")] + [pa.array(r, k) for r, k in zip(rows, kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])

    return map_arrow(documents(docs), one, SCHEMA)
