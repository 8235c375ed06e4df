"""HTML extraction by differencing with the page of the nearest URL.

Pages are cut into lines, one for each block of visible text, in one pass over the markup. Pages of a host are put in
the order of their URL paths; each is paired with the neighbour whose path shares the longer prefix, the two lists of
lines are aligned by a longest common subsequence, and lines that the pair shares are template text and are deleted. If
they hold half of the page's text or more, the pair may be copies: then only lines that the neighbour on the other side
shares too are deleted, and none if nothing would be left.

Structure protects and completes. Lines of the page's article element stay even if shared, since two pages of a host
can carry the same article; a page has one article, that of most text, and others beside it only if they are of like
size and not shared themselves. Lines of menus, headers, footers, sidebars, notices, adverts, forms and comments, told
by their elements and classes, go even if not shared, as do lines around an article. On a page without an article
element the difference decides about every line that isn't of such an element (inside ``main``, if there is one).

Pages are dealt by ranges of (host, path), so a large host spreads over many tasks; only the first and last page of
each task meet their neighbours in a join.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow, materialize

# Names of elements.
#: Text that is never shown as text of the page.
UNSEEN_NAMES = frozenset("head title script style noscript template iframe svg button select textarea object canvas".split())
#: Elements whose content is plain characters up to their end tag.
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
IN_HEAD = frozenset("head base link meta title script style noscript template".split())
#: Shown, but not main text.
ASIDE_NAMES = frozenset("nav aside footer dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Start tags of these leave an open paragraph as it is; those of other blocks end it.
INSIDE_P = frozenset("br option html body head title".split())
#: What a start tag closes, and the elements that shield it from doing so.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
}

# Words in classes, ids and roles that mark what isn't main text.
CUES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer ad ads advert advertisement advertising sponsor "
    "sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended comment comments respond replies disqus widget toolbar pagination pager skip "
    "contentinfo complementary search hidden".split()
)
#: Words that may stand beside a cue, as in ``site-footer`` or ``related-posts``.
BESIDE = frozenset(
    "site page main top bottom left right box block container wrapper wrap bar list area section link links post posts item items "
    "button buttons form panel inner outer global primary secondary unit slot text".split()
)
HEADERS = frozenset("header masthead topbar".split())
BESIDE_HEADERS = frozenset("site top main global bar container wrapper".split())
#: Classes whose elements go even if they are or hold article elements, as comments and teasers often are.
APART = frozenset("comment comments comment-list respond replies disqus related recommended".split())

#: What becomes of an element's lines: kept; dropped unless in an article inside it; dropped; not even lines.
KEPT, SOFT, HARD, UNSEEN = range(4)
#: A tag: its name and its attributes. Only a quoted value can hold a ``>``. Possessive, so that no character is read twice.
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Numbers of character references: leading zeros, and numbers that are beyond any character.
ZEROS = re.compile(r"(&#[xX]?)0++(?=[0-9a-fA-F])")
BEYOND = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?")
SPLIT_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)")

#: The share of a page's text from which on a neighbour that shares it may be a copy.
COPY_SHARE = 0.5
#: The share of the longest article's text that another one beside it must have to stay.
BESIDE_SHARE = 0.25
#: Bits of a table of a longest common subsequence; beyond it the table is halved.
CELLS = 1 << 26

PACKED = "page_id long, url string, host string, path string, packed binary"
RESULT = "page_id long, url string, text string, n_chars long, n_shared long, n_protected long, n_marked long"
#: Pages at the ends of a task also have the lines of the neighbours that they met there.
ENDS = "part int, is_first boolean, is_last boolean, host string, path string, own binary, before binary, before_path string, after binary, after_path string"


class Page(NamedTuple):
    """Lines; for each whether it is dropped, inside ``main``, and the number of its article (0: none); parents[k]: the article around article k."""

    lines: list[str]
    dropped: list[bool]
    in_main: list[bool]
    article: list[int]
    parents: list[int]


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host in lower case and the path of a URL; empty if it has none."""
    found = SPLIT_URL.match(url or "")
    return ((found[1] or "").lower(), found[2] or "") if found else ("", "")


def unescaped(text: str) -> str:
    """Text with its character references decoded."""
    if "&#" in text:
        text = BEYOND.sub("�", ZEROS.sub(r"\1", text))
    return html.unescape(text)


def is_cue(token: str) -> bool:
    """Whether a class token is a cue, or made of cues and of words that may stand beside them."""
    parts = re.split("[-_]", token)
    return any(x in CUES for x in parts) and all(x in CUES or x in BESIDE for x in parts)


def is_header(token: str) -> bool:
    parts = re.split("[-_]", token)
    return any(x in HEADERS for x in parts) and all(x in HEADERS or x in BESIDE_HEADERS for x in parts)


def marked(name: str, attributes: str, inside: bool) -> int:
    """What an element's attributes make of it; inside: whether it is in an article or ``main``."""
    tokens: list[str] = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" and value.lower() != "false" or key == "style" and NO_DISPLAY.search(value):
            return UNSEEN
        if key in ("class", "id", "role"):
            tokens += value.lower().split()
        elif key == "aria-label":
            tokens.append("-".join(value.lower().split()))
    if not APART.isdisjoint(tokens):
        return HARD
    if name in ("article", "main"):
        return KEPT
    return SOFT if any(map(is_cue, tokens)) or not inside and any(map(is_header, tokens)) else KEPT


class Walk:
    """The open elements while a page is read, and the lines so far. Each step takes constant time on average."""

    def __init__(self):
        self.page = Page([], [], [], [], [0])
        self.stack: list[tuple[str, int, bool, int]] = []  # name, what becomes of its lines, in main, article
        self.places: dict[str, list[int]] = {}  # where in the stack the elements of a name are
        self.blocks: list[int] = []  # where the blocks are
        self.pieces: list[str] = []
        self.drop, self.in_main, self.article = KEPT, False, 0

    def text(self, piece: str) -> None:
        if self.drop != UNSEEN and piece:
            self.pieces.append(piece)

    def end_line(self) -> None:
        if self.pieces:
            line = " ".join(unescaped("".join(self.pieces)).split())
            self.pieces.clear()
            if line:
                for column, value in zip(self.page, (line, self.drop != KEPT, self.in_main, self.article)):
                    column.append(value)

    def cut(self, depth: int) -> None:
        """Closes all elements from that depth on."""
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
        self.drop, self.in_main, self.article = self.stack[-1][1:] if self.stack else (KEPT, False, 0)

    def last(self, names) -> int:
        """The depth of the innermost open element of one of these names; -1: none."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def close(self, name: str) -> None:
        depth = self.last((name,))
        if depth < 0 or name not in BLOCKS and self.blocks and self.blocks[-1] > depth:
            return  # nothing to close, or an inline element that a block has outgrown
        self.cut(depth)

    def open(self, name: str, attributes: str) -> None:
        if name not in IN_HEAD and (depth := self.last(("head",))) >= 0:
            self.cut(depth)
        if name in BLOCKS and name not in INSIDE_P and (depth := self.last(("p",))) >= 0:
            self.cut(depth)
        if name in CLOSES:
            closed, shields = CLOSES[name]
            depth = self.last(closed)
            if depth > self.last(shields):
                self.cut(depth)
        inside = self.in_main or self.article > 0
        drop = self.drop
        if name in UNSEEN_NAMES:
            drop = UNSEEN
        elif name in ASIDE_NAMES or name == "header" and not inside:
            drop = max(drop, HARD)
        elif name == "form":
            drop = max(drop, SOFT)
        if attributes and name not in ("html", "body"):
            drop = max(drop, marked(name, attributes, inside))
        if drop != self.drop and name not in BLOCKS:
            drop = UNSEEN  # the block goes on without what this inline element holds
        in_main, article = self.in_main, self.article
        if name in ("article", "main"):
            if drop == SOFT and not inside:
                drop = KEPT
            if name == "main":
                in_main = True
            else:
                self.page.parents.append(article)
                article = len(self.page.parents) - 1
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, drop, in_main, article))
        self.drop, self.in_main, self.article = drop, in_main, article


def page_lines(page: str | None) -> Page:
    """The page's lines. A tag or comment that is open at the page's end is markup up to there, as in browsers."""
    walk, at, size = Walk(), 0, len(page or "")
    while at < size:
        stop = page.find("<", at)
        if stop < 0:
            walk.text(page[at:])
            break
        walk.text(page[at:stop])
        ahead = page[stop + 1 : stop + 3]
        ending = ahead[:1] == "/"
        first = ahead[1:] if ending else ahead[:1]
        if page.startswith("<!--", stop):
            end = page.find("-->", stop + 2)
            at = end + 3 if end >= 0 else size
        elif page.startswith("<![CDATA[", stop):
            end = page.find("]]>", stop)
            walk.text(html.escape(page[stop + 9 : end if end >= 0 else size]))
            at = end + 3 if end >= 0 else size
        elif ahead[:1] in ("!", "?") or ending and first and not (first.isascii() and first.isalpha()):
            end = page.find(">", stop)
            at = end + 1 if end >= 0 else size
        elif not (first.isascii() and first.isalpha()):
            walk.text("<")
            at = stop + 1
        else:
            found = TAG.match(page, stop)
            if not found:
                break
            at, name = found.end(), found[1].lower()
            if name in BLOCKS:
                walk.end_line()
            if ending:
                walk.close(name)
            elif name in RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                end = page.find(">", close.start()) if close else -1
                at = end + 1 if end >= 0 else size
            elif name not in VOID and not (found[2].endswith("/") and name not in BLOCKS):
                walk.open(name, found[2])
    walk.end_line()
    return walk.page


def prefix_lengths(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For i = 0 to n the length of the longest common subsequence of own[:i] and other, in linear memory.

    A zero bit i of a row says that own[i] raises the length.
    """
    n = len(own)
    order = np.argsort(own, kind="stable")
    values, first = np.unique(own[order], return_index=True)
    stops = np.append(first[1:], n)
    where = np.searchsorted(values, other)
    full = row = (1 << n) - 1
    masks: dict[int, int] = {}
    for k in where.tolist():
        mask = masks.get(k)
        if mask is None:
            flags = np.zeros(n, np.uint8)
            flags[order[first[k] : stops[k]]] = 1
            mask = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
            if len(masks) * n < CELLS:
                masks[k] = mask
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little", count=n)
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common_subsequence(own: list[int], other: list[int]) -> list[int]:
    """Places in own of a longest common subsequence, by bit-parallel rows and a walk back."""
    masks: dict[int, int] = {}
    for i, line in enumerate(own):
        masks[line] = masks.get(line, 0) | (1 << i)
    full = (1 << len(own)) - 1
    row, rows = full, []
    for line in other:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out = []
    i, j = len(own) - 1, len(other) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out


def shared_lines(own: list[str], other: list[str]) -> list[bool]:
    """Which own lines are on a longest common subsequence of the two.

    What a table of bits can't hold at once is halved by Hirschberg's method, so memory is linear in the lines.
    """
    out = [False] * len(own)
    numbers = {line: k for k, line in enumerate(dict.fromkeys(own))}
    known = set(own).intersection(other)
    places = [i for i, line in enumerate(own) if line in known]
    a = np.array([numbers[own[i]] for i in places], np.int64)
    b = np.array([numbers[line] for line in other if line in known], np.int64)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out[places[a0]] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            out[places[a1 - 1]] = True
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= CELLS or b1 - b0 == 1:
            for i in common_subsequence(a[a0:a1].tolist(), b[b0:b1].tolist()):
                out[places[a0 + i]] = True
            continue
        half = (b0 + b1) // 2
        own_part = a[a0:a1]
        # Lines that one half lacks have no place in its masks.
        before = prefix_lengths(own_part, b[b0:half][np.isin(b[b0:half], own_part)])
        after = prefix_lengths(own_part[::-1], b[half:b1][np.isin(b[half:b1], own_part)][::-1])[::-1]
        split = a0 + int(np.argmax(before + after))
        todo += [(a0, split, b0, half), (split, a1, half, b1)]
    return out


def common_prefix(a: str, b: str) -> int:
    """Length of the common prefix of two paths."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def template_lines(page: Page, near: list[list[str]]) -> list[bool]:
    """Which lines the page shares with the nearest page; near: lines of its neighbours, the nearest first."""
    if not near:
        return [False] * len(page.lines)
    shared = shared_lines(page.lines, near[0])
    if len(near) > 1:
        size = sum(len(x) for x, gone in zip(page.lines, page.dropped) if not gone)
        same = sum(len(x) for x, gone, s in zip(page.lines, page.dropped, shared) if s and not gone)
        if same >= COPY_SHARE * size:
            shared = [a and b for a, b in zip(shared, shared_lines(page.lines, near[1]))]
    return shared


def articles(page: Page, shared: list[bool]) -> set[int]:
    """Numbers of the articles whose lines are the main text; empty if no article has text."""
    size, same = [0] * len(page.parents), [0] * len(page.parents)
    for line, gone, k, s in zip(page.lines, page.dropped, page.article, shared):
        if k and not gone:
            size[k] += len(line)
            same[k] += len(line) * s
    longest = max(range(len(size)), key=size.__getitem__)
    if not size[longest]:
        return set()
    chosen = {longest}
    for k in range(1, len(size)):
        beside = page.parents[k] == page.parents[longest]
        if beside and size[k] >= BESIDE_SHARE * size[longest] and same[k] < COPY_SHARE * size[k]:
            chosen.add(k)
    around = page.parents[longest]
    while around:
        chosen.add(around)
        around = page.parents[around]
    return chosen


def main_text(page: Page, near: list[list[str]]) -> tuple[str, int, int, int]:
    """The page's text; how many lines went as shared, stayed though shared, and went though not shared."""
    shared = template_lines(page, near)
    chosen = articles(page, shared)
    if chosen:
        kept = [k in chosen and not gone for k, gone in zip(page.article, page.dropped)]
    else:
        open_ = [not gone for gone in page.dropped]
        if any(a and b for a, b in zip(open_, page.in_main)):
            open_ = [a and b for a, b in zip(open_, page.in_main)]
        kept = [a and not s for a, s in zip(open_, shared)]
        if not any(kept):
            kept = open_
    text = " ".join([x for x, k in zip(page.lines, kept) if k])
    counts = [sum(s == a and k == b for s, k in zip(shared, kept)) for a, b in ((True, False), (True, True), (False, False))]
    return text, *counts


def nearest(path: str, before: list[str] | None, before_path: str | None, after: list[str] | None, after_path: str | None) -> list[list[str]]:
    """Lines of the neighbours on the same host, that with the longer common path first; the earlier one on a tie."""
    if before is None or after is None:
        return [x for x in (before, after) if x is not None]
    return [before, after] if common_prefix(path, before_path) >= common_prefix(path, after_path) else [after, before]


def packed(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(json.dumps(value).encode())


def unpacked(raw: bytes | None):
    return None if raw is None else json.loads(zstandard.ZstdDecompressor().decompress(raw))


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch with the columns of a schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


def by_url(pages: DataFrame) -> DataFrame:
    """PACKED rows of pages. The markup goes compressed into the shuffle and is read behind it, once."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths = zip(*map(host_and_path, part.column("url").to_pylist()))
        compressor = zstandard.ZstdCompressor(level=3)
        raw = [compressor.compress((x or "").encode("utf-8", "surrogatepass")) for x in part.column("html").to_pylist()]
        columns = [part.column("page_id"), part.column("url"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(raw, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PACKED.split(", ")])

    return map_arrow(pages.select("page_id", "url", "html"), one, PACKED, "html")


def extract_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, and counts of lines.

    n_shared: deleted as shared with the nearest page; n_protected: shared, but kept as the article's; n_marked: not
    shared, but of an element that isn't main text, or outside the article.

    A null html counts as empty and gives an empty text. A null url is of an empty host. Pages of equal URL are
    neighbours, in the order of page_id (nulls first); repeated rows each give a row. An empty table gives an empty
    result; further columns are left out.
    """
    order = ["host", "path", "url", "page_id"]
    ordered = by_url(pages).repartitionByRange(*order).sortWithinPartitions(*order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        schema = f"{RESULT}, {ENDS}"
        no_end, no_result = (None,) * len(ENDS.split(", ")), (None,) * 5

        def finished(row: dict, after: dict | None, is_last: bool) -> tuple:
            """A result, or a page at an end of this task as it is."""
            before = row["before"]
            if row["is_first"] or is_last:
                met = [x for y in (before, after) for x in ((packed(y["page"].lines), y["path"]) if y else (None, None))]
                return (row["page_id"], row["url"], *no_result, number, row["is_first"], is_last, row["host"], row["path"], packed(row["page"]), *met)
            near = [x for y in (before, after) for x in ((y["page"].lines, y["path"]) if y else (None, None))]
            text, *counts = main_text(row["page"], nearest(row["path"], *near))
            return (row["page_id"], row["url"], text, len(text), *counts, *no_end)

        decompress = zstandard.ZstdDecompressor().decompress
        held: dict | None = None
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                row["page"] = page_lines(decompress(row.pop("packed")).decode("utf-8", "surrogatepass"))
                same = held is not None and held["host"] == row["host"]
                row |= {"is_first": held is None, "before": held if same else None}
                if held is not None:
                    rows.append(finished(held, row if same else None, False))
                    held["before"] = None
                    size += len(rows[-1][2] or "")
                    if size > 1 << 20 or len(rows) >= 1024:
                        yield batch_of(rows, schema)
                        rows, size = [], 0
                held = row
        if held is not None:
            yield batch_of([*rows, finished(held, None, True)], schema)

    walked = materialize(ordered.mapInArrow(walk, f"{RESULT}, {ENDS}"), "pages")
    done = walked.where("part is null").select([f.split()[0] for f in RESULT.split(", ")])
    # Two rows a task from here on.
    ends = walked.where("part is not null").select("page_id", "url", *[f.split()[0] for f in ENDS.split(", ")])
    around = Window.orderBy("part")
    links = ends.select("part").distinct()
    links = links.select("part", F.lag("part").over(around).alias("part_before"), F.lead("part").over(around).alias("part_after"))
    tails = ends.where("is_last").select(
        F.col("part").alias("part_before"), F.col("host").alias("tail_host"), F.col("path").alias("tail_path"), F.col("own").alias("tail")
    )
    heads = ends.where("is_first").select(
        F.col("part").alias("part_after"), F.col("host").alias("head_host"), F.col("path").alias("head_path"), F.col("own").alias("head")
    )
    met = ends.join(links, "part").join(tails, "part_before", "left").join(heads, "part_after", "left")
    from_tail = F.col("is_first") & (F.col("tail_host") == F.col("host"))
    from_head = F.col("is_last") & (F.col("head_host") == F.col("host"))
    met = met.select(
        "page_id", "url", "path", "own", "before", "before_path", "after", "after_path",
        F.when(from_tail, F.col("tail")).alias("tail"), F.when(from_tail, F.col("tail_path")).alias("tail_path"),
        F.when(from_head, F.col("head")).alias("head"), F.when(from_head, F.col("head_path")).alias("head_path"),
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                before, after = unpacked(row["before"]), unpacked(row["after"])
                before_path, after_path = row["before_path"], row["after_path"]
                if row["tail"] is not None:
                    before, before_path = Page(*unpacked(row["tail"])).lines, row["tail_path"]
                if row["head"] is not None:
                    after, after_path = Page(*unpacked(row["head"])).lines, row["head_path"]
                text, *counts = main_text(Page(*unpacked(row["own"])), nearest(row["path"], before, before_path, after, after_path))
                yield batch_of([(row["page_id"], row["url"], text, len(text), *counts)], RESULT)

    return done.unionByName(met.mapInArrow(close, RESULT))
