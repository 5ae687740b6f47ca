"""Main text of web pages by equivalence classes of tokens (op12).

Pages of one host come from one template. Tokens are open tags and texts between tags, told apart by the path of elements
around them. Tokens whose numbers of occurrences agree on every page of the host form a class: a class is found by a hash of
its occurrence vector, a sum over pages that is formed before the shuffle. Classes of three tokens and more that stand on at
least three pages and a fifth of the host's are laid into each other, the most frequent first: what lies between the same two
tokens of the classes around it is a valid piece, the rest of a class is not template. On each page a piece counts only if
its tokens stand in the template's order. The rest of a page are slots, and text comes from slots alone:

* text of an element that the template itself holds, tag and words alike, is boilerplate (notices, adverts, labels);
* regions that are no article by their tag, or by words of their class, id or role, are left out whole;
* of what remains, that inside `article` or `main` counts if there is any, else the innermost template element that
  holds most of the words, with headings of the first order.

Pages with the same prose count once when classes are formed, so many copies of an article don't turn it into template. A host
with fewer than three different pages has no template; its pages are read by regions alone. Hot hosts are summed in parts.

Null html gives an empty text, a null or odd url an empty host, whose pages share no template. Repeated rows give
repeated rows. Pages are parsed whole, whatever their length, in one pass. Broken html is read as browsers do: `p`, `li` and
cells close by themselves, end tags without a start are skipped, scripts end at their own end tag only. `br` is white space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.base import written

LEAST_PAGES, SHARE, LEAST_TOKENS = 3, 0.2, 3
MOST = 0.6  # of the words, for the innermost element that holds the text
PROSE = 8  # words of a text that tells articles apart
BROADCAST_TOKENS = 1_000_000  # of all templates together; beyond it Spark joins by host

# Fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("head noscript template svg math object audio video canvas select option button label datalist fieldset legend".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
                   "time tt u var wbr img".split())  # fmt: skip
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                   "menu nav ol p pre section table ul".split())  # fmt: skip
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
# Regions that are no article
OTHER_TAGS = frozenset("nav footer aside form menu dialog".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pager pagination footer masthead topbar "
    "share sharing social related recommended newsletter subscribe signup login search toolbar contentinfo complementary".split()
)
READER_WORDS = frozenset("comment comments reply replies respond disqus".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
NUMBERS = {"class": re.compile(r"\d{3,}"), "id": re.compile(r"\d+"), "role": re.compile(r"\d{3,}")}


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


class Text(NamedTuple):
    """A text between two tags."""

    block: int
    text: str
    element: int
    shown: bool  # in no region that is no article
    linked: bool
    main: bool


class Page:
    """Elements of a page as a tree, its texts, and its tokens in order."""

    def __init__(self, html: str) -> None:
        self.parent, self.name, self.role, self.marked = [-1], [""], [0], [False]
        self.texts: list[Text] = []
        self.text_role: list[int] = []
        self.tokens: list[int] = []
        stack, block, at, lower = [0], 0, 0, None
        # per open element: left out since, whether readers wrote it, links, article or main
        state = [(False, False, False, False)]
        for m in TOKEN.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(html[at : m.start()], block, stack[-1], state[-1])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if name not in INLINE:
                    block += 1
                for k in range(len(stack) - 1, 0, -1):
                    if self.name[stack[k]] == name:
                        del stack[k:], state[k:]
                        break
                continue
            if name == "br":
                self._text(" ", block, stack[-1], state[-1])
                continue
            if name not in INLINE:
                block += 1
            self._close_before(name, stack, state)
            attributes = {a.lower(): v.strip("\"'").lower() for a, v in ATTRIBUTE.findall(m[3] if m[2] else m[6])}
            element = self._open(name, attributes, stack[-1])
            if name in RAW:
                lower = html.lower() if lower is None or len(lower) != len(html) else lower
                end = lower.find(f"</{name}", at)
                at = len(html) if end < 0 else end
            elif name not in VOID:
                stack.append(element)
                state.append(self._state(name, attributes, state[-1]))
        if at < len(html):
            self._text(html[at:], block, stack[-1], state[-1])

    def _close_before(self, name: str, stack: list, state: list) -> None:
        """What an open tag ends by itself."""
        ends, until = CLOSES.get(name, ((), ()))
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            open_ = self.name[stack[k]]
            if open_ in ends or open_ == "p" and name in ENDS_P:
                cut = k
            if open_ in until or not ends and open_ not in INLINE:
                break
        if cut is not None:
            del stack[cut:], state[cut:]

    def _open(self, name: str, attributes: dict, parent: int) -> int:
        # numbers in an id count pages or parts of a page, as long ones in a class do
        sign = " ".join([name, *(NUMBERS[a].sub("0", attributes[a]) for a in NUMBERS if a in attributes)])
        self.parent.append(parent)
        self.name.append(name)
        self.role.append(_hash(sign, self.role[parent]))
        self.marked.append(len(sign) > len(name) and name not in INLINE)
        self.tokens.append(self.role[-1])
        return len(self.parent) - 1

    @staticmethod
    def _state(name: str, attributes: dict, outer: tuple) -> tuple:
        out, readers, linked, main = outer
        words = {w for a in ("class", "id", "role") for w in re.split(r"[^a-z]+", attributes.get(a, ""))}
        readers = readers or bool(words & READER_WORDS) and name not in ("body", "html", "main")
        article = name in ("article", "main") or "main" in words and "role" in attributes or "articlebody" in attributes.get("itemprop", "")
        if article and not main:
            # a frame named for what stands beside the article still holds it
            return readers, readers, linked, True
        out = out or readers or name in HIDDEN or name in OTHER_TAGS or name == "header" and not main
        if name not in ("body", "html", "article", "main") and words & (OTHER_WORDS if main else OTHER_WORDS | {"header"}):
            out = True
        return out, readers, linked or name == "a", main

    def _text(self, raw: str, block: int, element: int, state: tuple) -> None:
        if not raw:
            return
        text = unescape(raw)
        out, _, linked, main = state
        words = " ".join(text.split())
        role = _hash("#" + words, self.role[element]) if words else 0
        if words:
            self.tokens.append(role)
        self.texts.append(Text(block, text, element, not out, linked, main))
        self.text_role.append(role)

    def prose(self) -> int:
        """A hash of the texts that tell the page from others."""
        value = 0
        for t in self.texts:
            if t.shown and t.text.count(" ") >= PROSE - 1:
                value = _hash(" ".join(t.text.split()), value)
        return value or _hash(" ".join(t.text for t in self.texts), 1)


def template_on(page: Page, template: dict[int, tuple[int, int]]) -> dict[int, int]:
    """Tokens of the page that are template, with their piece: those of pieces whose tokens come in order."""
    first: dict[int, int] = {}
    for k, token in enumerate(page.tokens):
        if token in template:
            first.setdefault(token, k)
    last: dict[int, int] = {}
    broken = set()
    for token in sorted(first, key=lambda x: template[x]):
        piece = template[token][0]
        if first[token] < last.get(piece, -1):
            broken.add(piece)
        last[piece] = first[token]
    return {token: template[token][0] for token in first if template[token][0] not in broken}


def main_text(page: Page, template: dict[int, tuple[int, int]]) -> str:
    """Blocks of the article, in page order."""
    known = template_on(page, template)

    def fixed(k: int, t: Text) -> bool:
        """Tag and words in one piece of the template: in an article only for elements that have a name of their own."""
        piece = known.get(page.text_role[k])
        return piece is not None and known.get(page.role[t.element]) == piece and (page.marked[t.element] or not t.main)

    kept = [(t, len(t.text.split())) for k, t in enumerate(page.texts) if t.shown and not fixed(k, t)]
    if any(t.main and n for t, n in kept):
        kept = [(t, n) for t, n in kept if t.main]
    else:
        kept = _densest(page, kept, known)
    blocks: dict[int, list[str]] = {}
    for t, _ in kept:
        blocks.setdefault(t.block, []).append(t.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(b for b in joined if b)


def _densest(page: Page, kept: list[tuple[Text, int]], known: dict[int, int]) -> list[tuple[Text, int]]:
    """Texts of the innermost element with most words, of template elements if there is a template, and headings of first order.
    Lists of nothing but links are menus."""
    plain = Counter()
    for t, n in kept:
        plain[t.block] += 0 if t.linked else n
    listed = {t.block for t, _ in kept if _within(page, t.element, ("li", "td", "dt", "dd"))}
    kept = [(t, n) for t, n in kept if plain[t.block] or t.block not in listed]
    words = [0] * len(page.parent)
    for t, n in kept:
        words[t.element] += n
    for e in range(len(words) - 1, 0, -1):  # children have larger numbers
        words[page.parent[e]] += words[e]
    best = 0
    for e in range(1, len(words)):
        inside = page.parent[e] == best or page.parent[e] == 0 and best == 0
        frame = page.name[e] not in INLINE and page.name[e] not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr", "blockquote", "pre")
        if inside and frame and words[e] >= MOST * max(words[best], 1) and (not known or page.role[e] in known or page.name[e] in ("html", "body")):
            best = e
    inner = [False] * len(words)
    for e in range(len(words)):
        inner[e] = e == best or e > 0 and inner[page.parent[e]]
    return [(t, n) for t, n in kept if inner[t.element] or _within(page, t.element, ("h1",))]


def _within(page: Page, element: int, names: tuple) -> bool:
    while element > 0:
        if page.name[element] in names:
            return True
        element = page.parent[element]
    return False


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))


COUNTED = pa.struct([("role", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prose, keys, first, roles, numbers, places = [], [], [0], [], [], []
        for html in batch.column("html"):
            html = html.as_py() or ""
            page = Page(html)
            counts = Counter(page.tokens)
            at = {token: k for k, token in reversed(list(enumerate(page.tokens)))}
            prose.append(_signed(page.prose()))
            keys.append(_signed(_hash(html, 2)))
            roles += [_signed(token) for token in counts]
            numbers += counts.values()
            places += [at[token] * 1_000_000 // len(page.tokens) for token in counts]
            first.append(len(roles))
        tokens = pa.StructArray.from_arrays([pa.array(roles, pa.int64()), pa.array(numbers, pa.int32()), pa.array(places, pa.int32())], fields=list(COUNTED))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(prose, pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), tokens)],
            names=["host", "prose", "key", "tokens"],
        )


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, role, pages, all_pages, vector, place): each token of a host on enough of its pages, with a hash of how often it
    stands on each of them. Of pages with the same prose the one with the smallest hash counts."""
    hosts = pages.select(host(F.col("url")).alias("host"), "html").where("host <> '' and html is not null")
    read = hosts.mapInArrow(_count, "host string, prose bigint, key bigint, tokens array<struct<role:bigint,n:int,place:int>>")
    once = written(read.groupBy("host", "prose").agg(F.min(F.struct("key", "tokens")).alias("page")).select("host", "page.*"), "page-tokens")
    own = F.xxhash64("key", "n")
    tokens = once.select("host", "key", F.inline("tokens"))
    summed = tokens.groupBy("host", "role").agg(
        F.count("*").alias("pages"),
        # halves of 32 bits: a sum over two thousand million pages stays a long
        F.sum(own.bitwiseAND(F.lit(0xFFFFFFFF))).alias("_low"), F.sum(F.shiftrightunsigned(own, 32)).alias("_high"),
        F.avg("place").alias("place"),
    )
    sizes = once.groupBy("host").agg(F.count("*").alias("all_pages")).where(F.col("all_pages") >= LEAST_PAGES)
    enough = F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.col("all_pages") * SHARE)
    joined = summed.where(F.col("pages") >= LEAST_PAGES).join(sizes, "host").where(enough)
    return joined.select("host", "role", "pages", "all_pages", F.struct("pages", "_low", "_high").alias("vector"), "place")


def nested(vectors: list, pages: list[int], places: list[float]) -> list[int]:
    """The piece of each token, -1 where it is no template: classes laid into each other, the most frequent first."""
    classes: dict = {}
    for k, vector in enumerate(vectors):
        classes.setdefault(vector, []).append(k)
    piece, pieces, taken = [-1] * len(vectors), 0, np.zeros(0)
    for vector in sorted(classes, key=lambda v: (-pages[classes[v][0]], -len(classes[v]), v)):
        members = classes[vector]
        if len(members) < LEAST_TOKENS:
            continue
        gaps: dict[int, list[int]] = {}
        for k in members:
            gaps.setdefault(int(np.searchsorted(taken, places[k])), []).append(k)
        valid = [own for own in gaps.values() if len(own) >= min(2, LEAST_TOKENS)]
        for own in valid:
            for k in own:
                piece[k] = pieces
            pieces += 1
        taken = np.sort(np.concatenate([taken, [places[k] for own in valid for k in own]]))
    return piece


TEMPLATE = "array<struct<role:bigint,piece:int,rank:int>>"


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, n): the tokens of each host's template with their piece and order."""
    tokens = occurrences(pages)
    # of one host no more tokens than five times those of a page
    listed = tokens.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "role", "vector"))).alias("tokens"))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tokens in batch.column("tokens").to_pylist():
                vectors = [tuple(t["vector"].values()) for t in tokens]
                found = nested(vectors, [v[0] for v in vectors], [t["place"] for t in tokens])
                out.append([{"role": t["role"], "piece": p, "rank": k} for k, (t, p) in enumerate(zip(tokens, found)) if p >= 0])
            kind = pa.list_(pa.struct([("role", pa.int64()), ("piece", pa.int32()), ("rank", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, kind)], names=["host", "template"])

    return listed.mapInArrow(nest, f"host string, template {TEMPLATE}").withColumn("n", F.size("template"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, dict] = {}
    for batch in batches:
        texts, sizes = [], []
        for html, name, tokens in zip(batch.column("html"), batch.column("host").to_pylist(), batch.column("template")):
            page = Page(html.as_py() or "")
            if name not in cache:
                if len(cache) > 256:
                    cache.clear()
                cache[name] = {t["role"] & 0xFFFFFFFFFFFFFFFF: (t["piece"], t["rank"]) for t in tokens.as_py() or ()}
            texts.append(main_text(page, cache[name]).encode("utf-8", "replace").decode())
            sizes.append(len(cache[name]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())],
            names=["page_id", "url", "text", "n_template"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_template (tokens of the host's template, 0 where it has none)."""
    pages = pages.select("page_id", "url", "html")
    known = written(templates(pages), "page-templates")
    size = known.agg(F.sum("n")).first()[0] or 0
    known = known.select("host", "template")
    rows = pages.withColumn("host", host(F.col("url")))
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_TOKENS else known, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = joined.select("page_id", "url", "html", "host", "template").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_template int")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_template")
