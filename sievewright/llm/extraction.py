"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

A page is a stream of tags (with their first class) and texts. The streams of a host are aligned tag by tag along their nesting: tokens
with the same path, from the root down, are one item of the host's expression. What mismatches becomes part of it: an item that some
pages lack is optional, one that stands twice or more inside one parent is a repeated group, and texts that
differ make a slot. All of an item's counts are sums over pages, so an expression doesn't depend on which pages are
aligned first or where, and a host with a third of all pages is combined on all executors.

1. Every page gives its items and the texts of its slots. A slot is a block (what stands between two block tags), or a part
   of one in an element of its own kind. A page also gives a signature, one of its texts drawn by length and digest, by which copies and most
   near copies of a page count as one.
2. A slot's texts are counted by signature: how often it is filled, with how many different texts, how long they are, and how much
   of them is inside links. Texts that a good part of a host's pages have in one slot are its template texts.
3. Reading a page, its slots are found in its host's expression and weighed: BASE, a prior from the tags and names around, and the evidence of
   the host's pages (repeated texts and links speak against a slot, length for it), less for template texts. Slots
   with a positive sum are main text, in page order. Slots that the host's expression lacks are judged by the page alone, and so is a
   page with nothing left, as a host of one page's copies has.

The contract's own kinds (navigation, footers, asides, forms, page headers, scripts, styles, hidden parts and readers' comments) are out
whatever their texts. All other names are only a prior: long and varied text counts inside any of them.

Defined results: null or empty html gives an empty text; a page cut off in the middle is read up to there (an unfinished tag is
dropped); a null or odd url is a host of its own; repeated rows each get a row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_in, id_out

#: Shares of a host's pages from which on a text of a slot is listed as template, and a slot at all; what fewer have is judged by the page alone.
#: So a host's wrapper holds at most some multiple of what one page does, however many pages it has.
TEMPLATE_SHARE, SLOT_SHARE = 0.2, 0.01
#: Weights: of any slot, inside an article or a main part, beside those, of a template text by its share, of repeated texts, of links, and the range of length.
BASE, ARTICLE, MAIN, BESIDE, TEMPLATE, REPEATED, LINKED, SHORTEST, LONGEST = 1.5, 4.0, 2.0, -3.0, 7.0, 4.0, 4.0, -1.0, 3.0
#: Weights of names that speak of adverts and page furniture, and of such as main text also has. Characters of an even length.
FURNITURE, DOUBTFUL, EVEN = -4.5, -2.0, 30

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
OUT_TAGS = frozenset("head nav footer aside form button dialog menu label fieldset".split()) | RAW
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu".split())
_names = lambda words: re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)
#: A whole name of readers' comments: not one that only speaks of them, as of a post that has some.
READERS = re.compile(r"(?:^|\s)(?:(?:post|page|article|user|reader|readers|site|wp|fb)[-_]?)?(?:comments?|commentlist|repl(?:y|ies)|disqus|respond)(?:[-_](?:\d+|area|list|section|thread|threads|form|box|wrap|wrapper|block|container|content|body|text|item|inner|holder|title|meta|author))*(?:$|\s)", re.I)
FURNITURE_NAMES = _names(r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscri\w*|sidebar|popup|modal|overlay|nav|navbar|navigation|breadcrumbs?|masthead|topbar|login|signup|toolbar")
DOUBTFUL_NAMES = _names(r"notices?|alert|banner|widget|menu|footer|shar(?:e|ing)|social|related|recommend\w*|search|pag(?:er|ination)|skip|copyright")

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^>]*\Z|[^<]+|<", re.S)
_attribute = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_space = re.compile(r"\s+")


class Element:
    """A start tag: its path, what it says of texts inside (``out``, ``main``, ``weight``), and the element that judges them (itself, or the block around)."""

    __slots__ = ("judge", "kids", "link", "main", "name", "out", "path", "weight")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        found = {k.lower(): a or b or c for k, a, b, c in _attribute.findall(attributes)} if attributes else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        role = found.get("role", "").lower()
        sign = f"{name}.{found['class'].split()[0]}" if found.get("class", "").split() else name
        path = f"{parent.path}/{sign}" if parent and parent.path else sign
        self.path = path if len(path) <= 400 else f"{blake2b(path.encode('utf-8', 'replace'), digest_size=12).hexdigest()}/{sign}"  # nesting may be deep
        self.name, self.kids = name, set()
        self.link = name == "a" or bool(parent and parent.link)
        #: 2 inside an article, 1 inside a main part
        self.main = max(parent.main if parent else 0, 2 if name == "article" else 1 if name == "main" or role == "main" else 0)
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        whole = name in ("html", "body", "main", "article")
        readers = bool(names) and not whole and READERS.search(names)
        self.out = bool(parent and parent.out) or name in OUT_TAGS or (name == "header" and self.main == 0) or role in OUT_ROLES or hidden or bool(readers)
        own = 0.0 if whole or not names else FURNITURE if FURNITURE_NAMES.search(names) else DOUBTFUL if DOUBTFUL_NAMES.search(names) else 0.0
        self.weight = min(own, parent.weight if parent else 0.0)
        self.judge = self if parent is None or name in BLOCKS or own < 0 else parent.judge


class Slot:
    """A filled slot of a page: the element that judges it, its text, the characters of that inside links, and its block's number."""

    __slots__ = ("block", "element", "links", "text")

    def __init__(self, element: Element, text: str, links: int, block: int):
        self.element, self.text, self.links, self.block = element, text, links, block


def parse(page: str | None) -> tuple[list[Slot], dict[str, int], set[str]]:
    """The filled slots in order, the places of the items' paths in order of their first, and the paths that repeat inside one parent."""
    found, places, again = [], {}, set()
    root = Element("", "", None)
    stack, block, parts = [root], 0, []

    def end() -> None:
        nonlocal block
        for judge, texts, links in parts:
            text = entities.unescape("".join(texts))
            if text.strip():
                found.append(Slot(judge, text, links, block))
        parts.clear()
        block += 1

    def leave_head() -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name == "head":
                del stack[depth:]

    def put(element: Element, text: str) -> None:
        if not element.out:
            if not parts or (parts[-1][0] is not element.judge and text.strip()):
                parts.append([element.judge, [], 0])
            parts[-1][1].append(text)
            parts[-1][2] += len(_space.sub(" ", text)) * element.link

    at, page = 0, page or ""
    while at < len(page):
        token = _token.match(page, at)
        at = token.end()
        name = token[2] or token[5]
        if name:
            name = name.lower()
            closing, rest = (token[1], token[3]) if token[2] else (token[4], token[6])
            if name in BLOCKS:
                end()
            elif name in ("br", "td", "th", "img", "option"):
                put(stack[-1], " ")
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        del stack[depth:]
                        break
                continue
            if name == "body" or name in BLOCKS:  # a head may end without its end tag
                leave_head()
            if name in BLOCKS:  # an open paragraph ends where a block begins, and a list item at the next
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == "p" or (stack[depth].name == name and name in ("li", "dd", "dt", "tr")):
                        del stack[depth:]
                        break
                    if stack[depth].name in BLOCKS:
                        break
            element = Element(name, rest, stack[-1])
            places.setdefault(element.path, len(places))
            if element.path in stack[-1].kids:
                again.add(element.path)
            stack[-1].kids.add(element.path)
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            elif name not in VOID and not rest.endswith("/"):
                stack.append(element)
        elif not page.startswith("<", token.start()) or token[0] == "<":
            if token[0].strip():
                leave_head()
            put(stack[-1], token[0])
    end()
    return found, places, again


def mark(text: str) -> int:
    """A text's digest, whatever its white space."""
    return int.from_bytes(blake2b(" ".join(text.split()).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def signature(found: list[tuple[int, int]]) -> int:
    """One of a page's (digest, length), drawn by length: pages that share most of their text mostly draw the same."""
    return min(((-math.log(((digest & (2**52 - 1)) + 1) / (2**52 + 1)) / length, digest) for digest, length in found), default=(0.0, 0))[1]


def evidence(filled: float, different: float, chars: float, links: float) -> float:
    """What the pages say of a slot, from how often it is filled, with how many texts, of how many characters, so many inside links."""
    length = math.log2(max(chars, 1) / max(filled, 1) / EVEN)
    return min(max(length, SHORTEST), LONGEST) - REPEATED * max(0.0, filled - different) / (filled + 2) - LINKED * min(1.0, links / max(chars, 1))


class Reader:
    """A host's wrapper as it is used for reading: the counts of its slots, and the shares of its template texts."""

    def __init__(self, known: str | None = None):
        told = json.loads(known) if known else {}
        self.slots = {s["path"]: (s["filled"], s["different"], s["chars"], s["links"]) for s in told.get("slots") or ()}
        self.templates = {(t["path"], t["text"]): t["share"] for t in told.get("templates") or ()}

    def weigh(self, page: str | None) -> list[tuple[Slot, float]]:
        """The filled slots of a page with their weights."""
        found, _, _ = parse(page)
        marked = max((s.element.main for s in found), default=0)
        own: dict[str, list[int]] = {}
        for s in found:
            counts = own.setdefault(s.element.path, [0, 0, 0, 0])
            for i, n in enumerate((1, 1, len(s.text), s.links)):
                counts[i] += n
        out = []
        for s in found:
            prior = BASE + s.element.weight + (0.0, MAIN, ARTICLE)[s.element.main] + (BESIDE if s.element.main < marked else 0.0)
            share = self.templates.get((s.element.path, mark(s.text)), 0.0) if self.templates else 0.0
            out.append((s, prior + evidence(*(self.slots.get(s.element.path) or own[s.element.path])) - TEMPLATE * share))
        return out

    def text(self, page: str | None) -> str:
        """The page's main text: the slots that count, in page order, blocks joined by an empty line."""
        kept = [s for s, weight in self.weigh(page) if weight > 0]
        if not kept and self.slots:
            return Reader().text(page)
        out: dict[int, list[str]] = {}
        for s in kept:
            out.setdefault(s.block, []).append(s.text)
        return "\n\n".join(x for x in (_space.sub(" ", "".join(texts)).strip() for texts in out.values()) if x)


def main_text(page: str | None, reader: Reader | None = None) -> str:
    """The main text of a page, by its host's wrapper or, without one, by the page alone."""
    return (reader or Reader()).text(page)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


READ = "host string, path string, text long, sign long, n long, chars long, links long, place long, again boolean"


def items(pages: DataFrame) -> DataFrame:
    """What every page gives: a row for each text of a slot (and one with an empty path for itself) with the page's signature, and counts of its items."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            counts: dict[tuple[str, str], list] = {}
            for host, page in zip(batch["host"], batch["html"], strict=True):
                found, places, again = parse(page)
                texts = [(mark(s.text), len(s.text)) for s in found]
                if not places and not texts:
                    continue
                sign = signature(texts)
                rows.append((host, "", 0, sign, None, 0, 0, None, None))
                rows.extend({(host, s.element.path, text, sign, None, n, s.links, None, None) for s, (text, n) in zip(found, texts, strict=True)})
                for path, place in places.items():
                    item = counts.setdefault((host, path), [0, 0, False])
                    item[0], item[1], item[2] = item[0] + 1, item[1] + place, item[2] or path in again
            rows.extend((host, path, None, None, n, None, None, place, again) for (host, path), (n, place, again) in counts.items())
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in READ.split(", ")], dtype=object)
            yield out.astype({**dict.fromkeys(("text", "sign", "n", "chars", "links", "place"), "Int64"), "again": "boolean"})

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(each, READ)


def expression(shape: list[tuple[str, int, int, bool]]) -> str:
    """The wrapper as a union-free regular expression over tags, from (path, pages, place, again) of its items; ``?`` optional, ``+`` repeated, ``#`` a slot."""
    below: dict[str, list] = {}
    known = {path: pages for path, pages, _, _ in shape}
    for path, pages, place, again in shape:
        below.setdefault(path.rpartition("/")[0], []).append((place / pages, path, pages, again))

    def told(at: str, most: int) -> str:
        parts = []
        for _, path, pages, again in sorted(below.get(at, ())):
            sign = path.rpartition("/")[2]
            inner = told(path, known.get(path, most)) or "#"
            parts.append((f"({sign} {inner} /{sign.partition('.')[0]})+" if again else f"{sign} {inner} /{sign.partition('.')[0]}" if pages == most else f"({sign} {inner} /{sign.partition('.')[0]})") + "?" * (pages < most))
        return " ".join(parts)

    return told("", max((pages for _, pages, _, _ in shape), default=0))


def wrappers(pages: DataFrame, stages) -> DataFrame:
    """host and reading (JSON of slots and template texts): inferred from every page."""
    return _wrappers(stages.keep(items(pages), "items"))


def _wrappers(read: DataFrame) -> DataFrame:
    # a text counts once for all pages of one signature
    once = read.where("text is not null").groupBy("host", "path", "text", "sign").agg(F.max("chars").alias("chars"), F.max("links").alias("links"))
    texts = once.groupBy("host", "path", "text").agg(F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("links").alias("links"))
    whole = once.where("path = ''").groupBy("host").agg(F.count("*").alias("pages"))
    slots = texts.where("path <> ''").groupBy("host", "path").agg(F.sum("n").alias("filled"), F.count("*").alias("different"), F.sum(F.col("chars") * F.col("n")).alias("chars"), F.sum(F.col("links") * F.col("n")).alias("links"))
    # shares come before anything is collected: slots that a hundredth of the pages fill and texts that a fifth have are a bounded number of times what one page holds
    share = (F.col("n") - 1) / (F.col("pages") + 1)
    often = texts.where("path <> '' AND n > 1").join(whole, "host").where(share >= TEMPLATE_SHARE).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "text", share.alias("share")))).alias("templates"))
    many = slots.join(whole, "host").where((F.col("filled") >= 2) & (F.col("filled") >= SLOT_SHARE * F.col("pages")))
    known = many.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "filled", "different", "chars", "links"))).alias("slots")).join(often, "host", "left")
    return known.select("host", F.to_json(F.struct("slots", "templates")).alias("reading"))


def expressions(pages: DataFrame, stages) -> DataFrame:
    """host and its wrapper as a regular expression; items that less than SLOT_SHARE of the host's pages have are left out of the text."""
    read = stages.keep(items(pages), "items").where("n is not null")
    shape = read.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum("place").alias("place"), F.max("again").alias("again"))
    most = shape.groupBy("host").agg(F.max("pages").alias("most"))
    shape = shape.join(most, "host").where(F.col("pages") >= SLOT_SHARE * F.col("most"))
    told = lambda group: pd.DataFrame({"host": group["host"].iloc[:1], "expression": [expression(list(group[["path", "pages", "place", "again"]].itertuples(index=False, name=None)))]})
    return shape.groupBy("host").applyInPandas(told, "host string, expression string")


def extract(pages: DataFrame, stages) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``."""
    known = stages.keep(wrappers(pages, stages), "wrappers")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers: dict[str | None, Reader] = {}
        for batch in batches:
            if len(readers) > 1000:
                readers = {}
            texts = []
            for page, told in zip(batch["html"], batch["reading"], strict=True):
                if told not in readers:
                    readers[told] = Reader(told)
                texts.append(readers[told].text(page))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": np.array([len(t) for t in texts], dtype=np.int64)})

    rows = pages.select(id_in("page_id"), "url", "html", host_of(F.col("url")).alias("host")).join(known, "host", "left").select("page_id", "url", "html", "reading")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(read, "page_id long, url string, text string, n_chars long").withColumn("page_id", id_out("page_id").cast(kind))
