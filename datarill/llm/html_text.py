"""Main text of web pages by wrappers inferred from pages of the same host.

Every page becomes a stream of blocks, each named by its path of block elements
with their class. A wrapper is a union-free regular expression over such names: a
sequence of items that may be optional ``?`` or repeated ``+``, items being a name or
a group of names. Streams of one host are aligned one after another: what matches
stays, what only one side has becomes optional, what stands twice in a row becomes
a repeated group. Each item keeps how many pages had it, how much text stood in
it and whether that text varied: items with varying text are slots, the others are
template.

A host's wrapper decides what is main text on all its pages:

* its region is the deepest container that holds MASS of the slots' text. Markup is
  one feature of that mass: items in menus, forms, adverts and the like have none,
  links count little, headings and article markup count more;
* a text is template if it stands in one item on at least SHARE of the host's
  pages, MARKED of them inside article markup, and on PAGES of them, told apart by
  their longest block, so that copies of one article don't make its text template.

A page's text is what stands in the region, without the template and without what
is marked as menu, form, advert and the like.

Streams are counted per host and layout before they move, so a host with a third
of all pages sends one row per distinct layout and batch. Layouts of one host are
merged in a tree of bounded groups; merging is repeatable on its own results. Block
texts are counted by 64-bit hashes, partly before the shuffle. Pages get their host's
wrapper by a join that Spark may split (or a broadcast below MAX_HOSTS hosts and
MAX_TEMPLATE texts). Pages are parsed twice, which moves less than writing them.

Defined results: null html has no text; null urls are pages of one unnamed host;
a page without anything in its host's region uses its own; pages are read whole,
unclosed tags included; a quote that opens an attribute and isn't closed before a
blank, ``/`` or ``>`` is no quote; repeated rows stay repeated; an empty table gives
an empty table.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .url_rules import host_of

#: Layouts that one task aligns, and hosts and template texts that are broadcast, at most.
GROUP, MAX_HOSTS, MAX_TEMPLATE = 64, 50_000, 500_000
#: Longest group of names that is tried as a repeated group, and elements of a path; what stands deeper is named by the outer ones.
SQUARE, DEPTH = 4, 64
#: Share of the slots' text that a region holds.
MASS = 0.9
#: Share of a host's pages, the same inside article markup, and number of pages, from which on a text is template.
SHARE, MARKED, PAGES = 0.5, 0.95, 5

# Element classes of HTML (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas math noframes xmp".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg object canvas button select textarea menu dialog head title".split())
WORDS_DROPPED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header menu menus modal nav navbar navigation "
    "newsletter notice notices popup promo promotion related respond reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words that say nothing about what an element is; a class of such words and at least one of WORDS_DROPPED is dropped.
WORDS_PLAIN = frozenset("area bar block bottom box container content group inner item items left links list main outer page pages right row section site slot top unit wrap wrapper".split())
CLOSES_P = BLOCKS - {"body", "button", "head", "html", "title"}
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
SCOPES = frozenset("ul ol dl table body div section article td th blockquote".split())
CONTAINERS = frozenset("body main article section div td center".split())
HEADINGS = frozenset("h1 h2 h3".split())
ARTICLES = ("article", "main")

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>?|[^<]+|<""", re.S
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


class Block(NamedTuple):
    path: str
    text: str
    dropped: bool
    links: int  #: characters inside links


class Open(NamedTuple):
    tag: str
    dropped: bool  #: it or one around it is
    path: str
    article: bool
    link: bool


def _words(attributes: str) -> list[str]:
    """The class, id and role tokens of an element, in lower case."""
    return [t for m in _NAMED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split()]


def _marked(tokens: list[str]) -> bool:
    """Whether a token consists of words for menus, adverts and the like, and of words that say nothing."""
    for t in tokens:
        parts = set(_PARTS.findall(t))
        if parts & WORDS_DROPPED and parts <= WORDS_DROPPED | WORDS_PLAIN:
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Each block of a page that has text, in page order."""
    out: list[Block] = []
    stack = [Open("", False, "", False, False)]
    open_tags: Counter = Counter()
    text: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                out.append(Block(stack[-1].path, words, stack[-1].dropped, links))
        links = 0

    def last(tag: str) -> int:
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if open_tags[tag] else 0

    def close(index: int) -> None:
        flush()
        open_tags.subtract(x.tag for x in stack[index:])
        del stack[index:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                text.append(m[0])
                if stack[-1].link:
                    links += len(m[0])
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            index = last(tag)
            if index:
                if tag in BLOCKS:
                    close(index)
                else:
                    open_tags[tag] -= 1
                    gone = stack.pop(index)
                    if gone.link:
                        stack[index:] = [x._replace(link=stack[index - 1].link) for x in stack[index:]]
            elif tag == "p":
                flush()
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P and (index := last("p")):
                close(index)
            if tag in CLOSED_BY:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in CLOSED_BY[tag].split():
                        close(i)
                        break
                    if stack[i].tag in SCOPES and stack[i].tag not in ("td", "th"):
                        break
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:  # neither tags nor text inside
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        up = stack[-1]
        named = tag in BLOCKS and attributes and tag not in ("html", "body", "article", "main")
        tokens = _words(attributes) if attributes and tag not in ("html", "body", "article", "main") else []
        path = up.path
        if tag in BLOCKS and path.count("/") < DEPTH:
            name = tag + ("." + "".join(c for c in tokens[0] if not c.isdigit() and c != "/") if named and tokens else "")
            path = f"{path}/{name}" if path else name
        dropped = up.dropped or tag in DROPPED or tag == "header" and not up.article or _marked(tokens)
        stack.append(Open(tag, dropped, path, up.article or tag in ARTICLES, up.link or tag == "a"))
        open_tags[tag] += 1
    flush()
    return out


# ---- wrappers: lists of items [names, optional, repeated, pages, mass, varies, text hash]


def collapse(items: list[list]) -> list[list]:
    """Turns what stands twice in a row into repeated groups, until nothing does."""
    changed = True
    while changed:
        changed = False
        for size in range(1, SQUARE + 1):
            out: list[list] = []
            for item in items:
                out.append(item)
                while len(out) >= 2 * size and [x[0] for x in out[-size:]] == [x[0] for x in out[-2 * size : -size]]:
                    changed = True
                    last = [out.pop() for _ in range(size)][::-1]
                    if size == 1:
                        out[-1] = _joined(out[-1], last[0], repeated=True)
                    else:
                        first = [out.pop() for _ in range(size)][::-1]
                        both = [_joined(a, b) for a, b in zip(first, last)]
                        names = [n for x in both for n in x[0]]
                        out.append([names, all(x[1] for x in both), True, max(x[3] for x in both), sum(x[4] for x in both), any(x[5] for x in both), 0])
            items = out
    return items


def _joined(a: list, b: list, repeated: bool = False) -> list:
    return [a[0], a[1] and b[1] if repeated else a[1] or b[1], repeated or a[2] or b[2], max(a[3], b[3]) if repeated else a[3] + b[3], a[4] + b[4], a[5] or b[5] or a[6] != b[6], a[6]]


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of what either wrapper matches."""
    keys = ["\x00".join(x[0]) for x in a], ["\x00".join(x[0]) for x in b]
    out: list[list] = []
    optional = lambda x: [x[0], True, *x[2:]]
    for kind, i, j, k, m in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_joined(x, y) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [optional(x) for x in a[i:j]] + [optional(x) for x in b[k:m]]
    return collapse(out)


def _tag(name: str) -> str:
    return name.partition(".")[0]


def mass(b: Block) -> int:
    """What a block counts for as main text: its characters outside links, more in headings and article markup."""
    if b.dropped:
        return 0
    parts = [_tag(x) for x in b.path.split("/")]
    return max(0, len(b.text) - b.links) * (5 if parts[-1] in HEADINGS else 1) * (3 if any(x in ARTICLES for x in parts) else 1)


def stream(found: list[Block]) -> list[list]:
    """A page's own wrapper; dropped blocks are marked by a leading minus."""
    return collapse([[["-" * b.dropped + b.path], False, False, 1, mass(b), False, xxhash.xxh32_intdigest(b.text)] for b in found])


def pattern(wrapper: list[list]) -> str:
    """The wrapper as a regular expression over block names; slots are written ``{}``."""
    return " ".join(("(" + " ".join(x[0]) + ")" if len(x[0]) > 1 else x[0][0]) + ("{}" if x[5] else "") + "+" * bool(x[2]) + "?" * bool(x[1]) for x in wrapper)


def region(wrapper: list[list]) -> str:
    """The path of the deepest container that holds MASS of the slots' text, of all text if there are no slots.

    From article markup on, a region is written by that mark alone (``//article``), as
    the path above it differs between pages with their end tags.
    """
    slots = [x for x in wrapper if x[5]] or wrapper
    held: Counter = Counter()
    total = 0.0
    for names, _, _, _, weight, _, _ in slots:
        for name in names:
            if name.startswith("-"):
                continue
            share = weight / len(names)
            total += share
            parts = name.split("/")
            mark = next((i for i, p in enumerate(parts) if _tag(p) in ARTICLES), None)
            for i in range(1, len(parts) if mark is None else mark + 1):
                if _tag(parts[i - 1]) in CONTAINERS:
                    held["/".join(parts[:i])] += share
            if mark is not None:
                held["//" + _tag(parts[mark])] += share
    best = [p for p, m in held.items() if m >= MASS * total]
    depth = lambda p: 10_000 if p.startswith("//") else p.count("/")
    return min(best, key=lambda p: (-depth(p), p)) if best and total else ""


def marked(path: str) -> bool:
    """Whether a path goes through article markup."""
    return any(_tag(p) in ARTICLES for p in path.split("/"))


def inside(path: str, where: str) -> bool:
    if where.startswith("//"):
        return any(_tag(p) == where[2:] for p in path.split("/"))
    return not where or path == where or path.startswith(where + "/")


def text_key(b: Block) -> int:
    """A block's place and text as a signed 64-bit integer."""
    return xxhash.xxh64_intdigest(f"{b.path}\x00{b.text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def main_text(page: str, where: str | None, template: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks of a page inside its host's region that aren't template, or inside its own region if there are none."""
    found = [b for b in blocks(page)]
    live = [b for b in found if not b.dropped and not (template and text_key(b) in template)]
    kept = [b.text for b in live if inside(b.path, where)] if where is not None else []
    if not kept and live:
        own = region(stream(live))
        kept = [b.text for b in live if inside(b.path, own)]
    return "\n".join(kept)


_MEASURED = "host string, layout string, pages long, mass array<long>, hashes array<long>, varies array<boolean>, texts array<struct<key:bigint,main:bigint,marked:boolean>>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per host, layout and batch: pages, mass and text hash of each item, and each block's text with its page's longest block."""
    for b in batches:
        sums: dict[tuple[str, str], list] = {}
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = blocks(page or "")
            items = stream(found)
            key = (host or "", json.dumps([[x[0], x[2]] for x in items]))
            live = [x for x in found if not x.dropped]
            longest = text_key(max(live, key=lambda x: len(x.text))) if live else 0
            texts = {(text_key(x), longest, marked(x.path)) for x in live}
            old = sums.get(key)
            if old is None:
                sums[key] = [1, [x[4] for x in items], [x[6] for x in items], [x[5] for x in items], texts]
            else:
                old[0] += 1
                old[1] = [a + x[4] for a, x in zip(old[1], items)]
                old[3] = [v or x[5] or h != x[6] for v, h, x in zip(old[3], old[2], items)]
                old[4] |= texts
        rows = [(h, k, *s[:4], [{"key": x, "main": y, "marked": z} for x, y, z in sorted(s[4])]) for (h, k), s in sums.items()]
        part = list(zip(*rows)) or [()] * 7
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.struct([("key", pa.int64()), ("main", pa.int64()), ("marked", pa.bool_())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], names=["host", "layout", "pages", "mass", "hashes", "varies", "texts"])


def measure(pages: DataFrame) -> DataFrame:
    """The layouts and block texts of pages(url, html), counted per host; a table in the shared folder."""
    hosts = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "html")
    return materialize(hosts.mapInArrow(_measured, _MEASURED), "layouts")


def templates(measured: DataFrame) -> DataFrame:
    """host and the keys of its template texts, of hosts that have any. A host has twice as many of them as a page has blocks, on average, at most."""
    once = measured.select("host", F.explode("texts").alias("x")).groupBy("host", "x.key", "x.main", "x.marked").agg(F.count(F.lit(1)).alias("_"))
    seen = once.groupBy("host", "key", "marked").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES)
    # A page's longest block is the one whose key is the page's own.
    sizes = once.where(F.col("key") == F.col("main")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    share = F.when(F.col("marked"), F.lit(MARKED)).otherwise(F.lit(SHARE))
    found = seen.join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    return found.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("template"))


def infer_wrappers(measured: DataFrame) -> DataFrame:
    """host, wrapper (json), pattern and region of every host of measure()'s table."""
    # Rows of one layout differ in numbers only; sums are made before and behind the shuffle.
    at = F.posexplode(F.arrays_zip("mass", "hashes", "varies")).alias("i", "x")
    items = measured.select("host", F.xxhash64("layout").alias("key"), "layout", "pages", at)
    summed = items.groupBy("host", "key", "layout", "i").agg(
        F.sum("pages").alias("pages"), F.sum("x.mass").alias("mass"), F.min("x.hashes").alias("low"), F.max("x.hashes").alias("high"), F.max("x.varies").alias("varies")
    )
    whole = summed.groupBy("host", "key", "layout").agg(
        F.max("pages").alias("pages"), F.array_sort(F.collect_list(F.struct("i", "mass", (F.col("varies") | (F.col("low") != F.col("high"))).alias("varies"), "low"))).alias("items")
    )

    def as_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for layout, n, items in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                out.append(json.dumps([[names, False, repeated, n, x["mass"], x["varies"], x["low"]] for (names, repeated), x in zip(json.loads(layout), items)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    wrappers = materialize(whole.select("host", "layout", "pages", "items").mapInArrow(as_wrappers, "host string, wrapper string"), "wrappers")

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        got: list[list] | None = None
        for w in sorted(rows["wrapper"]):
            got = json.loads(w) if got is None else align(got, json.loads(w))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(got)]})

    while True:
        sizes = wrappers.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        salted = wrappers.join(sizes, "host").select("host", "wrapper", F.when(F.col("n") <= GROUP, F.lit(0)).otherwise(F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / (GROUP / 2)))).alias("salt"))
        wrappers = materialize(salted.groupBy("host", "salt").applyInPandas(merged, "host string, wrapper string"), "wrappers")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [json.loads(w) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pattern(w) for w in got], pa.string()), pa.array([region(w) for w in got], pa.string())], names=["host", "wrapper", "pattern", "region"])

    return wrappers.mapInArrow(named, "host string, wrapper string, pattern string, region string")


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars of every row of pages(key, url, html, ...)."""
    measured = measure(pages)
    wrappers = infer_wrappers(measured).select(F.col("host").alias("_host"), F.col("region").alias("_region"))
    wrappers = materialize(wrappers.join(templates(measured), F.col("_host") == F.col("host"), "left").select("_host", "_region", F.col("template").alias("_template")), "regions")
    size = wrappers.agg(F.count(F.lit(1)), F.sum(F.size(F.coalesce("_template", F.array())))).first()
    if size[0] <= MAX_HOSTS and (size[1] or 0) <= MAX_TEMPLATE:
        wrappers = F.broadcast(wrappers)
    joined = pages.select(key, "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("_h")).join(wrappers, F.col("_h") == F.col("_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = b.column(4).to_pylist()
            sets = {h: frozenset(b.column(5)[i].as_py()) for h, i in {h: i for i, h in enumerate(hosts)}.items()}
            texts = [main_text(p or "", r, sets[h]) for p, r, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), hosts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[key, "url", "text", "n_chars"])

    template = F.coalesce("_template", F.array().cast("array<bigint>"))
    return joined.select(key, "url", "html", "_region", "_h", template.alias("_t")).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
