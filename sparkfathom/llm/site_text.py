"""Main text of web pages: markup rules and removal of what a site repeats.

A page is read into blocks, the texts between block elements, and into subtrees, the
elements with the blocks that they hold. Markup says that some elements are no
article text (menus, forms, scripts). What a site repeats without saying so is found by
counting: subtrees are hashed, counted per host in Spark, and those that recur on many
different pages of their host are deleted with all they hold.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfathom.llm import shared

# Fixed word lists of HTML and of usual class names.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_NEVER = frozenset(
    "head script style template noscript textarea title iframe xmp noembed noframes svg math canvas audio video object map nav footer aside menu "
    "dialog form fieldset button select option datalist".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
_HINTS = _COMMENTS | frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topbar toolbar skiplink masthead footer colophon copyright sidebar "
    "aside rail widget widgets related recommended recommendations trending share sharing social follow notice cookie cookies consent gdpr alert popup "
    "modal overlay toast banner paywall subscribe subscription newsletter signup login ad ads adv advert adverts advertisement advertisements advertising "
    "adsense adslot adbox sponsor sponsored sponsors promo promoted promotion outbrain taboola".split()
)
#: A class name with one of these says what a page has or is about, not what its element is.
_ABOUT = frozenset("with without has no is main".split())
_OWN_HEADER = frozenset("article post entry story".split())
#: Elements whose start ends an open element of the same group.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/<>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/<>]*)(?P<rest2>[^<>]*)>"  # quotes that do not match
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[A-Za-z][^<>]*\Z",  # a page that was cut off inside a tag
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Rules(NamedTuple):
    """When a subtree counts as a part of its site and not of its page.

    Article text, inside ``article`` or ``main`` or of ``prose`` words or more that are
    no links, has to recur on nearly all pages of the host; anything else on a
    fifth of them. Pages that differ in nothing but markup count as one.
    """

    prose: int = 20
    least: int = 3
    share: float = 0.2
    least_in_article: int = 10
    share_in_article: float = 0.8


RULES = Rules()


class Block(NamedTuple):
    text: str
    in_main: bool


class Subtree(NamedTuple):
    """An element that holds the blocks from ``first`` up to but not ``after``.

    The last bit of ``key`` tells article text.
    """

    key: int
    first: int
    after: int


class _Open:
    __slots__ = ("block", "dropped", "first", "main", "name", "parts")

    def __init__(self, name: str, block: bool, dropped: bool, main: bool, first: int) -> None:
        self.name, self.block, self.dropped, self.main, self.first = name, block, dropped, main, first
        self.parts: list[str] = []


@lru_cache(maxsize=1 << 14)
def _says(name: str, rest: str) -> tuple[bool, bool]:
    """What the attributes of an element say: it is no article text; it is the main part."""
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
    role = given.get("role", "").lower()
    if role == "main":
        return False, True
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    if hidden or role in _ROLES:
        return True, False
    if name in ("html", "body", "main"):
        return False, False
    words = _COMMENTS if name == "article" else _HINTS
    for label in f"{given.get('class', '')} {given.get('id', '')}".split():
        parts = {p.lower() for p in _PART.findall(label)}
        if parts & words and not parts & _ABOUT:
            return True, False
        if "header" in parts and name != "article" and not parts & (_ABOUT | _OWN_HEADER):
            return True, False
    return False, False


def read_page(html: str | None, prose: int = RULES.prose) -> tuple[list[Block], list[Subtree]]:
    """Blocks of a page in its order, and the subtrees that hold some of them.

    Markup in any state is read: open elements end where their parent does, stray end
    tags are left out, a page may stop anywhere. A null page has no blocks.
    """
    blocks: list[Block] = []
    subtrees: list[Subtree] = []
    stack = [_Open("", True, False, False, 0)]
    pieces: list[str] = []
    loose = [0]  # words outside links, summed over blocks
    linked = 0
    html = html or ""

    def flush() -> None:
        nonlocal linked
        if not pieces:
            return
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            holder = next(x for x in reversed(stack) if x.block)
            blocks.append(Block(text, holder.main))
            loose.append(loose[-1] + max(0, text.count(" ") + 1 - linked))
            holder.parts.append(text)
        linked = 0

    def close(at: int) -> None:
        """End the elements of the stack from ``at`` on."""
        while len(stack) > at:
            if stack[-1].block:
                flush()
            top = stack.pop()
            if not top.block or len(blocks) == top.first:
                continue
            digest = xxhash.xxh3_64_intdigest("\x00".join((top.name, *top.parts)).encode("utf-8", "surrogatepass"))
            article = top.main or loose[len(blocks)] - loose[top.first] >= prose
            key = (digest & ~1 | article) - (1 << 63)
            subtrees.append(Subtree(key, top.first, len(blocks)))
            next(x for x in reversed(stack) if x.block).parts.append(f"\x01{digest}")

    def close_open(names: tuple[str, ...]) -> None:
        """End the nearest of ``names`` that only text-level elements and paragraphs are open in."""
        passed = ("p", "td", "th") if "tr" in names else ("p",)
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                close(i)
                return
            if stack[i].block and stack[i].name not in passed:
                return

    at = 0
    while True:
        tag = _TAG.search(html, at)
        if not stack[-1].dropped:
            piece = html[at : tag.start() if tag else len(html)]
            if piece:
                piece = unescape(piece) if "&" in piece else piece
                pieces.append(piece)
                if any(x.name == "a" for x in stack[-3:]):
                    linked += len(piece.split())
        if tag is None:
            break
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            continue
        if tag["end"] or tag["end2"]:
            inline = name in _INLINE
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if inline and stack[i].block:
                    break
            continue
        rest = tag["rest"] or tag["rest2"] or ""
        if name in _VOID:
            if name == "br" and not stack[-1].dropped:
                pieces.append(" ")
            elif name == "hr":
                flush()
            continue
        block = name not in _INLINE
        if block:
            if name in _SIBLINGS:
                close_open(_SIBLINGS[name])
            close_open(("p",))
            flush()
        over = stack[-1]
        bad, main = _says(name, rest) if rest and not rest.isspace() else (False, False)
        main = main or name in ("article", "main")
        never = name in _NEVER or (name == "header" and not over.main)
        stack.append(_Open(name, block, over.dropped or bad or never, over.main or (main and not bad), len(blocks)))
        if name in _RAW and not rest.endswith("/"):
            ended = re.compile(f"</{name}\\s*>|\\Z", re.I).search(html, at)
            at = ended.end()
            close(len(stack) - 1)
    close(1)
    flush()
    return blocks, subtrees


def main_text(page: tuple[list[Block], list[Subtree]], site: set[int] = frozenset()) -> str:
    """The blocks of the page's article, or of all of it if none is marked, one a line.

    Subtrees with a key in ``site`` are left out with all their blocks.
    """
    blocks, subtrees = page
    gone = [False] * len(blocks)
    for s in subtrees:
        if s.key in site:
            gone[s.first : s.after] = [True] * (s.after - s.first)
    marked = any(b.in_main for b in blocks)
    return "\n".join(b.text for b, g in zip(blocks, gone, strict=True) if not g and b.in_main >= marked)


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


#: The key under which a host's pages themselves are counted.
PAGES = 0

#: Counts that a task holds before it hands them on.
HELD_KEYS = 200_000


def subtree_counts(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``(host, key, n, seen)`` by the hash of the host: pages with that subtree, once each.

    ``seen`` has a bit for each remainder by 64 of the digests of their texts, so that
    copies of one page can be told from many pages. Key ``PAGES`` counts all pages.
    """
    shared.modest_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])

        def out() -> pa.RecordBatch:
            hosts, keys = zip(*held, strict=True)
            n, seen = zip(*held.values(), strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (hosts, keys, n, seen)], ["host", "key", "n", "seen"])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = read_page(html.as_py(), rules.prose)
                place = xxhash.xxh3_64_intdigest("\n".join(b.text for b in page[0]).encode("utf-8", "surrogatepass")) % 64
                bit = (1 << place) - (1 << 64 if place == 63 else 0)
                for key in {PAGES, *(s.key for s in page[1])}:
                    entry = held[host, key]
                    entry[0] += 1
                    entry[1] |= bit
                if len(held) >= HELD_KEYS:
                    yield out()
        if held:
            yield out()

    counted = pages.mapInArrow(shared.tidy(run), "host long, key long, n long, seen long")
    return counted.groupBy("host", "key").agg(F.sum("n").alias("n"), F.bit_or("seen").alias("seen"))


def site_parts(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``(host, keys, pages)``: for each host the keys of subtrees that belong to the site.

    A subtree recurs if the pages that hold it, and their different texts, both come
    to the least number and to the share of the host that ``rules`` ask for. A page
    has a bounded part of its site's subtrees, so ``keys`` is as short as pages are.
    """
    counts = shared.materialise(subtree_counts(pages, rules).where((F.col("key") == PAGES) | (F.col("n") >= rules.least)), "site-counts")
    hosts = counts.where(F.col("key") == PAGES).select("host", F.col("n").alias("pages"), F.bit_count("seen").alias("texts"))
    found = counts.where(F.col("key") != PAGES)
    entries = hosts.join(found.groupBy("host").agg(F.count(F.lit(1)).alias("rows")), "host")
    beside = shared.salted_lookup(found, entries, "host", "rows", "key")
    article = F.col("key").bitwiseAND(F.lit(1)) == 1
    least = F.when(article, rules.least_in_article).otherwise(rules.least)
    share = F.when(article, rules.share_in_article).otherwise(rules.share)
    texts = F.bit_count("seen")
    recurs = (F.col("n") >= least) & (F.col("n") >= share * F.col("pages")) & (texts >= least) & (texts >= share * F.col("texts"))
    return beside.where(recurs).groupBy("host").agg(F.collect_list("key").alias("keys"), F.first("pages").alias("pages"))


#: Keys of all hosts together up to which their table is broadcast: 8 MB.
BROADCAST_KEYS = 1_000_000


def extract(pages: DataFrame, rules: Rules = RULES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    ``pages`` has ``page_id``, ``url`` and ``html``; other columns do not matter, and
    repeated rows stay. A null page has an empty text. A page whose address is null
    or has no host belongs to no site: only markup counts there. Pages are read
    twice; what a site repeats is joined to them by host, by broadcast up to
    ``broadcast_keys`` keys and else by an exchange in which large hosts are salted.
    """
    host = host_of(F.col("url"))
    known = pages.select(F.xxhash64(host).alias("host"), "html", host.alias("name"))
    parts = shared.materialise(site_parts(known.where("name <> ''").select("host", "html"), rules), "site-parts")
    size = parts.agg(F.sum(F.size("keys")).alias("s")).first()["s"] or 0
    rows = pages.select("page_id", "url", "html", F.when(host != "", F.xxhash64(host)).alias("host"))
    if size <= broadcast_keys:
        joined = rows.join(F.broadcast(parts), "host", "left")
    else:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        every = rows.where("host is not null").select("host").distinct().join(parts, "host", "left").withColumn("pages", F.coalesce("pages", F.lit(1).cast("long")))
        joined = shared.salted_lookup(rows.where("host is not null"), every, "host", "pages", "row")
        joined = joined.select("page_id", "url", "html", "keys").unionByName(rows.where("host is null").selectExpr("page_id", "url", "html", "cast(null as array<long>) keys"))
    shared.modest_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, keys in zip(batch.column(2), batch.column(3), strict=True):
                site = frozenset(keys.as_py() or ())
                texts.append(main_text(read_page(html.as_py(), rules.prose), site))
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "keys").mapInArrow(shared.tidy(run), "page_id long, url string, text string, n_chars long")
