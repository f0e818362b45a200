"""HTML extraction: page structure first, a host suffix array for what the structure leaves open.

A page is cut into blocks with one pass over its tags. Marks decide where they can: blocks inside an article (or main)
element are the main text; blocks inside menus, page headers, footers, sidebars, notices, adverts, forms and reader comments
are not. On pages without such an element the unmarked blocks are open, and the host decides: the token streams of all its
pages, marked ones too, are concatenated, a suffix array with common prefix lengths finds token runs of MIN_RUN and more that
occur on MIN_PAGES distinct page bodies of the host, and what such runs cover goes, while unique runs stay, also within a block.

Hosts whose pages leave nothing open need no array: it could change no text of theirs. The array alone can't give the right text
(the README has figures): it removes an article that stands on two pages of a
host and keeps a footer that stands on one. So it never overrules a mark.

Marks are tags, roles, whole class names, whole ids of containers and known compounds (share-buttons); parts of names are
none. What an attribute says counts under its own name only: a title or data text that mentions `hidden` hides nothing. Inside
an article whole classes such as comment, commentlist and notice drop blocks (not paragraphs or words, where they may be the
author's emphasis); names that may as well be the author's (class search-results) leave a block in doubt: the array decides
it. Headings, paragraphs' ids, formulas, drawings, objects and buttons of an article stay.

Equal bodies of a host become one before anything else. They are dealt into shards of TOKENS_PER_SHARD by their hash, so a
host with a third of all pages is many tasks. Each shard builds its own array and passes on one fingerprint a distinct run of
MIN_RUN tokens with its number of pages; their sums by host say which runs repeat, exactly as one array over the whole host
would.

Defined results: null and empty html give empty text; unclosed elements end with their parent or the page; a start tag of an
article closes menus and page headers left open; unclosed comments and scripts run to the end; equal page bodies of a host
count as one page; pages whose url is null or names no host share none, so nothing on them is repeated; very long pages are
read whole; rows without a page_id and repeated rows come back each; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import read, write_table

MIN_RUN = 8
MIN_PAGES = 2
TOKENS_PER_SHARD = 500_000
OPEN, STAYS, GOES = range(3)  # what marks say of a block

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMING = ("class", "id", "role")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)

_RAW = {"script", "style", "title", "textarea"}
_DROPPED = {"nav", "footer", "aside", "form", "menu", "noscript", "template", "iframe", "svg", "math", "object", "select", "button", "dialog", "head", "audio", "video", "canvas"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input", "meta", "link", "base", "source", "track", "param", "area", "col", "embed"}
_VOID = {"img", "input", "meta", "link", "base", "source", "track", "param", "area", "col", "embed", "br", "hr", "wbr"}
_SELF_ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6"}
_BOILERPLATE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "commentlist", "comment-body", "respond", "disqus", "newsletter", "subscribe", "share", "sharing", "social", "related", "popup", "modal", "toolbar", "pagination", "masthead", "contentinfo", "complementary", "search"}
_PAGE_HEADER = {"header", "masthead"}

# inside an article
_KEPT_IN_ARTICLE = {"math", "svg", "object", "button"}
_INLINE_IN_ARTICLE = _KEPT_IN_ARTICLE | {"mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mfenced", "mstyle", "mtable", "mtr", "mtd", "semantics", "annotation"}
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "header", "details"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = _CONTAINERS | {"li", "dd", "article", "aside", "tr", "td", "blockquote"}
# whole classes that mean a comment or a notice on a block, and may be the author's emphasis on a paragraph or a part of one
_ON_BLOCKS = {"alert", "notice", "notices", "banner", "menu", "comment", "commentlist", "comment-body", "cookie", "cookies", "consent", "modal", "navigation"}
_EITHER = {"search"}
_SURE = {
    "class": _BOILERPLATE - _EITHER - _ON_BLOCKS,
    "id": {"comments", "respond", "disqus", "disqus-thread", "sidebar", "navbar", "newsletter", "breadcrumbs"},
    "role": {"navigation", "contentinfo", "complementary", "search", "banner", "menu", "toolbar"},
}
_COMPOUND = re.compile(
    r"(?:related|recommended)-(?:posts?|articles?|links?|stories)|(?:share|sharing|social)-(?:buttons?|links?|icons?|bar|tools)|(?:ads?|advert|advertisement)-(?:container|slot|unit|wrapper|banner|box|block)"
    r"|(?:cookie|cookies|consent|gdpr)-(?:banner|notice|bar|popup|consent)|(?:newsletter|subscribe)-(?:signup|form|box)|comments?-(?:section|list|area|form|thread)|(?:nav|navigation|breadcrumbs?)-(?:bar|menu|links|list)"
)


class _Element:
    __slots__ = ("article", "doubtful", "dropped", "tag")

    def __init__(self, tag: str, dropped: bool, article: bool, doubtful: bool = False) -> None:
        self.tag, self.dropped, self.article, self.doubtful = tag, dropped, article, doubtful


def blocks(page: str) -> list[tuple[str, bool | None]]:
    """Visible blocks of a page outside marked boilerplate, in order, each with whether an article or main holds it.

    None stands for a block of an article that its names leave in doubt.
    """
    out: list[tuple[str, bool | None]] = []
    stack: list[_Element] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of a tag are in the stack
    words: list[str] = []
    dropped = article = doubtful = 0

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append((text, None if article and doubtful else article > 0))
            words.clear()

    def say(text: str) -> None:
        if not dropped:
            words.append(html.unescape(text) if "&" in text else text)

    def push(e: _Element) -> None:
        places[e.tag].append(len(stack))
        stack.append(e)

    def pop(k: int) -> None:
        nonlocal dropped, article, doubtful
        while len(stack) > k:
            e = stack.pop()
            places[e.tag].pop()
            dropped -= e.dropped
            article -= e.article
            doubtful -= e.doubtful

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m.group(1) or m.group(4), m.group(3) if m.group(2) else m.group(6)
        if tag == "br":
            say(" ")
            continue
        if tag in _INLINE or (article and tag in _INLINE_IN_ARTICLE):
            if tag not in _VOID and not closing and attributes and _marked(tag, _attributes(attributes), article > 0):
                push(_Element(tag, True, False))
                dropped += 1
            elif closing and places[tag]:
                pop(places[tag][-1])
            continue
        flush()
        if closing:
            if places[tag]:
                pop(places[tag][-1])
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag == "body":
            if places["head"]:
                pop(places["head"][0])
            continue
        named = _attributes(attributes)
        marked = _marked(tag, named, article > 0)
        main = not marked and (tag in ("article", "main") or "main" in named.get("role", "").lower().split())
        if main and (ended := [places[t][0] for t in ("nav", "header", "head") if places[t]]):
            pop(min(ended))
        if tag in _SELF_ENDING and stack and stack[-1].tag == tag:
            pop(len(stack) - 1)
        if tag == "p" and not marked:
            continue  # a paragraph only parts blocks
        doubt = bool(article) and not marked and tag in _CONTAINERS and _in_doubt(named)
        push(_Element(tag, marked, main, doubt))
        dropped += marked
        article += main
        doubtful += doubt
    flush()
    return out


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by name, in small letters; of a name that repeats the first counts."""
    out: dict[str, str] = {}
    if text and not text.isspace():
        for m in _ATTRIBUTE.finditer(text):
            out.setdefault(m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or ""))
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    """Whether an element isn't shown: by its own attributes, whatever others say."""
    return (
        ("hidden" in attributes and attributes["hidden"].strip().lower() != "until-found")
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or ("style" in attributes and _NO_DISPLAY.search(attributes["style"]) is not None)
    )


def _marked(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element is boilerplate by its tag, its names or because it is hidden."""
    if (tag in _DROPPED and not (in_article and tag in _KEPT_IN_ARTICLE)) or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if _hidden(attributes):
        return True
    if tag in _HEADINGS:
        return False
    names = [(kind, name) for kind, own in _named(attributes) for name in own if kind != "id" or tag in _CONTAINERS]
    if in_article:
        return any(name in _SURE[kind] or (kind == "class" and ((name in _ON_BLOCKS and tag in _BLOCKS) or _COMPOUND.fullmatch(name))) for kind, name in names)
    return any(name in _BOILERPLATE or name in _PAGE_HEADER or name in _SURE[kind] or _COMPOUND.fullmatch(name) for kind, name in names)


def _named(attributes: dict[str, str]) -> Iterator[tuple[str, list[str]]]:
    """The names of an element by attribute, in small letters."""
    for kind in _NAMING:
        if kind in attributes:
            yield kind, attributes[kind].lower().replace("_", "-").split()


def _in_doubt(attributes: dict[str, str]) -> bool:
    """Whether a container inside an article may be boilerplate: by a part of a class, or a whole id or role."""
    return any(name in _BOILERPLATE or (kind == "class" and not _BOILERPLATE.isdisjoint(name.split("-"))) for kind, names in _named(attributes) for name in names)


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffix array of integer tokens by prefix doubling."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[:-step or None] = rank[step:] if step < n else -1
        order = np.lexsort((after, rank))
        changed = np.ones(n, bool)
        changed[1:] = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(changed) - 1
        if new[order[-1]] == n - 1 if n else True:
            return order
        rank, step = new, step * 2
        if step >= 2 * n:
            return order


def _common_prefix(tokens: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix length of each suffix with the one before it in the array, up to limit."""
    length = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(limit):
        a, b = order[live - 1] + k, order[live] + k
        ok = (a < len(tokens)) & (b < len(tokens))
        live, a, b = live[ok], a[ok], b[ok]
        live = live[tokens[a] == tokens[b]]
        length[live] += 1
    return length


def runs(streams: list[np.ndarray], min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every position's run of min_run tokens as (first position of an equal run, position) and pages by run.

    Returns for the concatenated streams: the run class of each position (-1 where fewer tokens follow in its stream), a
    representative position of each class and the number of distinct streams that hold it.
    """
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    tokens = np.concatenate([np.append(s, -1 - k) for k, s in enumerate(streams)]) if streams else np.zeros(0, np.int64)
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_array(tokens)
    same = _common_prefix(tokens, order, min_run) >= min_run
    kind = np.cumsum(~same) - 1
    ends = np.cumsum([len(s) + 1 for s in streams])
    full = (ends[page] - 1 - np.arange(len(tokens))) >= min_run
    of = np.full(len(tokens), -1, np.int64)
    of[order] = kind
    of[~full] = -1
    held = np.unique(np.stack([of[full], page[full]]), axis=1) if full.any() else np.zeros((2, 0), np.int64)
    kinds, n_pages = np.unique(held[0], return_counts=True)
    where = np.full(int(kind[-1]) + 1, -1, np.int64)
    where[of[full]] = np.flatnonzero(full)
    renumber = np.full(int(kind[-1]) + 1, -1, np.int64)
    renumber[kinds] = np.arange(len(kinds))
    of[full] = renumber[of[full]]
    return of, where[kinds], n_pages


def _tokens(text: str) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=7).digest(), "little") for w in text.split()], np.int64)


def _streams(pages: list[list[str]]) -> list[np.ndarray]:
    return [np.concatenate([_tokens(b) for b in p]) if p else np.zeros(0, np.int64) for p in pages]


def _fingerprints(streams: list[np.ndarray], where: np.ndarray, min_run: int) -> np.ndarray:
    """A 64-bit fingerprint of the run at each position of the concatenated streams."""
    tokens = np.concatenate([np.append(s, 0) for s in streams]).astype(np.uint64)
    h = np.zeros(len(where), np.uint64)
    for k in range(min_run):
        h = (h ^ tokens[where + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _shard_runs(min_run: int):
    def run(table: pa.Table) -> pa.Table:
        streams = _streams(table.column("body").to_pylist())
        _, where, n_pages = runs(streams, min_run)
        prints = _fingerprints(streams, where, min_run) if len(where) else np.zeros(0, np.int64)
        n = len(prints)
        host, shard = table.column("host")[0].as_py(), table.column("shard")[0].as_py()
        return pa.table({"host": pa.array([host] * n, pa.string()), "shard": pa.array([shard] * n, pa.int64()), "fingerprint": pa.array(prints), "pages": pa.array(n_pages)})

    return run


def _without(block: str, covered: np.ndarray, min_run: int) -> str:
    """The block without its repeated runs: all of it where they cover it, else stretches of min_run tokens and more.

    A run may cross blocks (a menu's items are blocks); the few words by which it reaches into a block of its own stay.
    """
    if covered.all():
        return ""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
    words = block.split()
    for begin, end in zip(edges[::2][::-1].tolist(), edges[1::2][::-1].tolist(), strict=True):
        if end - begin >= min_run:
            del words[begin:end]
    return " ".join(words)


def _uncovered(min_run: int):
    """The text of every distinct body: the unique runs of its blocks, checked against marks: what they keep is whole, what they drop goes."""

    def run(bodies: pa.Table, repeated: pa.Table) -> pa.Table:
        known = np.sort(repeated.column("fingerprint").to_numpy()) if len(repeated) else np.zeros(0, np.int64)
        texts = []
        for body, sure in zip(bodies.column("body").to_pylist(), bodies.column("certain").to_pylist(), strict=True):
            stream = _streams([body])
            n = len(stream[0])
            hit = np.zeros(n + 1, np.int64)
            if n >= min_run and len(known):
                at = np.arange(n - min_run + 1)
                prints = _fingerprints(stream, at, min_run)
                found = known[np.minimum(np.searchsorted(known, prints), len(known) - 1)] == prints
                np.add.at(hit, at[found], 1)
                np.add.at(hit, at[found] + min_run, -1)
            cover = np.cumsum(hit)[:n] > 0
            kept, begin = [], 0
            for block, state in zip(body, sure, strict=True):
                end = begin + len(block.split())
                if state != GOES:
                    kept.append(block if state == STAYS else _without(block, cover[begin:end], min_run))
                begin = end
            texts.append("\n".join(k for k in kept if k))
        return pa.table({"host": bodies.column("host"), "digest": bodies.column("digest"), "text": pa.array(texts, pa.string())})

    return run


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's host, all its visible blocks with what marks say of them, and the digest of both; the text of pages without a host."""
    for batch in batches:
        texts, hosts, open_blocks, certain, digests = [], [], [], [], []
        for url, page in zip(batch.column(1), batch.column(2), strict=True):
            found = blocks(page.as_py() or "")
            marked = any(main for _, main in found)  # then blocks outside the article go, and only doubtful ones within are open
            host = host_of(url.as_py()) if found else ""
            states = [(OPEN if main is None or not marked else GOES) if not main else STAYS for _, main in found]
            texts.append("\n".join(text for (text, _), state in zip(found, states, strict=True) if state != GOES) if not host else None)
            hosts.append(host or None)
            open_blocks.append([text for text, _ in found] if host else None)
            certain.append(states if host else None)
            digests.append(hashlib.sha256(repr((found, states)).encode("utf-8", "surrogatepass")).digest() if host else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(hosts, pa.string()), pa.array(open_blocks, pa.list_(pa.string())), pa.array(certain, pa.list_(pa.int8())), pa.array(digests, pa.binary())],
            ["page_id", "url", "text", "host", "body", "certain", "digest"],
        )


def extract(pages: DataFrame, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, tokens_per_shard: int = TOKENS_PER_SHARD) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    parsed = write_table(slim.mapInArrow(_parse, "page_id long, url string, text string, host string, body array<string>, certain array<tinyint>, digest binary"), "pages")
    # of a host on whose pages marks leave nothing open, the array could change no text; else all of its pages go there
    asking = write_table(parsed.where(F.exists("certain", lambda s: s == OPEN)).select("host").distinct(), "open-hosts")
    by_marks = F.transform(F.filter(F.arrays_zip("body", "certain"), lambda b: b["certain"] == STAYS), lambda b: b["body"])
    sure = parsed.where("text is not null").select("page_id", "url", "text").unionByName(parsed.where("text is null").join(asking, "host", "left_anti").select("page_id", "url", F.array_join(by_marks, "\n").alias("text")))
    left = parsed.where("text is null").join(asking, "host", "left_semi")
    bodies = left.groupBy("host", "digest").agg(F.first("body").alias("body"), F.first("certain").alias("certain"))
    bodies = write_table(bodies.withColumn("tokens", F.aggregate("body", F.lit(0), lambda n, b: n + F.size(F.split(b, " ")))), "bodies")
    sizes = bodies.groupBy("host").agg(F.ceil(F.sum("tokens") / tokens_per_shard).alias("shards"))
    # dealt by host and shard anew: the join's partitioning by host would do for Spark, but not for a large host
    dealt = bodies.join(sizes, "host").withColumn("shard", F.pmod(F.xxhash64("digest"), F.col("shards"))).select("host", "shard", "digest", "body", "certain").repartition("host", "shard")
    found = dealt.groupBy("host", "shard").applyInArrow(_shard_runs(min_run), "host string, shard long, fingerprint long, pages long")
    found = write_table(found, "runs")
    repeated = found.groupBy("host", "fingerprint").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= min_pages)
    back = found.join(repeated.select("host", "fingerprint"), ["host", "fingerprint"], "left_semi").select("host", "shard", "fingerprint").repartition("host", "shard")
    texts = dealt.groupBy("host", "shard").cogroup(back.groupBy("host", "shard")).applyInArrow(_uncovered(min_run), "host string, digest binary, text string")
    rest = left.select("page_id", "url", "host", "digest").join(texts, ["host", "digest"]).select("page_id", "url", "text")
    return sure.unionByName(rest).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
