"""Main text of web pages, with boilerplate found by host suffix arrays.

A page is read into blocks of text. Markup decides for many of them: what
stands in an article or main element is the text, what stands in menus,
headers, footers, sidebars, notices, adverts, forms and comments isn't. For
the blocks that markup says nothing about, a host's pages are held against
each other: each task concatenates the token streams of a host's pages
outside their articles, sorts the suffixes and reads off the substrings of
RUN tokens with the number of distinct pages that have them. As the tasks'
pages are disjoint, these numbers add up to those of the host. A substring
that a tenth of a host's pages share is boilerplate; tokens that it covers
go, and the unique runs between them stay.

Of hosts without undecided blocks no page is shuffled. Pages with undecided
blocks meet the substrings of their own host again, all others are done in one
pass.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import WordHashes, grams, keep, release, small_batches, split_by_key, table
from ledgerloom.llm.url_filter import host_of

#: Tokens of the substrings that are looked for.
RUN = 6
#: Boilerplate stands on so many pages of its host at least, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.1
#: A page of whose undecided tokens more than this share is covered is a copy of other pages, not boilerplate.
COPY_SHARE = 0.8
#: Tokens of a host that one suffix array holds; a host with more in a task gets several.
ARRAY_TOKENS = 1 << 18

MAIN, CHROME, PLAIN, GONE = 0, 1, 2, 3
#: What begins with "<": a comment, a declaration, or a tag with its attributes; a quote counts only where a value begins.
#: Nothing is tried twice (possessive), and where a tag has no end, there is none behind it either, so reading is linear.
TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|/?([A-Za-z][^\s/>]*+)((?>[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
#: Elements that are open at once at most; text of deeper ones belongs to these.
DEPTH = 256
BLANKS = re.compile(r"[\x20\x09-\x0D\xA0]+")
#: Elements by what they mean for text.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
HIDDEN = {"head", "svg", "math", "select", "button", "object", "canvas", "audio", "video", "datalist", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CHROME_TAGS = {"nav", "footer", "aside", "form", "menu"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}
MAIN_TAGS = {"article", "main"}
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|topbar|footer|copyright|sidebar|aside|widget|related|recommended|ads?|adverts?|advertisement|advertising|banner|sponsor|sponsored|promo|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|comments?|disqus|respond|replies|discussion|pagination|pager|skip|hidden)(?:$|[\s_-])",
    re.I,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
MAIN_NAMES = re.compile(r"(?:^|\s)(?:content|main|main-content|maincontent|article|article-body|articlebody|article-content|post-content|post-body|entry-content|story|story-body|page-content)(?:$|\s)", re.I)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])comments?(?:$|[\s_-])", re.I)
#: Names of an element that is nothing but reader comments.
ONLY_COMMENTS = re.compile(r"(?:^|\s)(?:comments?|comment-list|commentlist|comments-area|disqus_thread|respond)(?:$|\s)", re.I)
HIDDEN_NAME = re.compile(r"(?:^|\s)hidden(?:$|[\s/])", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
NOTHING, P = frozenset(), frozenset({"p"})
#: An open element of these names ends where the next of its kind begins, or where a parent ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


def _kind(tag: str, attributes: str, parent: int, in_main: bool) -> int:
    """The kind of an element. An article or main element is text even in a wrapper that looks like chrome, as a form around the whole page, unless itself or a wrapper is hidden or holds comments."""
    if parent == GONE:
        return GONE
    role = name = ""
    if "=" in attributes:
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        role, name = found.get("role", "").lower(), f"{found.get('class', '')} {found.get('id', '')}".strip()
        if found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return GONE
    if HIDDEN_NAME.search(ATTRIBUTE.sub("", attributes)):
        return GONE
    own = tag not in ("html", "body") and name
    if tag in MAIN_TAGS or role == "main":
        return GONE if own and COMMENT_NAMES.search(name) else parent if parent == CHROME and in_main else MAIN
    if own and ONLY_COMMENTS.search(name):
        return GONE
    if parent == CHROME or tag in CHROME_TAGS or role in CHROME_ROLES or (own and CHROME_NAMES.search(name)):
        return CHROME
    if not in_main and (tag == "header" or (own and HEADER_NAMES.search(name))):
        return CHROME  # in an article, a header holds its title
    return MAIN if own and MAIN_NAMES.search(name) else parent


def blocks(page: str) -> list[tuple[int, str, bool]]:
    """(kind, text, whether it is a first heading) of the blocks that have text, in order."""
    out: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # element, kind, hidden, whether in a main element
    kind, hidden, in_main, heading, at, held = PLAIN, False, False, False, 0, []

    def end_block() -> None:
        nonlocal held
        if held:
            text = BLANKS.sub(" ", html.unescape("".join(held))).strip(" ")
            if text:
                out.append((kind, text, heading))
            held = []

    def pop_to(depth: int) -> None:
        nonlocal kind, hidden, in_main
        del stack[depth:]
        kind, hidden, in_main = stack[-1][1:] if stack else (PLAIN, False, False)

    while m := TOKEN.search(page, at):
        if not hidden and m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        if not m[3]:
            break  # the page ends within a tag
        tag, closing = m[1].lower(), page[m.start() + 1] == "/"
        if tag not in INLINE:
            end_block()
            heading = tag == "h1" and not closing
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if any(x[0] not in INLINE for x in stack[depth:]):
                        end_block()
                    pop_to(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break  # an inline end tag doesn't end blocks
            continue
        if tag in RAW:
            ended = RAW_END[tag].search(page, at)
            at = ended.end() if ended else len(page)
            continue
        if tag in VOID:
            continue
        if ends := CLOSES.get(tag, NOTHING) | (P if tag in ENDS_P else NOTHING):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    pop_to(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        new = _kind(tag, m[2], kind, in_main)
        if new != kind:
            end_block()
        if len(stack) < DEPTH and (not m[2].endswith("/") or tag not in ("svg", "math")):
            stack.append((tag, new, hidden or tag in HIDDEN, in_main or new == MAIN))
            kind, hidden, in_main = stack[-1][1:]
    else:
        if not hidden:
            held.append(page[at:])
    end_block()
    return out


def read_page(page: str) -> tuple[str | None, list[tuple[int, str]]]:
    """The text that markup decides on (None if it doesn't) and the blocks outside of it. Where the main elements have no first heading, that before them is theirs."""
    found = [b for b in blocks(page) if b[0] != GONE]
    if any(k == MAIN for k, *_ in found):
        first = next(i for i, b in enumerate(found) if b[0] == MAIN)
        titled = any(h for k, _, h in found if k == MAIN)
        title = [] if titled else [t for k, t, h in found[:first] if k == PLAIN and h][-1:]
        return "\n".join(title + [t for k, t, _ in found if k == MAIN]), [(k, t) for k, t, _ in found if k == CHROME]
    return (None if any(k == PLAIN for k, *_ in found) else ""), [(k, t) for k, t, _ in found]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """The positions of tokens in the order of what follows them, by doubling, up to RUN tokens: no longer order is asked for."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < RUN:
        second = np.full(len(rank), -1, np.int64)
        step = min(width, RUN - width)
        second[: len(rank) - step] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.ones(len(rank), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank[order] = np.cumsum(new) - 1
        width += step
    return order


def shared_runs(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each distinct run of RUN tokens in the pages' streams, and the number of distinct pages that have it."""
    tokens = np.concatenate(pages)
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    order = suffix_array(tokens)
    order = order[order + RUN <= len(tokens)]
    order = order[page[order] == page[order + RUN - 1]]  # runs lie within a page
    if not len(order):
        return np.array([], np.int64), np.array([], np.int64)
    run = grams(tokens, RUN)[order]
    new = np.ones(len(order), bool)  # neighbours in the suffix array that begin with the same run
    new[1:] = run[1:] != run[:-1]
    group = np.cumsum(new) - 1
    pairs = np.unique(np.stack([group, page[order]]), axis=1)[0]
    return run[new].astype(np.int64), np.bincount(pairs, minlength=group[-1] + 1)


def _streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes, held, sizes = WordHashes(), defaultdict(list), defaultdict(int)

    def flush(host: str) -> pd.DataFrame:
        runs, n = shared_runs(held.pop(host))
        sizes.pop(host)
        return pd.DataFrame({"host": [host] * len(runs), "run": runs, "n": n})

    for rows in batches:
        for host, page in zip(rows["host"], rows["html"], strict=True):
            stream = hashes.of(" ".join(t for _, t in read_page(page)[1]).encode("utf-8", "surrogatepass").split())
            if len(stream) >= RUN:
                held[host].append(stream)
                sizes[host] += len(stream)
                if sizes[host] > ARRAY_TOKENS:
                    yield flush(host)
        if sum(sizes.values()) > 8 * ARRAY_TOKENS:
            for host in list(held):
                yield flush(host)
    for host in list(held):
        yield flush(host)


def _covered(tokens: np.ndarray, runs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(tokens), bool)
    if len(tokens) >= RUN and len(runs):
        for i in np.flatnonzero(np.isin(grams(tokens, RUN).astype(np.int64), runs)):
            out[i : i + RUN] = True
    return out


def _without_runs(page: str, runs, hashes: WordHashes) -> str:
    """The page's undecided blocks without the covered tokens; markup's boilerplate is part of the stream and goes in any case."""
    found = read_page(page)[1]
    words = [t.split(" ") for _, t in found]
    flat = [w.encode("utf-8", "surrogatepass") for block in words for w in block]
    covered = _covered(hashes.of(flat), np.asarray(runs, np.int64))
    plain = np.repeat([k == PLAIN for k, _ in found], [len(w) for w in words])
    if covered[plain].mean() > COPY_SHARE:
        covered[:] = False
    out, at = [], 0
    for (kind, _), block in zip(found, words, strict=True):
        if kind == PLAIN:
            out.append(" ".join(w for w, c in zip(block, covered[at : at + len(block)], strict=True) if not c))
        at += len(block)
    return "\n".join(t for t in out if t)


def _page_key() -> Column:
    return F.xxhash64("page_id", "url", "html")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages.

    Null and empty html have an empty text. Pages without a host are held
    against each other. Rows are read on their own: repeated rows and null
    ids come out as they went in, and count as one page where a host's pages
    are counted. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = [read_page(x)[0] for x in part]
            yield pd.DataFrame({"text": texts, "left": [x if t is None else None for t, x in zip(texts, part, strict=True)]}, dtype=object)
        release()

    read = F.pandas_udf(decide, "text string, left string")("html")
    decided = keep(rows.withColumn("r", read).select("page_id", "url", "host", "r.text", F.col("r.left").alias("html")))  # pages are read once; html is kept where it is needed again
    done = decided.where("text is not null").select("page_id", "url", "text")
    open_ = decided.where("text is null").select("page_id", "url", "host", "html")

    hosts = keep(open_.select(F.xxhash64("host").alias("key"), "host").distinct())
    streams = split_by_key(rows.withColumn("key", F.xxhash64("host")), hosts)[1].join(hosts.select("host"), "host", "left_semi").dropDuplicates(["host", "html"])
    n_pages = keep(streams.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")))
    runs = streams.select("host", "html").mapInPandas(_streams, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("n"))
    boilerplate = keep(runs.join(n_pages, "host").where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= LEAST_SHARE * F.col("n_pages"))).select("host", "run"))

    def runs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in batches:
            for key, host, page in zip(part["key"], part["host"], part["html"], strict=True):
                stream = hashes.of(" ".join(t for _, t in read_page(page)[1]).encode("utf-8", "surrogatepass").split())
                if len(stream) >= RUN:
                    found = np.unique(grams(stream, RUN).astype(np.int64))
                    yield pd.DataFrame({"key": key, "host": [host] * len(found), "run": found})

    keyed = open_.withColumn("host", F.coalesce("host", F.lit(""))).select(F.xxhash64("page_id", "url", "html").alias("key"), "*")
    hits = keyed.select("key", "host", "html").dropDuplicates(["key"]).mapInPandas(runs_of, "key long, host string, run long").join(boilerplate, ["host", "run"], "left_semi")
    hits = hits.groupBy("key").agg(F.collect_list("run").alias("runs"))

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts, found in batches:
            yield pd.Series([_without_runs(t, [] if r is None else r, hashes) for t, r in zip(texts, found, strict=True)], dtype=object)

    rest = keyed.join(hits, "key", "left").select("page_id", "url", F.pandas_udf(cut, "string")("html", "runs").alias("text"))
    return done.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
