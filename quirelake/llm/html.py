"""Main-text extraction: markup names chrome and articles, a host suffix array judges the blocks of every page.

A page's blocks fall into three kinds. Chrome (menus, footers, adverts, forms, comments ...) goes. Text inside the page's
article is its main text. What lies in neither is open: the main text of a page without an article element, with
boilerplate that its markup doesn't name; on other pages it goes like chrome.

The token streams of a host's pages are concatenated and their suffixes sorted; neighbours in that order that share a long
prefix, on several distinct pages, are boilerplate. Markup has a vote on how that is used: open blocks are held against
the whole text of the host's pages, chrome included, and lose the tokens that are covered; blocks of an article are held
against the main texts alone, since menus and lists of links repeat the headlines of articles, and go only if they are
covered whole, since passages inside a paragraph are quoted, and only if most of the article stays, since a page whose
blocks other pages have is a version of theirs."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import common

#: A repeated substring has at least this many tokens, on at least so many distinct pages of the host.
MIN_RUN, MIN_PAGES = 6, 3
#: Bytes of html whose suffixes are sorted together; the pages of a larger host are dealt into several such groups.
GROUP_BYTES = 4 * 1024 * 1024

# HTML element names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SILENT = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "audio", "video", "select", "option", "textarea", "datalist", "map"}
CHROME = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "label", "fieldset", "input"}
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adsense|sponsor\w*|promo\w*|banner\w*|sidebars?|menus?|nav\w*|breadcrumbs?|footer\w*|masthead|topbar|comments?|commentlist|disqus|respond|replies|reply|cookies?|consent|gdpr|notices?|popups?|newsletter|subscribe|signup|login|social\w*|recommend\w*|pager|pagination)(?:$|[\s_-])", re.I)
#: Names of chrome outside articles; inside, they may name parts of the text.
OUTER = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header|side|share\w*|related|widgets?|alerts?|modal|overlay|skip|toolbar|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
#: An opening tag of these closes an open paragraph (HTML's implied end tags).
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}

SPACE = re.compile(r"\s+")
#: Kinds of blocks; what is mute is no text of the page.
MUTE, GONE, OPEN, KEPT = -1, 0, 1, 2


class Blocks(HTMLParser):
    """Blocks of a page in page order, as (kind, text)."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[int, str]] = []
        self.stack: list[tuple[str, int]] = []
        self.text: list[str] = []
        self.kind = OPEN
        self.open: dict[str, int] = {}

    def flush(self) -> None:
        if self.text:
            t = SPACE.sub(" ", "".join(self.text)).strip()
            if t:
                self.out.append((self.kind, t))
            self.text = []

    def kind_of(self, tag: str, attrs: list) -> int:
        """Of a new element, from its parent's."""
        if self.kind == MUTE or tag in SILENT:
            return MUTE
        if self.kind == GONE or tag in CHROME:
            return GONE
        a = {k: v or "" for k, v in attrs}
        if tag not in ("html", "body", "article", "main"):
            named = f"{a.get('class', '')} {a.get('id', '')}"
            if NAMES.search(named) or a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
                return GONE
            if self.kind == OPEN and (tag == "header" or OUTER.search(named)):
                return GONE
        if tag in ("article", "main") or a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody":
            return KEPT
        return self.kind

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag in ENDS_P or tag == "li":
            self._imply(tag)
        kind = self.kind_of(tag, attrs)
        if kind != self.kind:
            self.flush()
        self.stack.append((tag, self.kind))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.kind = kind

    def _imply(self, tag: str) -> None:
        """Close what an opening tag ends without an end tag: a paragraph, or the list item before."""
        ends, walls = ({"li"}, {"ul", "ol", "menu"}) if tag == "li" else ({"p"}, {"article", "main", "section", "div", "td", "th", "body", "html", "li", "aside", "nav", "footer", "header", "form", "button", "blockquote", "table"})
        if not any(self.open.get(x) for x in ends):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in ends:
                self._close(i)
                return
            if name in walls:
                return

    def _close(self, i: int) -> None:
        """Close the element at i of the stack and all that are open inside it."""
        if self.stack[i][0] not in INLINE or self.kind != self.stack[i][1]:
            self.flush()
        self.kind = self.stack[i][1]
        for name, _ in self.stack[i:]:
            self.open[name] -= 1
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in VOID or not self.open.get(tag):  # an end without a beginning isn't looked for
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._close(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.kind != MUTE:
            self.text.append(data)

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def unknown_decl(self, data: str) -> None:
        pass


def all_blocks(page: str | None) -> list[tuple[int, str]]:
    """Blocks of a page in page order, its chrome among them."""
    if not page:
        return []
    parser = Blocks()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.out


def main_kind(blocks: list[tuple[int, str]]) -> int:
    """The kind that may be a page's main text. On a page with an article, open blocks are chrome too."""
    return KEPT if any(k == KEPT for k, _ in blocks) else OPEN


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """Blocks of a page that may be its main text."""
    out = all_blocks(page)
    return [(k, t) for k, t in out if k == main_kind(out)]


def host_of(url):
    """The host of a url column, lower-cased, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def suffix_ranks(stream: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of the suffixes of a stream of numbers by their first 1, 2, 4 ... tokens, up to depth or more, by doubling."""
    ranks, h = [np.unique(stream, return_inverse=True)[1]], 1
    while h < depth:
        r = ranks[-1]
        after = np.zeros(len(r), np.int64)
        after[:-h] = r[h:] + 1
        ranks.append(np.unique(r * (len(r) + 1) + after, return_inverse=True)[1])
        h *= 2
    return ranks


def repeated_places(streams: list[np.ndarray], run: int, min_pages: int) -> list[np.ndarray]:
    """For each page's stream of token numbers the places where a substring of run tokens begins that min_pages pages have.

    The streams are concatenated, each closed by a number of its own, so no repeat goes beyond a page. Suffixes are sorted
    by their first run tokens or more; neighbours whose common prefix (read off the ranks) has run tokens make a group.
    What is covered by longer repeats is covered by their substrings of run tokens."""
    lengths = np.array([len(s) for s in streams])
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = -1 - np.arange(len(streams))
    text = np.concatenate([x for s, e in zip(streams, ends, strict=True) for x in (s, [e])]).astype(np.int64)
    ranks = suffix_ranks(text, run)
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.maximum(a, b) < len(text)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        step = np.where(same, 1 << level, 0)
        a, b, lcp = a + step, b + step, lcp + step
    group = np.concatenate([[0], np.cumsum(lcp < run)])
    page = np.searchsorted(starts, order, side="right") - 1
    distinct = np.unique(group * len(streams) + page) // len(streams)
    often = np.sort(order[np.bincount(distinct)[group] >= min_pages])
    cut = np.searchsorted(often, np.append(starts, len(text)))
    return [often[i:j] - at for i, j, at in zip(cut, cut[1:], starts, strict=False)]


def uncovered(blocks: list[str], hits: np.ndarray, run: int, own: list[bool] | None = None, article: bool = False) -> list[str]:
    """Blocks without the tokens covered by repeated substrings, which begin at hits. A substring may run over several
    short blocks, such as the items of a menu, and takes those that it covers whole; of other blocks only what repeats
    within the block goes. own: which of the blocks are asked for; the others are only read along. article: blocks go whole
    or not at all, and none goes if that would be half of all tokens."""
    tokens = [t.split(" ") for t in blocks]
    ends = np.cumsum([len(t) for t in tokens])

    def cover(at: np.ndarray) -> np.ndarray:
        edge = np.zeros(ends[-1] + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + run, -1)
        return np.cumsum(edge[:-1]) > 0

    every = cover(hits)
    whole = [bool(every[end - len(t) : end].all()) for t, end in zip(tokens, ends.tolist(), strict=True)]
    if article and 2 * sum(len(t) for t, w in zip(tokens, whole, strict=True) if w) >= ends[-1]:
        return blocks
    inner = cover(hits[np.searchsorted(ends, hits, side="right") == np.searchsorted(ends, hits + run - 1, side="right")])
    out = []
    for t, end, gone, asked in zip(tokens, ends.tolist(), whole, own or [True] * len(blocks), strict=True):
        if asked and not gone:
            out.append(" ".join(w for w, g in zip(t, inner[end - len(t) : end], strict=True) if article or not g))
    return [t for t in out if t]


def cleaned(blocks: list[str], own: list[bool], kept: bool, hits: np.ndarray, run: int) -> list[str]:
    """The main text of a page as blocks; hits: the places in its stream where repeated substrings begin."""
    asked = [t for t, o in zip(blocks, own, strict=True) if o]
    if not asked or not len(hits):
        return asked
    return (uncovered(asked, hits, run, None, True) if kept else uncovered(blocks, hits, run, own)) or asked


def judged(blocks: list[list[str]], own: list[list[bool]], kept: list[bool], run: int, min_pages: int) -> list[list[str]]:
    """The main text of each page of one host, as blocks."""
    ids: dict[str, int] = {}
    number = lambda texts: np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t.split(" ")), dtype=np.int64)
    asked = [[t for t, o in zip(b, mine, strict=True) if o] for b, mine in zip(blocks, own, strict=True)]
    out = list(asked)
    # articles are held against the main texts, open pages against all that the pages have
    for article in (True, False):
        mine = [i for i, k in enumerate(kept) if k == article and asked[i]]
        if not mine:
            continue
        pool = [i for i, t in enumerate(asked if article else blocks) if t]
        pages = max(min_pages, len(pool) // 2 + 1) if article else min_pages
        found = dict(zip(pool, repeated_places([number(asked[i] if article else blocks[i]) for i in pool], run, pages), strict=True))
        for i in mine:
            out[i] = cleaned(blocks[i], own[i], article, found[i], run)
    return out


def run_hashes(texts: list[str], run: int) -> np.ndarray:
    """Hashes of the substrings of run tokens of a page's stream, by place."""
    words = [w.encode() for t in texts for w in t.split(" ")]
    return common.shingle_hashes(common.hash_words(words), run).view(np.int64) if len(words) >= run else np.zeros(0, np.int64)


def candidates(asked: list[list[str]], run: int) -> np.ndarray:
    """Hashes of the substrings that most of a group's main texts have. What most texts of a host have, most texts of one of
    its groups have, so no other substring needs to be counted over the host."""
    ids: dict[str, int] = {}
    asked = [t for t in asked if t]
    if not asked:
        return np.zeros(0, np.int64)
    streams = [np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t.split(" ")), dtype=np.int64) for texts in asked]
    places = [at[at <= len(s) - run] for at, s in zip(repeated_places(streams, run, len(asked) // 2 + 1), streams, strict=True)]
    return np.unique(np.concatenate([run_hashes(t, run)[at] for t, at in zip(asked, places, strict=True) if len(at)] or [np.zeros(0, np.int64)]))


def packed(blocks: list[str]) -> bytes:
    """Blocks hold no line ends, so they are lines of one text."""
    return zlib.compress("\n".join(blocks).encode(), 1)


def unpacked(data: bytes) -> list[str]:
    text = zlib.decompress(data).decode()
    return text.split("\n") if text else []


def extract(pages: DataFrame, run: int = MIN_RUN, min_pages: int = MIN_PAGES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_removed_tokens of every page.

    Character references are decoded, white space inside a block is one space, blocks are joined in page order by one
    space. A page without text (null, empty or chrome alone) has the empty text. A null or odd url belongs to the host "".
    A host of more than group_bytes of html has its pages dealt by hash into groups of about that size, whatever files they
    stand in, so that no host is in one task; what a group can't decide by itself is counted over the host, so results
    don't depend on the groups. A substring must be on min_pages pages of the host, in an article on most of
    them too; a longer page has its group's size exceeded by its own. Repeated rows count as pages of their own;
    ties of suffixes don't matter, as places are counted. Other columns are ignored; an empty table gives no rows. Where
    all of a page's main text is repeated it is kept as it is: a host of equal pages has no boilerplate to tell from its
    article."""
    kind = dict(pages.dtypes)["page_id"]
    sized = pages.select(F.col("page_id").cast("string"), "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("turn"))
    hosts = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("html")) / group_bytes)).cast("long").alias("parts"))
    hosts = common.materialize(hosts.where("parts > 1"), "html-hosts", narrow=True)
    dealt = sized.join(common.small_or_not(hosts, 256), "host", "left").withColumn("part", F.pmod("turn", F.coalesce("parts", F.lit(1))))
    result = "page_id string, url string, text string, n_chars long, n_blocks long, n_removed_tokens long"

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for pdf in it:
            found = [all_blocks(h if isinstance(h, str) else None) for h in pdf["html"]]
            main = [main_kind(b) for b in found]
            own = [bytes(k == m for k, _ in b) for b, m in zip(found, main, strict=True)]
            yield pd.DataFrame({"host": pdf["host"], "part": pdf["part"], "page_id": pdf["page_id"], "url": pdf["url"], "kept": [m == KEPT for m in main], "blocks": [packed([t for _, t in b]) for b in found], "own": own})

    def rows(pdf: pd.DataFrame, blocks: list[list[str]], left: list[list[str]]) -> pd.DataFrame:
        words = lambda texts: sum(t.count(" ") + 1 for t in texts)
        gone = [words(t for t, o in zip(b, mine, strict=True) if o) - words(x) for b, mine, x in zip(blocks, pdf["own"], left, strict=True)]
        texts = [" ".join(x) for x in left]
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(x) for x in left], "n_removed_tokens": gone})

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        common.lean()
        blocks = [unpacked(b) for b in pdf["blocks"]]
        return rows(pdf, blocks, judged(blocks, [list(o) for o in pdf["own"]], pdf["kept"].tolist(), run, min_pages))

    def grouped(part: DataFrame):
        parsed = part.select("host", "part", "page_id", "url", "html").mapInPandas(parse, "host string, part long, page_id string, url string, kept boolean, blocks binary, own binary")
        return parsed.groupBy("host", "part")

    out = grouped(dealt.where("parts is null")).applyInPandas(judge, result)
    if hosts.isEmpty():
        return out.withColumn("page_id", F.col("page_id").cast(kind))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        common.lean()
        asked = [[t for t, o in zip(unpacked(b), own, strict=True) if o] for b, own in zip(pdf["blocks"], pdf["own"], strict=True)]
        often = candidates(asked, run)
        return pdf.assign(asked=[bool(t) for t in asked], nr=range(len(pdf)), candidates=[often if i == 0 else None for i in range(len(pdf))])

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Distinct substrings of each page, of its main text or of all that it has."""
        common.lean()
        for pdf in it:
            texts = [[t for t, o in zip(unpacked(b), own, strict=True) if o or every] for b, own, every in zip(pdf["blocks"], pdf["own"], pdf["every"], strict=True)]
            yield pd.DataFrame({"host": pdf["host"], "part": pdf["part"], "nr": pdf["nr"], "run": [np.unique(run_hashes(t, run)) for t in texts]})

    def clean(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.lean()
        for pdf in it:
            blocks, left = [unpacked(b) for b in pdf["blocks"]], []
            for b, own, kept, often in zip(blocks, pdf["own"], pdf["kept"], pdf["often"], strict=True):
                own, hits = list(own), np.zeros(0, np.int64)
                if often is not None and len(often):
                    hits = np.flatnonzero(np.isin(run_hashes([t for t, o in zip(b, own, strict=True) if o or not kept], run), np.asarray(often, np.int64)))
                left.append(cleaned(b, own, kept, hits, run))
            yield rows(pdf, blocks, left)

    def met(df: DataFrame, table: DataFrame, size: DataFrame, how: str = "left") -> DataFrame:
        """df with a table of one row per host: broadcast if the rows it was made from are few, else met by groups, as a host
        is too much for one task."""
        limit = common.BROADCAST_BYTES // 64
        if size.limit(limit + 1).count() <= limit:
            return df.join(F.broadcast(table), "host", how)
        return df.join(table.join(hosts, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), ["host", "part"], how)

    def runs_of(df: DataFrame, every: bool) -> DataFrame:
        found = df.select("host", "part", "nr", "blocks", "own", F.lit(every).alias("every")).mapInPandas(counted, "host string, part long, nr long, run array<long>")
        return found.withColumn("run", F.explode("run"))

    far = grouped(dealt.where("parts is not null")).applyInPandas(local, "host string, part long, page_id string, url string, kept boolean, blocks binary, own binary, asked boolean, nr long, candidates array<long>")
    far = common.materialize(far, "html-pages")
    nothing = F.lit(None).cast("array<long>").alias("often")

    # articles lose what most main texts of the host have: candidates are counted over its pages
    articles = far.where("kept or not asked")
    asked_for = common.materialize(far.select("host", F.explode("candidates").alias("run")).distinct(), "html-candidates", narrow=True)
    if asked_for.isEmpty():
        articles = articles.select("*", nothing)
    else:
        main = far.where("asked")
        named = asked_for.select("host").distinct()
        runs = runs_of(met(main, named, named, "left_semi"), False).join(common.small_or_not(asked_for, 64), ["host", "run"], "left_semi").groupBy("host", "run").count()
        sizes = main.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        often = runs.join(common.small_or_not(sizes, 256), "host").where(F.col("count") >= F.greatest(F.lit(min_pages), F.floor(F.col("n") / 2) + 1)).select("host", "run")
        often = common.materialize(often, "html-often", narrow=True)
        articles = met(articles, often.groupBy("host").agg(F.collect_list("run").alias("often")), often)

    # open pages lose what min_pages pages of the host have
    opened = far.where("asked and not kept")
    named = common.materialize(opened.select("host").distinct(), "html-open-hosts", narrow=True)
    if named.isEmpty():
        opened = opened.select("*", nothing)
    else:
        runs = runs_of(met(far, named, named, "left_semi"), True).groupBy("host", "run").count().where(F.col("count") >= min_pages).select("host", "run")
        runs = common.materialize(runs, "html-open-runs")
        hits = runs_of(opened, True).join(common.small_or_not(runs, 64), ["host", "run"]).groupBy("host", "part", "nr").agg(F.collect_list("run").alias("often"))
        opened = opened.join(hits, ["host", "part", "nr"], "left")

    for pages_left in (articles, opened):
        out = out.unionByName(pages_left.select("page_id", "url", "kept", "blocks", "own", "often").mapInPandas(clean, result))
    return out.withColumn("page_id", F.col("page_id").cast(kind))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return extract(common.table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLES: dict[str, str] = {}
