"""Main text of web pages: page structure, and a suffix array over the pages of each host.

Every page is parsed into blocks. Parts that the page itself marks as something else are left
out (menus, headers, footers, sidebars, adverts, notices, forms, comments, scripts, styles). What
stands in the page's article (``article``, ``main``) is main text. All other blocks are loose:
their words, page after page, make one token stream per host, and a suffix array finds runs of
``least_tokens`` or more that repeat on distinct pages. Covered blocks are boilerplate and go;
blocks with a word of their own stay whole, in page order, so a phrase that sentences share is
never cut out of them. Article blocks are kept whole, as articles share passages.

A run repeats if ``least_pages`` pages and ``least_share`` of the host's pages hold it. Pages of one
host whose loose text is the same count as one page, so copies are no evidence against each
other; the url's host tells hosts apart, and pages without one (null or relative urls) are
evidence for nobody.

A host of any size is cut into chunks of pages of bounded length, one suffix array each. An
array's prefix intervals (suffixes with the same first ``least_tokens`` tokens) leave the chunk
as one row per page; rows of one prefix meet by (host, prefix) and are counted. So the result
doesn't depend on the cut.

Defined results: a null or empty html has no text; broken markup is read as far as it goes, in time
linear in its length; repeated rows of one page_id count as one page; a null page_id stays null
and ids of any width stay exact; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import repetition
from tillroll.llm.common import ship_by_value, small_batches, stash, table, texts_of
from tillroll.llm.url_trust import host_and_path

LEAST_TOKENS = 5
#: Distinct pages of a host, and their share of all its distinct pages, that a boilerplate run has.
LEAST_PAGES = 3
LEAST_SHARE = 0.01
#: Loose tokens in one suffix array, about.
CHUNK_TOKENS = 500_000

# What elements and names mean.
DROPPED = frozenset(
    "nav header footer aside form script style noscript template iframe object svg canvas button select "
    "textarea input label menu dialog head title audio video datalist".split()
)
ARTICLE = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements whose class and id say what they hold; those of body, headings or text don't.
CONTAINER = frozenset("article div section ul ol li dl table tr td fieldset details".split())
_NAME = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|side-?bar|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|"
    r"header|masthead|footer|comments?|disqus|replies|share|sharing|social|related|recommended|toolbar|widget"
)
#: Words that leave the name beside them its meaning.
_BESIDE = (
    r"left|right|top|bottom|site|main|global|primary|secondary|area|bar|box|block|slot|unit|list|links|buttons|"
    r"icons|posts|articles|stories|items|thread"
)
#: A whole class token or id, made of such names and the words beside them.
DROPPED_NAME = re.compile(rf"(?i)(?:(?:{_BESIDE})[-_]+)*(?:{_NAME})(?:[-_]+(?:{_NAME}|{_BESIDE}))*\Z")
COMMENTS_NAME = re.compile(r"(?i)(?:comments?|disqus|replies)(?:[-_]+(?:area|list|thread))*\Z")
#: Parts that an article within them doesn't end: comments, teasers of other articles.
SIDE = frozenset(["aside", "nav", "footer"])
SIDE_NAME = re.compile(r"(?i)(?:comments?|disqus|replies|related|recommended|side-?bar)(?:[-_]|\Z)|(?:left|right)[-_]+side-?bar\Z")
DROPPED_ROLE = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split()
)
BLANK = re.compile(r"[\x20\x09-\x0D]+")
#: A tag that the end of the page cuts off.
CUT_TAG = re.compile(r"<[/!?A-Za-z][^<>]*\Z")

BLOCKS = "page_id long, url string, host string, blocks array<struct<text: string, loose: boolean>>"
PREFIXES = "host string, prefix string, content string, places array<int>"
RESULT = "page_id long, url string, text string, n_chars long"


class BlockParser(HTMLParser):
    """Collects (text, loose) blocks of what is not marked as something else."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, dropped from here, in an article, in a side part
        self.counts: Counter = Counter()  # open elements by tag
        self.blocks: list[tuple[str, bool]] = []
        self.data: list[str] = []

    def flush(self) -> None:
        text = BLANK.sub(" ", "".join(self.data)).strip(" ")
        self.data.clear()
        if text:
            self.blocks.append((text, not (self.open and self.open[-1][2])))

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "aria-hidden", "hidden")}
        _, dropped, inside, side = self.open[-1] if self.open else ("", False, False, False)
        names = []
        if tag in CONTAINER:
            is_dropped = COMMENTS_NAME if tag == "article" else DROPPED_NAME
            names = [n for n in BLANK.split(named.get("class", "")) if is_dropped.match(n)]
            # in an article an id is an anchor, unless it is that of the comments
            if (COMMENTS_NAME if inside else is_dropped).match(named.get("id", "")):
                names.append(named["id"])
        marked = (
            tag in DROPPED
            or "hidden" in named
            or named.get("aria-hidden") == "true"
            or named.get("role", "").lower() in DROPPED_ROLE
            or bool(names)
        )
        main = tag in ARTICLE or named.get("role", "").lower() in ("main", "article")
        if main and not (marked or inside or side):
            self.open.clear()  # what was left open before the article doesn't hold it
            self.counts.clear()
            dropped = False
        side = side or tag in SIDE or any(SIDE_NAME.match(n) for n in names)
        self.open.append((tag, dropped or marked, inside or main, side))
        self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if self.counts[tag]:  # a stray end tag closes nothing
            while self.open:
                closed = self.open.pop()[0]
                self.counts[closed] -= 1
                if closed == tag:
                    break

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.data.append(data)

    def close(self):
        super().close()
        self.flush()


def page_blocks(html: str) -> list[tuple[str, bool]]:
    parser = BlockParser()
    parser.feed(CUT_TAG.sub("", html))
    parser.close()
    return parser.blocks


def _parse_batches(batches):
    """mapInArrow from (page_id, url, host, html) to BLOCKS."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("text", pa.string()), ("loose", pa.bool_())]))
    for batch in batches:
        html = texts_of(batch.column(3).to_pylist())
        blocks = [[{"text": t, "loose": loose} for t, loose in page_blocks(h)] for h in html]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(blocks, type=kind)], names=["page_id", "url", "host", "blocks"]
        )


def stream(texts: list[str]) -> list[str]:
    """A page's loose tokens; a line feed stands on either side of every block."""
    tokens = []
    for text in texts:
        tokens += ["\n", *text.split(" ")]
    return [*tokens, "\n"] if tokens else []


def prefix_intervals(pages: list[tuple[str, list[str]]], least: int) -> list[tuple[str, str, list[int]]]:
    """(prefix, page, places) for the suffixes of at least ``least`` tokens, one entry per page and
    prefix; places count from the page's first token."""
    numbers: dict[str, int] = {}
    words = np.array([numbers.setdefault(t, len(numbers)) for _, ts in pages for t in ts], dtype=np.int64)
    if len(words) == 0:
        return []
    sizes = np.array([len(ts) for _, ts in pages], dtype=np.int64)
    stops = np.cumsum(sizes)
    ends = np.repeat(stops, sizes)
    page = np.repeat(np.arange(len(pages)), sizes)
    order, _, prefix = repetition.neighbour_prefixes(words, ends, np.zeros(len(words), dtype=np.int64))
    long_enough = ends[order] - order >= least
    order = order[long_enough]
    # suffixes that are too short to count stand before all longer ones of their prefix
    starts = prefix[order] < least
    if len(starts):
        starts[0] = True
    found = []
    for members in np.split(order, np.flatnonzero(starts)[1:]) if len(order) else []:
        i = int(members[0])
        row = int(page[i])
        place = i - int(stops[row] - sizes[row])
        key = hashlib.md5("\x00".join(pages[row][1][place : place + least]).encode("utf-8", "surrogatepass")).hexdigest()
        places: dict[int, list[int]] = {}
        for p, at in zip(page[members].tolist(), members.tolist()):
            places.setdefault(p, []).append(at - int(stops[p] - sizes[p]))
        found += [(key, pages[p][0], at) for p, at in places.items()]
    return found


def chunk_intervals(least: int):
    """An applyInPandas function over the pages of one chunk of a host."""

    def intervals(chunk):
        import pandas as pd

        host = chunk["host"].iloc[0]
        pages = [(p, list(s)) for p, s in zip(chunk["content"], chunk["stream"])]
        return pd.DataFrame(
            [(host, *row) for row in prefix_intervals(pages, least)], columns=["host", "prefix", "content", "places"]
        )

    return intervals


def keep_unique(texts: list[str], places: list[int], least: int) -> list[str]:
    """The loose texts; empty in place of those whose every word the marked places cover."""
    gone = set()
    for place in places:
        gone.update(range(place, place + least))
    kept, at = [], 0
    for text in texts:
        n = text.count(" ") + 1
        kept.append("" if gone and all(i in gone for i in range(at + 1, at + 1 + n)) else text)
        at += n + 1
    return kept


def assemble(least: int):
    """A mapInArrow function: page text from (page_id, url, blocks, covered places)."""

    def assembled(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for blocks, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                loose = iter(keep_unique([b["text"] for b in blocks if b["loose"]], places or [], least))
                whole = [next(loose) if b["loose"] else b["text"] for b in blocks]
                texts.append("\n\n".join(t for t in whole if t))
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"]
            )

    return assembled


def main_text(
    pages: DataFrame,
    *,
    least_tokens: int = LEAST_TOKENS,
    least_pages: int = LEAST_PAGES,
    least_share: float = LEAST_SHARE,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    ship_by_value(__name__)
    ship_by_value(repetition.__name__)
    small_batches(spark)
    host, _ = host_and_path(F.col("url"))
    given = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), "html")
    parsed = stash(given.mapInArrow(_parse_batches, BLOCKS), "page-blocks")

    loose = F.transform(F.filter("blocks", lambda b: b["loose"]), lambda b: b["text"])
    content = F.sha2(F.array_join(loose, "\n").cast("binary"), 256)
    told = parsed.withColumn("content", F.when((F.size(loose) > 0) & (F.col("host") != ""), content))
    tokens = F.flatten(F.transform(loose, lambda t: F.concat(F.array(F.lit("\n")), F.split(t, " "))))
    # one page stands for all of its host that have the same loose text
    streams = (
        told.filter("content is not null")
        .select("host", "content", F.concat(tokens, F.array(F.lit("\n"))).alias("stream"))
        .dropDuplicates(["host", "content"])
    )
    hosts = streams.groupBy("host").agg(
        F.ceil(F.sum(F.size("stream")) / F.lit(chunk_tokens)).cast("int").alias("chunks"),
        F.greatest(F.lit(least_pages), F.ceil(F.count("*") * F.lit(least_share))).alias("needed"),
    )
    intervals = stash(
        streams.join(hosts, "host")
        .withColumn("chunk", F.pmod(F.xxhash64("content"), F.col("chunks").cast("long")))
        .groupBy("host", "chunk")
        .applyInPandas(chunk_intervals(least_tokens), PREFIXES),
        "page-prefixes",
    )
    repeated = (
        intervals.groupBy("host", "prefix")
        .agg(F.count("*").alias("on_pages"))
        .join(hosts, "host")
        .filter("on_pages >= needed")
        .select("host", "prefix")
    )
    places = (
        intervals.join(repeated, ["host", "prefix"], "left_semi")
        .groupBy("host", "content")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
        .select(F.col("host").alias("on_host"), F.col("content").alias("on_content"), "places")
    )
    same = (F.col("host") == F.col("on_host")) & (F.col("content") == F.col("on_content"))
    return (
        told.join(places, same, "left")
        .select("page_id", "url", "blocks", "places")
        .mapInArrow(assemble(least_tokens), RESULT)
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html": op5_html}
ORACLES: dict[str, str] = {}
