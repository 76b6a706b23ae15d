"""Main text of web pages: blocks of the article, without what a suffix array over each host's pages finds repeated."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid.llm.common import Prefixes, mixed, sent_by_value, stored
from pricegrid.llm.repeats import sliding_minimum

sent_by_value(__name__)

#: Words that a repeated substring has at least, and distinct pages of its host that it is on to be boilerplate.
RUN_WORDS, RUN_PAGES = 8, 4

#: Share of its host's pages that a repeated substring is on to be boilerplate inside an article or a main element.
RUN_SHARE = 0.5

# Elements whose text is never part of the article.
DROPPED = frozenset(
    "head nav header footer aside form script style noscript template iframe svg math canvas object audio video map "
    "select option textarea button dialog menu".split()
)
# Those whose content is text up to their end tag, whatever it looks like.
RAW = frozenset("script style textarea title noscript iframe template".split())
# Words in a class, id or role that mark boilerplate, and words that make such a name one of layout.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar widget footer header masthead toolbar share sharing social related recommended "
    "comment comments disqus respond replies reply pagination pager complementary contentinfo search alert dialog".split()
)
LAYOUT = frozenset("has no with without wrap wrapper container layout page content main body article".split())

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody tfoot thead title tr ul".split()
)
SPACED = frozenset("br td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that another one of the kind ends.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
HOST = re.compile(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def marked(attributes: str) -> bool:
    """Whether an element's class, id or role marks it as boilerplate, or it is hidden."""
    if not attributes.strip():
        return False
    for match in NAMES.finditer(attributes):
        for name in (match[1] or match[2] or match[3] or "").split():
            parts = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
            if MARKS.intersection(parts) and not LAYOUT.intersection(parts):
                return True
    return HIDDEN.search(attributes) is not None


def main_blocks(found: list[tuple[str, int, bool]]) -> tuple[list[str], bool]:
    """Which blocks are the main text, of (text, number of its outermost article or 0, whether in a main element).

    Running text decides, in words: where a main element has more outside articles than the longest article has, the
    articles are teasers, and the main element is the text; without its articles, unless these hold the most of it.
    Else the articles are the text. A page with neither has all its blocks, which settles nothing.
    """
    articles: Counter[int] = Counter()
    own = inside = 0
    for text, article, main in found:
        n = text.count(" ") + 1
        if article:
            articles[article] += n
            inside += n * main
        else:
            own += n * main
    if own > max(articles.values(), default=0):
        return [text for text, article, main in found if main and (not article or inside > own)], True
    return [text for text, article, _ in found if article or not articles], bool(articles)


def blocks_of(page: str) -> tuple[list[str], bool]:
    """The blocks of a page's article, or of its main element; else of all that is not boilerplate by its markup.

    Also whether the page has an article or a main element, which settles that its blocks are the main text. Tags may
    be unclosed, misplaced or cut off. References are decoded, and white space inside a block is one space.
    """
    found: list[tuple[str, int, bool]] = []
    articles = 0
    stack: list[tuple[str, bool]] = []  # open elements that matter, and whether they are dropped
    depth = {"article": 0, "main": 0}
    dropped, parts, at = 0, [], 0

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append((text, articles if depth["article"] else 0, depth["main"] > 0))

    def pop() -> None:
        nonlocal dropped
        name, drop = stack.pop()
        dropped -= drop
        if name in depth and not drop:
            depth[name] -= 1

    while True:
        match = TAG.search(page, at)
        if not dropped:
            text = page[at : match.start() if match else len(page)]
            if text:
                parts.append(text)
        if not match:
            break
        at = match.end()
        closing, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            end_block()
            while not closing and stack and stack[-1][0] == "p":
                pop()
        elif name in SPACED and not dropped:
            parts.append(" ")
        if closing:
            if any(x[0] == name for x in stack):
                end_block()
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        ends = ENDS.get(name)
        if ends and stack and stack[-1][0] in ends:
            pop()
        if name in RAW:
            end_block()
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else len(page)
            stack.append((name, True))
            dropped += 1
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        drop = name in DROPPED or (name not in ("html", "body", "main") and marked(attributes))
        if drop or name in ("html", "body", "main", "article", "div", "section", "ul", "ol", "table", "blockquote", "figure", "dl"):
            if drop:
                end_block()
            stack.append((name, drop))
            dropped += drop
            if name in depth and not drop:
                articles += name == "article" and not depth[name]
                depth[name] += 1
    end_block()
    return main_blocks(found)


def host_of(url: str | None) -> str:
    match = HOST.match(url or "")
    return match[1].lower() if match else ""


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, node (hash of the html), settled, blocks for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [blocks_of(x.as_py() or "") for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string()),
                    batch.column(2),
                    pa.array([x[1] for x in each], pa.bool_()),
                    pa.array([x[0] for x in each], pa.list_(pa.string())),
                ],
                ["page_id", "url", "host", "node", "settled", "blocks"],
            )

    page = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", F.xxhash64(page).alias("node"), page.alias("html")).mapInArrow(
        run, "page_id bigint, url string, host string, node bigint, settled boolean, blocks array<string>"
    )


def windows_of(blocks: list[str], run_words: int) -> np.ndarray:
    """Hashes of all strings of ``run_words`` words in a page's stream of words."""
    codes = np.array([xxhash.xxh64_intdigest(w) for b in blocks for w in b.split(" ")], np.uint64)
    at = np.arange(max(0, len(codes) - run_words + 1))
    return mixed(Prefixes(mixed(codes)).of(at, at + run_words))


def anchors_of(blocks: list[str], run_words: int) -> np.ndarray:
    """For each string of ``run_words`` words the least hash of the strings of half as many words in it."""
    half = max(1, run_words // 2)
    hashed = windows_of(blocks, half)
    return sliding_minimum(hashed, run_words - half + 1) if len(hashed) > run_words - half else hashed[:0]


def hosted(pages: DataFrame) -> DataFrame:
    """page_id, url, host, node (hash of the html), html for every row of ``pages``; ``host`` as ``host_of`` has it."""
    page = F.coalesce("html", F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST.pattern, 1))
    return pages.select("page_id", "url", host.alias("host"), F.xxhash64(page).alias("node"), page.alias("html"))


def host_runs(pages: DataFrame, run_words: int = RUN_WORDS, run_pages: int = RUN_PAGES, share: float = RUN_SHARE) -> DataFrame:
    """host, leads: hashes of the strings of ``run_words`` words on ``share`` of a host's pages, and ``run_pages``, or more.

    ``pages`` are ``hosted``; all take part, with an article or without. Of each string only the anchor is counted
    first, one word in some three, by groups that are combined before they are exchanged; equal strings have equal
    anchors, so none is missed. Then the strings of common anchors are counted themselves. Equal pages count once.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, found = batch.column(0).to_numpy(), []
            for page in batch.column(1):
                found.append(np.unique(anchors_of(blocks_of(page.as_py())[0], run_words)))
            n = np.array([len(x) for x in found], np.int64)
            each = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(host, n)), pa.array(each)], ["code", "anchor"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, nodes, found = batch.column(0).to_pylist(), batch.column(1).to_numpy(), []
            for page, known in zip(batch.column(2), batch.column(3)):
                blocks = blocks_of(page.as_py())[0]
                common = np.isin(anchors_of(blocks, run_words).view(np.int64), known.values.to_numpy())
                found.append(np.unique(windows_of(blocks, run_words)[common]).view(np.int64))
            n = np.array([len(x) for x in found], np.int64)
            row = np.repeat(np.arange(len(found)), n)
            each = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()).take(pa.array(row)), pa.array(nodes[row]), pa.array(each)], ["host", "node", "lead"]
            )

    sizes = pages.select("host", "node").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    least = F.greatest(F.lit(run_pages), F.ceil(share * F.col("n_pages"))).alias("least")
    sizes = stored(sizes.filter(F.col("n_pages") >= run_pages).select("host", F.xxhash64("host").alias("code"), least), "hosts")
    short = pages.select(F.xxhash64("host").alias("code"), "html").mapInArrow(anchors, "code bigint, anchor bigint")
    short = short.groupBy("code", "anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= run_pages)
    short = short.join(sizes, "code").filter("n >= least").groupBy("host").agg(F.collect_list("anchor").alias("anchors"))
    few = pages.join(stored(short, "anchors"), "host").select("host", "node", "html", "anchors")
    each = few.mapInArrow(strings, "host string, node bigint, lead bigint").distinct().groupBy("host", "lead").agg(F.count(F.lit(1)).alias("n"))
    each = each.join(sizes, "host").filter("n >= least")
    return stored(each.groupBy("host").agg(F.collect_list("lead").alias("leads")), "runs")


def without_runs(blocks: list[str], leads: np.ndarray, run_words: int = RUN_WORDS) -> list[str]:
    """The blocks of an article without those that ``leads`` cover whole.

    A block that is covered in part stays as it is; so does all of an article of which more than half is covered, as
    it is then the article itself that the pages share.
    """
    at = np.flatnonzero(np.isin(windows_of(blocks, run_words).view(np.int64), leads))
    if not len(at):
        return blocks
    n = np.cumsum([0] + [len(b.split(" ")) for b in blocks])
    edge = np.zeros(n[-1] + 1, np.int64)
    edge[at] += 1
    edge[at + run_words] -= 1
    covered = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
    if 2 * covered[-1] > n[-1]:
        return blocks
    return [b for b, x, y in zip(blocks, n, n[1:]) if covered[y] - covered[x] < y - x]


def suffix_leads(pages: DataFrame, run_words: int) -> DataFrame:
    """host, lead, node, at for each place in a page's stream of words: the hash of the ``run_words`` words from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, node, blocks in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                lead = windows_of(blocks, run_words)
                at = np.arange(len(lead))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([host] * len(at), pa.string()),
                        pa.array(lead.view(np.int64)),
                        pa.array(np.full(len(at), node)),
                        pa.array(at, pa.int32()),
                    ],
                    ["host", "lead", "node", "at"],
                )

    return pages.select("host", "node", "blocks").mapInArrow(run, "host string, lead bigint, node bigint, at int")


def without_boilerplate(pages: DataFrame, runs: DataFrame, run_words: int = RUN_WORDS, run_pages: int = RUN_PAGES) -> DataFrame:
    """page_id, url, text of ``pages`` (page_id, url, host, node, blocks), without what other pages of the host repeat.

    ``runs`` (host, leads) are those of all pages of the hosts, which go too.

    The suffixes of a host's word streams that share their first ``run_words`` words are neighbours in its suffix
    array; where ``run_pages`` distinct pages or more share them, these words are covered and go, and a block of
    nothing but covered words goes whole. Suffixes are counted by groups, combined before they are exchanged, so that
    a host with a third of all pages is spread over all tasks. Equal pages count once.
    """
    leads = suffix_leads(pages.dropDuplicates(["host", "node"]), run_words)
    counted = leads.select("host", "lead", "node").distinct().groupBy("host", "lead").agg(F.count(F.lit(1)).alias("n"))
    common = counted.filter(F.col("n") >= run_pages).select("host", "lead")
    common = stored(common.union(runs.select("host", F.explode("leads").alias("lead"))).distinct(), "common")
    covered = leads.join(common, ["host", "lead"]).groupBy("host", "node").agg(F.collect_set("at").alias("covered"))
    marked_ = pages.join(stored(covered, "covered"), ["host", "node"], "left").select("page_id", "url", "blocks", "covered")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, covered in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if covered:
                    gone = {k for at in covered for k in range(at, at + run_words)}
                    kept, at = [], 0
                    for block in blocks:
                        stream = block.split(" ")
                        kept.append(" ".join(w for k, w in enumerate(stream, at) if k not in gone))
                        at += len(stream)
                    blocks = [b for b in kept if b]
                texts.append("\n".join(blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return marked_.mapInArrow(cut, "page_id bigint, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``pages`` (page_id, url, html).

    The text is that of the page's articles, or of its main element if that has more running text, without the elements that
    their name, class, id or role tells to be menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles or comments. Then what a host repeats is looked for on all its pages: a block of an article or main element
    goes if strings of eight words or more that half of the host's pages have, and four at least, cover it whole, and
    they do not cover most of the article. A page with neither element loses these strings and those on four of its
    kind wherever they stand. References are decoded, white space inside a block is one space, blocks are joined by a
    line feed. A null or empty page has the empty text, a null url belongs to the host without a name, repeated rows
    are treated alike, and an empty table gives an empty result. Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for k, (page, leads) in enumerate(zip(batch.column(2), batch.column(3))):
                blocks, settled = blocks_of(page.as_py())
                if settled:
                    rows.append(k)
                    texts.append("\n".join(without_runs(blocks, leads.values.to_numpy()) if leads.is_valid else blocks))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    every = hosted(pages)
    runs = host_runs(every)
    open_ = stored(parsed(pages).filter("NOT settled").drop("settled"), "open-pages")
    settled = every.join(runs, "host", "left").select("page_id", "url", "html", "leads")
    settled = settled.mapInArrow(cut, "page_id bigint, url string, text string")
    return settled.union(without_boilerplate(open_, runs))
