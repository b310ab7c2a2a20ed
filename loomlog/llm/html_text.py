"""The main text of web pages: what a page marks as its article, less what the host repeats.

1. A linear scanner cuts each page into blocks of text. Elements that cannot hold main text (scripts, menus, headers,
   footers, sidebars, forms) are left out by element and role. Where a page marks its article (`article`, `main` or
   that role), the blocks in it are its text so far, else all blocks are.
2. Host suffix array: the blocks' tokens are concatenated to a stream a page. Distinct streams of a host are dealt in
   ranges, and each run of at most `block_pages` streams gets a suffix array by prefix doubling over its tokens, up to
   `long_run` tokens deep; buckets of that depth count the distinct pages that share a string.
3. Counts of all runs of a host are added up. A string on at least `least_pages` distinct pages and `share` of the
   host's distinct pages is boilerplate: the tokens it covers go, on marked pages and on others, and unique runs stay.

A string that reaches `share` on the host reaches half of that in some run of pages and, added up over the runs where it does, half
of the host's pages; so runs pass on such strings only, and those are then counted exactly. Nothing is lost by it, the size
of a task is bounded, and a host that holds a third of all pages is spread like any other.

Copied articles stay: pages of equal streams count as one distinct page, and a marked page of which more than half would go stays
whole, as does an unmarked one of which nothing would be left.

Names of classes never decide inside a marked article, but for containers of reader comments and adverts that are named exactly so
(COMMENTS, ADVERTS: whole names, `comments-on-law` is none). Elsewhere the last word of a name does (`site-footer`).

Defined cases: a null html counts as empty and has the text ""; broken markup is read as far as it
goes (unclosed elements end with their parents, a tag that never ends drops the rest, a quote that never ends is none); rows that
repeat an id are pages of their own; a null url belongs to the host ""; an empty table gives an empty result; other columns are
not read. Ids are cast to long.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import partitions, stage
from loomlog.llm.url_filters import host_and_path

LONG_RUN, LEAST_PAGES, SHARE, BLOCK_PAGES, BLOCK_TOKENS = 8, 3, 0.5, 256, 1 << 20
NAME = re.compile(r"[^\s/>]++")
STOP = re.compile(r">|=\s*+([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "title", "xmp", "noembed", "noframes"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "svg", "math", "object", "audio", "video", "canvas", "fieldset", "map", "applet", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
#: Whole names of containers that are no article text wherever they are.
COMMENTS = {"comment", "comments", "comment-list", "commentlist", "comments-area", "disqus_thread"}
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement"}
#: Last words of class names and ids that mark what is not main text, outside a marked article.
MARKS = {
    "advertising", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header",
    "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "recommended", "replies", "respond", "share", "sharing", "sidebar", "sidenav", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "topbar", "widget",
} | COMMENTS | ADVERTS
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "blockquote", "pre", "form", "nav", "aside", "header", "footer", "main", "hr", "dl", "figure", "address", "fieldset"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ENDS_INLINE = {"p", "li", "div", "section", "article", "h1", "h2", "h3"}
LAST_WORD = re.compile(r"(?:.*[^a-z0-9])?([a-z0-9]+)[^a-z0-9]*", re.S)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)


def _noise(name: str, raw: str, article: bool) -> bool:
    """Whether an element is not main text; article: it lies inside the marked article, which may have a header."""
    if name in DROPPED and not (article and name == "header"):
        return True
    if name in ("html", "body", "main") or "=" not in raw and "hidden" not in raw:
        return False
    at = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(raw)}
    if "hidden" in at or at.get("aria-hidden") == "true" or at.get("role", "").lower() in ROLES or HIDDEN.search(at.get("style", "")):
        return True
    names = {w for k in ("class", "id") for w in html.unescape(at.get(k, "")).split()}
    whole = {w.lower() for w in names}
    if article or name == "article":
        return bool(whole & (COMMENTS | ADVERTS))
    return bool(whole & MARKS) or any(m[1] in MARKS for w in names if (m := LAST_WORD.fullmatch(CAMEL.sub("-", w).lower())))


def _tag_end(page: str, at: int, lost: set) -> int:
    """The place after the `>` that ends a tag, -1 if none does; lost: quotes that are known not to come again."""
    while m := STOP.search(page, at):
        if m[1] is None:
            return m.end()
        close = -1 if m[1] in lost else page.find(m[1], m.end())
        if close < 0:
            lost.add(m[1])
        at = m.end() if close < 0 else close + 1
    return -1


class _Page:
    """The blocks of a page as its tags come; each call takes time in proportion to what it reads."""

    def __init__(self):
        self.out: list[tuple[str, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []  # (name, is noise, is article)
        self.names: Counter = Counter()  # of what is open
        self.solid: list[int] = []  # places in `open` of what is not inline
        self.parts: list[str] = []
        self.noise = self.article = 0

    def end_block(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.out.append((text, self.article > 0))
            self.parts = []

    def say(self, raw: str):
        if raw and not self.noise:
            self.parts.append(html.unescape(raw) if "&" in raw else raw)

    def pop(self) -> str:
        name, bad, main = self.open.pop()
        self.names[name] -= 1
        if name not in INLINE:
            self.solid.pop()
            self.end_block()
        self.noise, self.article = self.noise - bad, self.article - main
        return name

    def close(self, name: str):
        if self.names[name] > 0:
            while self.pop() != name:
                pass
        elif name == "p":
            self.end_block()

    def start(self, name: str, raw: str):
        if name not in INLINE:
            while self.open and name in CLOSED_BY.get(self.open[-1][0], ()):
                self.pop()
            if name in ENDS_INLINE and self.solid and name in CLOSED_BY.get(self.open[self.solid[-1]][0], ()):
                # inline elements that were never closed end with their paragraph
                for _ in range(len(self.open) - self.solid[-1]):
                    self.pop()
            self.end_block()
        elif name == "br":
            self.say(" ")
        if name in EMPTY or raw.endswith("/"):
            return
        bad = _noise(name, raw, self.article > 0)
        main = not self.noise and not bad and (name in ("article", "main") or 'role="main"' in raw)
        if name not in INLINE:
            self.solid.append(len(self.open))
        self.open.append((name, bad, main))
        self.names[name] += 1
        self.noise, self.article = self.noise + bad, self.article + main


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, inside the marked article) of each block that structure leaves, in linear time."""
    out, lost = _Page(), set()
    at = 0
    while (lt := page.find("<", at)) >= 0:
        out.say(page[at:lt])
        mark = page[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            closer = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            stop = page.find(closer, lt + 2)
            at = len(page) if stop < 0 else stop + len(closer)
            continue
        closing = mark == "/"
        begin = lt + 1 + closing
        first = page[begin : begin + 1]
        if not ("a" <= first <= "z" or "A" <= first <= "Z"):
            if closing and first:  # no name: a comment
                stop = page.find(">", begin)
                at = len(page) if stop < 0 else stop + 1
            else:
                out.say("<")
                at = lt + 1
            continue
        named = NAME.match(page, begin)
        stop = _tag_end(page, named.end(), lost)
        if stop < 0:
            at = len(page)
            break
        at, name = stop, named[0].lower()
        if closing:
            out.close(name)
        elif name in RAW:
            end = RAW_END[name].search(page, at)
            stop = _tag_end(page, end.end(), lost) if end else -1
            at = len(page) if stop < 0 else stop
            out.end_block()
        else:
            out.start(name, page[named.end() : stop - 1].strip())
    out.say(page[at:])
    while out.open:
        out.pop()
    out.end_block()
    return out.out


# -- the suffix arrays -------------------------------------------------------------------------------


def _token_hashes(page: list[str], known: dict[str, int]) -> np.ndarray:
    """A hash of 32 bits of each token of a page's blocks; known: those of tokens seen. A run of eight is told by 256 bits."""
    import xxhash

    tokens = [t for block in page for t in block.split(" ")]
    if len(known) > 500_000:
        known.clear()
    for t in set(tokens).difference(known):
        known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def run_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` token hashes."""
    n = len(tokens) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(size):
            out = (out ^ tokens[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def suffix_buckets(streams: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket, page) of the suffixes of concatenated streams that are at least `depth` tokens long.

    `order` is the suffix array to that depth and `bucket` the rank of each suffix, equal for those whose first `depth`
    tokens are; ranks of pairs (own bucket, bucket of a later offset) double the depth in each round.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    page = np.repeat(np.arange(len(streams)), sizes)
    ends = np.cumsum(sizes)[page] if len(page) else np.empty(0, np.int64)
    _, rank = np.unique(np.concatenate(streams) if streams else np.empty(0, np.uint64), return_inverse=True)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        later = np.zeros(len(rank), np.int64)
        later[: len(rank) - step] = rank[step:] + 1
        later[np.arange(len(rank)) + step >= ends] = 0  # a stream ends before
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + later, return_inverse=True)
        known += step
    at = np.nonzero(np.arange(len(rank)) + depth <= ends)[0]
    at = at[np.argsort(rank[at], kind="stable")]
    return at, rank[at], page[at]


def shared_runs(streams: list[np.ndarray], depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, pages): the runs of `depth` tokens that at least `least` of the streams hold, and how many do."""
    at, bucket, page = suffix_buckets(streams, depth)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # in the order of the suffix array and of the pages in it, a new pair is one page more
    new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (page[1:] != page[:-1])))
    first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    pages = np.add.reduceat(new.astype(np.int64), np.nonzero(first)[0])
    some = at[first][pages >= least]
    data = np.concatenate(streams)
    rows = np.stack([data[some + k] for k in range(depth)], axis=1) if len(some) else np.empty((0, depth), np.uint64)
    out = np.zeros(len(rows), np.uint64)
    for k in range(depth):
        out = (out ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out, pages[pages >= least]


def _cut(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(row, i, url, host, marked, stream, first, blocks): `first` for the first of equal streams that a task meets."""
    host, _ = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("h"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        met: set = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                b = batch.slice(begin, 500)
                marked, stream, first, kept = [], [], [], []
                for h, t in zip(b.column(2).to_pylist(), b.column(3)):
                    found = blocks(t.as_py() or "")
                    marked.append(any(x[1] for x in found))
                    kept.append([x[0] for x in found if x[1] or not marked[-1]])
                    stream.append(xxhash.xxh3_64_intdigest(" ".join(kept[-1]).encode("utf-8", "surrogatepass")))
                    first.append((h, stream[-1]) not in met)
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add((h, stream[-1]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(marked), pa.array(np.array(stream, np.uint64).view(np.int64)), pa.array(first), pa.array(kept, pa.list_(pa.string()))],
                    ["i", "url", "host", "marked", "stream", "first", "blocks"],
                )

    return stage(rows.mapInArrow(work, "i long, url string, host string, marked boolean, stream long, first boolean, blocks array<string>"), "blocks")


def _candidates(streams: DataFrame, long_run: int, share: float, block_pages: int) -> DataFrame:
    """(host, run, pages): strings that suffix arrays of up to `block_pages` streams of a host find on half of `share` of them."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            tokens = [_token_hashes(page.as_py(), known).astype("<u4").tobytes() for page in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.binary())], ["host", "stream", "tokens"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = before = None

        def flush() -> pa.RecordBatch:
            runs, pages = shared_runs(held, long_run, max(int(np.ceil(share / 2 * len(held) - 1e-9)), 1))
            return pa.RecordBatch.from_arrays([pa.array([at] * len(runs), pa.string()), pa.array(runs.view(np.int64)), pa.array(pages, pa.int64())], ["host", "run", "pages"])

        size = 0
        for b in batches:
            for host, stream, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if held and (host != at or len(held) >= block_pages or size >= BLOCK_TOKENS):
                    yield flush()
                    held, size = [], 0
                if (host, stream) == before:  # equal streams come one after the other
                    continue
                at, before = host, (host, stream)
                held.append(np.frombuffer(page.as_buffer(), "<u4").astype(np.uint64))
                size += len(held[-1])
        if held:
            yield flush()

    dealt = streams.mapInArrow(coded, "host string, stream long, tokens binary").repartitionByRange(partitions(streams.sparkSession), "host", "stream").sortWithinPartitions("host", "stream")
    found = dealt.mapInArrow(work, "host string, run long, pages long")
    return found.groupBy("host", "run").agg(F.sum("pages").alias("pages"))


def _hits(streams: DataFrame, wanted: DataFrame, long_run: int) -> DataFrame:
    """(host, stream, run, at): where the streams hold the wanted runs of their host."""
    sets = wanted.groupBy("host").agg(F.collect_list("run").alias("runs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for host, stream, page, runs in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                hashes = run_hashes(_token_hashes(page.as_py(), known), long_run)
                at = np.nonzero(np.isin(hashes, runs.values.to_numpy(zero_copy_only=False).view(np.uint64)))[0]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([host.as_py()] * len(at), pa.string()), pa.array([stream.as_py()] * len(at), pa.int64()), pa.array(hashes[at].view(np.int64)), pa.array(at, pa.int64())], ["host", "stream", "run", "at"])

    return streams.join(sets, "host").select("host", "stream", "blocks", "runs").mapInArrow(work, "host string, stream long, run long, at long")


def uncovered(page: list[str], at: list[int], long_run: int, marked: bool) -> list[str]:
    """The blocks without the tokens of the runs that start at `at`; all of them where too much would go."""
    covered = {k for a in at for k in range(a, a + long_run)}
    out, k = [], 0
    for block in page:
        tokens = block.split(" ")
        if rest := [t for n, t in enumerate(tokens, k) if n not in covered]:
            out.append(" ".join(rest))
        k += len(tokens)
    return page if not out or marked and 2 * len(covered) > k else out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", long_run: int = LONG_RUN, least_pages: int = LEAST_PAGES, share: float = SHARE, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """(id, url, text) of each page."""
    cut = _cut(pages, id_col, url_col, html_col)
    streams = cut.where("first and size(blocks) > 0").select("host", "stream", "blocks")
    sizes = stage(streams.select("host", "stream").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= least_pages), "host-sizes")
    runs = _candidates(streams, long_run, share, block_pages).join(sizes, "host")
    wanted = stage(runs.where(F.col("pages") >= F.lit(share / 2) * F.col("all")).select("host", "run"), "candidate-runs")
    whole = F.array_join("blocks", "\n\n")
    if wanted.isEmpty():
        return cut.select(F.col("i").alias(id_col), F.col("url").alias(url_col), whole.alias("text"))
    hits = stage(_hits(streams, wanted, long_run).distinct(), "runs-found")
    enough = F.col("n") >= F.greatest(F.lit(least_pages), F.lit(share) * F.col("all"))
    repeated = hits.groupBy("host", "run").agg(F.count_distinct("stream").alias("n")).join(sizes, "host").where(enough).select("host", "run")
    places = stage(hits.join(repeated, ["host", "run"], "left_semi").groupBy("host", "stream").agg(F.collect_set("at").alias("at")), "repeated-runs")
    if places.isEmpty():
        return cut.select(F.col("i").alias(id_col), F.col("url").alias(url_col), whole.alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n\n".join(page or [] if at is None else uncovered(page or [], at, long_run, mark)) for page, at, mark in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["i", "url", "text"])

    out = cut.join(places, ["host", "stream"], "left").select("i", "url", "blocks", "at", "marked").mapInArrow(work, "i long, url string, text string")
    return out.select(F.col("i").alias(id_col), F.col("url").alias(url_col), "text")
