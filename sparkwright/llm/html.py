"""Main text of web pages: page structure, and a host suffix array for what structure leaves open.

A page is read as a stream of tags and text, in one pass. Elements that are no article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments; by tag, role, or the words of class and id) are skipped. Text inside
<article> or <main> is the article. A page without either is open: its blocks may hold boilerplate that only its host gives
away. So may blocks of an article in elements whose class (search, legal, alert...) can name a part of it as well. End tags
that may be missing are implied as browsers do.

Host suffix array. The token streams of a host's open pages are taken together; a suffix is a place in them with the words that
follow in its block. Suffixes are sorted by host and tokens, neighbours are compared token by token, and equal ones stand
together; what stands on enough distinct pages is a repeated passage. Longer repeats are unions of suffixes that begin one
after another, so the order needs a depth of `run` words and no more. Covered words go, and the unique runs between them stay.
A block of fewer than `run` words is a suffix of its own, ends included. A passage is boilerplate on at
least `least_pages` pages and at least `least_share` of its host's open pages. Pages of one host with equal blocks are one page
here, so that an article copied to several open pages stays, and on open pages a repeated run of four fifths of a page's words stays,
so that near copies do. Other text of <article> and <main> is not judged by repeats: copies of an article on one host are still articles.

Scale. Suffixes that occur too rarely are sieved out before the sort by counts of 64-bit hashes (map-side sums; a collision can
only let one through, and the sort compares tokens). The rest are dealt by ranges of (host, tokens, page), so a host with a
third of all pages and a passage on all of them are split over tasks, and each task counts what it sees as a stream.

Defined cases: a null page is empty; a null url is a host of its own; character references are decoded; white space inside a
block becomes one space; blocks are joined by two line feeds; unclosed and stray tags are tolerated, and a tag that never ends
is text; rows keep repeats; other columns of the input are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import cut, written

RUN, PAGES, SHARE, SALTS = 8, 3, 0.02, 32

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img".split()
)
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
SKIPPED = frozenset(
    "head script style noscript template iframe svg math canvas object audio video nav footer aside form button select "
    "textarea input dialog menu".split()
)
MAIN = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: Elements whose class and id are read; headings and inline elements (code, say) are not among them.
CONTAINERS = frozenset("article center details div dl fieldset li ol p section table ul".split())
#: Words of class and id that name what is no article.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header footer masthead sidebar aside widget cookie cookies consent gdpr notice alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "commentlist disqus reply replies respond pagination pager copyright legal toolbar search skip".split()
)
#: Words that inside of an article may as well name a part of it; there the host's repeats decide.
DOUBTFUL = frozenset("alert copyright legal overlay search skip toolbar".split())
#: Words before `reviews` that tell of reader comments, and words of an article's class that tell of another page's article.
READERS, TEASERS = frozenset("customer reader readers user users visitor".split()), frozenset("excerpt preview teaser".split())
#: Elements that an open element's missing end tag gives way to, and those beyond which none is looked for.
CLOSES = {
    **dict.fromkeys(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(),
        frozenset("p"),
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tbody": frozenset(["tbody", "thead", "tr"]), "tfoot": frozenset(["tbody", "thead", "tr"]),
}
BARRIERS = {
    "p": frozenset("html body table td th caption object button template".split()),
    "li": frozenset("html body ul ol menu dir table td th section article aside nav header footer main form".split()),
    "dt": frozenset("html body dl table td th section article aside nav header footer main form".split()),
    "option": frozenset("select".split()), "td": frozenset("table tr".split()), "tr": frozenset("table".split()), "tbody": frozenset("table".split()),
}
BARRIERS |= {"dd": BARRIERS["dt"], "th": BARRIERS["td"], "tfoot": BARRIERS["tbody"]}
#: Words that may follow one of those, as in comment-list.
NEUTRAL = frozenset(
    "area article articles bar block box button buttons container content form group inner item items label link links list "
    "outer panel post posts row section slot stories text thread unit widget wrap wrapper x".split()
)
#: First words of a class that tell of a layout, as in has-sidebar.
LAYOUT = frozenset("has with without no is".split())
#: Words of ids that name no part of an article even inside of one, where ids often repeat a heading.
SURE = frozenset("breadcrumb breadcrumbs commentlist comments consent cookie cookies disqus newsletter pagination replies respond sidebar".split())
NAME = re.compile(r"/?+([a-zA-Z][^\s/>]*+)")
#: The rest of a tag: quotes count only behind an equals sign. Nothing here can go back, so a scan is linear.
REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def attributes_of(rest: str) -> dict[str, str]:
    """The attributes of a tag by their exact names in lower case; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def names_boilerplate(value: str, among: frozenset[str]) -> bool:
    """Whether a token of a class or id ends in a word of `among`, but for neutral words."""
    for token in value.split():
        words = [w.lower() for w in SPLIT.split(token) if w]
        if not words or words[0] in LAYOUT:
            continue
        while len(words) > 1 and words[-1] in NEUTRAL:
            words.pop()
        if words[-1] in among or words[-1] == "reviews" and words[0] in READERS:
            return True
    return False


def is_skipped(tag: str, rest: str, in_main: bool) -> bool:
    """Whether an element is no part of an article; a header counts as one only outside of <article> and <main>."""
    if tag in SKIPPED or tag == "header" and not in_main:
        return True
    if not rest or tag in ("html", "body"):
        return False
    found = attributes_of(rest)
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if tag not in CONTAINERS:
        return False
    if not in_main:
        return names_boilerplate(found.get("class", ""), WORDS) or names_boilerplate(found.get("id", ""), WORDS)
    return names_boilerplate(found.get("class", ""), WORDS - DOUBTFUL - {"header"}) or tag != "section" and names_boilerplate(found.get("id", ""), SURE)


def is_doubtful(tag: str, rest: str) -> bool:
    """Whether an element inside of an article may be none of it by its class."""
    return tag in CONTAINERS and "class" in rest.lower() and names_boilerplate(attributes_of(rest).get("class", ""), DOUBTFUL)


class Page:
    """Reads one page into the blocks inside of <article> and <main>, and those outside, both without what is skipped. `doubts` says
    of each block inside whether it stands in an element whose class leaves that open."""

    def __init__(self) -> None:
        self.inside: list[str] = []
        self.outside: list[str] = []
        self.parts: list[str] = []
        self.doubts: list[bool] = []
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, skipped, in the article, doubtful
        self.open: Counter[str] = Counter()
        self.skipped = self.in_main = self.doubtful = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                (self.inside if self.in_main else self.outside).append(text)
                if self.in_main:
                    self.doubts.append(self.doubtful)

    def text(self, piece: str) -> None:
        if piece and not self.skipped:
            self.parts.append(unescape(piece))  # a reference does not go on behind a tag

    def leave(self, depth: int) -> None:
        """Close all but the first `depth` open elements."""
        for tag, *_ in self.stack[depth:]:
            self.open[tag] -= 1
        del self.stack[depth:]
        self.skipped, self.in_main, self.doubtful = self.stack[-1][1:] if self.stack else (False, False, False)

    def imply_end(self, tag: str) -> None:
        """Close an open element whose end tag may be missing before this one."""
        closing = CLOSES.get(tag)
        if closing is None or not any(self.open[c] for c in closing):
            return
        stop = BARRIERS["p"] if "p" in closing else BARRIERS[tag]
        found = None
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth][0]
            if name in closing:
                found = depth
                if tag not in ("tbody", "tfoot"):
                    break
            elif name in stop:
                break
        if found is not None:
            self.leave(found)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.text(" ")
        if not self.open[tag]:
            return self.flush() if tag == "p" and not self.skipped else None
        if tag not in INLINE:
            self.flush()
        depth = len(self.stack) - 1
        while self.stack[depth][0] != tag:
            depth -= 1
        if self.stack[depth][2] != (self.stack[depth - 1][2] if depth else False) or self.stack[depth][1]:
            self.flush()
        self.leave(depth)

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            return self.text(" ")
        if tag not in INLINE:
            self.flush()
        if tag == "body" and self.open["head"]:  # <head> may be left open
            self.leave(0)
        self.imply_end(tag)
        if tag in VOID or rest.endswith("/") and tag in ("svg", "path"):
            return
        skipped = self.skipped or is_skipped(tag, rest, self.in_main)
        in_main = self.in_main or tag in MAIN and not skipped and not (rest and names_boilerplate(attributes_of(rest).get("class", ""), TEASERS))
        doubtful = self.doubtful or bool(in_main and rest and not skipped) and is_doubtful(tag, rest)
        if skipped != self.skipped or in_main != self.in_main or doubtful != self.doubtful:
            self.flush()
        self.stack.append((tag, skipped, in_main, doubtful))
        self.open[tag] += 1
        self.skipped, self.in_main, self.doubtful = skipped, in_main, doubtful

    def read(self, page: str) -> tuple[list[str], list[str]]:
        at, size, last, whole = 0, len(page), page.rfind(">"), True
        while at < size:
            begin = page.find("<", at)
            if begin < 0 or begin > last and not page.startswith("<!", begin):
                self.text(page[at:])
                break
            if page.startswith("<!--", begin):
                self.text(page[at:begin])
                empty = 5 if page.startswith(">", begin + 4) else 6 if page.startswith("->", begin + 4) else 0
                stop = begin + empty - 3 if empty else page.find("-->", begin + 4)
                at = stop + 3 if stop >= 0 else size
                continue
            if page.startswith(("<!", "<?"), begin):
                self.text(page[at:begin])
                stop = page.find(">", begin)
                at = stop + 1 if stop >= 0 else size
                continue
            name = NAME.match(page, begin + 1)
            if not name:  # a sign, not a tag
                self.text(page[at : begin + 1])
                at = begin + 1
                continue
            rest = REST.match(page, name.end()) if whole else None
            if rest:
                stop, attributes = rest.end(), rest[1]
            else:  # the marks of some value never close: from here on tags end at their first >
                whole = False
                stop = page.find(">", name.end()) + 1
                attributes = page[name.end() : stop - 1]
            self.text(page[at:begin])
            at, tag = stop, name[1].lower()
            if page[begin + 1] == "/":
                self.end(tag)
            elif tag in RAW:  # holds no tags: jump to its end
                self.flush()
                close = RAW_END[tag].search(page, at)
                at = close.end() if close else size
            else:
                self.start(tag, attributes)
        self.flush()
        return self.inside, self.outside


RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}


def blocks_of(page: str | None) -> tuple[list[str], list[str]]:
    """The blocks inside of <article> and <main>, and those outside, both without what is skipped."""
    return Page().read(page or "")


def judged_blocks(page: str | None) -> tuple[list[str], list[bool]]:
    """The blocks that may be the article, and of each whether the host's repeats are to judge it: what is doubtful inside of the
    article, or all of a page without one."""
    read = Page()
    inside, outside = read.read(page or "")
    return (inside, read.doubts) if inside else (outside, [True] * len(outside))


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", url or "", re.I)
    return found[1].rpartition("@")[2].partition(":")[0].lower() if found else ""


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts, judged, hosts = [], [], []
            for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                blocks, open_ = judged_blocks(page)
                texts.append(blocks)
                judged.append(open_)
                hosts.append(host_of(url))
            arrays = [part.column(0), part.column(1), pa.array(hosts), pa.array(texts, pa.list_(pa.string())), pa.array(judged, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "blocks", "judged"])


def suffixes_of(blocks: list[str], run: int) -> Iterator[tuple[int, int, str]]:
    """(first word, number of words, tokens) of each suffix of a page, to the depth of `run` words of its block; a shorter
    block is one suffix, its ends included."""
    at = 0
    for block in blocks:
        words = block.split(" ")
        if len(words) < run:
            yield at, len(words), f"\n{block}\n"
        for i in range(len(words) - run + 1):
            yield at + i, run, " ".join(words[i : i + run])
        at += len(words)


def _hashed(host: str, tokens: str) -> int:
    whole = xxhash.xxh64_intdigest(f"{host} {tokens}")
    return whole - (whole >> 63 << 64)


def _keys(run: int):
    """(k, least, page): a hash of each different suffix of a page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, host, least, blocks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = list({_hashed(host, tokens) for _, _, tokens in suffixes_of(blocks, run)})
                arrays = [pa.array(found, pa.int64()), pa.array([least] * len(found), pa.int64()), pa.array([page] * len(found), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "least", "page"])

    return rows


def _suffixes(run: int):
    """(host, tokens, page, i, n, least) of the suffixes whose hash is among a page's `ks`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, host, least, blocks, ks in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                often = set(ks)
                found = [s for s in suffixes_of(blocks, run) if _hashed(host, s[2]) in often]
                size = len(found)
                arrays = [pa.array([host] * size, pa.string()), pa.array([t for _, _, t in found], pa.string()), pa.array([page] * size, pa.int64())]
                arrays += [pa.array([i for i, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([least] * size, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["host", "tokens", "page", "i", "n", "least"])

    return rows


def _pages_of_equals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tokens, least, pages): the distinct pages of each run of equal neighbours in suffix order."""
    at, pages, page, least = None, 0, None, 0
    for batch in batches:
        out: list[tuple] = []
        for host, tokens, here, need in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (host, tokens) != at:
                if at is not None:
                    out.append((*at, least, pages))
                at, pages, page = (host, tokens), 0, None
            if here != page:
                pages, page = pages + 1, here
            least = need
        yield _counts(out)
    if at is not None:
        yield _counts([(*at, least, pages)])


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"host": pa.string(), "tokens": pa.string(), "least": pa.int64(), "pages": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def unique_runs(blocks: list[str], judged: list[bool], covered: list[tuple[int, int]]) -> str:
    """The words of the blocks without those that are covered, (first word, number of words) among the judged blocks; on an open page
    a covered run of four fifths of all words is the page itself, as near copies of one are, and stays."""
    gone = {i + k for i, n in covered for k in range(n)}
    words_of = [b.split(" ") for b in blocks]
    total, runs = sum(map(len, words_of)), []
    for i in sorted(gone):
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    for a, b in runs:
        if all(judged) and 5 * (b - a) >= 4 * total:
            gone.difference_update(range(a, b))
    at, kept = 0, []
    for words, own in zip(words_of, judged, strict=True):
        if not own:
            kept.append(" ".join(words))
            continue
        if left := " ".join(w for k, w in enumerate(words, at) if k not in gone):
            kept.append(left)
        at += len(words)
    return "\n\n".join(kept)


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        covered = [[(c["i"], c["n"]) for c in cover or ()] for cover in batch.column(4).to_pylist()]
        texts = [unique_runs(*row) for row in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), covered, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def repeated(streams: DataFrame, run: int, least_pages: int, least_share: float) -> DataFrame:
    """(page, covered): what repeats of the host cover, for the distinct streams (page, host, open) of open pages."""
    # the hosts' page counts meet the pages by host and salt, so that a large host is no hot key
    salted = streams.withColumn("salt", F.pmod("page", F.lit(SALTS).cast("long")))
    hosts = streams.groupBy("host").agg(F.greatest(F.lit(least_pages), F.ceil(F.count("*") * F.lit(least_share))).cast("long").alias("least"))
    hosts = hosts.select("host", "least", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    named = cut(salted.join(hosts, ["host", "salt"]).select("page", "host", "least", "open"))
    keys = named.mapInArrow(_keys(run), "k long, least long, page long")
    often = keys.groupBy("k").agg(F.count("*").alias("n"), F.min("least").alias("least")).where("n >= least").select("k")
    marked = keys.join(often, "k").groupBy("page").agg(F.collect_set("k").alias("ks"))
    rows = named.join(marked, "page").select("page", "host", "least", "open", "ks")
    array = rows.mapInArrow(_suffixes(run), "host string, tokens string, page long, i long, n long, least long")
    array = cut(array.repartitionByRange("host", "tokens", "page").sortWithinPartitions("host", "tokens", "page", "i"))
    counts = array.select("host", "tokens", "page", "least").mapInArrow(_pages_of_equals, "host string, tokens string, least long, pages long")
    found = counts.groupBy("host", "tokens").agg(F.sum("pages").alias("pages"), F.max("least").alias("least")).where("pages >= least")
    return array.join(found.select("host", "tokens"), ["host", "tokens"]).groupBy("page").agg(F.collect_set(F.struct("i", "n")).alias("covered"))


def main_text(pages: DataFrame, run: int = RUN, least_pages: int = PAGES, least_share: float = SHARE) -> DataFrame:
    """(page_id, url, text) of each page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    read = written(own.mapInArrow(_read, "page_id long, url string, host string, blocks array<string>, judged array<boolean>"))
    some = F.array_contains("judged", True)
    closed = read.where(~some).select("page_id", "url", F.array_join("blocks", "\n\n").alias("text"))
    opened = read.where(some).withColumn("page", F.xxhash64("host", "blocks", "judged"))
    stream = F.transform(F.filter(F.arrays_zip("blocks", "judged"), lambda z: z["judged"]), lambda z: z["blocks"])
    streams = opened.dropDuplicates(["page"]).select("page", "host", stream.alias("open"))
    covered = repeated(streams, run, least_pages, least_share).withColumnRenamed("page", "same")
    rest = opened.join(covered, opened["page"] == covered["same"], "left").select("page_id", "url", "blocks", "judged", "covered")
    return closed.unionByName(rest.mapInArrow(_uncovered, "page_id long, url string, text string"))
