"""Vector operators against brute force, and main text of pages."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import ann, embdedup, html

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 32))
    rows = []
    for i, v in enumerate(base):
        rows.append((i, v))
        if i < 20:
            rows += [(100 + 10 * i + k, v + rng.normal(size=32) * 0.05) for k in range(5)]
    rows += [(1000 + i, base[30]) for i in range(40)]
    good = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in rows]
    odd = [(2000, None, 0), (2001, [0.0] * 32, 0), (2002, [float("nan")] * 32, 1), (2003, [None] + [1.0] * 31, 1), (2004, [float("inf")] * 32, 1), (2005, [], 1), (2020, [1.0, 2.0], 1), (2040, [2.0, 4.0], 1), (None, good[0][1], 1)]
    return good, spark.createDataFrame(good + odd, SCHEMA)


def test_nearest(spark, vectors):
    good, df = vectors
    ids, m = np.array([g[0] for g in good]), np.array([g[1] for g in good])
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20, slab_least=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in ids[ids % 20 == 0]:
        score = m @ m[ids == q][0]
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != q][:20]
        mine = sorted(got[q])
        assert np.allclose([s for _, _, s in mine], score[order])
        assert [v for _, v, _ in mine] == ids[order].tolist()
    assert got[2020] == [(1, 2040, 10.0)]
    assert 2000 not in got and 2040 in got
    assert ann.nearest(df.limit(0), df, 3).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 16)), rng.normal(size=(200, 16))
    found = dict(ann.Slab(np.arange(200) + 1000, y).search(np.arange(30), x, 5, wide=64))
    for i in range(30):
        assert [-c - 1000 for _, c in found[i]] == np.argsort(-(y @ x[i]))[:5].tolist()


@pytest.mark.parametrize("times", [2, 20])
def test_nearest_with_repeated_rows(spark, times):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 64)).astype(np.float32).astype(np.float64)
    m[7], m[8, 0], m[9, 0] = m[0] * 2, 0.0, -0.0
    rows = [(i, v.tolist()) for i, v in enumerate(m)] * times
    rows += [(9, [0.0, *m[9, 1:].tolist()])] * times + [(7, m[7].tolist())] * 400  # a zero of the other sign; a hot id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 20))
    for q, mine in got.items():
        score = m @ m[q]
        order = [i for i in np.argsort(-score) if i != q][:20]
        assert [(r, v) for r, v, _ in sorted(mine)] == list(enumerate(order, 1))
        assert np.allclose([s for _, _, s in sorted(mine)], score[order])


@pytest.mark.parametrize("times", [2, 20])
def test_bounds_hold_with_repeated_rows(times):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 64)), rng.normal(size=(400, 64))
    found = dict(ann.Slab(np.tile(np.arange(400), times) + 1000, np.tile(y, (times, 1))).search(np.arange(30), x, 20))
    for i in range(30):
        assert [-c - 1000 for _, c in found[i]] == np.argsort(-(y @ x[i]))[:20].tolist()


@pytest.mark.parametrize("tile", [embdedup.TILE, 16])
def test_embedding_groups(spark, vectors, tile):
    good, df = vectors
    rows = {r["vec_id"]: r for r in embdedup.embedding_groups(df, tile=tile).collect() if r["vec_id"] is not None}
    ids, m = np.array([g[0] for g in good]), np.array([g[1] for g in good])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = ids.copy()
    for _ in range(9):
        label = np.array([min(label[i], label[link[i]].min(initial=label[i])) for i in range(len(ids))])
    for i, v in enumerate(ids):
        assert rows[v]["n_links"] == link[i].sum() and rows[v]["component_id"] == label[i]
        assert rows[v]["kept"] == (v == label[i])
    for v in (2000, 2001, 2002, 2003, 2004, 2005):
        assert rows[v]["n_links"] == 0 and rows[v]["component_id"] == v and rows[v]["kept"]
    assert rows[2040]["component_id"] == 2020
    assert embdedup.embedding_groups(df.limit(0)).count() == 0


def test_recall():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(1500, 64))
    b -= a * (a * b).sum(axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9 * a + np.sqrt(1 - 0.81) * b
    assert (embdedup.first_shared(embdedup.buckets(a), embdedup.buckets(near)) >= 0).mean() > 0.97


PAGES = [
    ("<html><head><title>t</title><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; b</h1><p>one<br>two <b>three<p>four\n five</article><footer>f</footer>", "A & b\n\none two three\n\nfour five"),
    ("<article><header><h1>Head</h1></header><script>if (a < b) '</p>'</script><p>x&nbsp;y<!-- <p>no</p> --></p><div class='comments'><p>me</p></div><form>f</form></article>", "Head\n\nx y"),
    ("<main><article class='comment'>no</article><p>yes</p><aside>no</aside></main>", "yes"),
    ("<div class='page has-sidebar'><article><div class='entry-header'><h1>T</h1></div><p>b</p></article><div id='leftSidebar'>s</div></div>", "T\n\nb"),
    ("plain text", "plain text"), ("", ""), (None, ""), ("<p>a</p></p></div><p>b", "a\n\nb"), ("<article></article>", ""), ("<p hidden>x</p><p>y</p>", "y"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/x", h) for i, (h, _) in enumerate(PAGES)] + [(None, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert [got[i] for i in range(len(PAGES))] == [t for _, t in PAGES] and got[None] == ""


def test_host_boilerplate(spark):
    common = "please read our terms of use and privacy policy before you go on"
    rows = [(i, f"http://www.a.org/{i}", f"<div>{common}</div><div>page {i} has words of its own number {i * 7}</div>") for i in range(5)]
    rows += [(9, "http://b.org/9", f"<div>{common}</div><div>other</div>")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "page 2 has words of its own number 14" and common in got[9]


def test_repeated_articles_stay(spark):
    rows = [(i, "http://a.org/1", "<article><p>the same long article text stands on many pages of this host</p></article>") for i in range(6)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"the same long article text stands on many pages of this host"}


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><div style="overflow:hidden"><p>whole body</p></div></article>', "whole body"),
        ('<article><p>a <a href="/the-hidden-valley">link text</a> b</p></article>', "a link text b"),
        ('<article><p title="hidden gems">x</p></article>', "x"),
        ('<article><p data-id="nav">x</p></article>', "x"),
        ('<article><h2 id="search-algorithms">x</h2></article>', "x"),
        ('<article><h2 id="legal-history" class="menu">x</h2></article>', "x"),
        ('<article><section id="comments"><p>x</p></section><div id="comments">y</div><div class="comment-list">z</div></article>', "x"),
        ("<article><pre><code><span class='comment'># x</span></code></pre></article>", "# x"),
        ("<article><p>1 < 2 > 0</p><p>y <abc never ends</article", "1 < 2 > 0\n\ny <abc never ends</article"),
        ('<article><a title="x>y</a> z</article>', "y z"),
        ('<article><ul><li class="ad">x<li>real text</ul></article>', "real text"),
        ('<article><p class="promo">Ad<h2>Heading</h2><p>Real</article>', "Heading\n\nReal"),
        ('<article><p class="share">Share<div>body text</div></article>', "body text"),
        ('<article><p class="notice"><b>Ad<p>Real</article>', "Real"),
        ('<article><table><tr><td hidden>x<td>y<tr><td>z</table><dl><dt hidden>a<dd>b</dl></article>', "y\n\nz\n\nb"),
        ('<article><ul><li class="ad">x<ul><li>y</ul>z<li>w</ul></article>', "w"),
        ("<article><p>z<!--></p><p>w<!---></p><p>v</p></article>", "z\n\nw\n\nv"),
        ("<article>A &lt<b>;</b> B &am<i>p;</i> C &amp;amp; D</article>", "A <; B &amp; C &amp; D"),
        ('<article><section class="search"><h2>Search algorithms</h2></section><div class="legal">Law</div><div class="alert alert-info">Care</div></article>', "Search algorithms\n\nLaw\n\nCare"),
        ('<article><p>x</p><div class="user-reviews">y</div><div class="reviews">z</div></article>', "x\n\nz"),
    ],
)
def test_structure(page, text):
    assert "\n\n".join(html.blocks_of(page)[0]) == text


@pytest.mark.parametrize("unit", ["<" + "a" * 1_000_000, "<a " * 300_000, '<a b=" > " c=' * 80_000, "<b>" * 150_000 + "</i>" * 200_000, "<a b='" * 100_000 + ">", "<!-- " * 200_000])
def test_broken_pages_take_linear_time(unit):
    began = time.time()
    html.blocks_of(unit)
    assert time.time() - began < 20


def plain_uniques(pages, run, least_pages, least_share):
    """Unique runs of open pages, each place compared with each other one's tokens; pages are (host, blocks)."""
    out = []
    for host, blocks in pages:
        others = {tuple(b) for h, b in pages if h == host}
        need = max(least_pages, -(-len(others) * least_share // 1))
        cover, at, marked = set(), 0, []
        for i, block in enumerate(blocks):
            words = block.split(" ")
            marked += [(w, i) for w in words]
            for k in range(len(words) - run + 1):
                if sum(any(b.split(" ")[j : j + run] == words[k : k + run] for b in o for j in range(len(b.split(" ")))) for o in others) >= need:
                    cover |= set(range(at + k, at + k + run))
            if len(words) < run and sum(block in o for o in others) >= need:
                cover |= set(range(at, at + len(words)))
            at += len(words)
        for a in range(at):  # a covered run of four fifths of the page stays
            b = a
            while b in cover:
                b += 1
            if a - 1 not in cover and 5 * (b - a) >= 4 * at:
                cover -= set(range(a, b))
        left = [" ".join(w for k, (w, own) in enumerate(marked) if own == i and k not in cover) for i in range(len(blocks))]
        out.append("\n\n".join(x for x in left if x))
    return out


def test_open_pages_against_brute_force(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(n))
    shared = [prose(rng.randint(1, 14)) for _ in range(8)]
    pages = []
    for _ in range(60):
        blocks = [rng.choice(shared) if rng.random() < 0.5 else prose(rng.randint(1, 20)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.4:
            blocks[0] = f"{prose(3)} {rng.choice(shared)} {prose(2)}"
        pages.append((rng.choice(["h", "h", "k"]), blocks))
    pages += [pages[0]] * 4  # copies count once
    rows = [(i, f"http://{h}/{i}", "".join(f"<div>{b}</div>" for b in bs)) for i, (h, bs) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for run, least, share in ((5, 3, 0.02), (3, 2, 0.1)):
        got = {r["page_id"]: r["text"] for r in html.main_text(df, run, least, share).collect()}
        want = plain_uniques(pages, run, least, share)
        assert [got[i] for i in range(len(rows))] == want and any(len(w) < len("\n\n".join(p[1])) for w, p in zip(want, pages, strict=True))


def test_copied_open_pages_stay_and_odd_tables(spark):
    text = "an article of many words that was copied to several open pages of its host"
    rows = [(i, f"http://a.org/{i}", f"<p>{text}</p>", "x") for i in range(6)] + [(6, None, None, None), (6, None, "<p>z</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html.main_text(df).collect()]
    assert sorted(got) == [*((i, text) for i in range(6)), (6, ""), (6, "z")]
    assert html.main_text(df.limit(0)).collect() == []


def test_recall_of_whole_operator(spark):
    """Pairs at a cosine of just 0.9 among many others: buckets and probes together find most of them, and nothing below."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(700, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(700, 64))
    b -= a * (a * b).sum(axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9001 * a + np.sqrt(1 - 0.9001**2) * b
    below = 0.89 * a[:300] + np.sqrt(1 - 0.89**2) * b[:300]
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(1000 + i, v.tolist()) for i, v in enumerate(near[300:])] + [(2000 + i, v.tolist()) for i, v in enumerate(below)]
    got = {r["vec_id"]: r for r in embdedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert np.mean([got[1000 + i]["component_id"] == 300 + i for i in range(400)]) > 0.95
    assert all(got[2000 + i]["n_links"] == 0 for i in range(300))


def test_repeated_ids_and_empty_tables_of_vectors(spark):
    rows = [(i, [1.0, i / 10]) for i in range(30)] + [(5, [1.0, 0.5])] * 40 + [(5, [2.0, 0.1])] * 3 + [(None, [9.0, 9.0]), (50, None), (51, [0.0, 0.0]), (52, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit("own")).withColumn("score", F.lit("own"))
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(found) == {0, 20} and all([k for k, _ in sorted(x)] == list(range(1, 21)) for x in found.values())
    assert not {50, 51, 52, None} & {v for x in found.values() for _, v in x}
    assert ann.nearest(df.limit(0), df, 20).count() == 0 and ann.nearest(df, df.limit(0), 20).count() == 0


def test_links_do_not_depend_on_the_size_of_tiles(spark):
    """Dense clusters, some in buckets of many tiles: the same links and components for every tile, and those of brute force."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 32))
    rows = [centers[i % 12] + rng.normal(size=32) * rng.choice([0.05, 0.16]) for i in range(400)]
    v = np.array(rows)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = ((unit @ unit.T >= 0.9).sum(axis=1) - 1).tolist()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>").cache()
    found = []
    for tile in (4, 50, 4096):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.embedding_groups(df, tile=tile).collect()}
        found.append(got)
    assert found[0] == found[1] == found[2]
    assert sum(found[0][i][0] for i in range(400)) >= 0.98 * sum(links) and all(found[0][i][0] <= links[i] for i in range(400))
    assert all(found[0][i][1] == i % 12 for i in range(400) if links[i] > 20)


def test_doubtful_parts_teasers_and_near_copies(spark):
    """A search box inside of each article goes by the host's repeats, a section on search stays; a teaser is not the article; near
    copies of a text on open pages stay."""
    box = "type here what you are looking for on this great site of ours"
    rng = random.Random(8)
    body = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, f"http://a/{i}", f'<article><p>own text {i} of this page</p><div class="search">{box}</div></article>') for i in range(6)]
    rows += [(10, "http://a/10", '<article><p>about</p><section class="search"><p>Search algorithms are old and many of them are still in use</p></section></article>')]
    rows += [(20 + i, f"http://b/{i}", f"<div>{body} end{i}</div>") for i in range(3)] + [(30 + i, f"http://b/x{i}", f"<div>one page {rng.random()} apart from others</div>") for i in range(20)]
    rows += [(60, "http://c/1", '<article class="teaser">Read more elsewhere</article><div><p>The text itself</p></div>')]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"own text {i} of this page" for i in range(6)]
    assert got[10].endswith("still in use") and [got[20 + i] for i in range(3)] == [f"{body} end{i}" for i in range(3)]
    assert got[60] == "Read more elsewhere\n\nThe text itself"
