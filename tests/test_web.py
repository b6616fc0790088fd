import json
import math
import random

from pyspark.sql import functions as F

from quillspark.operators.embedding import parsed_vector
from quillspark.sources import web

WORDS = " ".join(f"word{i}" for i in range(30))


def test_choice_among_extractions(spark):
    noisy = "Copy page\nsome text\n# On this page\nmore"
    menu = "<ul><li><a href='/a'>Some menu</a></li><li><a href='/b'>More of it</a></li></ul>"
    long, short = f"<main><h1>T</h1>{menu}<p>{WORDS}</p></main>", f"<main>{menu}<p>few words</p></main>"
    rows = [
        (0, "fit text", "cited", "raw", long), (1, noisy, "cited", "raw", long), (2, noisy, "cited", "raw", short), (3, noisy, "cited", None, None), (4, "", "cited", "raw", long),
        (5, None, noisy, "raw", ""), (6, None, "", "raw", long), (7, None, None, None, long), (8, None, None, None, None), (9, "", "", "", ""), (10, None, noisy, None, long), (11, "Copy page\none line of furniture", None, None, long),
    ]
    pages = spark.createDataFrame(rows, "page_id int, fit string, cited string, raw string, html string")
    whole = lambda h: web.to_markdown(h)
    main = f"# T\n\n{WORDS}"
    want = {0: ("fit", "fit text"), 1: ("html", main), 2: ("html", whole(short)), 3: ("fit", noisy), 4: ("cited", "cited"), 5: ("cited", noisy), 6: ("raw", "raw"), 7: ("html", main), 8: ("none", ""), 9: ("none", ""), 10: ("html", main), 11: ("fit", rows[11][1])}
    out = web.chosen(pages)
    assert {r.page_id: (r.choice, r.content) for r in out.collect()} == want and out.columns[-2:] == ["choice", "content"]
    assert web.chosen(pages.limit(0)).count() == 0
    seen = spark.sparkContext.accumulator(0)

    def parse(html):
        @F.udf("string")
        def one(h):
            seen.add(h is not None)
            return web.to_markdown(h)

        return one(html)

    web.chosen(pages, parse).collect()
    assert seen.value == 6  # the undecided pages that have any html, two empty ones among them
    assert "[Some menu]" in whole(short) and "[Some menu]" not in main


def test_plain_text_is_no_html(spark):
    d = spark.createDataFrame([(1, "https://h/x", "# Title\n\na < b and b > c"), (2, "https://h/y", "<p>para</p>"), (3, "https://h/z", None)], "page_id int, url string, html string")
    assert {r.page_id: (r.title, r.content) for r in web.markdown_pages(d).collect()} == {1: ("Title", "# Title\n\na < b and b > c"), 2: ("Y", "para")}


def test_links_scope_and_defaults(spark):
    page = "<a href='/x'>1</a> <A class=k HREF=\"y/z?p=1&amp;q=2#f\">2</A> <a href='https://sub.h.org/w'>3</a> <a href='//o.net/v'>4</a> <a href='mailto:a@b'>5</a> <a href='#top'>6</a> <a href='./s'>7</a> <a href='?n=2'>8</a> <a href='/x'>again</a> <abbr href='/no'>"
    d = spark.createDataFrame([("https://h.org/d/p?q=1#t", page), ("https://h.org", "<a href='k'>"), ("ftp://h.org/", page), ("https://h.org/n", None)], "url string, html string")
    out = {(r.url[-1], r.link) for r in web.page_links(d).collect()}
    assert out == {("t", u) for u in ("https://h.org/x", "https://h.org/d/y/z?p=1&q=2", "https://sub.h.org/w", "https://o.net/v", "https://h.org/d/s", "https://h.org/d/p?n=2")} | {("g", "https://h.org/k")}
    urls = ["https://h.org/d/a", "https://H.org/e", "https://sub.h.org/w", "https://o.net/v", "no url", None]
    d = spark.createDataFrame([(u,) for u in urls], "u string").coalesce(1)
    for scope, want in (("subpages", [1, 0, 0, 0, 0, 0]), ("host", [1, 1, 0, 0, 0, 0]), ("domain", [1, 1, 1, 0, 0, 0])):
        assert [int(r[0]) for r in d.select(web.in_scope(F.col("u"), "https://h.org/d/", scope)).collect()] == want
    urls = ["https://h.org/docs/LICENSE", "https://h.org/a/old/b", "https://h.org/app.min.js", "https://h.org/x.conf", "https://h.org/zh-tw/p", "https://h.org/docs/guide"]
    d = spark.createDataFrame([(u,) for u in urls], "u string").coalesce(1)
    assert [r[0] for r in d.select(web.url_passes(F.col("u"), [], web.DEFAULT_EXCLUDES)).collect()] == [False] * 5 + [True]
    assert len(web.DEFAULT_EXCLUDES) == 70


def test_frontier_like_a_queue(spark):
    """Against a plain search, with loops, repeated and null links; the plan of the result is a scan, whatever the depth."""
    rng = random.Random(4)
    rows = [(f"u{rng.randrange(60):02}", f"u{rng.randrange(90):02}") for _ in range(130)] + [("u00", None), ("u00", "u00"), ("u00", "u07"), ("u00", "u07"), ("u07", "u08")]
    links = spark.createDataFrame(rows, "url string, link string")
    depths, now = {"u00": 0}, ["u00"]
    for k in range(1, 5):
        now = sorted({b for a, b in rows if a in now and b and b not in depths})
        depths |= dict.fromkeys(now, k)
    whole = sorted((k, u) for u, k in depths.items())
    for depth, cap in ((4, 1000), (4, 9), (0, 5), (3, 0), (2, 1)):
        want = [(k, u) for k, u in whole if k <= depth][:cap]
        out = web.frontier(links, "u00", depth, cap)
        assert sorted((r.depth, r.url) for r in out.collect()) == want
    size = [len(web.frontier(links, "u00", k, 1000)._jdf.queryExecution().optimizedPlan().toString()) for k in (1, 4)]
    assert abs(size[0] - size[1]) < 20 and not web.frontier(links.limit(0), "u00", 3, 10).filter("url <> 'u00'").count()


def test_crawl_over_captures(spark):
    rows = [(1, "https://h/", "<a href='/a'><a href='/no'><a href='https://o/b'>"), (2, "https://h/a", "<a href='/b'><a href='/'>"), (3, "https://h/b", "<a href='/c'>"), (4, "https://h/c", ""), (5, "https://o/b", ""), (6, "https://h/a", "<a href='/c'>"), (7, "https://h/no", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = web.crawled(pages, "https://h/", 3, 10, exclude=["*/no"])
    assert sorted((r.depth, r.page_id) for r in out.collect()) == [(0, 1), (1, 6), (2, 4)]


def test_vectors_from_json(spark):
    texts = ["[1, 2.5, -3e2]", " [0.1]\n", "[]", "[ ]", "1", '["1"]', "[1, null]", "[1,]", "[01]", "[1.]", "[.5]", "[[1]]", "{}", "", None, "[true, false]", "[NaN, -Infinity]", "[1 2]", "[1e5]x", "[" + ",".join(["0.25"] * 20000) + "]"]

    def plain(t):
        try:
            v = json.loads(t)
        except (TypeError, ValueError):
            return None
        return [float(x) for x in v] if isinstance(v, list) and v and all(isinstance(x, (int, float)) for x in v) else None

    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = {r.i: r.v for r in d.select("i", parsed_vector(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert (out[i] is None) == (want is None), t
        assert want is None or all(math.isclose(a, b, rel_tol=1e-6) or (a != a and b != b) for a, b in zip(out[i], want, strict=True)), t


def test_links_stay_with_their_page(spark, tmp_path):
    """Two captures of one URL have links of their own."""
    from quillspark.plans.queries import QUERIES

    pages = [(1, "https://h.org/d", "<a href='/x'>1</a>"), (2, "https://h.org/d", "<a href='/y'>2</a><a href='/y'>2</a>"), (3, "https://h.org/e", "none")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = sorted(tuple(r) for r in QUERIES["page_links"](spark, str(tmp_path)).collect())
    assert rows == [(1, "https://h.org/d", "https://h.org/x"), (2, "https://h.org/d", "https://h.org/y")]
