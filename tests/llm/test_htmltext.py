import html as library
import re

from quillspark.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style></head><body><nav><ul><li><a href="/a">One</a></li><li><a href='x>y'>Two</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy it now, the very best of all things you never needed.</div><article><h1>A  title&nbsp;here</h1><p>First <b>bold</b> &lt;text&gt;
 and <a href="#">a link</a> more.<p>Second, unclosed<br>line. <script>var p = "</p>";</script></p><aside>Not this here</aside><ul><li>point one of it</li></ul>
<div class="reader comments"><p>I liked it very much, thanks.</p></div><pre>x = 1</pre></article><form><label>Mail</label><input></form><footer>&copy; me</footer>"""


def test_page(spark):
    rows = [(1, "u", PAGE, "a"), (2, None, None, None), (3, "", "", "x"), (None, "v", "plain words only", "y"), (1, "u", PAGE, "a"), (5, "w", "<article><p>cut <b of", "t")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract(d).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text.split("\n\n") == ["A title here", "First bold <text> and a link more.", "Second, unclosed line.", "point one of it", "x = 1"]
    assert by[2].text == by[3].text == "" and by[2].n_chars == 0 and by[1].n_chars == len(by[1].text)
    assert htmltext.extract(d.limit(0)).count() == 0


def test_articles_of_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in htmltext.extract(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", html[r.page_id], re.S)[1]
        blocks = [" ".join(library.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_markup_is_linear():
    import time

    t = time.time()
    htmltext.blocks_of("<a '" * 20000 + "<!-- " * 20000)
    assert time.time() - t < 20


def test_missing_end_tags_lose_no_text():
    read = lambda page: htmltext.blocks_of(page)[0]
    rest = "<article><p>The text.</p></article>"
    assert read(f"<html><head><title>t</title><meta content='a>b'><body>{rest}") == ["The text."]
    assert read(f"<html><head><title>t</title><script>'<div>'</script>{rest}") == ["The text."]
    assert read(f"<head>stray<title>t</title></head><body>{rest}") == ["The text."]
    assert read("<datalist><option>x<option>y</datalist><p>rest") == ["rest"]
    assert read("<select><option>x<option>y</select><p>rest") == ["rest"]
    assert read(f"<option>x{rest}<option>y</option>") == ["The text."]
    assert read("<svg/><p>rest") == read("<svg viewBox='0'/><p>rest<svg><text>no</text></svg>") == ["rest"]
    assert read("<svg><svg><text>no</text></svg><text>no</text></svg><p>rest") == ["rest"]
    for tag in ("select", "button", "iframe", "noscript", "template", "svg"):
        assert read(f"<{tag}>{rest}") == ["The text."]
        assert read(f"<{tag}>{rest}<{tag}>no</{tag}><p>more") == ["The text.", "more"]
        assert read(f"<p>a</p><{tag} x='>'>no</{tag}>{rest}") == ["a", "The text."]
    for tag in ("script", "style", "textarea"):
        assert read(f"{rest}<{tag}>no <p>no") == ["The text."]


def test_missing_end_tags_are_linear():
    import time

    t = time.time()
    for tag in ("head", "title", "option", "svg", "svg/", "select", "template", "button", "head><title", "script"):
        htmltext.blocks_of(f"<{tag}>" * 20000)
    assert time.time() - t < 20


def main_text(page):
    texts, known = htmltext.blocks_of(page)
    return [t for t, k in zip(texts, htmltext.fitted().predict(htmltext.features(known)), strict=True) if k]


def test_word_count_and_link_density_decide():
    used = {f for f, *_ in htmltext.fitted().nodes}
    assert {0, 1} <= used and used & {2, 4} and used & {3, 5}  # own words and density, and neighbours' of both


def test_page_without_article():
    link = lambda n: "".join(f"<li><a href='/{i}'>Some place {i}</a></li>" for i in range(n))
    page = f"<body><ul>{link(4)}</ul><h1>Title of it all</h1><p>{'A long paragraph with <a href=x>one</a> link. ' * 8}</p><p>Short one here.</p><p>{'More words of the text. ' * 10}</p><div><a href=y>{'Read this too, and that. ' * 5}</a></div><ul>{link(5)}</ul>"
    got = main_text(page)
    assert got[0] == "Title of it all" and len(got) == 4 and not any("Some place" in t or "Read this" in t for t in got)


def test_classes_are_whole_purposes():
    rest = "<article><div class='post-header'><h1>Title</h1></div><p>The text of it.</p></article>"
    assert main_text(f"<body class='has-sidebar no-footer'>{rest}") == ["Title", "The text of it."]
    for name in ("sidebar", "site-footer", "cookie-banner", "left_nav", "x reader-comments y", "Ad-Slot"):
        assert main_text(f"<div class='{name}'><p>{'Buy this thing now. ' * 9}</p></div>{rest}") == ["Title", "The text of it."]
    assert main_text(f"<html><head><title>t</title><body>{rest}") == ["Title", "The text of it."]


def test_articles_in_forms_and_open_navigation():
    rest = f"<article><h1>Title</h1><p>{'Words of the text. ' * 12}</p></article>"
    own = ["Title", ("Words of the text. " * 12).strip()]
    links = "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>"
    assert main_text(f"<form id='aspnetForm'>{rest}<aside>Not this one here</aside></form>") == own
    assert main_text(f"<form><nav>{links}</nav>{rest}<footer><p>Of the site, all rights.</p></footer></form>") == own
    assert main_text(f"<nav>{links}{rest}") == main_text(f"<header>{links}{rest}") == own
    assert main_text(f"<nav>{links}<h1>Title</h1><p>{own[1]}</p>") == own
    assert main_text(f"<aside><article><p>{'Read this other one. ' * 9}</p></article></aside>{rest}") == own
    assert main_text(f"{rest}<form><p>Your mail address, please, for our letter.</p></form>") == own
    assert main_text("<p>One short paragraph here.</p>") == ["One short paragraph here."]


def test_purposes_stand_at_either_end_of_a_name():
    rest = lambda name: f"<article><p>The text of it all.</p><div class='{name}'><p>{'More words for you. ' * 6}</p></div></article>"
    for name in ("share-price", "reply-letter", "widget-factory-story", "post-header", "has-sidebar", "adstock", "headerless"):
        assert len(main_text(rest(name))) == 2
    for name in ("article-comments", "post-comments", "commentSection", "in-article-ad", "comment-list", "shareButtons", "related_posts"):
        assert main_text(rest(name)) == ["The text of it all."]


def test_headings_between_links_go():
    block = lambda words: f"<div><a href=x>{'word ' * words}</a></div>"
    text = f"<h1>Title of it all</h1><p>{'More words of the text. ' * 6}</p>"
    got = main_text(f"{text}{block(20)}<h3>Read these other ones</h3>{block(23)}")
    assert got[0] == "Title of it all" and "Read these other ones" not in got


def test_very_long_text():
    assert main_text(f"<article><p>{'word ' * 300000}</p><p>end</p></article>")[1] == "end"
