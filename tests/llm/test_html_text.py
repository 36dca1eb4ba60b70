import time

from tests.llm.helpers import LONG

from kindred.llm import html_text

TREE = html_text.train_tree()

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav><!-- <p>comment</p> -->
<div class="ad">Buy this now it is very cheap today.</div>
<div id="cookie-notice"><p>We use cookies to make this site better for all of our readers.</p></div>
<article><h1>Title of&nbsp;it</h1><p><b>First   paragraph &amp; more<br>after a break.<br><p>Short.</p>
<p title="a > b">With <a href="/x">a link</a> inside &#8212; and &copy;</p>
<aside><p>Read this other story as well, it is by the same author.</p></aside>
<form><p>Sign up for letters</p><input value="x"></form><ul><li>point one</li><li>point two</li></ul>
<div hidden><p>not seen</p></div></article>
<section class="comments"><p>Reader says that this article was far too short for its title, and other things too.</p></section>
<footer>&copy; site &middot; words in the footer.</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html_text.main_text(PAGE, TREE) == (
        "Title of it\nFirst paragraph & more after a break.\nShort.\nWith a link inside — and ©\npoint one\npoint two"
    )


def test_labelled_table_is_learnt():
    wrong = total = 0
    for page in html_text.labelled_pages():
        blocks = html_text.blocks_of(page)
        found = TREE.predict(html_text.describe(blocks))
        wrong += sum(b.text.startswith("+") != f for b, f in zip(blocks, found))
        total += len(blocks)
    assert total > 300 and wrong <= 0.02 * total


def test_pages_without_article_tags():
    text = "This is a longer paragraph of plain prose that goes on for a while and has no links in it at all, as articles do."
    page = f"<body><div class='menu'><a href=/>home</a> <a href=/b>more</a></div><div class='post-content'><p>{text}</p><p>End.</p></div><div class='footer'>imprint</div></body>"
    assert html_text.main_text(page, TREE) == f"{text}\nEnd."


def test_broken_markup_and_extremes():
    assert html_text.main_text(None, TREE) == html_text.main_text("", TREE) == html_text.main_text("<p><br>&nbsp;</p>", TREE) == ""
    assert html_text.main_text("<article><p>open", TREE) == "open"
    assert html_text.main_text('<article><p class="x>unclosed quote</p><p>next one</p></article>', TREE) == "unclosed quote\nnext one"
    assert html_text.main_text("<article>1 < 2 and 3 > 2</article>", TREE) == "1 < 2 and 3 > 2"
    assert html_text.main_text("<article>seen<!-- open", TREE) == "seen"
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep", TREE) == "deep"
    assert html_text.main_text(f"<article><p>{LONG}</p></article>", TREE) == LONG
    assert html_text.main_text("<article>" + "<p title='" * 20_000, TREE) is not None


def test_markup_that_may_be_left_out_or_closes_itself():
    def text(page):
        return html_text.main_text(page, TREE)

    assert text("<head><title>t</title><body><article><p>main text</p></article>") == "main text"
    assert text("<head><title>t</title><article><p>main text</p></article>") == "main text"
    assert text("<title>t</title><article><p>main text</p></article>") == "main text"
    assert text("<article><p>a</p><svg class=i/><p>main text</p></article>") == "a\nmain text"
    assert text("<article><p>a</p><svg class=i><p>main text</p></article>") == "a\nmain text"
    assert text("<article><p>a <svg><title>x</title></svg>b</p></article>") == "a b"
    assert text("<article><video-player></video-player><button-group><p>main</p></button-group></article>") == "main"
    assert text("<article><p>a</p><SCRIPT>x = '</script >'; <p>b</p></article>") == "a\n'; \nb".replace("; \n", ";\n")
    assert text("<article><p>a</p><style>x") == "a"
    assert text("<article><p>a</p><svgx>b</svgx><svg>c</svgx></svg></article>") == "a\nb"


def test_names_that_contradict_each_other_say_nothing():
    prose = " ".join(f"word{i}" for i in range(70))
    assert html_text.main_text(f'<article class="post related-x"><div class="story-body share-me"><p>{prose}</p></div></article>', TREE) == prose
    assert html_text.main_text(f'<article><div class="text more"><p>{prose}</p></div></article>', TREE) == prose
    assert html_text.main_text(f'<article><p>{prose}</p><div class="article-sidebar"><p>{prose}</p></div></article>', TREE) == prose
    assert html_text.main_text("<div><p>Only a few words.</p><p>And more.</p></div><nav><p>menu</p></nav>", TREE) == "Only a few words.\nAnd more."


def test_link_density_decides_inside_an_article():
    def features(tree):
        return set() if tree.left is None else {html_text.FEATURES[tree.feature]} | features(tree.left) | features(tree.right)

    assert "links" in features(TREE) and features(TREE) & {"links_before", "links_after"}
    page = "<article><p>Some words of prose here.</p><ul>{}</ul><p>And <a href=/>a link</a> within the prose.</p></article>"
    items = "".join(f"<li><a href=/{i}>Another story {i}</a></li>" for i in range(4))
    assert html_text.main_text(page.format(items), TREE) == "Some words of prose here.\nAnd a link within the prose."


def test_time_grows_with_the_page():
    for bad in ("<a ", "<svg x='", "<p title='", "<p title=\"a' ", "<!", "<", "<div>", "<div></p></ul>", "<svg>", "</div><p class=", "<script", "<div class='a'>b"):
        start = time.perf_counter()
        html_text.blocks_of("<article><p>x</p>" + bad * (1_000_000 // len(bad)) + "<p>y")
        assert time.perf_counter() - start < 6, bad


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract_main_text(pages).collect()
    assert len(out) == 4 and {len(r.text) == r.n_chars for r in out} == {True}
    assert [r.n_chars for r in out if r.page_id is None] == [0]
    assert html_text.extract_main_text(pages.limit(0)).count() == 0
