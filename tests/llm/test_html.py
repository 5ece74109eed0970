import html as entities
import re

import pytest

from murkwater.llm import html
from murkwater.llm.html import main_text


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


@pytest.mark.parametrize("mark", ['class="ad"', "class='site-comments'", "id=sidebar", 'class="x cookie-notice"', 'role="navigation"', "hidden"])
def test_marked_elements_go(mark):
    page = f"<body><div id=main><h1>Title</h1><p>One, two, three. Four, five.<p>More text here, and more.<div {mark}><p>Not, this. Never, ever, at all, however long it may be.</div><ul><li>a<li>b</ul></div></body>"
    assert main_text(page) == "Title\nOne, two, three. Four, five.\nMore text here, and more.\na\nb"


def test_space_references_and_inline_markup():
    page = "<html><body><nav>Menu</nav><article><p>A\n  <b>b</b>c <i>d</i>&nbsp;&amp;&#x41;&copy;<br>e</p><pre> x\n\ny </pre><p>  </p><script>if (a < b) { '</p>' }</script><!-- <p>no</p> --></article><footer>f</footer></body></html>"
    assert main_text(page) == "A bc d &A© e\nx y"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<html><head><title>t</title></head><body></body></html>", "<nav>only a menu</nav>", "<!--", "<script>", "</p></div>"])
def test_nothing_to_extract(page):
    assert main_text(page) in ("", "<", "<p")


def test_plain_text_and_broken_markup():
    assert main_text("just text &lt;here&gt;") == "just text <here>"
    assert main_text("<div><p>one<div>two</p>three</div>") == "one\ntwo\nthree"
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</article>") == "deep"


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars"))
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(r.text for r in got.collect()) == ["", "a", "a"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_unclosed_quotes_and_many_openings():
    assert main_text('<div><p class="x>one</p><p>two</p></div>') == "one\ntwo"
    assert main_text("<" * 200_000) == "<" * 200_000
    assert main_text("<p>a</p>" + '<x "' * 50_000).startswith("a")
    assert main_text("<p>" + "word " * 400_000).count("word") == 400_000


PROSE = [f"Sentence {i} of the story, which is about as long as such a sentence is, ends here." for i in range(12)]
STORY = "".join(f"<p>{x}</p>" for x in PROSE)


@pytest.mark.parametrize(
    "open_, close",
    [
        ('<div class="widget Blog">', "</div>"),
        ('<div class="elementor-widget-text-editor">', "</div>"),
        ('<div class="elementor-element elementor-widget elementor-widget-text-editor"><div class="elementor-widget-container">', "</div></div>"),
        ('<div class="content with-sidebar">', "</div>"),
        ('<div class="single comments-open">', "</div>"),
        ('<form id="aspnetForm" action="x">', "</form>"),
        ('<div class="modal"><div class="modal-body">', "</div></div>"),
    ],
)
def test_marked_wrappers_of_the_article_stay(open_, close):
    page = f"<body><nav>Home, about.</nav>{open_}<h1>Title</h1>{STORY}<div class=sidebar><p>Other stories, here.</p></div>{close}<footer>f</footer></body>"
    assert main_text(page) == "\n".join(["Title", *PROSE])
    parts = f"<body><main>{''.join(f'{open_}<p>{x}</p><p>{x}</p>{close}' for x in PROSE)}</main><div class=related><p>Other stories, here.</p></div></body>"
    assert main_text(parts) == "\n".join(x for x in PROSE for _ in "ab")


def test_long_comments_go():
    assert main_text(f"<body><div><h1>Title</h1><p>{PROSE[0]}</p></div><div class=comments>{STORY}</div></body>") == f"Title\n{PROSE[0]}"
    assert main_text(f"<body><article><h1>Title</h1>{STORY[:400]}</article><div class=related>{STORY}</div></body>").count("\n") < 6


def test_header_inside_an_article_stays():
    page = f'<body><header><h1>Site</h1></header><article><header class="entry-header"><h1>Title</h1></header>{STORY}<footer>f</footer></article></body>'
    assert main_text(page) == "\n".join(["Title", *PROSE])


def test_content_beside_the_container_stays():
    page = f"<body><div id=top><a>Home</a> <a>About</a></div><div id=post><div class=lead><p>{PROSE[0]}</p></div><div class=body>{STORY[len(PROSE[0]) + 7:]}</div></div></body>"
    got = main_text(page)
    assert got.startswith(PROSE[0] + "\n") and "Home" not in got and got.endswith(PROSE[-1])
    assert main_text(f"<body>{PROSE[0]}<div class=body>{STORY[len(PROSE[0]) + 7:]}</div></body>").startswith(PROSE[0] + "\n")


def test_unmarked_menus_go():
    menu = "<div class=k><a>Home</a><a>News</a></div>"
    assert main_text(f"<body><article>{menu}{STORY}</article></body>") == "\n".join(PROSE)
    assert main_text(f"<body><div>{menu}{STORY}<ul><li><a>More</a><li><a>Other</a></ul></div></body>") == "\n".join(PROSE)
    assert "\nsee here\n" in main_text(f"<body><div>{STORY}<p>see <a>here</a></p>{STORY}</div></body>")


def _unnamed(page):
    page = re.sub(r"<(/?)(nav|footer|article|main|header|aside)\b", r"<\1div", page)
    return re.sub(r' (class|id|role)=("[^"]*"|\S+?)(?=[ >])', "", page)


def test_paths_decide_without_any_name(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    # an article no longer than the advert and the footer beside it can't be told apart without names
    same = [main_text(_unnamed(x)) == main_text(x) for x in pages if len(main_text(x)) >= 300]
    assert len(same) >= 0.8 * len(pages) and sum(same) >= 0.95 * len(same)
    assert all(main_text(_unnamed(x), threshold=0) != main_text(x) for x in pages)


def test_lead_beside_the_body_and_headings_with_what_they_head():
    page = f"<body><div id=post><div class=lead>{PROSE[0]}</div><div class=body>{STORY}</div><div><h3>Next</h3><a>x</a><a>y</a></div></div></body>"
    assert main_text(page) == "\n".join([PROSE[0], *PROSE])
    assert main_text(f"<body><div><h1>Site</h1></div><div><h1>Title</h1>{STORY}<h2>More</h2>{STORY}</div></body>") == "\n".join(["Title", *PROSE, "More", *PROSE])


def test_extra_columns_and_very_long_pages(spark):
    long = "<body><div>" + "".join(f"<p>{x}</p>" for x in PROSE * 3000) + "</div></body>"
    rows = spark.createDataFrame([(1, "u", long, "x", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert html.extract(rows).first().text == "\n".join(PROSE * 3000)


def test_words_inside_attribute_values_hide_nothing():
    assert html.main_text('<article title="The hidden city"><p>Some text of it.</p></article>') == "Some text of it."
    assert html.main_text('<div data-title="A hidden gem, class=menu in town"><p>Some text of it.</p></div>') == "Some text of it."
    assert html.main_text('<article><p>One.</p><p class="mt-2 hidden md:block">Two, on wide screens.</p></article>') == "One.\nTwo, on wide screens."
    for mark in ("hidden", "hidden=''", 'class="x" hidden', "HIDDEN=hidden", 'hidden="until-found" id=a'):
        assert html.main_text(f"<article><p>One sentence.</p><p {mark}>Two.</p></article>") == "One sentence."


@pytest.mark.parametrize("length", [30, 99, 101, 400])
def test_a_mark_weighs_the_same_at_every_length(length):
    text = ("word " * 100)[: length - 1].strip() + "."
    assert html.main_text(f'<div class="share-of-voice"><p>{text}</p></div>') == text


def test_rows_of_links_go_and_linked_sentences_stay():
    assert html.main_text("<article><div><a>Home</a> <a>News</a></div><div>A long text, which goes on and on.</div></article>") == "A long text, which goes on and on."
    assert html.main_text("<article><p>A long text, which goes on.</p><p><a href=x>All of this is a link.</a></p></article>") == "A long text, which goes on.\nAll of this is a link."


def test_controls_inside_a_paragraph_are_read():
    assert html.main_text("<article><p>Press the <button>Go</button> key, or <label>the other</label>.</p><button>Like</button></article>") == "Press the Go key, or the other."


def test_equal_scores_keep_both_blocks():
    assert html.main_text("<div><p>Twins are alike.</p></div><div><p>Twins are alike.</p></div>") == "Twins are alike.\nTwins are alike."
