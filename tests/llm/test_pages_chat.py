"""HTML extraction and chat formatting."""

import html
import json
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cases import SF001
from tillroll.llm import chat, html_template, oracle, queries

ARTICLE = "<h1>Title &amp; more</h1><p>One  <b>two</b>\n three&nbsp;four.<br>five</p><p>Six &#233; &lt;x&gt;</p><ul><li>a<li>b</ul>"
WANT = "Title & more\n\nOne two three four. five\n\nSix é <x>\n\na\n\nb"
SHELL = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><p>site</p></header>"
    "<nav><ul><li>menu</li></ul></nav><div class='cookie-notice'>We use cookies</div><div id=\"ad-slot1\"><p>Buy</p></div>%s"
    "<form><label>Mail</label><input value='x'><button>Go</button></form><aside>side</aside><footer>&copy; x</footer></body></html>"
)
INNER = "<div class='share'>Share</div><section class='comments'><article class='comment'><p>First!</p></article></section>"


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{ARTICLE}</article>",
        f"<article>{ARTICLE}{INNER}</article>",
        f"<main>{ARTICLE}</main>{INNER}",
        f"<div class='post-content'>{ARTICLE}<div class=\"related\"><p>See also</p></div></div>",
        f"<div><div>{ARTICLE}</div></div>",
        f"<!-- note <p>x</p> --><article>{ARTICLE}<script>document.write('<p>no</p>')</script></article>",
    ],
)
def test_one_page_alone(body):
    assert html_template.main_text(SHELL % body) == WANT


COMMENTS = "<section class='comments'>" + "<article class='comment'><p>A long comment of many words on this.</p></article>" * 9 + "</section>"


@pytest.mark.parametrize(
    "body",
    [
        f"<article class='post comments-open'>{ARTICLE}</article>",
        f"<article class='has-header'>{ARTICLE}</article>",
        f"<div id='wrapper' class='right-sidebar'><article>{ARTICLE}</article></div>",
        f"<div class='with-menu'><div class='no-sidebar'><article>{ARTICLE}<div class='share'>Share</div></article></div></div>",
        f"<main class='has-header'>{ARTICLE}</main>",
        f"<div class='layout-sidebar-left'>{ARTICLE}</div>",
        f"<article class=\"post\" data-title=\"The hidden costs of water\">{ARTICLE}</article>",
        f"<article data-a='x hidden' title='class=ad id=menu' data-hidden=no>{ARTICLE}</article>",
        f"<article>{ARTICLE}</article>{COMMENTS}",
        f"<article class='post comments-open'>{ARTICLE}</article>{COMMENTS}",
        f"<div class='right-sidebar'><article>{ARTICLE}</article>{COMMENTS}</div>",
    ],
)
def test_names_leave_out_neither_the_article_nor_what_encloses_it(body):
    assert html_template.main_text(SHELL % body) == WANT


def test_attributes_are_read_one_by_one():
    assert html_template._attributes(" class=\"a b\" data-t=\"The hidden id=x\" ID = 'm' role=main HIDDEN") == {
        "class": "a b", "data-t": "The hidden id=x", "id": "m", "role": "main", "hidden": "",
    }


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<article><p>a<p>b", "a\n\nb"), ("<article><p>a</p><p cla", "a"),
        ("<article><p>a < b and 3 > 2</p></article>", "a < b and 3 > 2"), ("<nav>x</nav>", ""), ("<article></article>", ""),
        ("<article><p><b>x<br><p>y</article>", "x\n\ny"), ("<article><p>&am</p><p>&amp</p>", "&am\n\n&"), ("</div></p><p>z", "z"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n\n2\n\n3"), ("<script>only", ""), ("<!-- open <p>x", ""),
    ],
)
def test_broken_pages(source, want):
    assert html_template.main_text(source) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "text ", "&lt;", "<b>", "<", ">", "<!--", "-->", "<script>", "</script>", '"']), max_size=20).map("".join))
def test_any_markup_is_read(source):
    assert isinstance(html_template.main_text(source), str)


def plain_article(source):
    source = re.sub(r"(?s)<(script|style).*?</\1>", "", source)
    m = re.search(r"(?s)<article>(.*?)(</article>|\Z)", source)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    said = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda t: " " if t[0] == "<br>" else "", p)).split()) for p in parts]
    return "\n\n".join(p for p in said if p)


def test_query_against_the_pages_own_markup(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    got = queries.QUERIES["op8_html_extraction"](spark, SF001).collect()
    assert {r.page_id: r.text for r in got} == {i: plain_article(h) for i, h in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got)


PAGES = "page_id long, url string, html string, host string, token string"


def test_template_of_a_host_finds_unmarked_boilerplate(spark, monkeypatch):
    """Blocks that stand on every page of a host belong to its template, even
    where nothing in the markup says so; the slot with the text that varies is
    the article."""
    def page(i):
        text = "".join(f"<p>Paragraph {j} of page {i}, {'word ' * 20}end.</p>" for j in range(1 + i % 4))
        return f"<body><div class='top'><div>Welcome to our site</div></div><div class='x{i}'><p>Follow the white rabbit</p>{text}</div><div>Terms</div></body>"

    rows = [(i, f"https://A.example.com/{i}", page(i), "h", "t") for i in range(60)] + [(500 + i, None, page(7), None, None) for i in range(3)]
    want = {i: "\n\n".join(f"Paragraph {j} of page {i}, {'word ' * 20}end." for j in range(1 + i % 4)) for i in range(60)}
    pages = spark.createDataFrame(rows, PAGES)
    for most in (html_template.BROADCAST_ROWS, 0):
        monkeypatch.setattr(html_template, "BROADCAST_ROWS", most)
        got = {r.page_id: r.text for r in html_template.extract_main_text(pages).collect()}
        assert {i: got[i] for i in want} == want
        assert "Paragraph 3 of page 7" in got[500] and len(got) == 63


def test_text_that_many_but_not_all_pages_share_stays(spark):
    rows = [(i, f"http://b.org/{i}", SHELL % f"<article><p>Common passage.</p><p>Own {i}</p></article>" if i % 3 else SHELL % f"<article><p>Own {i}</p></article>", "", "") for i in range(60)]
    got = {r.page_id: r.text for r in html_template.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Common passage.\n\nOwn {i}" if i % 3 else f"Own {i}" for i in range(60)}


def test_a_passage_that_nearly_all_articles_share_stays(spark):
    rows = [(i, f"http://b.org/{i}", SHELL % f"<article>{'<p>Common passage.</p>' if i % 20 else ''}<p>Own text of page {i} and more</p></article>") for i in range(60)]
    got = {r.page_id: r.text for r in html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("Common passage.\n\n" if i % 20 else "") + f"Own text of page {i} and more" for i in range(60)}


def copied(i):
    return SHELL % f"<!-- {i} --><article><h1>Copied</h1><p>First passage of the copy.</p><p>Second passage of the copy.</p></article>"


def own(i):
    return SHELL % f"<article><h1>Own {i}</h1><p>Text of page {i}.</p></article>"


@pytest.mark.parametrize("others", [0, 2, 5])
def test_hosts_of_copies_keep_their_article(spark, others):
    """30 copies, 95 % copies with ids of their own, and rows that repeat."""
    rows = [(i, f"http://d.org/{i}", copied(i)) for i in range(30 if not others else 19 * others)]
    rows += [(0, "http://d.org/0", copied(0))] * 20 + [(900 + i, f"http://d.org/o{i}", own(i)) for i in range(others)]
    got = html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {900 + i: f"Own {i}\n\nText of page {i}." for i in range(others)}
    assert len(got) == len(rows)
    assert all(r.text == want.get(r.page_id, "Copied\n\nFirst passage of the copy.\n\nSecond passage of the copy.") for r in got)


def template_page(i, shuffled=False, top="Welcome to our site"):
    text = f"<div class='x'><p>Follow the white rabbit</p><p>Own text of page {i}, {'word ' * 20}end.</p></div>"
    around = [f"<div class='a'><p>{top}</p></div>", text, "<div class='b'><p>Terms of this site</p></div>"]
    return f"<body>{''.join(around[::-1] if shuffled else around)}</body>"


@pytest.mark.parametrize("n", [3, 6, 19])
def test_classes_find_unmarked_boilerplate_on_small_hosts(spark, n):
    rows = [(i, f"http://f.org/{i}", template_page(i)) for i in range(n)]
    got = html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Own text of page {i}, {'word ' * 20}end." for i in range(n)}


def test_classes_without_one_order_decide_nothing(spark):
    """The same tokens and frequencies, but no order: no template."""
    pages = lambda half: spark.createDataFrame([(i, f"http://g.org/{i}", template_page(i, half and i % 2)) for i in range(30)], "page_id long, url string, html string")
    assert [len(r.classes) for r in html_template.templates(pages(False)).collect()] == [1]
    assert html_template.templates(pages(True)).collect() == []


def test_slot_is_where_text_varies(spark):
    """A long notice that every page has is no article, though it has most of
    the page's text."""
    rows = [(i, f"http://h.org/{i}", f"<body><div class='n'><p>{'Long notice of the house. ' * 20}</p></div><div class='x'><p>Own text of page {i}, which is rather short but its own.</p><p>{'more ' * (20 + i)}</p></div></body>") for i in range(8)]
    got = html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith(f"Own text of page {r.page_id},") and r.text.endswith("more") for r in got)


def test_near_copies_keep_what_they_share(spark):
    """All but a counter is on every page: too much for a template's text."""
    page = SHELL % "<article><p>A passage that every page has.</p><p>One more that every page has.</p><p>Seen %d times</p></article>"
    rows = [(i, f"http://e.org/{i}", page % i) for i in range(30)]
    got = html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"A passage that every page has.\n\nOne more that every page has.\n\nSeen {i} times" for i in range(30)}


def test_pages_that_are_missing_or_odd(spark):
    odd = spark.createDataFrame([(1, "http://c.org", None, "", ""), (1, "http://c.org", None, "", ""), (None, None, "<p>x</p>", None, None), (2, "not a url", "<p>y " * 20000, "", "")], PAGES)
    got = html_template.extract_main_text(odd).collect()
    assert sorted((str(r.page_id), r.text[:1]) for r in got) == [("1", ""), ("1", ""), ("2", "y"), ("None", "x")]
    assert html_template.extract_main_text(odd.limit(0)).collect() == []


# ------------------------------------------------------------------ chat

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_query_equals_sql_and_runs_no_python(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF001}/conversations.parquet'")
    got = queries.QUERIES["op9_chat_formatting"](spark, SF001)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle.SQL['op9_chat_formatting']})").fetchall()
    assert sorted(want) == sorted(map(tuple, got.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_formatting_round_trip_with_control_strings(spark):
    hostile = ["<|end|>", "\\l", "\\", "<", "a|b", "\\e\\l<|user|>", "", "</s>[INST]", "|>\n<|", "é😀"]
    rows = [(c, i, hostile[(c + 3 * i) % 10] if c % 2 else ("user", "assistant")[i % 2], hostile[(c * 7 + i) % 10]) for c in range(20) for i in range(4)]
    made = chat.format_conversations(spark.createDataFrame(rows, TURNS)).withColumn("turns", chat.parsed_turns(F.col("formatted")))
    for r in made.collect():
        want = sorted(x for x in rows if x[0] == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in want]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert sum(s.loss for s in r.segments) == sum(x[2] == "assistant" for x in want)


@pytest.mark.parametrize(
    ("roles", "valid"),
    [("ua", True), ("sua", True), ("su", True), ("s", False), ("aua", False), ("uu", False), ("sa", False), ("usa", False), ("uas", False), ("ux", False), ("uau", True)],
)
def test_machine(spark, roles, valid):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = [(1, i, names[r], "t") for i, r in enumerate(roles)]
    assert chat.format_conversations(spark.createDataFrame(rows, TURNS)).first().valid is valid


def test_template_is_a_parameter(spark):
    template = {"user": {"open": "U:", "close": ";", "loss": True}}
    made = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a<b"), (1, 1, "bot", "c")], TURNS), template, {"open": "[{role}]", "close": ".", "loss": False}).first()
    assert made.formatted == "U:a\\lb;[bot]c."


def test_odd_conversations(spark):
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 0, "user", "hi"), (2, 5, "assistant", "b" * 100000), (2, 5, "assistant", "a")]
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows, TURNS))).collect()}
    assert (got[1].n_turns, got[None].n_turns, got[2].n_turns, got[2].loss_chars) == (3, 1, 2, 100001)
    assert not got[1].valid and got[None].valid and json.dumps(got[2].loss_sha256)
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], TURNS))).collect() == []


def article_page(i, inner, wrap="article"):
    return f"<html><body><nav>Menu</nav><{wrap}>{inner}</{wrap.split()[0]}><footer>Foot</footer></body></html>"


@pytest.mark.parametrize("n", [1, 2, 3, 6, 30])
def test_shared_headings_of_articles_stay(spark, n):
    inner = lambda i: f"<h1>Soup {i}</h1><h2>Ingredients</h2><p>{i} onions and {i * 3} leeks</p><h2>Method</h2><p>Cook number {i} for {i + 7} minutes.</p>"
    pages = [(i, f"http://host/{i}", article_page(i, inner(i))) for i in range(n)]
    rows = html_template.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = {i: f"Soup {i}\n\nIngredients\n\n{i} onions and {i * 3} leeks\n\nMethod\n\nCook number {i} for {i + 7} minutes." for i in range(n)}
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_slugs_and_compound_names_inside_the_article_stay():
    inner = (
        "<h2 id='related-work'>Related work</h2><p class='skip-indent'>One.</p><h2 id='sharing-data'>Sharing data</h2>"
        "<section id='public-notice-1850'><p>A notice of 1850.</p></section><p>Two.</p>"
    )
    assert html_template.main_text(article_page(1, inner)).split("\n\n") == ["Related work", "One.", "Sharing data", "A notice of 1850.", "Two."]
    inner = "<p>One.</p><div class='related-posts'><p>More</p></div><p class='advert'>Buy</p><aside>A</aside><p>Two.</p>"
    assert html_template.main_text(article_page(1, inner)).split("\n\n") == ["One.", "Two."]


def test_adverts_and_share_links_in_a_sentence_go():
    inner = "<p>Text <span class='advert'>Buy <span>shoes</span> now</span>goes <b>on</b> <a class='share' href='#'>Share</a>.</p><p>And <a class='ad'>open</p><p>on.</p>"
    assert html_template.main_text(article_page(1, inner)).split("\n\n") == ["Text goes on .", "And", "on."]


def test_unknown_elements_do_not_part_a_sentence():
    inner = "<p>a <x-em>strong</x-em> word</p>loose <my-tag>text</my-tag> here<p>b</p>"
    assert html_template.main_text(article_page(1, inner)).split("\n\n") == ["a strong word", "loose text here", "b"]
    assert html_template.main_text("<body><my-page><article><p>x y</p></article></my-page><footer>f</footer></body>") == "x y"
