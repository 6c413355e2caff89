"""HTML extraction on planted articles, and perspective rotation against plain Python."""

import html
import random

import pyarrow as pa
import pytest

from stratalode.llm import chat_formatting, html_extraction

BODY = ["Thin king of the north, and so on.", "Second paragraph; with a comma, and a dot.", "Short.", "A fourth one that runs for somewhat longer than the others, as articles do."]
NOISE_TOP = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav>'
NOISE_END = '<footer>&copy; example &middot; all rights, reserved. Read our terms.</footer>'

PAGES = {
    "article": NOISE_TOP + "<article><h1>Title here</h1>" + "".join(f"<p>{x}</p>" for x in BODY) + "</article>" + NOISE_END,
    "unclosed": NOISE_TOP + "<article><h1>Title here</h1><p><b>" + "<br><p>".join(BODY) + "</article>" + NOISE_END,
    "main with comments": "<header><a href=/>Site name</a></header><main><h1>Title here</h1>" + "".join(f"<p>{x}</p>" for x in BODY) + '<section class="comments"><p>I like this, very much. Really, a lot of it.</p></section></main>' + NOISE_END,
    "divs": '<div id="topMenu"><a href=1>One</a> <a href=2>Two</a></div><div class="wrap"><div class="content"><h1>Title here</h1>' + "".join(f"<p>{x}</p>" for x in BODY) + '</div><div class="side-bar sidebar"><p>Look, here is more, to read. And more.</p></div></div><div class="cookie-notice">We use cookies, as all do. Accept.</div>',
    "form and ad": '<article><h1>Title here</h1><div class="ad">Buy now, cheap. Really cheap, and good.</div>' + "".join(f"<p>{x}</p>" for x in BODY) + "<form><label>Mail</label><input><button>Send</button></form></article>" + "<aside><p>Other things, of interest.</p></aside>",
    "scripts": '<script>var t="</p>";</script><style>p{}</style><!-- <p>no</p> --><article><h1>Title\n  here</h1>' + "".join(f"<p>{x.replace(' ', '  ')}<script>x<1</script></p>" for x in BODY) + "</article>",
    "no container": NOISE_TOP + "<h1>Title here</h1>" + "".join(f"<p>{x}</p>" for x in BODY) + NOISE_END,
}


@pytest.mark.parametrize("name", PAGES)
def test_extracts_the_article(name):
    page = f'<!DOCTYPE html><html lang="en"><head><title>Title of all</title><meta charset="utf-8"></head><body>{PAGES[name]}</body></html>'
    assert html_extraction.extract(page).split("\n") == ["Title here", *BODY]


PLAIN = {
    "divs": "<div><a href=1>One</a> <a href=2>Two</a></div><div><span>Log in</span><span>Search</span></div><div><h1>Title here</h1>" + "".join(f"<p>{x}</p>" for x in BODY) + "<div>Share this</div></div><div><span>Imprint</span> <span>Legal</span></div>",
    "table": "<table><tr><td><div>One</div><div>Two</div></td><td><h1>Title here</h1>" + "".join(f"<p>{x}</p>" for x in BODY) + "</td></tr></table><div>Imprint</div><div>Legal</div>",
    "divs as paragraphs": "<div><div><span>One</span></div><div><span>Two</span></div></div><div><h1>Title here</h1>" + "".join(f"<div>{x}</div>" for x in BODY) + "<div><span>Share</span></div></div><div><span>Imprint</span></div>",
    "a form around all": '<form id="aspnetForm"><div class="nav-list"><div>One</div><div>Two</div></div><div><h1>Title here</h1>' + "".join(f"<p>{x}</p>" for x in BODY) + "</div><div>Imprint</div></form>",
    "a telling class around all": '<div class="page has-sidebar"><div>One</div><div>Two</div><article><h1>Title here</h1>' + "".join(f"<p>{x}</p>" for x in BODY) + "</article></div>",
}


@pytest.mark.parametrize("name", PLAIN)
def test_ratios_find_the_article_without_telling_names(name, monkeypatch):
    page = f"<html><body>{PLAIN[name]}</body></html>"
    assert html_extraction.extract(page).split("\n") == ["Title here", *BODY]
    monkeypatch.setattr(html_extraction, "_content_paths", lambda leaves: {n.path for n, _, _ in leaves})
    # the container alone, by most of the text, is enough for pages that are one article but for a few words
    assert (html_extraction.extract(page).split("\n") != ["Title here", *BODY]) == ("all" not in name)


def test_ratios_decide_on_the_table(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    whole = [html_extraction.extract(x) for x in pages]
    monkeypatch.setattr(html_extraction, "_content_paths", lambda leaves: {n.path for n, _, _ in leaves})
    assert sum(html_extraction.extract(x) != y for x, y in zip(pages, whole, strict=True)) > 0.05 * len(pages)


def test_scores_by_hand():
    leaves = html_extraction._leaves('<div><a href=1>Home</a></div><div class="ad">Buy, now.</div><p>One, two, three.</p><p>Four.</p>')
    ratios = [(4, 0), (8, 2), (9.5, 2), (9.5, 2)]  # length without blanks, and punctuation; a path each but for p's two leaves
    near = [((2 * a[0] + b[0]) / 3, (2 * a[1] + b[1]) / 3) for a, b in ((ratios[0], ratios[1]), (ratios[3], ratios[2]))]
    inner = [tuple(0.25 * ratios[k - 1][i] + 0.5 * ratios[k][i] + 0.25 * ratios[k + 1][i] for i in (0, 1)) for k in (1, 2)]
    fused = [n * (0.5 + p) for n, p in (near[0], *inner, near[1])]
    want = {"/div/a": fused[0] * html_extraction.LINKED, "/div!": fused[1] * html_extraction.HINTED, "/p": (fused[2] + fused[3]) / 2}
    assert html_extraction._scores(leaves) == pytest.approx(want)


def test_odd_pages(spark):
    e = html_extraction.extract
    assert e(None) == e("") == e("<html><body></body></html>") == "" and e("just  text\n") == "just text"
    assert e("<article><p>a &amp; b &lt;c&gt; &#233; x<br>y</p><p>cut &amp</p><p>open <b") == "a & b <c> é x y\ncut &\nopen"
    assert e("<p>one<p>two") == "one\ntwo" and e("</div></p>x") == "x"
    rng = random.Random(1)
    for _ in range(300):
        e("".join(rng.choice(["<p>", "</p>", "<", ">", "<div class='x", '"', "text, ", "<b>", "</div>", "&amp;", "<table>", "<td>", "</tr>", "<!--", "<script>"]) for _ in range(60)))
    long = "".join(f"<p>word {k}, and more.</p>" for k in range(30_000))
    assert e(f"<article>{long}</article>").count("\n") == 29_999
    rows = pa.table({"page_id": pa.array([1, 1, None], pa.int64()), "url": pa.array(["u", "u", None]), "html": pa.array([PAGES["article"], PAGES["article"], None], pa.string()), "text": ["x", "y", "z"]})
    got = html_extraction.extract_pages(spark.createDataFrame(rows)).collect()
    assert len(got) == 3 and got[0] == got[1] and got[2].text == "" and got[2].n_chars == 0
    assert html_extraction.extract_pages(spark.createDataFrame(rows).limit(0)).count() == 0


def test_articles_of_real_pages_come_back_whole(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = r.html[r.html.index("<article>") :].split("</article>")[0]
        want = " ".join(html.unescape(__import__("re").sub(r"<[^>]*>?", " ", body)).split())
        assert " ".join(html_extraction.extract(r.html).split()) == want


def test_rotation(spark):
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("speaker", pa.string())])
    rows = [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", None, "x"), (1, 3, None, "who?", "x"), (1, 3, None, "who?", "x"), (1, 2000, "ann", "late", "x"), (2, 0, "system", "alone", "x"), (None, 0, "user", "lost", "x"), (None, None, "user", "", "x")]
    docs = spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], schema=kinds))
    got = chat_formatting.rotate(docs, block=2).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "user")}
    for key in {(r.conv_id, r.perspective) for r in got}:
        mine = sorted((r for r in got if (r.conv_id, r.perspective) == key), key=lambda r: r.char_start)
        whole = "".join(r.rendered for r in mine)
        assert [r.turn for r in mine if r.turn is not None] == sorted(r.turn for r in mine if r.turn is not None)
        for r in mine:
            assert whole[r.char_start :].startswith(r.rendered) and (r.role == "assistant") == (r.speaker == key[1]) == (r.mask_start is not None)
            if r.mask_start is not None:
                text = next(x[3] for x in rows if (x[2] or "unknown") == r.speaker and x[1] == r.turn and x[0] == r.conv_id) or ""
                assert whole[r.mask_start : r.mask_end] == text + "<|im_end|>"
    assert len(got) == 6 * 3 + 2 and chat_formatting.rotate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("drawn", ["<svg class=x/>", "<svg/>", '<svg viewBox="0 0"><path d="M0"/></svg>', "<svg>", "<math/>", "<math><mi>x</mi></math>", "<canvas>", "<object>", "<template>"])
def test_nothing_after_a_drawn_element_is_lost(drawn):
    page = f"<article><p>one is here, and there.</p>{drawn}<p>two three, four five, six seven.</p><svg><text>no</text></svg><p>The last, of all.</p></article>"
    assert html_extraction.extract(page) == "one is here, and there.\ntwo three, four five, six seven.\nThe last, of all."


def test_names_that_hold_a_word_of_menus_are_kept():
    page = "<article><p>First, of all, is this.</p><p class='comment-free response'>Second, with its words.</p><div class='table-responsive search-results'><p>Third is here, too, with words.</p></div><div class='search-box'><p>Find, by words, what you like.</p></div><p class='advert'>Buy this, and that, now.</p></article>"
    assert html_extraction.extract(page) == "First, of all, is this.\nSecond, with its words.\nThird is here, too, with words."
