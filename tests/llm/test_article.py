"""Main text of pages: what is left out, broken markup, long pages."""

import time

import pytest
from pyspark.sql import functions as F

from pairedsense.llm.article import extract_text, main_text
from .helpers import CLASHING

ONE = "The first passage of the text is long enough to count, and it says what it has to say."
TWO = "A second passage follows, with commas, words and more words than a menu would ever have."
BODY = f"<p>{ONE}</p>\n<p>{TWO}</p>"
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(8)) + "</ul>"
NOISE = {
    "nav": f"<nav>{MENU}</nav>",
    "header": "<header><h2>The name of the site</h2><p>News every day, for everyone who reads</p></header>",
    "footer": "<footer>&copy; 2020 All rights, of every kind, are reserved to the owner of the page</footer>",
    "aside": f"<aside><p>{TWO} aside</p></aside>",
    "sidebar": f'<div class="left-sidebar"><p>{ONE} sidebar</p></div>',
    "cookie": '<div id="cookieNotice"><p>We use cookies, and other things, to know what you read here.</p></div>',
    "ad": "<div class='ad'>Buy it now, buy it here, buy it all day long and be happy ever after.</div>",
    "form": "<form action='/x'><label>Name</label><input name=a><textarea>Type your message here</textarea><button>Send it</button></form>",
    "script": "<script>if (a < b) { document.write('<p>written by a script</p>') }</script><style>p > a { color: red }</style><noscript>Please turn on scripts</noscript>",
    "comments": f'<section id="comments"><h3>3 comments</h3><div class="comment"><p>{ONE} I agree with all of it.</p></div><article class="comment"><p>{TWO} I do not.</p></article></section>',
    "comment": "<!-- <p>a remark in the markup</p> -->",
    "hidden": f'<div style="display: none"><p>{ONE} hidden</p></div>',
}


@pytest.mark.parametrize("kind", NOISE)
def test_what_is_left_out(kind):
    noise = NOISE[kind]
    want = f"Title\n{ONE}\n{TWO}"
    marked = f"<html><head><title>Title - Site</title></head><body>{noise}<article><h1>Title</h1>{BODY}</article>{noise}</body></html>"
    assert main_text(marked) == want
    inside = f"<body><main><article><h1>Title</h1><p>{ONE}</p>{noise}<p>{TWO}</p></article></main></body>"
    assert main_text(inside) == want
    plain = f"<body><div id='page'>{noise}<div class='content'><h1>Title</h1>{BODY}</div>{noise}</div></body>"
    assert main_text(plain) == want


def test_density_chooses_the_container():
    links = "".join(f"<div><a href='{i}'>Teaser number {i}</a> and a word</div>" for i in range(9))
    page = f"<body><div>{links}</div><div><div><p>{ONE}</p><p>{TWO}</p><p>Short.</p></div></div><div>Page 1 of 2</div></body>"
    assert main_text(page) == f"{ONE}\n{TWO}\nShort."
    parts = "".join(f"<section class='part'><h2>Part {i}</h2><p>{ONE} {i}</p><p>{TWO} {i}</p></section>" for i in range(3))
    assert main_text(f"<body><div>{parts}</div><div>{links}</div></body>") == "\n".join(x for i in range(3) for x in (f"Part {i}", f"{ONE} {i}", f"{TWO} {i}"))
    assert main_text(f"<body><form><article>{BODY}<input value=x></article></form></body>") == f"{ONE}\n{TWO}"
    assert main_text(f"<article><header><h1>Title</h1><span>by someone</span></header>{BODY}</article>") == f"Title\n{ONE}\n{TWO}"


def test_blocks_and_references():
    page = "<article><p>a &amp; b &lt;c&gt; &#233;&eacute;&#x41; &nope; AT&ampT</p><p> two\n\t  spaces<br>here </p><p><b>open<p>next</b> on</p><ul><li>x<li>y</ul>tail<table><tr><td>1<td>2</table></article>"
    assert main_text(page) == "a & b <c> ééA &nope; AT&T\ntwo spaces here\nopen\nnext on\nx\ny\ntail\n1\n2"
    assert main_text("5 < 6 and 7 > 3") == "5 < 6 and 7 > 3"
    assert main_text("<head><title>t</title><p>no body tag") == "no body tag"
    assert main_text(f"<body><article>{BODY}") == f"{ONE}\n{TWO}"
    assert main_text(f"<body><article>{BODY}</article></body></html>") == f"{ONE}\n{TWO}"
    assert main_text("<article><p>one</p><P CLASS=x>two</P ></article>") == "one\ntwo"


def test_rows_of_a_table(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<nav>menu</nav>"), (None, "u", f"<article>{BODY}</article>"), (4, "u", "<p>x</p>"), (4, "u", "<p>x</p>"), (5, "u", "<p>" + "wort " * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in CLASHING + ["text", "n_chars"]:
        pages = pages.withColumn(name, F.lit(name))
    out = extract_text(pages)
    assert set(out.columns) == set(pages.columns) - {"html"} and dict(out.dtypes)["n_chars"] == "bigint"
    got = {r["page_id"]: (r["text"], r["n_chars"], r["size"]) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("", 0, "size") and got[4] == ("x", 1, "size")
    assert got[None][0] == f"{ONE}\n{TWO}" and got[5][1] == 2_499_999 and out.count() == 7
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<", "<a ", '<a href="', "<b>", "<div>", "<p>", "<ul><li>", "<!--", "<script>", "&amp", "<li>", "<p class='a' b= c", "</b>", "<b></i>", "x "])
def test_broken_pages_take_linear_time(piece):
    began = time.perf_counter()
    main_text(piece * 100_000)
    assert time.perf_counter() - began < 10
