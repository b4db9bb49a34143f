import pytest

from postloom.llm.html_text import extract, main_text

P1 = "The first paragraph, which is long enough, holds commas, and so it scores points for its container."
P2 = "A second paragraph, equally long and equally dull, follows here &amp; ends with a reference &#233;&nbsp;x."
P2_TEXT = "A second paragraph, equally long and equally dull, follows here & ends with a reference é x."


@pytest.mark.parametrize("inner", [
    f"<article><h1>Head</h1><p>{P1}</p><p>{P2}</p></article>",
    f"<main><h1>Head</h1><p>{P1}<p>{P2}</main>",
    f"<div class='page'><div class='content'><h1>Head</h1><p>{P1}</p>\n\n<p>{P2}</p></div></div>",
    f"<table><tr><td><h1>Head</h1><p>{P1}</p><p>{P2}</p></td></tr></table>",
    f"<article><header><h1>Head</h1></header><p>{P1}</p><form><p>{P1}</p></form><p>{P2}</p><aside>{P1}</aside></article>",
    f"<div id='story'><h1>Head</h1><p>{P1}</p><p>{P2}</p><div class='comments'><p>{P1} {P1}</p></div><div class='share-bar'>{P1}</div></div>",
])
def test_article_without_its_surroundings(inner):
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a = "</p><p>no";</script></head><body>
      <header><p>{P1}</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">{P1}</div><div class="ad">{P1}</div>
      <!-- <p>{P1}</p> --><div class="sidebar"><p>{P1}</p><p>{P1}</p></div>{inner}
      <section id="comments"><article class="comment"><p>{P1}, {P1}</p></article></section><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == f"Head\n\n{P1}\n\n{P2_TEXT}"


def test_broken_markup():
    assert main_text(None) == main_text("") == main_text("<p class=") == main_text("<!-- only") == ""
    assert main_text("<") == "<"
    assert main_text("no markup\n at  all") == "no markup at all"
    assert main_text("<p>a<b>b</p><p>c</i></b>d") == "ab\n\ncd"
    assert main_text("<article><p>one<br>two</p><ul><li>x<li>y</ul></article><p") == "one two\n\nx\n\ny"
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<p>1 < 2 &lt; 3 &bogus; &#x41;</p>") == "1 < 2 < 3 &bogus; A"
    assert main_text("<div class='sidebar'>all there is</div>") == "all there is"


def test_menus_without_a_name():
    menu = "<div><a href=/>Home</a> | <a href=/a>About us</a> | <a href=/c>Contact and imprint</a></div>"
    assert main_text(f"<body>{menu}<h1>Head</h1><p>{P1}</p><p>{P2}</p>{menu}</body>") == f"Head\n\n{P1}\n\n{P2_TEXT}"
    assert main_text(f"<body><div class='mainNav'>{P1}</div><div><p>{P1}</p></div><div class='layout has-sidebar'><p>{P2}</p></div></body>").endswith(P2_TEXT)
    assert main_text(f"<article><p>{P1}</p><ul><li><a href=/>a source</a></li></ul></article>") == f"{P1}\n\na source"


def test_article_competes_with_other_containers():
    long = "".join(f"<p>{P1}</p><p>{P2}</p>" for _ in range(10))
    long_text = "\n\n".join([P1, P2_TEXT] * 10)
    for teaser in ("<article>More</article>", f"<article><h2>Read on</h2><p>{P1}</p></article>"):
        assert main_text(f"<body><div class='content'>{long}</div><div>{teaser}</div></body>") == long_text
    assert main_text(f"<body><article>More</article><div class='content'>{long}</div></body>") == long_text
    assert main_text(f"<body><article><div>{long}</div><ul><li>x</li></ul></article></body>") == f"{long_text}\n\nx"


def test_siblings_of_an_article():
    page = f"<body><h1>Head</h1><p>A lead, short.</p><article><p>{P1}</p></article><h2>Part two</h2><section><p>{P2}</p><p>{P2}</p></section><h2>Links</h2><div><a href=/>{P1}</a></div></body>"
    assert main_text(page) == f"Head\n\nA lead, short.\n\n{P1}\n\nPart two\n\n{P2_TEXT}\n\n{P2_TEXT}"


def test_what_lies_inside_the_article_stays():
    links = "<ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul>"
    for tag in ("div", "article"):
        page = f"<body><div class=nav>x</div><{tag}><p>{P1}</p><p>{P2}</p><h2>Sources</h2>{links}</{tag}></body>"
        assert main_text(page) == f"{P1}\n\n{P2_TEXT}\n\nSources\n\nFirst source\n\nSecond source"
    between = "<pre>code  here</pre><table><tr><td>a cell</td></tr></table><ul><li>an item</li></ul><blockquote>Said.</blockquote><section><h2>Short</h2><p>Yes.</p></section>bare <b>text</b>"
    kept = "code here\n\na cell\n\nan item\n\nSaid.\n\nShort\n\nYes.\n\nbare text"
    page = f"<body><section><p>{P1}</p><p>{P2}</p></section>{between}<section><p>{P1}</p><p>{P2}</p></section></body>"
    assert main_text(page) == f"{P1}\n\n{P2_TEXT}\n\n{kept}\n\n{P1}\n\n{P2_TEXT}"
    page = f"<article><p>{P1}</p><p class='promotional'>Told twice.</p><div class='notice-of-law'>By law.</div><div class='cookie-notice'>{P1}</div><p class=notice>Kept, too.</p></article>"
    assert main_text(page) == f"{P1}\n\nTold twice.\n\nBy law.\n\nKept, too."
    # a list of links between two paragraphs, and menus around a container without a name
    page = f"<body><div>{links}<p>{P1}</p>{links}<p>{P2}</p>{links}</div></body>"
    assert main_text(page) == f"{P1}\n\nFirst source\n\nSecond source\n\n{P2_TEXT}"


def test_very_long_page():
    many = "".join(f"<p>{P1} {k}</p>" for k in range(20000))
    text = main_text(f"<body><div class=menu>{P1}</div><div>{many}</div><footer>x</footer></body>")
    assert text.count("\n\n") == 19999 and text.endswith(" 19999")


def test_query_shape(spark, rows_of):
    rows = [(1, "u", f"<article><p>{P1}</p></article>", 5), (1, "u", None, 6), (None, None, "", None), (2, "v", "<p>é</p>", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    assert rows_of(extract(df)) == sorted([(1, "u", P1, len(P1)), (1, "u", "", 0), (None, None, "", 0), (2, "v", "é", 1)], key=repr)
    assert rows_of(extract(df.limit(0))) == []


def test_whole_text_of_the_pages(spark):
    """On the given pages the text is that between the article's tags, cut at its block tags."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r, h in zip(extract(pages).collect(), pages.collect(), strict=True):
        inner = h.html[h.html.index("<article>") : h.html.index("</article>")]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1|article)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p)
