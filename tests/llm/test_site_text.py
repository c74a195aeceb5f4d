"""Main text of pages: markup in any state, site parts, and the driver's pages."""

import html as markup
import os
import re

import pytest

from sparkfathom.llm import queries, site_text

SF = "/root/testdata/sf0.001"


def text_of(html):
    return site_text.main_text(site_text.read_page(html))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("no markup  at\n all", "no markup at all"),
        ("<p>a &amp; b&nbsp;&lt;c&gt; &#233;&amp;amp;</p>", "a & b <c> é&amp;"),
        ("<body><p><b>One<br>line<p>two</b> x</body>", "One line\ntwo x"),
        ("<nav>menu</nav><p>kept</p><footer>foot", "kept"),
        ("<article><h1>T</h1><p>in</p></article><p>out</p>", "T\nin"),
        ("<header>site</header><main><header><h1>T</h1></header>x</main>", "T\nx"),
        ('<article>a<div class="reader-comments"><article>c</article></div></article><article class="comment">d</article>', "a"),
        ('<div class="with-sidebar"><p>kept</p><div id="sideBar" class="sidebar">s</div></div>', "kept"),
        ('<body class="has-cookie-banner"><div class="cookie-banner">c</div><div role="dialog">d</div><div hidden>h</div>t', "t"),
        ('<div style="display: none">x</div><span class="ad">y</span>t', "t"),
        ("<script>if (a < b) '</p>'</script><style>p{}</style><!-- c > --><p>t<!-- never ended", "t"),
        ("<ul><li>a<li>b <i>c</i></ul><table><tr><td>d<td>e<tr><td>f</table>", "a\nb c\nd\ne\nf"),
        ('<p title="a > b">x</p><p title=it\'s>y</p><p cla', "x\ny"),
        ("</div></p>stray<div>in</p>side</div>", "stray\ninside"),
        ("a < b and c<5 & d", "a < b and c<5 & d"),
        ("<p>a<form><p>f</p><input><select><option>o</select></form><p>b", "a\nb"),
        ("<textarea><p>x</textarea><title>t</title><P>Y</P>", "Y"),
    ],
)
def test_markup(html, want):
    assert text_of(html) == want


def test_long_and_deep_pages():
    assert text_of("<div>" * 20_000 + "x" * 200_000) == "x" * 200_000
    assert text_of("<p>" + "a <" * 50_000).count("a") == 50_000


def site(n, own, extra="", host="h.example"):
    """Pages of a site whose repeated parts no markup names."""
    return [
        (i, f"http://{host}/{i}", f"<div><div>Home | News | {host}</div><div><p>{own(i)}</p>{extra}</div><div>All rights reserved</div></div>")
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, keys string")


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_what_a_site_repeats_goes(spark):
    rows = site(12, lambda i: f"story {i} of its own")
    rows += [(100, "http://other.example/", rows[0][2]), (101, None, rows[0][2]), (102, "no address", None), (103, "http://h.example/", None)]
    got = texts(site_text.extract(frame(spark, rows)))
    assert all(got[i] == f"story {i} of its own" for i in range(12))
    assert got[100] == got[101] == "Home | News | h.example\nstory 0 of its own\nAll rights reserved"  # alone on its host, and no host
    assert got[102] == got[103] == ""


def test_both_ways_of_joining_agree(spark):
    rows = site(12, lambda i: f"story {i}") + site(9, lambda i: f"tale {i}", host="H.example:80") + [(50, None, "<p>x"), (50, None, "<p>x"), (51, "http://lone.example", "<p>y")]
    one = sorted(map(tuple, site_text.extract(frame(spark, rows)).collect()), key=repr)
    other = sorted(map(tuple, site_text.extract(frame(spark, rows), broadcast_keys=-1).collect()), key=repr)
    assert one == other and len(one) == len(rows)


def test_copies_of_a_page_are_no_site(spark):
    long = "a paragraph of this article that has many more words than any line of a menu would ever have on its pages"
    rows = [(i, f"http://h.example/{i}?x", f"<script>{i}</script><article><p>{long}</p></article>") for i in range(40)]
    assert set(texts(site_text.extract(frame(spark, rows))).values()) == {long}


def test_article_text_goes_only_if_nearly_every_page_has_it(spark):
    notice = "<p>Support us: this notice stands within every article</p>"
    rows = [(i, f"http://h.example/{i}", f"<article><p>story {i}</p>{notice if i else ''}{'<p>shared line</p>' if i % 2 else ''}</article>") for i in range(30)]
    got = texts(site_text.extract(frame(spark, rows)))
    assert all(got[i] == (f"story {i}\nshared line" if i % 2 else f"story {i}") for i in range(30))


def test_empty_table(spark):
    got = site_text.extract(frame(spark, []))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_driver_pages_give_their_articles(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op13_site_text(spark, SF).collect()
    assert len(got) == len(html)
    for r in got:
        inner = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1]
        parts = (" ".join(markup.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
