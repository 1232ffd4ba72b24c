from siftstone.llm import html_text as h

ARTICLE = "<h1>A  title &amp; more</h1><p><b>First&nbsp;words &lt;here&gt;<br>go on.<br><p>Second\n one <a href=/x>linked</a> end</p>"
WANT = "A title & more\nFirst words <here> go on.\nSecond one linked end"
MENU = '<nav><ul><li><a href="/a">Menu entry</a></li></ul></nav><div class="ad-box">Buy this now. Buy this now.</div>'
FOOT = '<footer>&copy; words words words words words words words words words words words words words words</footer>'


def page(body, head=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script>{head}</head><body>{body}</body></html>'


def own(source):
    return h.Page(source).text(None)


def test_plain_article():
    assert own(page(f"{MENU}<!-- <p>no</p> --><article>{ARTICLE}</article>{FOOT}")) == WANT
    assert own(page(f"{MENU}<article>{ARTICLE}</article>{FOOT}").removesuffix("</body></html>")) == WANT


def test_other_layouts():
    comments = '<section id="comments"><h2>Comments</h2><div class="comment">I say so, and so, and so again, at length, at length.</div></section>'
    side = '<div class="left-sidebar"><p>Side text side text side text side text</p></div><aside>More at the side</aside>'
    notice = '<div class="cookie-notice">We use cookies.</div><form><label>Mail</label><input name=q><textarea>x</textarea></form>'
    wrapped = f'<div id="wrap">{MENU}{notice}{side}<div class="post-17 with-sidebar">{ARTICLE}{comments}</div></div>{FOOT}'
    assert own(page(wrapped)) == WANT
    assert own(page(f"<header><h2>Site name</h2></header>{side}<main><header><h1>Head</h1></header>{ARTICLE}{notice}</main>{FOOT}")) == "Head\n" + WANT
    assert own(page("<div><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><pre>x\n y</pre></div>")) == "one\ntwo\na b\nc\nx y"


def test_odd_input():
    for source in ("", " ", "<", "<p", "<!--", "<script>x", "<p class='a", "</p></b>", "<nav>only a menu</nav>", "<a href=\"x>y"):
        h.Page(source).text("x")
    assert own("just words &am here") == "just words &am here"
    assert own("<p>" + "long " * 100_000) == ("long " * 100_000).strip()
    assert own("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_consensus_and_rows(spark):
    rows = [(i, "https://A.example.com:80/x", page(f"<div class='p{i}'>{ARTICLE}</div><div class=other><p>{'short ' * 3}</p></div>"), 5) for i in range(6)]
    # Alone, this page would take its longer list of links' neighbour; its host knows better.
    rows += [(10, "https://a.example.com/y", page(f"<div class='p9'>{ARTICLE}</div><div class=other><p>{'longer than that ' * 8}</p></div>"), 5)]
    rows += [(11, None, page(ARTICLE), 5), (12, "nonsense", None, 5), (13, "http://b.org", "", 5), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, N_chars int")
    for hosts in (0, h.BROADCAST_HOSTS):
        got = sorted((x.page_id, x.text, x.n_chars) for x in h.extract(df, broadcast_hosts=hosts).collect())
        assert got == sorted([(i, WANT, len(WANT)) for i in [0, *range(6), 10, 11]] + [(12, "", 0), (13, "", 0)])
    assert h.extract(df.limit(0)).count() == 0
