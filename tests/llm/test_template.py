import time
from collections import Counter

import pyarrow as pa

from boardstat.llm import template

from .fixtures import prose

HEAD = "<!DOCTYPE html><html><head><title>t</title><style>p{x:y}</style><script>var t='</p>';</script></head><body>"


def marked(i, host="a.example.com"):
    body = prose(i, 40)
    html = (f"{HEAD}<nav><ul><li><a href='/x'>Menu {i}</a></li></ul></nav><!-- ad --><div class='ad'>Buy {i}</div><article>"
            f"<header>Top</header><h1>Title {i}</h1><p><b>{body}.<br>tom &amp; jerry<p>second   one\n here</p><aside>side</aside>"
            f"<div class='comments'>nice {i}</div><form><input>Sign</form></article><footer>&copy; a {i}</footer></body></html>")
    return (i, f"http://{host}/{i}", html), f"Title {i}\n\n{body}. tom & jerry\n\nsecond one here"


def unmarked(i, host="b.example.com"):
    """No article element: the slot must come from the template, whose own line must go."""
    body = prose(i, 60)
    html = (f"{HEAD}<div id='top'><a href='/'>Home</a><a href='/l{i}'>Link {i}</a></div><div id='page'><div class='intro'>Welcome to our "
            f"site</div><p>{body}</p><p>end {i}</p></div><div class='legal'>Imprint</div></body></html>")
    return (i, f"https://{host}/p/{i}", html), f"{body}\n\nend {i}"


def odd():
    return [((90, "http://c.example.com/1", None), ""), ((91, None, ""), ""), ((None, "nonsense", "plain <b>words</b> &lt;x&gt;"), "plain words <x>"),
            ((92, "http://c.example.com/2", "<p>one<p>two<br>three<ul><li>x<li>y</ul>"), "one\n\ntwo three\n\nx\n\ny"),
            ((93, "http://c.example.com/3", "<main><p>" + "long words " * 30_000 + "</main>"), ("long words " * 30_000).strip()),
            ((94, "http://c.example.com/4", "<nav>only a menu</nav>"), "")]


def test_main_texts(spark):
    cases = [marked(i) for i in range(12)] + [unmarked(i) for i in range(20, 32)] + odd() + [marked(3)] + [marked(70, "solo.example.com")]
    rows = [(*page, "s", "x") for page, _ in cases]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    got = template.main_texts(frame.withColumnRenamed("host", "top"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got.collect()) == sorted(
        (str(page[0]), text, len(text)) for page, text in cases)


def test_template_of_a_host(spark):
    frame = spark.createDataFrame([unmarked(i)[0] for i in range(8)] + [marked(i)[0] for i in range(8)],
                                  "page_id long, url string, html string")
    specs = {r["host"]: r for r in template.templates(frame).collect()}
    assert specs["a.example.com"]["top"] == "html/body/article"
    assert specs["b.example.com"]["top"] == "html/body/div#page"
    assert any("Welcome" in t for t in specs["b.example.com"]["fixed"])


def test_repeated_articles_are_not_template(spark):
    page, text = marked(1)
    frame = spark.createDataFrame([(i, page[1] + str(i), page[2]) for i in range(10)], "page_id long, url string, html string")
    assert {r["text"] for r in template.main_texts(frame).collect()} == {text}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert template.main_texts(frame).collect() == []


def test_copied_articles_of_unmarked_hosts_are_kept(spark):
    """Short paragraphs that half of the pages share because they are copies, equal or with a line of their own."""
    def page(i, body, line=""):
        paragraphs = "".join(f"<p>{prose(body * 10 + k, 9)}</p>" for k in range(6))
        return f"{HEAD}<div id='top'><a href='/'>Home</a></div><div id='page'>{paragraphs}{line}</div><div class='legal'>Imprint</div></body></html>"

    def text(body):
        return "\n\n".join(prose(body * 10 + k, 9) for k in range(6))

    cases = [("two.example.com", [(1, ""), (1, "")]), ("four.example.com", [(2, ""), (2, ""), (3, ""), (4, "")]),
             ("lines.example.com", [(5, f"<p>seen {i} times</p>") for i in range(4)] + [(6, ""), (7, "")])]
    rows, wanted = [], {}
    for host, bodies in cases:
        for body, line in bodies:
            i = len(rows)
            rows.append((i, f"http://{host}/{i}", page(i, body, line)))
            wanted[i] = text(body) + (f"\n\n{line[3:-4]}" if line else "")
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in template.main_texts(frame).collect()}
    assert {i: wanted[i] in t for i, t in got.items()} == dict.fromkeys(wanted, True)


def test_template_texts_inside_the_slot_go(spark):
    """Notices under a neutral class in a marked article, and a long one on a host without marks."""
    long = "Read more of us every week. " * 12
    rows, wanted = [], {}
    for i in range(8):
        body = f"<p>{prose(i, 70)}</p><p>{prose(i + 50, 8)}</p>"
        notices = f"<div class='k7'><p>Sign up here</p></div><p class='z'>{long}</p>"
        rows.append((i, f"http://a.example.com/{i}", f"{HEAD}<nav>n</nav><article><h1>T {i}</h1>{body}{notices}</article></body></html>"))
        wanted[i] = f"T {i}\n\n{prose(i, 70)}\n\n{prose(i + 50, 8)}"
        rows.append((i + 20, f"http://b.example.com/{i}", f"{HEAD}<div id='top'>x</div><div id='page'>{body}<div>{long}</div></div></body></html>"))
        wanted[i + 20] = f"{prose(i, 70)}\n\n{prose(i + 50, 8)}"
    # a page without the notices, and one whose notice is another
    for i, notice in ((40, ""), (41, "<div class='k7'><p>Closed today</p></div>")):
        rows.append((i, f"http://a.example.com/{i}", f"{HEAD}<nav>n</nav><article><h1>T {i}</h1><p>{prose(i, 70)}</p>{notice}</article></body></html>"))
        wanted[i] = f"T {i}\n\n{prose(i, 70)}" + ("\n\nClosed today" if notice else "")
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in template.main_texts(frame).collect()} == wanted


ARTICLE = "The whole article stands here, and it is longer than all that stands beside it. " * 3


def alone(html):
    page = template.Page(html)
    return template.extract(page, template.choose(*template._own_text(page))[0], set())


def test_no_name_costs_an_article():
    for html in ('<article><p class="ad-hoc">{}</p></article>', '<article><section class="share-price">{}</section></article>',
                 '<body class="has-sidebar no-header"><article>{}</article>', '<div id="content"><div class="related-work">{}</div></div>',
                 '<form id="aspnetForm"><div class="article">{}</div></form>', '<body><form><div><p>{}</p></div></form>',
                 '<div class="modal"><article>{}</article></div><p>x</p>', '<article><div class="share">{}</div></article>'):
        assert alone(html.format(ARTICLE)) == ARTICLE.strip(), html


def test_parts_beside_the_article_go():
    html = (f'<article><p>{ARTICLE}</p><ins class="adsbygoogle">ad</ins><div class="signup">s</div><div role="navigation">n</div>'
            '<div role="complementary">c</div><div id="respond">r</div><div class="share-buttons">b</div>'
            f'<div class="comment-list"><article>{ARTICLE * 3}</article></div></article>')
    assert alone(html) == ARTICLE.strip()
    assert alone('<article>text <button>x</button> y</article>') == "text y"
    assert alone("<article><p>short</p></article><div class='comments'><article>" + ARTICLE + "</article></div>") == "short"


def test_malformed_pages(spark):
    rows = [(1, "http://x.example.com/1", "<article><p>a <![foo[ x ]]> b</p>"), (2, "http://x.example.com/2", "<p>z</p>" + "<a " * 20_000),
            (3, "http://x.example.com/3", "<p>z</p>" + "<!--" * 20_000), (4, "http://x.example.com/4", "&#" + "9" * 9000 + ";"),
            (5, "http://x.example.com/5", "<p>one <b class='a/b c'>two</p")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in template.main_texts(frame).collect()}
    assert got == {1: "a b", 2: "z", 3: "z", 4: "�", 5: "one two"}


def test_deep_pages_are_read_in_time():
    for html in ("<div>" * 100_000 + ARTICLE, "".join(f"<div class='c{i}'>" for i in range(50_000)) + ARTICLE,
                 "<table><tr><td>" * 20_000 + ARTICLE, "<ul><li>" * 40_000 + ARTICLE, "<b>" * 50_000 + ARTICLE):
        begin = time.perf_counter()
        assert alone(html) == ARTICLE.strip()
        assert time.perf_counter() - begin < 15
    deep = "<article>" + "<div>" * 90 + f"{ARTICLE}<script>x</script><div class='comments'>no</div>"
    assert alone(deep) == ARTICLE.strip()


def test_the_template_decides_where_no_name_does(spark):
    """Hosts without marks or known names: the notice goes by its class, which no single page can tell."""
    pages = [(i, f"http://n.example.com/{i}", f"{HEAD}<div id='k1'><div class='k2'>Printed on our own paper since then</div>"
              f"<p>{prose(i, 50)}</p></div><div id='k3'><a href='/'>Home</a></div></body></html>") for i in range(6)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in template.main_texts(frame).collect()}
    assert got == {i: prose(i, 50) for i in range(6)}
    assert all("Printed" in alone(html) for _, _, html in pages)
    # the classes, by brute force: tokens that occur equally often on each page of the host
    counts = [Counter(t["token"] for t in tokens) for tokens in page_tokens(pages)]
    everywhere = {t for t in counts[0] if all(t in c for c in counts)}
    fixed = {r["host"]: set(r["fixed"]) for r in template.templates(frame).collect()}["n.example.com"]
    assert fixed and fixed <= everywhere


def page_tokens(pages):
    batch = pa.RecordBatch.from_arrays([pa.array(["h"] * len(pages)), pa.array([p[2] for p in pages]), pa.array(range(len(pages)))],
                                       ["host", "html", "page"])
    return [t for b in template._tokens([batch]) for t in b.column(2).to_pylist()]
