import time

from hypothesis import given, settings
from hypothesis import strategies as st

from boardstat.frames import literal_frame
from boardstat.functions.markup import END, START, TEXT, events
from boardstat.operators import text as tx

PIECES = ["<", ">", "<!", "<![foo[", "]]>", "<!--", "-->", "</", "<a ", "<td>", "</td>", "<script>", "</script", "&#x41;",
          "&#999999999999;", '"', "'", "=", "/", "x", " ", "\n", "é", "<title>", "<?php"]


def shown(html):
    return list(events(html))


def test_tags_texts_and_comments():
    assert shown("<P Class=a CLASS=b>x &lt; y</p>") == [(START, "p", {"class": "a"}), (TEXT, "x < y"), (END, "p")]
    assert shown("a <![foo[ x ]]> b") == [(TEXT, "a "), (TEXT, " b")]
    assert shown("1 < 2 <3") == [(TEXT, "1 < 2 <3")]
    assert shown("<br/><a href='x>y' b=\"c d\" e=f g>t") == [
        (START, "br", {}), (END, "br"), (START, "a", {"href": "x>y", "b": "c d", "e": "f", "g": ""}), (TEXT, "t")]
    assert shown("<!-->a<!--->b<!-- > -- -->c<!-- d") == [(TEXT, "a"), (TEXT, "b"), (TEXT, "c")]
    assert shown("<script>if (a</b>) '</p>'</SCRIPT >x") == [(START, "script", {}), (TEXT, "if (a</b>) '</p>'"), (END, "script"), (TEXT, "x")]
    assert shown("<title>a<b>") == [(START, "title", {}), (TEXT, "a"), (START, "b", {})]
    assert shown("&#" + "9" * 10_000 + ";") == [(TEXT, "�")]
    assert shown("x<b") == [(TEXT, "x")] and shown("") == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60))
def test_every_string_is_a_page(parts):
    assert all(e[0] in (TEXT, START, END) for e in events("".join(parts)))


def test_time_grows_with_the_length():
    for piece in ("<a ", "<!--", '<a b="', "<", "<title>", "<!", "<a b     ", "=", "&", "<a '"):
        begin = time.perf_counter()
        shown("<a " * (piece == "=") + piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - begin < 8, piece


def test_tables_of_malformed_pages(spark):
    row = "<tr><td>{}</td><td>10</td><td>5</td><td>50.00%</td></tr>"
    table = "<table>" + row.format("School") + row.format("Total") + row.format("A College") + "</table>"
    pages = [(1, f"<p>a <![foo[ x ]]>{table}"), (2, table + "<a " * 50_000), (3, "<table><tr><td>" * 20_000), (4, "<table" + "<!--" * 9)]
    got = tx.html_tables(literal_frame(spark, {"page_id": "long", "html": "string"}, pages)).collect()
    assert sorted((r.page_id, r.school, r.takers, r.passers) for r in got) == [(1, "A College", 10, 5), (2, "A College", 10, 5)]
