"""Result pages, good and broken ones."""

import json
from datetime import date

import pytest

from subsetlab.sources import result_pages as rp
from subsetlab.sources.pages import parse_official

BALLS = "".join(f'<span class="bong_tron">{x:02d}</span>' for x in (9, 2, 3, 44, 5, 6))
END = '<span class="bong_tron-sperator">|</span><span class="bong_tron active">07</span>'
GOOD = f"<tr><td>01/08/2017</td><td><a href='/x?a=1&amp;b=2'>#00012</a></td><td><div>{BALLS}<i></i>{END}</div></td></tr>"


def page(html, **more):
    return json.dumps({"value": {"Error": False, "HtmlContent": html} | more})


def table(*rows):
    return page(f"<div><table class=x><thead><tr><th>Day</th></tr></thead><tbody>{''.join(rows)}</tbody></table></div>")


def row(day="01/08/2017", ident="12", balls=BALLS + END):
    return f"<tr><td>{day}</td><td>{ident}</td><td>{balls}</td></tr>"


def parsed(content):
    return list(rp.ParsePage().eval(content))


WHOLE = ("00012", date(2017, 8, 1), [2, 3, 5, 6, 9, 44], 7, None)


@pytest.mark.parametrize("html", [
    GOOD, GOOD.upper().replace("CLASS=\"BONG_TRON", "CLASS=\"bong_tron").replace("SPERATOR", "sperator").replace(" ACTIVE", " active"),
    GOOD.replace("</td>", "").replace("</tr>", ""), GOOD.replace("01/08/2017", "<b>01/08</b><!-- </td> -->/2017"), GOOD.replace("<td>", "<td\n class='a>b'>"),
    GOOD.replace("09</span>", "<b>0<span>9</span></b></span>"), GOOD.replace("00012", "&#49;2").replace("#", "", 1),
])
def test_rows_that_patterns_miss(html):
    assert parsed(table(html)) == [WHOLE]


@pytest.mark.parametrize(("content", "error"), [
    ("<html>busy</html>", rp.NOT_JSON), (None, rp.NOT_JSON), ("{}", rp.NO_TABLE), ("[1]", rp.NO_TABLE), (json.dumps({"value": {"Error": True, "InfoMessage": "x"}}), rp.REPORTED),
    (page("<p>nothing</p>"), rp.NO_TABLE), (page(None), rp.NO_TABLE), (table(row(day="31/02/2017")), rp.NO_DATE), (table(row(day="")), rp.NO_DATE), (table(row(ident="x1")), rp.NO_ID),
    (table("<tr><td>01/08/2017</td></tr>"), rp.NO_ID), (table(row(balls=BALLS.replace("44", "4a") + END)), rp.NO_NUMBER), (table(row(balls=BALLS + END + END)), rp.MANY),
    (table(row(balls="")), rp.NONE), (table(row(balls=BALLS[:120])), rp.NOT_SIX), (table(row(balls=BALLS + '<span class="separator"></span>')), rp.EMPTY_END),
])
def test_each_error(content, error):
    found = parsed(content)
    assert [r[4] for r in found] == [error]


def test_pages_without_rows():
    assert parsed(page("")) == parsed(page(" \n")) == parsed(table()) == []


def test_a_table_inside_a_cell_is_text():
    inner = "<table><tr><td>x</td></tr></table>"
    assert parsed(table(row(ident="12", balls=inner + BALLS + END), row(ident="13"))) == [WHOLE, ("00013", *WHOLE[1:])]
    assert parsed(page(f"<table>{row()}</table><table>{row(ident='99')}</table>")) == [WHOLE]


def test_pages_as_a_table(spark):
    rows = [("a", table(row(), row(ident="13", day="x"))), ("b", page("")), ("c", None), ("c", None)]
    got = parse_official(spark.createDataFrame(rows, "file string, content string")).collect()
    assert sorted(((r["file"], r["draw_id"], r["error"]) for r in got), key=str) == sorted([("a", "00012", None), ("a", "00013", rp.NO_DATE), ("c", None, rp.NOT_JSON), ("c", None, rp.NOT_JSON)], key=str)
    first = next(r for r in got if r["draw_id"] == "00012")
    assert (first["draw_date"], first["main"], first["special"], first["source"]) == (date(2017, 8, 1), [2, 3, 5, 6, 9, 44], 7, "official")
