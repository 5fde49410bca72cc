"""Result pages as a state machine: JSON with an HTML table in it, read by the standard library's parser.

The parser follows tags as they come, so nested tags, entities, comments, upper-case names, missing end tags and line
breaks inside tags need no pattern. It stays in the first table that isn't inside another one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from html.parser import HTMLParser

from subsetlab.model import K

#: Classes of spans that hold a number, and of the one before the special number. Fixed values of the page format.
BALLS = {"ball", "bong_tron"}
SEPARATORS = {"separator", "bong_tron-sperator"}
#: What a page or a row can have wrong.
NOT_JSON, REPORTED, NO_TABLE = "not JSON", "the page reports an error", "no table in the page"
NO_ID, NO_DATE, NO_NUMBER = "no id in the row", "no date in the row", "a ball is no number"
NONE, NOT_SIX, EMPTY_END, MANY = "no numbers in the row", "not six numbers in the row", "nothing after the separator", "more than one special number"
Parsed = tuple[str | None, date | None, list[int] | None, int | None, str | None]


@dataclass
class TableRow:
    """Cells' texts, and the balls of the third cell: texts, and None for the separator."""

    cells: list[str] = field(default_factory=list)
    balls: list[str | None] = field(default_factory=list)


class ResultTable(HTMLParser):
    """Collects the rows of the first table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[TableRow] = []
        #: Tables that are open (0: none yet), and whether the first one has ended.
        self.tables, self.over = 0, False
        self.in_cell, self.span = False, 0
        self.ball: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.over:
            return
        if tag == "table":
            self.tables += 1
        elif self.tables == 1 and tag == "tr":
            self._end_cell()
            self.rows.append(TableRow())
        elif self.tables == 1 and tag == "td":
            self._end_cell()
            if not self.rows:
                self.rows.append(TableRow())
            self.rows[-1].cells.append("")
            self.in_cell = True
        elif tag == "span" and self.in_cell:
            classes = {c for name, value in attrs if name == "class" for c in (value or "").split()}
            if self.ball is not None:
                self.span += 1
            elif len(self.rows[-1].cells) == 3 and classes & SEPARATORS:
                self.rows[-1].balls.append(None)
            elif len(self.rows[-1].cells) == 3 and classes & BALLS:
                self.ball, self.span = "", 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables:
                self._end_cell()
                self.over = True
        elif self.tables == 1 and tag in ("td", "tr", "tbody"):
            self._end_cell()
        elif tag == "span" and self.ball is not None:
            self.span -= 1
            if not self.span:
                self._end_ball()

    def handle_data(self, data: str) -> None:
        if self.in_cell and not self.over:
            self.rows[-1].cells[-1] += data
            if self.ball is not None:
                self.ball += data

    def close(self) -> None:
        super().close()
        self._end_cell()

    def _end_ball(self) -> None:
        if self.ball is not None:
            self.rows[-1].balls.append(self.ball.strip())
        self.ball, self.span = None, 0

    def _end_cell(self) -> None:
        self._end_ball()
        self.in_cell = False


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() else None


def record_of(row: TableRow) -> Parsed:
    """Return draw_id, date, sorted numbers, special number and what is wrong with a table row."""
    cells = [c.strip() for c in row.cells]
    number = _number(cells[1].removeprefix("#").strip()) if len(cells) > 1 else None
    draw_id = None if number is None else str(number).zfill(5)
    try:
        day = datetime.strptime(cells[0], "%d/%m/%Y").date()
    except ValueError:
        day = None
    cut = row.balls.index(None) if None in row.balls else len(row.balls)
    texts, after = row.balls[:cut], [b for b in row.balls[cut:] if b is not None]
    values, special = [_number(b) for b in texts], [_number(b) for b in after]
    error = None
    if draw_id is None:
        error = NO_ID
    elif day is None:
        error = NO_DATE
    elif None in values or None in special:
        error = NO_NUMBER
    elif not values:
        error = NONE
    elif len(values) != K:
        error = NOT_SIX
    elif cut < len(row.balls) and not special:
        error = EMPTY_END
    elif len(special) > 1:
        error = MANY
    return draw_id, day, sorted(v for v in values if v is not None), special[0] if special else None, error


class ParsePage:
    """A table function: a page's content to its records, or to one row that says what is wrong with the page.

    A page without any HTML has no rows: it is the one after the last. Rows without cells (headings) are none.
    """

    def eval(self, content: str | None) -> Iterator[Parsed]:
        wrong = lambda text: (None, None, None, None, text)
        try:
            whole = json.loads(content or "")
        except ValueError:
            yield wrong(NOT_JSON)
            return
        value = whole.get("value") if isinstance(whole, dict) else None
        if not isinstance(value, dict):
            yield wrong(NO_TABLE)
            return
        if value.get("Error"):
            yield wrong(REPORTED)
            return
        html = value.get("HtmlContent")
        if isinstance(html, str) and not html.strip():
            return
        parser = ResultTable()
        parser.feed(html if isinstance(html, str) else "")
        parser.close()
        if not parser.tables and not parser.over:
            yield wrong(NO_TABLE)
            return
        for row in parser.rows:
            if row.cells:
                yield record_of(row)
