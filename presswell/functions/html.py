"""HTML by a parser, where patterns aren't enough. Python runs for fields with tags only."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Parser(HTMLParser):
    """Takes ``<![`` without a known section name for a comment up to the next ``>``, as HTML 5 does; the library raises there."""

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)


class _Text(_Parser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_text(html: str | None) -> str | None:
    """Text nodes joined by blanks, entities decoded, scripts and styles left out; without < and > the text itself."""
    if html is None or ("<" not in html and ">" not in html):
        return html
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(parser.parts)


def strip_html(df: DataFrame, column: str) -> DataFrame:
    """``df`` (with an ``id``) as (id, column) with the column's visible text."""
    tagged = F.col(column).contains("<") | F.col(column).contains(">")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], column: [visible_text(x) for x in frame[column]]})

    rows = df.select("id", column)
    parsed = rows.where(tagged).mapInPandas(run, f"id long, {column} string")
    return parsed.unionByName(rows.where(~F.coalesce(tagged, F.lit(False))))


class _Listing(_Parser):
    """Articles of a listing page: a link around a title, a teaser and a date."""

    FIELDS = {("h3", "cat_title"): "title", ("p", "text-dark"): "content", ("h4", "text-secondary"): "date"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict[str, str]] = []
        self.links: list[str | None] = []
        self.open: str | None = None
        self.tag = ""

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "a":
            self.links.append(found.get("href"))
        for (name, css), field in self.FIELDS.items():
            if tag == name and css in (found.get("class") or "").split():
                if field == "title":
                    self.rows.append({"title": "", "content": "N/A", "date": "N/A", "link": next((x for x in reversed(self.links) if x), None) or "N/A"})
                if self.rows:
                    self.open, self.tag = field, tag
                    self.rows[-1][field] = ""

    def handle_endtag(self, tag):
        if tag == "a" and self.links:
            self.links.pop()
        if self.open and tag == self.tag:
            self.rows[-1][self.open] = " ".join(self.rows[-1][self.open].split()) or "N/A"
            self.open = None

    def handle_data(self, data):
        if self.open:
            self.rows[-1][self.open] += data


def parse_listings(pages: DataFrame) -> DataFrame:
    """(title, content, date, link) of the articles on stored listing pages (html); what a page lacks is 'N/A', rows without a link are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for html in frame["html"]:
                parser = _Listing()
                parser.feed(html or "")
                parser.close()
                rows.extend(r for r in parser.rows if r["link"] != "N/A")
            yield pd.DataFrame(rows, columns=["title", "content", "date", "link"])

    return pages.select("html").mapInPandas(run, "title string, content string, date string, link string")
