"""Pages as table functions: one page, many rows, joined laterally.

``page_rows`` reads a page in one of three dialects and gives its rows the dialect's columns; ``list_entries`` walks the
pages of a list in order and gives each entry once.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

LEVELS = {f"h{k}": k for k in range(1, 7)}
SKIPPED = {"script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "li", "br", "tr", "section", "article", "td", "th", "dt", "dd", "ul", "ol", "table", *LEVELS}
#: The columns of each dialect's rows.
_INT, _TEXT = IntegerType(), StringType()
DIALECTS = {
    "sections": (("position", _INT), ("depth", _INT), ("path", _TEXT), ("heading", _TEXT), ("text", _TEXT), ("links", _INT)),
    "cards": (("position", _INT), ("href", _TEXT), ("label", _TEXT), ("heading", _TEXT)),
    "fields": (("position", _INT), ("label", _TEXT), ("value", _TEXT), ("heading", _TEXT)),
}


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Walk(HTMLParser):
    """Sections by a stack of open headings, links in list items, and labelled fields, in one walk."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections = [{"depth": 0, "path": [], "heading": [], "text": [], "links": 0}]
        self.open: list[dict] = []
        self.cards: list[dict] = []
        self.fields: list[dict] = []
        self.skipped: list[str] = []
        self.items = 0
        self.heading = self.card = self.label = self.value = None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED or tag == "title":
            self.skipped.append(tag)
        if tag in LEVELS:
            while self.open and self.open[-1]["depth"] >= LEVELS[tag]:
                self.open.pop()
            self.heading = {"depth": LEVELS[tag], "path": [s["heading"] for s in self.open], "heading": [], "text": [], "links": 0}
            self.open.append(self.heading)
            self.sections.append(self.heading)
        elif tag in BLOCKS:
            self.sections[-1]["text"].append(" ")
        if tag == "li":
            self.items += 1
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.sections[-1]["links"] += 1
            if self.items:
                self.card = {"href": href.strip(), "label": [], "heading": self.sections[-1]["heading"]}
                self.cards.append(self.card)
        if tag in ("dt", "th"):
            self.label, self.value = [], None
        elif tag in ("dd", "td") and self.label is not None:
            self.value = []
            self.fields.append({"label": self.label, "value": self.value, "heading": self.sections[-1]["heading"]})

    def handle_endtag(self, tag):
        if self.skipped and self.skipped[-1] == tag:
            self.skipped.pop()
        if tag in LEVELS:
            self.heading = None
        elif tag in BLOCKS:
            self.sections[-1]["text"].append(" ")
        if tag == "li":
            self.items = max(0, self.items - 1)
        elif tag == "a":
            self.card = None
        elif tag in ("dd", "td"):
            self.value = None
        elif tag in ("tr", "dl"):
            self.label = self.value = None

    def handle_data(self, data):
        if self.skipped:
            return
        if self.heading is not None:
            self.heading["heading"].append(data)
        else:
            self.sections[-1]["text"].append(data)
        if self.card is not None:
            self.card["label"].append(data)
        if self.value is not None:
            self.value.append(data)
        elif self.label is not None:
            self.label.append(data)


def read(html: str | None, dialect: str) -> list[tuple]:
    """A page's rows in a dialect; a null page has none."""
    if html is None:
        return []
    page = _Walk()
    page.feed(html)
    page.close()
    if dialect == "sections":
        rows = [(s["depth"], " / ".join(filter(None, map(_clean, s["path"]))), _clean(s["heading"]), _clean(s["text"]), s["links"]) for s in page.sections]
        rows = [r for r in rows if r[2] or r[3] or r[4]]
    elif dialect == "cards":
        rows = [(c["href"], _clean(c["label"]), _clean(c["heading"])) for c in page.cards]
    else:
        rows = [(_clean(f["label"]).rstrip(":"), _clean(f["value"]), _clean(f["heading"])) for f in page.fields]
        rows = [r for r in rows if r[0]]
    return [(k, *r) for k, r in enumerate(rows)]


class PageRows:
    """``page_rows(html, dialect)``; the dialect is a constant and says what columns the rows have."""

    @staticmethod
    def analyze(html: AnalyzeArgument, dialect: AnalyzeArgument) -> AnalyzeResult:
        if dialect.value not in DIALECTS:
            raise ValueError(f"dialect must be one of {sorted(DIALECTS)}")
        return AnalyzeResult(StructType([StructField(*column) for column in DIALECTS[dialect.value]]))

    def eval(self, html, dialect):
        yield from read(html, dialect)


class ListEntries:
    """``list_entries(TABLE(entries) PARTITION BY list ORDER BY page, position)``: entries of all pages of a list, each
    href once, where it is first seen.  entries: list, page, position, href."""

    @staticmethod
    def analyze(entries: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in entries.dataType.fields}
        missing = {"list", "page", "position", "href"} - set(kinds)
        if missing:
            raise ValueError(f"entries lack {sorted(missing)}")
        return AnalyzeResult(StructType().add("list", kinds["list"]).add("place", _INT).add("page", kinds["page"]).add("href", _TEXT).add("seen", _INT))

    def __init__(self):
        self.list = None
        self.seen: dict[str, list] = {}

    def eval(self, row):
        self.list = row["list"]
        if row["href"] is not None:
            self.seen.setdefault(row["href"], [row["page"], 0])[1] += 1

    def terminate(self):
        for place, (href, (page, seen)) in enumerate(self.seen.items()):
            yield self.list, place, page, href, seen


def register(spark: SparkSession) -> None:
    """Makes both functions known to SQL."""
    spark.udtf.register("page_rows", F.udtf(PageRows))
    spark.udtf.register("list_entries", F.udtf(ListEntries))


def rows(pages: DataFrame, dialect: str, html: str = "html") -> DataFrame:
    """The pages' columns but ``html``, and each page's rows in a dialect; pages without rows have none."""
    return pages.lateralJoin(F.udtf(PageRows)(F.col(html).outer(), F.lit(dialect))).drop(html)


def listed(entries: DataFrame) -> DataFrame:
    """Each list's entries once, in order of its pages (see ``ListEntries``)."""
    return F.udtf(ListEntries)(entries.asTable().partitionBy("list").orderBy("page", "position"))
