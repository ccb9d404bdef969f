"""Web pages, sitemaps, feeds and files as rows.

Pages go through the standard library's HTML parser in Arrow batches, a page at a time; all that
follows (urls, dates, money) is Column work on the parsed rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "noscript", "template"}
HEADINGS = {"h1", "h2", "h3", "h4"}
BLOCKS = {"p", "div", "li", "br", "tr", "section", "article", "td", *HEADINGS}
PAGE = "title string, headings array<string>, links array<struct<href:string,text:string>>, text string"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.headings, self.links, self.text = [], [], [], []
        self.inside: list[str] = []
        self.link: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED or tag == "title" or tag in HEADINGS:
            self.inside.append(tag)
            if tag in HEADINGS:
                self.headings.append("")
        if tag in BLOCKS:
            self.text.append("\n")
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.link = [href, ""]
            self.links.append(self.link)

    def handle_endtag(self, tag):
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()
        if tag == "a":
            self.link = None
        if tag in BLOCKS:
            self.text.append("\n")

    def handle_data(self, data):
        now = self.inside[-1] if self.inside else ""
        if now in SKIPPED:
            return
        if now == "title":
            self.title.append(data)
            return
        if now in HEADINGS:
            self.headings[-1] += data
        if self.link is not None:
            self.link[1] += data
        self.text.append(data)


def _clean(text: str) -> str:
    return " ".join(text.split())


def _read(html: str | None) -> tuple:
    page = _Page()
    page.feed(html or "")
    page.close()
    lines = (_clean(x) for x in "".join(page.text).split("\n"))
    return _clean("".join(page.title)), [h for h in map(_clean, page.headings) if h], [{"href": h.strip(), "text": _clean(t)} for h, t in page.links], "\n".join(x for x in lines if x)


def parsed(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The carried columns, and each page's title, headings, links and visible text."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = pd.DataFrame(map(_read, pdf[html]), columns=["title", "headings", "links", "text"], index=pdf.index)
            yield pd.concat([pdf[list(carry)], got], axis=1)

    schema = ", ".join(f"`{c}` {dict(pages.dtypes)[c]}" for c in carry) + ", " + PAGE
    return pages.select(*carry, html).mapInPandas(of, schema)


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, href, text): a row per distinct link of a parsed page, its first text kept."""
    rows = pages.select(key, F.posexplode("links").alias("position", "link")).select(key, "position", "link.*")
    return rows.groupBy(key, "href").agg(F.min_by("text", "position").alias("text"), F.min("position").alias("position"))


def next_pages(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, next_url): a page's link to the next page of its list; links back to the page itself
    are no next page, so a pager cannot loop on one page."""
    rows = pages.select(key, url, F.explode("links").alias("link")).where(F.lower("link.text").rlike(r"^(next|older|следующая|далее|»|›)") | F.col("link.href").rlike(r"[?&]page=\d+"))
    return rows.where(F.col("link.href") != F.col(url)).groupBy(key).agg(F.min("link.href").alias("next_url"))


def sitemap(files: DataFrame, prefix: str) -> DataFrame:
    """(url, lastmod, copies) of a sitemap's entries under ``prefix``, each once."""
    xml = F.col("content").cast("string")
    bare = F.regexp_replace(xml, r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    locs, mods = F.expr("xpath(bare, '/urlset/url/loc/text()')"), F.expr("xpath(bare, '/urlset/url/lastmod/text()')")
    rows = files.select(bare.alias("bare")).select(F.explode(F.arrays_zip(locs.alias("loc"), mods.alias("lastmod"))).alias("u")).select(F.trim("u.loc").alias("url"), F.col("u.lastmod").try_cast("timestamp").alias("lastmod"))
    return rows.where(F.col("url").startswith(prefix)).groupBy("url").agg(F.max("lastmod").alias("lastmod"), F.count(F.lit(1)).alias("copies"))


def feed_messages(pages: DataFrame) -> DataFrame:
    """(channel, message_id, published_at, text, links) of a channel's public pages."""
    # One block per message: it opens with its address, and holds a time and a text.
    blocks = F.split("html", r'data-post="')
    rows = pages.where("html is not null").select("url", F.explode(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("b"))
    post = F.regexp_extract("b", r'^([^"/]+/\d+)"', 1)
    body = F.regexp_extract("b", r'(?s)<div class="[^"]*message_text[^"]*"[^>]*>(.*?)</div>', 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"<br\s*/?>", "\n"), r"<[^>]+>", ""))
    links = F.array_distinct(F.regexp_extract_all(body, F.lit(r'href="(https?://[^"]+)"'), F.lit(1)))
    return rows.where(post != "").select(
        F.split_part(post, F.lit("/"), F.lit(1)).alias("channel"), F.split_part(post, F.lit("/"), F.lit(2)).cast("long").alias("message_id"),
        F.regexp_extract("b", r'datetime="([^"]+)"', 1).try_cast("timestamp").alias("published_at"), text.alias("text"), links.alias("links"),
    )


ARTIFACT = "kind string, n_entries int, excerpt string, problem string"


def artifacts(files: DataFrame, most_bytes: int = 20 << 20, most_entries: int = 200, most_chars: int = 4000) -> DataFrame:
    """(path, length, sha256, kind, n_entries, excerpt, problem) of captured files (``binaryFile``).

    HTML gives its text, Office archives the text of their parts, within the bounds; a larger or
    damaged file keeps its row and says why.  PDF text is not read.
    """

    def inspect(body: bytes) -> tuple:
        import io
        import re
        import zipfile

        if len(body) > most_bytes:
            return "unread", 0, None, "too_large"
        if body[:4] == b"%PDF":
            return "pdf", 0, None, None
        if body[:2] == b"PK":
            try:
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    names = z.namelist()
                    if len(names) > most_entries:
                        return "zip", len(names), None, "too_many_entries"
                    if sum(i.file_size for i in z.infolist()) > most_bytes:
                        return "zip", len(names), None, "too_large_unpacked"
                    inner = [n for n in names if re.fullmatch(r"(word/document|xl/sharedStrings|ppt/slides/slide\d+)\.xml", n)]
                    text = " ".join(re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "replace")) for n in inner)
                    return "office" if inner else "zip", len(names), _clean(text)[:most_chars] or None, None
            except zipfile.BadZipFile:
                return "zip", 0, None, "damaged"
        title, _, _, text = _read(body.decode("utf-8", "replace"))
        return "html", 1, _clean(f"{title} {text}")[:most_chars], None

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = pd.DataFrame(map(inspect, pdf["content"]), columns=["kind", "n_entries", "excerpt", "problem"], index=pdf.index)
            yield pd.concat([pdf[["path", "length", "sha256"]], got], axis=1)

    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content").mapInPandas(of, "path string, length long, sha256 string, " + ARTIFACT)
