"""Extraction from tables of fetched pages: one parse of each page, in Arrow batches; the rest is native."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean_motivation, country_from_place, distinct_paragraphs, drop_boilerplate, parse_date, trim_all

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "h1", "h2", "h3", "h4", "li", "div", "td"}
BLOCKS = "array<struct<tag: string, cls: string, path: string, text: string>>"


class _Blocks(HTMLParser):
    """Text of each block element in order, with its tag, its class and the classes and tags around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.links: list[dict] = []
        self.stack: list[tuple[str, str]] = []
        self.open: list[int] = []
        self.skip = 0
        self.link: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "p":  # an open paragraph ends where the next begins
            self._close("p")
        if tag == "a":
            self.link = {"href": a.get("href") or "", "text": ""}
            self.links.append(self.link)
        if tag == "br" and self.open:
            self.out[self.open[-1]]["text"] += "\n"
        if tag in _BLOCK:
            self.out.append({"tag": tag, "cls": a.get("class") or "", "path": " ".join(f"{t}.{c}" if c else t for t, c in self.stack), "text": ""})
            self.open.append(len(self.out) - 1)
        if tag not in _VOID:
            self.stack.append((tag, a.get("class") or ""))

    def _close(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, _ = self.stack.pop()
                if t in _BLOCK and self.open:
                    self.open.pop()
                if t == tag:
                    break

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "a":
            self.link = None
        self._close(tag)

    def handle_data(self, data):
        if self.skip:
            return
        if self.link is not None:
            self.link["text"] += data
        if self.open:
            self.out[self.open[-1]]["text"] += data


def parse_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with blocks (tag, cls, path, text) and links (href, text)."""
    rest = [c for c in pages.columns if c != html_col]
    shaped = pages.select(*rest, F.coalesce(F.col(html_col), F.lit("")).alias(html_col))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                blocks, links = [], []
                for page in part.column(len(rest)).to_pylist():
                    p = _Blocks()
                    p.feed(page)
                    p.close()
                    blocks.append([b | {"text": b["text"].strip()} for b in p.out])
                    links.append([x | {"text": x["text"].strip()} for x in p.links])
                s = pa.string()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(rest))), pa.array(blocks, pa.list_(pa.struct([("tag", s), ("cls", s), ("path", s), ("text", s)]))), pa.array(links, pa.list_(pa.struct([("href", s), ("text", s)])))],
                    [*rest, "blocks", "links"],
                )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html_col]
    return shaped.mapInArrow(run, ", ".join([*schema, f"blocks {BLOCKS}", "links array<struct<href: string, text: string>>"]))


def _texts(blocks: Column, *tags: str) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["tag"].isin(*tags) & (b["text"] != "")), lambda b: b["text"])


def facts(blocks: Column) -> Column:
    """born, died, birth_place, country, motivation, language from a facts page's paragraphs."""
    ps = _texts(blocks, "p")
    line = lambda key: F.get(F.filter(ps, lambda t: F.lower(t).startswith(key)), 0)
    place = F.nullif(trim_all(F.regexp_extract(line("born:"), r"\d{4},\s*(.*)$", 1)), F.lit(""))
    after = lambda key: F.nullif(trim_all(F.regexp_replace(line(key), r"^[^:]*:", "")), F.lit(""))
    return F.struct(
        parse_date(line("born:")).alias("born"), parse_date(line("died:")).alias("died"), place.alias("birth_place"), country_from_place(place).alias("country"),
        clean_motivation(after("prize motivation:")).alias("motivation"), after("language:").alias("language"),
    )


def section(blocks: Column, heading: str) -> Column:
    """Paragraphs between an h3 with this title and the next heading, each once; empty text if there is none."""
    at = F.array_position(F.transform(blocks, lambda b: b["tag"].isin("h3") & (F.lower(b["text"]) == heading.lower())), True).cast("int")
    rest = F.slice(blocks, at + 1, F.size(blocks))
    stop = F.array_position(F.transform(rest, lambda b: b["tag"].isin("h1", "h2", "h3")), True).cast("int")
    inside = F.when(stop > 0, F.slice(rest, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rest)
    return F.when(at > 0, distinct_paragraphs(F.array_join(_texts(inside, "p"), "\n"))).otherwise("")


def main_text(blocks: Column, least_words: int = 50) -> Column:
    """Paragraphs of the first of article, content, main with more than least_words words; else of the whole page; null if too short."""

    def within(word: str) -> Column:
        return F.array_join(F.transform(F.filter(blocks, lambda b: (b["tag"] == "p") & F.contains(b["path"], F.lit(word))), lambda b: b["text"]), "\n")

    some = [F.when(F.size(F.split(c, r"\s+")) > least_words, c) for c in (within("article"), within("content"), within("main"), F.array_join(_texts(blocks, "p"), "\n"))]
    return F.coalesce(*some)


def article(blocks: Column) -> Column:
    """title (second h2, else h1) and body: paragraphs after the first, without citation ones."""
    title = F.coalesce(F.get(_texts(blocks, "h2"), 1), F.get(_texts(blocks, "h1"), 0))
    ps = F.filter(blocks, lambda b: (b["tag"] == "p") & (b["text"] != "") & ~F.contains(F.lower(b["cls"]), F.lit("citation")))
    return F.struct(title.alias("title"), F.array_join(F.transform(F.slice(ps, 2, F.size(ps)), lambda b: b["text"]), "\n").alias("body"))


def speech_span(blocks: Column, salutations: tuple[str, ...], stops: tuple[str, ...] = ("to cite this section", "copyright", "back to top")) -> Column:
    """Paragraphs from the first that opens with a salutation (else the first) up to the first stop."""
    ps = _texts(blocks, "p")
    opens = F.array_position(F.transform(ps, lambda t: F.lower(t).rlike("^(" + "|".join(salutations) + ")")), True).cast("int")
    rest = F.slice(ps, F.greatest(opens, F.lit(1)), F.size(ps))
    end = F.array_position(F.transform(rest, lambda t: F.lower(t).rlike("|".join(stops))), True).cast("int")
    return F.array_join(F.when(end > 0, F.slice(rest, 1, F.greatest(end - 1, F.lit(0)))).otherwise(rest), "\n")


def transcript(blocks: Column, least_words: int = 50, award: str | None = None) -> Column:
    """title and text without boilerplate; text is null below least_words words."""
    body = drop_boilerplate(F.array_join(_texts(blocks, "p"), "\n"), award=award)
    return F.struct(F.get(_texts(blocks, "h1", "h2"), 0).alias("title"), F.when(F.size(F.split(body, r"\s+")) >= least_words, body).alias("text"))


def pick_links(links: Column, base: str, ends: str, href_has: str = "", text_has: str = "") -> Column:
    """Absolute addresses of links whose href ends so and contains, and whose text contains."""
    hit = F.filter(links, lambda x: F.lower(x["href"]).endswith(ends) & F.contains(F.lower(x["href"]), F.lit(href_has)) & F.contains(F.lower(x["text"]), F.lit(text_has)))
    return F.transform(hit, lambda x: F.when(x["href"].rlike("^https?://"), x["href"]).otherwise(F.concat(F.lit(base), x["href"])))


def absence(blocks: Column, not_found: str = "page not found", not_given: str = "did not deliver") -> Column:
    """delivered and reason: missing_page, not_delivered, no_text, or delivered."""
    body = F.lower(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"))
    reason = F.when(F.contains(body, F.lit(not_found)), "missing_page").when(F.contains(body, F.lit(not_given)), "not_delivered").when(trim_all(body) == "", "no_text")
    return F.struct(reason.isNull().alias("delivered"), reason.alias("reason"))


def title_of(html: Column) -> Column:
    """Text of the title element as it stands in the source."""
    return F.nullif(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), F.lit(""))


def hrefs(html: Column) -> Column:
    """All href values in double quotes, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))
