"""Pages of HTML to element rows: one tokenizer pass a page, in Arrow batches.

Only what the markup says is produced; layout (boxes, computed visibility) is not in HTML and stays null. Script,
style, noscript and svg content is skipped, void elements and the usual unclosed ones are closed, entities decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
SKIPPED = frozenset(("script", "style", "noscript", "svg", "template"))
#: Elements whose start closes an open one of the same kind.
SELF_CLOSING = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
KEPT = frozenset(
    ("a", "button", "input", "textarea", "select", "option", "img", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "label", "nav", "main", "header", "footer", "aside", "form", "table", "ul", "ol", "article", "section", "span", "div", "title", "blockquote", "figcaption", "caption", "dialog")
)
SCHEMA = (
    "page_id string, ord int, parent_ord int, tag string, role string, text string, label string, input_type string, autocomplete string, placeholder string, href string, src string, alt string, "
    "checked boolean, selected_value string, html_id string, label_for string, hidden boolean, xpath string, attrs map<string,string>"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class _Tokenizer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[tuple[str, int | None, dict]] = []
        self.counts: list[dict] = [{}]
        self.skipping = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipping or tag in SKIPPED:
            self.skipping += tag not in VOID
            return
        for closed in SELF_CLOSING.get(tag, ()):
            if self.stack and self.stack[-1][0] == closed:
                self._pop()
        a = {k: v or "" for k, v in attrs}
        self.counts[-1][tag] = n = self.counts[-1].get(tag, 0) + 1
        path = (self.stack[-1][2]["path"] if self.stack else "/") + f"/{tag}[{n}]"
        hidden = (self.stack[-1][2]["hidden"] if self.stack else False) or "hidden" in a or a.get("type") == "hidden" or "display:none" in a.get("style", "").replace(" ", "").lower()
        at = None
        if tag in KEPT:
            at = len(self.rows)
            parent = next((o for _, o, _ in reversed(self.stack) if o is not None), None)
            self.rows.append(
                {
                    "parent_ord": parent, "tag": tag, "role": a.get("role"), "words": [], "label": a.get("aria-label") or a.get("title"), "input_type": a.get("type"), "autocomplete": a.get("autocomplete"), "placeholder": a.get("placeholder"),
                    "href": a.get("href"), "src": a.get("src"), "alt": a.get("alt"), "checked": ("checked" in a) if a.get("type") in ("checkbox", "radio") else None, "selected_value": a.get("value"), "html_id": a.get("id"),
                    "label_for": a.get("for"), "hidden": hidden, "xpath": path, "attrs": a,
                }
            )
        if tag not in VOID:
            self.stack.append((tag, at, {"path": path, "hidden": hidden}))
            self.counts.append({})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self.skipping and self.stack and self.stack[-1][0] == tag:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            self.skipping -= 1
            return
        if any(t == tag for t, _, _ in self.stack):
            while self.stack and self._pop() != tag:
                pass

    def _pop(self) -> str:
        self.counts.pop()
        return self.stack.pop()[0]

    def handle_data(self, data: str) -> None:
        if not self.skipping and data.strip():
            at = next((o for _, o, _ in reversed(self.stack) if o is not None), None)
            if at is not None:
                self.rows[at]["words"].append(data)


def tokenize(html: str | None) -> list[dict]:
    """Element rows of one page, in document order, with their own (not their descendants') text."""
    if not html:
        return []
    t = _Tokenizer()
    t.feed(html)
    t.close()
    for i, r in enumerate(t.rows):
        r["ord"] = i + 1
        r["parent_ord"] = None if r["parent_ord"] is None else r["parent_ord"] + 1
        r["text"] = " ".join(" ".join(r.pop("words")).split()) or None
    return t.rows


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row an element of each page."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, h in zip(batch["page_id"], batch["html"], strict=True):
                rows = [{"page_id": k, **r} for r in tokenize(h)]
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS).astype({"parent_ord": "Int32", "checked": "boolean"})

    from pyspark.sql import functions as F

    return pages.select(F.col(key).cast("string").alias("page_id"), F.col(html).alias("html")).mapInPandas(parse, SCHEMA)


def with_labels(e: DataFrame) -> DataFrame:
    """Labels of controls: their own, else that of a label element for their id, the first in order."""
    from pyspark.sql import functions as F

    named = e.filter((F.col("tag") == "label") & F.col("label_for").isNotNull()).groupBy("page_id", F.col("label_for").alias("html_id")).agg(F.min_by("text", "ord").alias("__for"))
    return e.join(named, ["page_id", "html_id"], "left").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.col("__for"))).drop("__for")
