"""Main text of stored HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: where the main content of a page is looked for, and the fallback tags
MAIN_CLASSES = {
    "article-body", "post-content", "entry-content", "main-content", "td-post-content",
    "content-wrapper", "l-article-body", "article__body", "article-content", "story-body",
    "body-content"}
MAIN_IDS = {
    "article-body", "content", "main", "primary", "article-content", "story-page",
    "main-article-text"}
FALLBACK_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li"}

# HTML standard: elements without content, elements that end an open paragraph, and elements
# an implied end tag never crosses
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = set("""address article aside blockquote center details dialog dir div dl fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search
section summary table ul dd dt td th tr tbody thead tfoot""".split())
_SCOPE = set("html body table td th caption button object template".split())
_ENDS_ITSELF = {"li", "td", "th", "tr", "dd", "dt"}
_LIST_SCOPE = _SCOPE - {"td", "th"} | {"ul", "ol", "dl"}
_NOT_TEXT = {"script", "style", "template"}


class _Page(HTMLParser):
    """Elements in document order, each with the range of text runs it covers.

    Of the open elements the depths are kept by tag, and those of the barriers of implied ends, so a
    tag costs the same however many elements are open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.elements: list[list] = []      # [tag, attributes, first run, end run]
        self._open: list[int] = []
        self._depths: dict[str, list[int]] = {}
        self._barriers: tuple[list[int], list[int]] = [], []    # depths of _SCOPE and of _LIST_SCOPE
        self._hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._imply_end("p", self._barriers[0])
        if tag in _ENDS_ITSELF:
            self._imply_end(tag, self._barriers[1])
        self.elements.append([tag, dict(attrs), len(self.texts), None])
        if tag not in _VOID:
            depth = len(self._open)
            self._open.append(len(self.elements) - 1)
            self._depths.setdefault(tag, []).append(depth)
            for scope, depths in zip((_SCOPE, _LIST_SCOPE), self._barriers):
                if tag in scope:
                    depths.append(depth)
            self._hidden += tag in _NOT_TEXT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self._depths.get(tag):
            self._close_down_to(tag)

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self.texts.append(data)

    def finish(self) -> _Page:
        self.close()
        while self._open:
            self._pop()
        for e in self.elements:
            e[3] = e[2] if e[3] is None else e[3]
        return self

    def _imply_end(self, tag: str, barriers: list[int]) -> None:
        depths = self._depths.get(tag)
        if depths and (not barriers or depths[-1] >= barriers[-1]):
            self._close_down_to(tag)

    def _close_down_to(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def _pop(self) -> str:
        e = self.elements[self._open.pop()]
        e[3] = len(self.texts)
        self._depths[e[0]].pop()
        for depths in self._barriers:
            if depths and depths[-1] == len(self._open):
                depths.pop()
        self._hidden -= e[0] in _NOT_TEXT
        return e[0]


def main_text(html: str) -> str:
    """Text of the main element: its non-empty paragraphs, else all of its text.

    The main element is the first with a listed class, else the first with a listed id, else the
    first ``<article>``. A page without one yields its paragraphs, headings and list items.
    """
    page = _Page()
    page.feed(html)
    page.finish()
    els, texts = page.elements, page.texts

    def first(test) -> int | None:
        return next((i for i, e in enumerate(els) if test(e)), None)

    at = first(lambda e: MAIN_CLASSES & set((e[1].get("class") or "").split()))
    if at is None:
        at = first(lambda e: e[1].get("id") in MAIN_IDS)
    if at is None:
        at = first(lambda e: e[0] == "article")
    if at is None:
        parts = ["".join(t.strip() for t in texts[a:b]) for tag, _, a, b in els
                 if tag in FALLBACK_TAGS]
        return "\n".join(p for p in parts if p)

    start, end = els[at][2], els[at][3]
    parts = ["".join(texts[a:b]).strip() for tag, _, a, b in els[at + 1:]
             if tag == "p" and start <= a and b <= end and a < end]
    body = "\n".join(p for p in parts if p)
    return body or "\n".join(t.strip() for t in texts[start:end] if t.strip())


@F.pandas_udf(StringType())
def html_main_text(pages: pd.Series) -> pd.Series:
    """``main_text`` over Arrow batches."""
    return pages.map(lambda h: None if h is None else main_text(h))
