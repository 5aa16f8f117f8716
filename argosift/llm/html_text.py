"""Main text of web pages by line-block distribution.

A page is read as a list of lines, one per block element; markup is stripped, and elements that are no article text by
name or by the words of their class or id leave empty lines. The distribution is the text length summed over a window
of ``window`` lines. It surges where text begins and dives where it ends; every stretch between a surge and a dive is
a region. The region with most text is the article; other regions belong to it if they stand in the same article or
main element, or, on pages without such an element, if their text is as dense (``dense`` characters per window) or only
an excluded element lies between them and the article. Outside of such elements, a line that is mostly links does not
count as text. Article and main elements inside one another, and articles with one parent, count as the same element.
An article inside an excluded wrapper is read too, unless the wrapper is hidden, holds comments or related items, or is
closed and excluded by its name (nav, aside); its text counts like text outside of article elements.

Blocks lose nothing: character references are decoded, white space becomes one space, blocks are joined by an empty
line, and short lines inside a region stay.

Defined cases: null and empty html give an empty text; text without markup is one block; unclosed elements end with
their parent; pages of any length are read whole in one pass; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from argosift.llm.common import map_arrow

# Element names by role, and words of class and id that mark text outside the article.
_RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title"}
_OUTSIDE = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "audio", "video", "map"}
_BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt",
           "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main",
           "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HOLDERS = {"article", "main"}
_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
          "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead",
          "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup",
          "promo", "related", "replies", "reply", "share", "sharing", "sidebar", "signup", "social", "sponsor",
          "sponsored", "subscribe", "toolbar", "widget"}
_APART = {"comment", "comments", "disqus", "related", "replies", "reply"}  # blocks with articles of their own
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_LAYOUT = re.compile(r"(?:has|with|without|no|is|js|layout)[-_]", re.I)  # names that only say how a page is laid out
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Line:
    text: str
    linked: int = 0  # characters inside links
    holder: int = 0  # number of the article or main element around it, negative inside an excluded wrapper


def _is_outside(name: str, attributes: str, holder: int) -> bool:
    if name in _OUTSIDE or name == "header" and not holder:
        return True
    if name in ("body", "html", "article", "main") and "comment" not in attributes.lower():
        return False
    if _UNSEEN.search(attributes):
        return True
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and any(w.lower() in _WORDS for name_ in value.split() if not _LAYOUT.match(name_)
                                          for w in _PARTS.findall(name_)):
            return True
    return False


def _is_apart(name: str, attributes: str) -> bool:
    """Whether the articles in an excluded element are none of the page's own."""
    if name in _OUTSIDE and name != "form" or _UNSEEN.search(attributes):
        return True
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id") and any(w.lower() in _APART for w in _PARTS.findall(value)):
            return True
    return False


def lines_of(page: str, gap: int) -> list[Line]:
    """The lines of a page; elements outside the article leave ``gap`` empty lines."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = in_link = holders = serial = 0
    # Open elements with the holder around them, a number of their own and the skipped element they interrupt.
    stack: list[tuple[str, int, int, tuple]] = []
    siblings: dict[tuple, int] = {}  # holder of the articles of one parent
    holder = 0
    skip, skip_depth, skip_at, skip_apart = "", 0, 0, False
    lowered = page.lower()

    def end_line() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append(Line(text, linked, holder))
        linked = 0

    def open_element(name: str, interrupted: tuple = ()) -> None:
        nonlocal holder, holders, serial
        parent = (stack[-1][2] if stack else 0, interrupted[2] if interrupted else 0)
        serial += 1
        stack.append((name, holder, serial, interrupted))
        if name in _HOLDERS and not holder:
            if parent not in siblings:
                holders += 1
                siblings[parent] = -holders if interrupted else holders
            holder = siblings[parent]

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text and not skip:
            parts.append(text)
            linked += len(text.strip()) if in_link else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1]), m[3]
        if skip:
            # Elements of the same name nest; an end tag of what stands around closes the skipped one as well, and so
            # does an article inside a form around the page or an element that is never closed. Other wrappers are
            # skipped again after the article.
            if not closing and name in _HOLDERS and not _is_outside(name, attributes, holder):
                ends = skip == "form" or lowered.find(f"</{skip}", at) < 0
                if ends or not skip_apart:
                    end_line()
                    open_element(name, () if ends else (skip, skip_depth, skip_at, skip_apart))
                    skip = ""
                    continue
            if name == skip:
                skip_depth += -1 if closing else 0 if attributes.endswith("/") else 1
            elif closing and name in ("body", "html") or closing and any(name == x[0] for x in stack[-1:]) and (
                    lowered.find(f"</{skip}", at) < 0):
                skip_depth = 0
            if skip_depth == 0:
                skip = ""
                if name != "head" and closing and stack and stack[-1][0] == name:
                    holder = stack.pop()[1]
            continue
        if name in _RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else at if name not in ("script", "style") else len(page)
            parts.append(" ")
            continue
        if name in _VOID:
            if name in _BLOCKS:
                end_line()
            else:
                parts.append(" " if name == "br" else "")
            continue
        if not closing:
            if _is_outside(name, attributes, holder):
                end_line()
                lines.extend(Line("") for _ in range(gap))
                if not attributes.endswith("/"):
                    skip, skip_depth, skip_at, skip_apart = name, 1, at, _is_apart(name, attributes)
                continue
            if name == "a":
                in_link += 1
            if name in _BLOCKS or name in _HOLDERS:
                end_line()
                if name != "p" and not attributes.endswith("/"):
                    open_element(name)
            continue
        if name == "a":
            in_link = max(0, in_link - 1)
        if name in _BLOCKS or name in _HOLDERS:
            end_line()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    holder = stack[i][1]
                    interrupted = stack[i][3]
                    del stack[i:]
                    if interrupted:
                        lines.extend(Line("") for _ in range(gap))
                        skip, skip_depth, skip_at, skip_apart = interrupted
                    break
    end_line()
    return lines


def main_text(page: str | None, window: int = 3, dense: int = 80) -> str:
    """Article text of a page: blocks joined by an empty line."""
    lines = lines_of(page or "", window)
    weight = [len(x.text) if x.holder or x.linked < 0.8 * len(x.text) else 0 for x in lines]
    sums = [sum(weight[i:i + window]) for i in range(len(weight))]
    regions, start = [], None
    for i, line in enumerate(lines + [Line("")]):
        # A surge begins a region at its first line of text, a dive ends it.
        inside = i < len(lines) and (weight[i] > 0 or bool(line.text) and start is not None)
        if inside and start is not None and line.holder != lines[i - 1].holder:
            regions.append((start, i))
            start = i
        elif inside and start is None:
            start = i
        elif not inside and start is not None and (i >= len(lines) or sums[i] == 0 or not line.text):
            regions.append((start, i))
            start = None
    if not regions:
        return ""
    mass = [sum(weight[a:b]) for a, b in regions]
    # Text in an article element goes before text outside of one.
    held = [m if lines[a].holder > 0 else 0 for (a, _), m in zip(regions, mass)]
    best = max(range(len(regions)), key=lambda k: (held[k], mass[k]))
    holder = lines[regions[best][0]].holder
    top = max(sums[regions[best][0]:regions[best][1]])
    kept = [(a, b) for k, (a, b) in enumerate(regions)
            if k == best or holder and lines[a].holder == holder
            or not holder and not lines[a].holder and max(sums[a:b]) >= min(dense, top)]
    if not holder:
        # Short regions beside these count as well if only excluded elements lie between.
        loose = [r for r in regions if not lines[r[0]].holder]
        for order in (loose, loose[::-1]):
            for one, other in zip(order, order[1:]):
                if one in kept and other not in kept and not any(
                        x.text for x in lines[min(one[1], other[1]):max(one[0], other[0])]):
                    kept.append(other)
        kept.sort()
    return "\n\n".join(x.text for a, b in kept for x in lines[a:b] if x.text)


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of all pages."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    kind = chosen.schema["page_id"].dataType.simpleString()
    return map_arrow(chosen, run, f"page_id {kind}, url string, text string, n_chars long")
