"""What an agent that does not run JavaScript reads of a page: its Markdown, cut at 40,000 characters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from docgauge import constants as K
from docgauge.functions.text import looks_like_html

_BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "blockquote", "nav", "header", "footer", "table", "tr", "figure"}
_UNDERLINES = {"h1": "=", "h2": "-"}


class _Markdown(HTMLParser):
    """Headings, links, lists, code, emphasis and table rows; anything else is its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.frames: list[list[str]] = [[]]
        self.links: list[str] = []
        self.lists: list[list] = []
        self.hidden = 0
        self.pre = 0
        self.code = 0

    def _close(self) -> str:
        return "".join(self.frames.pop()) if len(self.frames) > 1 else ""

    def _block(self, text: str):
        self.frames[-1].append(f"\n\n{text}\n\n")

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.frames[-1].append("\n\n")
        elif tag == "br":
            self.frames[-1].append("  \n")
        elif tag == "hr":
            self._block("* * *")
        elif tag == "img" and attrs.get("src"):
            self.frames[-1].append(f"![{attrs.get('alt') or ''}]({attrs['src']})")
        elif tag == "a":
            self.links.append(attrs.get("href") or "")
            self.frames.append([])
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "code", "strong", "b", "em", "i", "td", "th"):
            self.pre += tag == "pre"
            self.code += tag in ("pre", "code")
            self.frames.append([])
        elif tag in _BLOCKS:
            self.frames[-1].append("\n\n")

    def handle_endtag(self, tag):
        self.code = max(0, self.code - (tag in ("pre", "code")))
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.links and len(self.frames) > 1:
            href, text = self.links.pop(), self._close()
            self.frames[-1].append(f"[{text.strip()}]({href})" if href else text)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and len(self.frames) > 1:
            text = " ".join(self._close().split())
            mark = _UNDERLINES.get(tag)
            self._block(f"{text}\n{mark * len(text)}" if mark else f"{'#' * int(tag[1])} {text}")
        elif tag == "li" and len(self.frames) > 1:
            text = self._close().strip().replace("\n", "\n    ")
            if self.lists:
                self.lists[-1][1] += 1
            ordered = bool(self.lists) and self.lists[-1][0] == "ol"
            bullet = f"{self.lists[-1][1]}.  " if ordered else "*   "
            self.frames[-1].append(f"\n{bullet}{text}")
        elif tag == "pre" and len(self.frames) > 1:
            self.pre = max(0, self.pre - 1)
            self._block("    " + self._close().strip("\n").replace("\n", "\n    "))
        elif tag == "code" and len(self.frames) > 1:
            text = self._close()
            self.frames[-1].append(text if self.pre else f"`{text}`")
        elif tag in ("strong", "b", "em", "i") and len(self.frames) > 1:
            text, mark = self._close(), "**" if tag in ("strong", "b") else "_"
            self.frames[-1].append(f"{mark}{text.strip()}{mark}" if text.strip() else text)
        elif tag in ("td", "th") and len(self.frames) > 1:
            self.frames[-1].append(f"| {' '.join(self._close().split())} ")
        elif tag == "tr":
            self.frames[-1].append("|\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.frames[-1].append("\n\n")
        elif tag in _BLOCKS:
            self.frames[-1].append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            text = data if self.pre else _squeeze(data)
            self.frames[-1].append(text if self.code else _escape(text))

    def result(self) -> str:
        while len(self.frames) > 1:
            self.frames[-2].append(self._close())
        lines = [line if line.startswith("    ") else line.strip(" \t") for line in "".join(self.frames[0]).split("\n")]
        out: list[str] = []
        for line in lines:
            if line or (out and out[-1]):
                out.append(line)
        return "\n".join(out).strip()


# Characters that would read as Markdown are escaped in running text.
_ESCAPES = tuple(
    (re.compile(pattern), replacement)
    for pattern, replacement in (
        (r"([\\*_`\[\]])", r"\\\1"), (r"^(-|\+ |=+|~~~|>)", r"\\\1"), (r"^(#{1,6} )", r"\\\1"), (r"^(\d+)\. ", r"\1\\. "),
    )
)


def _escape(text: str) -> str:
    for pattern, replacement in _ESCAPES:
        text = pattern.sub(replacement, text)
    return text


def _squeeze(text: str) -> str:
    if not text.strip():
        return " " if text else ""
    words = " ".join(text.split())
    return f"{' ' if text[0].isspace() else ''}{words}{' ' if text[-1].isspace() else ''}"


@F.pandas_udf(StringType())
def _to_markdown(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def convert(body):
        if body is None:
            return None
        parser = _Markdown()
        parser.feed(body)
        parser.close()
        return parser.result()

    for series in bodies:
        yield series.map(convert)


def agent_text(responses: DataFrame, body: str = "body", limit: int = K.MAX_CHARS_PER_FETCH) -> DataFrame:
    """Adds ``agent_text, truncated, full_length``. Only HTML visits a Python worker; Markdown and text pass through."""
    kind = F.coalesce(F.col("content_type"), F.lit(""))
    is_html = F.contains(kind, F.lit("html")) | (~F.contains(kind, F.lit("markdown")) & looks_like_html(F.col(body)))
    marked = responses.withColumn("__html", F.coalesce(is_html, F.lit(False)))
    read = marked.filter("__html").withColumn("__text", _to_markdown(F.col(body))).unionByName(
        marked.filter(~F.col("__html")).withColumn("__text", F.coalesce(F.col(body), F.lit("")))
    )
    return read.withColumns(
        {
            "agent_text": F.left("__text", F.lit(limit)),
            "truncated": F.length("__text") > limit,
            "full_length": F.length("__text").cast("bigint"),
        }
    ).drop("__html", "__text")
