"""Web pages to markdown, by the standard library's parser inside tasks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

DROPPED = {"script", "style", "noscript", "svg", "template", "iframe", "nav"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Tags that end a run of inline text.
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "ul", "ol", "table", "blockquote", "br", "hr", "dl", "dt", "dd", "figure", "body"} | set(HEADINGS)


class _Markdown(HTMLParser):
    """Collects blocks: headings, fenced code, table rows, list items and runs of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.run: list[str] = []
        self.skip = 0
        self.prefix = ""
        self.title, self.in_title, self.in_pre = "", False, False
        self.cells: list[str] | None = None

    def flush(self, prefix: str = "") -> None:
        text = "".join(self.run)
        text = text.strip("\n") if self.in_pre else re.sub(r"\s+", " ", text).strip()
        self.run.clear()
        if text:
            self.out.append(f"```\n{text}\n```" if self.in_pre else (prefix or self.prefix) + text)

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in HEADINGS:
            self.flush()
            self.prefix = "#" * HEADINGS[tag] + " "
        elif tag == "li":
            self.flush()
            self.prefix = "- "
        elif tag == "pre":
            self.flush()
            self.in_pre = True
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in HEADINGS or tag == "li":
            self.flush()
            self.prefix = ""
        elif tag == "pre":
            self.flush()
            self.in_pre = False
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(re.sub(r"\s+", " ", "".join(self.run)).strip())
            self.run.clear()
        elif tag == "tr" and self.cells is not None:
            if any(self.cells):
                self.out.append("| " + " | ".join(self.cells) + " |")
            self.cells = None
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.run.append(data)


def to_markdown(html: str | None) -> tuple[str, list[str]]:
    """Title and blocks of a page; a null or broken page gives what could be read."""
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return re.sub(r"\s+", " ", parser.title).strip(), parser.out


def page_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, block_no, depth, block`` of every page; the title is block 0 where there is one."""

    def run(frames):
        for pdf in frames:
            rows = []
            for page_id, html in zip(pdf["page_id"], pdf["html"]):
                title, blocks = to_markdown(html)
                for n, block in enumerate(([f"# {title}"] if title else []) + blocks):
                    marks = len(block) - len(block.lstrip("#"))
                    rows.append((page_id, n, marks if marks <= 6 and block[marks : marks + 1] == " " else 0, block))
            yield pd.DataFrame(rows, columns=["page_id", "block_no", "depth", "block"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, block_no bigint, depth bigint, block string")
