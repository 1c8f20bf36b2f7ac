"""Markdown to document nodes."""

from __future__ import annotations

import re
from itertools import accumulate, groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import normalize_markdown
from factloom.operators.outline import DOCUMENT, Outline, Sections

#: The shapes of lines.
SHAPES = (
    ("blank", re.compile(r"\s*$")),
    ("heading", re.compile(r"(#{1,6})\s+(.*?)\s*#*$")),
    ("rule", re.compile(r"\s*(?:-{3,}|\*{3,}|_{3,}|[—–]+)\s*$")),
    ("fence", re.compile(r"\s*(```+|~~~+)(.*)$")),
    ("quote", re.compile(r"\s*>")),
    ("item", re.compile(r"(\s*)(?:[-*+]|\d+[.)])\s+(.*)$")),
    ("prose", re.compile(r"")),
)
FIELD = re.compile(r"\*{0,2}([A-Z][^:*]{0,60}?):\*{0,2}\s*(.*)$")


class Line(NamedTuple):
    shape: str
    match: re.Match
    start: int
    text: str

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def lines_of(text: str) -> list[Line]:
    lines = text.split("\n")
    starts = accumulate((len(x) + 1 for x in lines), initial=0)
    return [Line(*next((name, m) for name, rx in SHAPES if (m := rx.match(x))), at, x) for at, x in zip(starts, lines, strict=False)]


def _fence_is_open(group: list[Line]) -> bool:
    return len(group) == 1 or not group[-1].text.lstrip().startswith(group[0].match[1][0] * 3)


#: Whether a line goes on with the block of the lines before it, by the shape of the block's first line.
GOES_ON = {
    "fence": lambda group, x: _fence_is_open(group),
    "quote": lambda group, x: x.shape == "quote",
    "item": lambda group, x: x.shape == "item" or (x.shape != "blank" and x.text.startswith("  ")),
    "prose": lambda group, x: x.shape == "prose",
}


def _joined(group: list[Line], drop: str = "") -> str:
    return "\n".join(re.sub(drop, "", x.text) if drop else x.text for x in group).strip()


#: Kind and payload of a block by the shape of its first line.
BUILT = {
    "heading": lambda group: ("heading", (len(group[0].match[1]), group[0].match[2].strip())),
    "rule": lambda group: ("rule", None),
    "fence": lambda group: ("code", _joined(group)),
    "quote": lambda group: ("blockquote", _joined(group, r"^\s*>\s?")),
    "item": lambda group: ("list", [(x.start, x.end, x.match[2]) for x in group if x.shape == "item"]),
    "prose": lambda group: ("paragraph", _joined(group)),
}


def blocks(text: str):
    """(kind, start, end, payload) of each block in order; offsets are code points. Each line is numbered with the block it
    belongs to, and the lines of a number make the block."""
    groups: list[list[Line]] = []
    for line in lines_of(text):
        if groups and GOES_ON.get(groups[-1][0].shape, lambda *_: False)(groups[-1], line):
            groups[-1].append(line)
        else:
            groups.append([line])
    for group in groups:
        if group[0].shape in BUILT:
            kind, load = BUILT[group[0].shape](group)
            yield kind, group[0].start, load[-1][1] if kind == "list" else group[-1].end, load


def extract(text: str, slug: str) -> dict:
    """Nodes of normalized Markdown. Without headings but with rules between its parts, each part is an example, its
    quotes the source and its paragraphs the target of an analogy."""
    out, found = Outline(slug, "markdown"), list(blocks(text))
    riddles = any(b[0] == "rule" for b in found) and not any(b[0] == "heading" for b in found)
    places = Sections(out, out.root)

    def put(parent: dict, block) -> None:
        kind, start, end, load = block
        if kind == "list":
            row = out.add(parent, "list", span=(start, end))
            for s, e, body in load:
                field = FIELD.match(body)
                if field:
                    out.add(row, "metadata_field", title=field[1].strip(), text=field[2].strip(), span=(s, e))
                else:
                    out.add(row, "list_item", text=body.strip(), span=(s, e))
        elif kind in ("code", "blockquote"):
            named = "source_analog" if riddles and kind == "blockquote" else kind
            out.add(parent, "block", text=load, span=(start, end), attrs={"kind": named})
        elif load:
            out.add(parent, "paragraph", text=load, span=(start, end), attrs={"kind": "target_analog"} if riddles else None)

    if riddles:
        parts = [list(part) for is_rule, part in groupby(found, key=lambda b: b[0] == "rule") if not is_rule]
        for n, part in enumerate(parts, 1):
            row = out.add(out.root, "example", title=f"riddle {n}", span=(part[0][1], part[-1][2]), attrs={"kind": "riddle"})
            for b in part:
                put(row, b)
    else:
        for b in found:
            if b[0] == "heading":
                places.enter(b[3][0], title=b[3][1] or None, span=(b[1], b[2]))
            elif b[0] != "rule":
                put(places.here, b)
    return out.result(len(text))


def decompose(docs: DataFrame) -> DataFrame:
    """slug, nodes, edges, n_chars for documents (slug, text); a document is a row, so rows are independent."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([extract(t, s) for s, t in zip(pdf["slug"], pdf["text"], strict=True)], columns=["slug", "nodes", "edges", "n_chars"])

    return docs.select("slug", normalize_markdown(F.coalesce("text", F.lit(""))).alias("text")).mapInPandas(run, DOCUMENT)


def node_rows(decomposed: DataFrame) -> DataFrame:
    return decomposed.select(F.explode("nodes").alias("n")).select("n.*")


def edge_rows(decomposed: DataFrame) -> DataFrame:
    return decomposed.select(F.explode("edges").alias("e")).select("e.*")


def run_metrics(decomposed: DataFrame) -> DataFrame:
    """slug, n_nodes, n_edges, n_edges_resolved, max_depth, classified_ratio (share that isn't a plain block)."""
    blocks_ = F.size(F.filter("nodes", lambda n: n["type"] == "block"))
    n = F.size("nodes")
    return decomposed.select(
        "slug", n.alias("n_nodes"), F.size("edges").alias("n_edges"), F.size(F.filter("edges", lambda e: e["resolved"])).alias("n_edges_resolved"),
        F.array_max(F.transform("nodes", lambda x: x["depth"])).alias("max_depth"), F.round(1 - blocks_ / F.greatest(F.lit(1), n - 1), 4).alias("classified_ratio"))
