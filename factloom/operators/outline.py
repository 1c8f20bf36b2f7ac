"""Rows of document nodes and edges, collected in document order while a parser walks its source."""

from __future__ import annotations

import hashlib
import json
import re

from factloom.functions.text import ROLES

ROLE_OF = {t: role for role, types in ROLES.items() for t in types}
NODES = "slug string, seq bigint, id string, parent_id string, type string, role string, label string, title string, text string, depth int, ord int, span struct<start:int,end:int>, content_sha256 string, attrs map<string,string>"
EDGES = "slug string, seq bigint, id string, source string, target string, relation string, resolved boolean, attrs map<string,string>"
DOCUMENT = f"slug string, nodes array<struct<{NODES.replace(' string', ':string').replace(' bigint', ':bigint').replace(' int,', ':int,').replace(' struct', ':struct').replace(' map', ':map')}>>, edges array<struct<{EDGES.replace(' string', ':string').replace(' bigint', ':bigint').replace(' boolean', ':boolean').replace(' map', ':map')}>>, n_chars int"


def digest(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()[:16]


class Outline:
    """Nodes get path ids parent/type.k, with one counter for each type in a document, in the order they are added."""

    def __init__(self, slug: str, adapter: str) -> None:
        self.slug, self.nodes, self.edges, self.counts, self.next = slug, [], [], {}, {}
        self.labels: dict[str, str] = {}
        self.root = self._put(slug, None, "document", 0, 0, title=slug, attrs={"adapter": adapter})

    def _put(self, node_id, parent, kind, depth, order, title=None, text=None, label=None, span=None, attrs=None, hashed=None) -> dict:
        hashed = text if hashed is None else hashed
        row = {
            "slug": self.slug, "seq": len(self.nodes), "id": node_id, "parent_id": parent, "type": kind, "role": ROLE_OF.get(kind, "narrate"), "label": label, "title": title, "text": text or None, "depth": depth, "ord": order,
            "span": {"start": span[0], "end": span[1]} if span else None, "content_sha256": digest(hashed) if hashed else None, "attrs": {k: json.dumps(v, ensure_ascii=False) for k, v in (attrs or {}).items()},
        }
        self.nodes.append(row)
        self.next[node_id] = 0
        return row

    def number(self, kind: str) -> int:
        self.counts[kind] = self.counts.get(kind, 0) + 1
        return self.counts[kind]

    def add(self, parent: dict, kind: str, name: str | None = None, **more) -> dict:
        """A child of parent, last in its order. name replaces the counted part of the id."""
        order = self.next[parent["id"]]
        self.next[parent["id"]] += 1
        row = self._put(f"{parent['id']}/{name or f'{kind}.{self.number(kind)}'}", parent["id"], kind, parent["depth"] + 1, order, **more)
        if row["label"]:
            self.labels[row["label"]] = row["id"]
        return row

    def link(self, source: dict, target: str, relation: str, edge_id: str, **attrs) -> None:
        self.edges.append({"slug": self.slug, "seq": len(self.edges), "id": edge_id, "source": source["id"], "target": target, "relation": relation, "resolved": False, "attrs": {k: json.dumps(v, ensure_ascii=False) for k, v in attrs.items()}})

    def resolve(self) -> None:
        """Targets that are labels become the ids they label; other edges are external."""
        for e in self.edges:
            found = self.labels.get(e["target"])
            if found:
                e["target"], e["resolved"] = found, True
            else:
                e["attrs"]["external"] = "true"

    def result(self, n_chars: int) -> dict:
        return {"slug": self.slug, "nodes": self.nodes, "edges": self.edges, "n_chars": n_chars}


class Sections:
    """Where a block goes: under the last heading of a smaller level that no heading has closed."""

    def __init__(self, outline: Outline, top: dict) -> None:
        self.outline, self.open = outline, [(-1, top)]

    @property
    def here(self) -> dict:
        return self.open[-1][1]

    def enter(self, level: int, **more) -> dict:
        while len(self.open) > 1 and self.open[-1][0] >= level:
            self.open.pop()
        row = self.outline.add(self.here, "section", **more)
        self.open.append((level, row))
        return row


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()
