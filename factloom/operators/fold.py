"""Alignment of one pair of results whose facts stand beside each other, in Arrow batches: folded and projected in one pass, so
that no hypothesis and no fact leaves its row. Facts come as positions, expressions and match keys; only those that
match or may be projected are parsed."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa

#: A result's facts are one text: position, expression and key between PART, facts between ROW; no expression holds control characters.
PART, ROW = "\x02", "\x03"
LEAF, OPEN, BRACKET, FLAT = re.compile(',"([^"]*)"'), re.compile('\\["([^"]*)",?'), re.compile("[\\[\\]]"), re.compile("\\[[^\\[\\]]*\\]")


def subexprs(e: str) -> list[str]:
    """Predicates in pre-order, itself first."""
    flat = FLAT.findall(e, 1)
    if len(flat) == e.count("[") - 1:
        return [e, *flat]
    opened, spans = [], []
    for m in BRACKET.finditer(e):
        if m.group() == "[":
            opened.append(len(spans))
            spans.append([m.start(), 0])
        elif opened:
            spans[opened.pop()][1] = m.end()
    return [e[a:b] for a, b in spans if b]


def order(e: str) -> int:
    if e.count("[") < 2:
        return e.count("[")
    deep = at = 0
    for m in BRACKET.findall(e):
        at += 1 if m == "[" else -1
        deep = max(deep, at)
    return deep


def leaves(e: str) -> list[str]:
    return LEAF.findall(e) if e[0] == "[" else [e.strip('"')]


def fold(base: tuple, target: tuple, times: int = 1) -> tuple[float, dict, list] | None:
    """score, corrs and matched of (positions, expressions, keys) of both sides; None without any hypothesis."""
    by, found, seen = {}, [], {}
    for j, key in enumerate(target[2]):
        if key in by:
            by[key].append(j)
        else:
            by[key] = [j]
    for i, key in enumerate(base[2]):
        js = by.get(key)
        if js is None:
            continue
        b, deep = leaves(base[1][i]), -order(base[1][i])
        apart = len(set(b)) == len(b)
        for j in js:
            if j not in seen:
                t = leaves(target[1][j])
                seen[j] = t, len(set(t)) == len(t)
            t, lone = seen[j]
            if apart and lone:
                found.append((deep, base[0][i], target[0][j], list(zip(b, t, strict=True))))
            elif apart == lone:
                c = list(dict.fromkeys(zip(b, t, strict=True)))
                if len({x for x, _ in c}) == len(c) == len({y for _, y in c}):
                    found.append((deep, base[0][i], target[0][j], c))
    if not found:
        return None
    if len(found) > 1 or times > 1:
        found = sorted(found * times)
    there, back, matched, score = {}, {}, [], 0.0
    for deep, p, q, c in found:
        for x, y in c:
            if there.get(x, y) != y or back.get(y, x) != x:
                break
        else:
            for x, y in c:
                there[x] = y
                back[y] = x
            matched.append((p, q))
            score += 1 - deep
    return score, there, matched


def infer(base: tuple, corrs: dict[str, str], hit: set) -> list[tuple]:
    """position, expr, projection, anchored, entity_overlap, n_skolems, key and images of base facts that are tied to the map."""
    known, found = {e for p, e in zip(base[0], base[1], strict=True) if p in hit}, []
    bare = any(',"' not in e for e in known)  # a part without entities may be all that ties a fact to the map
    for p, e, key in zip(*base, strict=True):
        if e in known:
            continue
        own = leaves(e)
        if not bare and corrs.keys().isdisjoint(own):
            continue
        overlap = len(corrs.keys() & own)
        anchored = sum(x in known for x in subexprs(e)[1:]) if e.count("[") > 1 else 0
        if anchored or overlap:
            images = [corrs[x] if x in corrs else "skolem:" + x for x in own]
            parts = e.split('"')
            if e[0] == "[":
                rest = iter(images)
                for i in range(3, len(parts), 2):
                    if parts[i - 1][-1] == ",":
                        parts[i] = next(rest)
            else:
                parts[1] = images[0]
            found.append((p, e, '"'.join(parts), anchored, overlap, len({x for x in images if x.startswith("skolem:")}), key, images))
    return found


def confirmed(found: list[tuple], target: tuple) -> set:
    """Positions of inferred facts that a fact of the target matches, invented entities matching any."""
    hit = set()
    for x in found:
        for e, key in zip(target[1], target[2], strict=True):
            if key == x[6] and x[0] not in hit and all(w == s or w.startswith("skolem:") for w, s in zip(x[7], leaves(e), strict=True)):
                hit.add(x[0])
    return hit


def printed(e: str) -> str:
    """F(a, G(b)) for ["F","a",["G","b"]]."""
    return OPEN.sub(r"\1(", e).replace('"', "").replace("]", ")").replace(",", ", ")


def rounded(x: float) -> float:
    return x if x.is_integer() else float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP))


def _side(facts: str) -> tuple[list, list, list]:
    """positions, expressions, keys of a result's facts."""
    parts = facts.replace(ROW, PART).split(PART)
    return list(map(int, parts[::3])), parts[1::3], parts[2::3]


def _rows(batch: pa.RecordBatch):
    """base, target and what fold() takes, for each row."""
    columns = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("base", "target", "times", "b", "t"))
    for b, t, times, base, target in zip(*columns, strict=True):
        yield b, t, times, _side(base), _side(target)


def _lists(rows: list, kind: pa.ListType) -> pa.Array:
    """Rows of pairs as lists of structs."""
    flat, ends = [x for row in rows for x in row], [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    parts = [pa.array([x[i] for x in flat], kind.value_type.field(i).type) for i in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=[kind.value_type.field(i) for i in (0, 1)]), type=kind)


def maps(schema: pa.Schema):
    """base, target, score, corrs, matched of each pair."""
    def run(batches):
        for batch in batches:
            rows = [(b, t, *found) for b, t, times, base, target in _rows(batch) if (found := fold(base, target, times))]
            b, t, score, corrs, matched = zip(*rows, strict=True) if rows else [()] * 5
            arrays = [pa.array(x, f.type) for x, f in zip((b, t, score), schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, _lists([c.items() for c in corrs], schema.field(3).type), _lists(matched, schema.field(4).type)], schema=schema)

    return run


def conjectures(penalty: float, schema: pa.Schema):
    """base, target, bpos, base_fact, projection, anchored, entity_overlap, n_skolems, score, status, i of each pair's map."""
    def run(batches):
        for batch in batches:
            rows = []
            for b, t, times, base, target in _rows(batch):
                if (folded := fold(base, target, times)) and (found := infer(base, folded[1], {p for p, _ in folded[2]})):
                    hit = confirmed(found, target)
                    scored = [(-rounded(2.0 * x[3] + x[4] - penalty * x[5]), x) for x in found]
                    if len(found) > 1:
                        scored.sort(key=lambda s: (s[0], printed(s[1][2]), s[1][0]))
                    rows += [(b, t, *x[:6], -s, "confirmed" if x[0] in hit else "novel", i) for i, (s, x) in enumerate(scored)]
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run
