"""Columns over expressions in canonical JSON: a string is an entity, ["F", a, b] a predicate.

Symbols hold no quotes, backslashes or brackets; canonical() refuses others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separates tokens in match keys; no symbol holds it.
SEP = "\x01"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row; the optimizer copies an expression into each of its uses, but not out
    of a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def canonical(expr: Column) -> Column:
    """JSON text without white space. Anything but a string or a non-empty list that starts with a string, at every
    level, is an error, as are symbols with quotes, backslashes or brackets."""
    text = F.to_json(F.parse_json(expr))
    bare = F.regexp_replace(text, '"[^"\\\\\\[\\]]*"', "s")
    ok = ~bare.rlike('[^s,\\[\\]]') & ~bare.rlike("\\[(?!s)")
    return F.when(ok, text).otherwise(F.raise_error(F.concat(F.lit("not an expression: "), F.coalesce(expr, F.lit("null")))))


def is_entity(e: Column) -> Column:
    return ~e.startswith("[")


def functor(e: Column) -> Column:
    return F.when(is_entity(e), None).otherwise(F.regexp_extract(e, '^\\["([^"]*)"', 1))


#: A predicate without predicates in it, and one whose arguments have none.
FLAT = "\\[[^\\[\\]]*\\]"
SHALLOW = f"^\\[[^\\[\\]]*(?:{FLAT}[^\\[\\]]*)*\\]$"


def arg_list(e: Column) -> Column:
    """Arguments as expressions, in order; none for an entity. Where no argument holds predicates in predicates they are read
    off by a pattern; else a comma is at the top level of the list where as many brackets have closed as opened."""
    inner = F.regexp_replace(e, '^\\["[^"]*",?|\\]$', "")
    pieces = F.split(inner, ",")

    def step(acc: Column, x: Column) -> Column:
        opened = F.length(x) - F.length(F.replace(x, F.lit("["), F.lit(""))) - (F.length(x) - F.length(F.replace(x, F.lit("]"), F.lit(""))))
        part = F.when(acc["part"] == "", x).otherwise(F.concat_ws(",", acc["part"], x))
        depth = acc["depth"] + opened
        return F.struct(
            depth.alias("depth"), F.when(depth == 0, F.lit("")).otherwise(part).alias("part"),
            F.when(depth == 0, F.array_append(acc["out"], part)).otherwise(acc["out"]).alias("out"))

    start = F.expr("struct(0 as depth, '' as part, cast(array() as array<string>) as out)")
    none = F.expr("cast(array() as array<string>)")
    shallow = F.regexp_extract_all(inner, F.lit(f'"[^"]*"|{FLAT}'), F.lit(0))
    return F.when(is_entity(e) | (inner == ""), none).when(e.rlike(SHALLOW), shallow).otherwise(F.aggregate(pieces, start, step, lambda a: a["out"]))


def order(e: Column) -> Column:
    """Greatest depth of brackets: 0 for an entity, 1 for a predicate without predicates in it."""
    brackets = F.split(F.regexp_replace(e, "[^\\[\\]]", ""), "")

    def step(acc: Column, c: Column) -> Column:
        d = acc["d"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(d.alias("d"), F.greatest(acc["m"], d).alias("m"))

    deep = F.aggregate(brackets, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda a: a["m"])
    return F.when(is_entity(e), 0).when(e.rlike(f"^{FLAT}$"), 1).when(e.rlike(SHALLOW), 2).otherwise(deep)


def leaves(e: Column) -> Column:
    """Entities in order of occurrence, repeats kept."""
    return F.when(is_entity(e), F.array(F.regexp_replace(e, '^"|"$', ""))).otherwise(F.regexp_extract_all(e, F.lit(',"([^"]*)"'), F.lit(1)))


def entities(e: Column) -> Column:
    return F.array_distinct(leaves(e))


def functors(e: Column) -> Column:
    """Functors of all predicates in pre-order, repeats kept."""
    return F.regexp_extract_all(e, F.lit('\\["([^"]*)"'), F.lit(1))


def skeleton(e: Column) -> Column:
    """The expression with every entity blanked; two expressions match exactly if their skeletons are equal."""
    return F.when(is_entity(e), F.lit("_")).otherwise(F.regexp_replace(e, ',"[^"]*"', ",_"))


def match_key(e: Column, ascension: Column | None = None) -> Column:
    """Key whose equality is a match: the skeleton, or, with a map functor to role, the shape and each functor's
    role where it has one. Prefixes keep a role and a functor of the same name apart."""
    if ascension is None:
        return skeleton(e)
    tokens = F.transform(functors(e), lambda f: F.coalesce(F.concat(F.lit("R:"), F.element_at(ascension, f)), F.concat(F.lit("F:"), f)))
    shape = F.regexp_replace(skeleton(e), '\\["[^"]*"', "[?")
    return F.concat_ws(SEP, shape, F.array_join(tokens, SEP))


def subexprs(e: Column) -> Column:
    """Predicates in pre-order, itself first, repeats kept: each opening bracket up to the one that closes it. Where no
    argument holds predicates in predicates, those below are all flat."""
    def closing(rest: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            d = acc["d"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
            return F.when(acc["over"], acc).otherwise(F.struct(d.alias("d"), (acc["n"] + 1).alias("n"), (d == 0).alias("over")))

        return F.aggregate(F.split(rest, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(False).alias("over")), step, lambda a: a["n"])

    opens = F.filter(F.sequence(F.lit(1), F.length(e)), lambda i: F.substr(e, i, F.lit(1)) == "[")
    below = F.regexp_extract_all(F.substr(e, F.lit(2), F.length(e)), F.lit(FLAT), F.lit(0))
    shallow = F.when(e.rlike(f"^{FLAT}$"), F.array(e)).otherwise(F.concat(F.array(e), below))
    return F.when(e.rlike(SHALLOW), shallow).otherwise(F.transform(opens, lambda i: F.substr(e, i, closing(F.substr(e, i, F.length(e))))))


def fmt_expr(e: Column) -> Column:
    """F(a, G(b)) for ["F","a",["G","b"]]."""
    text = F.regexp_replace(e, '\\["([^"]*)",?', "$1(")
    return F.regexp_replace(F.replace(F.replace(text, F.lit('"'), F.lit("")), F.lit("]"), F.lit(")")), ",", ", ")


def project(e: Column, mapping: Column) -> Column:
    """Entities replaced by their images; those without one become skolem:<name>. Blanks of the skeleton and images
    are joined again in order."""
    images = F.transform(leaves(e), lambda x: F.coalesce(F.element_at(mapping, x), F.concat(F.lit("skolem:"), x)))
    whole = F.concat(F.lit('"'), F.element_at(images, 1), F.lit('"'))
    parts = F.split(F.regexp_replace(e, ',"[^"]*"', ",\x02"), "\x02")
    rest = F.zip_with(images, F.slice(parts, 2, F.size(images)), lambda x, p: F.concat(F.lit('"'), x, F.lit('"'), p))
    return F.when(is_entity(e), whole).otherwise(F.concat(F.element_at(parts, 1), F.array_join(rest, "")))


def pairs_of(base: Column, target: Column) -> Column:
    """Distinct correspondences of two expressions with equal match keys."""
    return F.array_distinct(F.zip_with(leaves(base), leaves(target), lambda b, t: F.struct(b.alias("b"), t.alias("t"))))


def bijective(pairs: Column) -> Column:
    n = F.size(pairs)
    return (n == F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"])))) & (n == F.size(F.array_distinct(F.transform(pairs, lambda p: p["t"]))))


def consistent(known: Column, new: Column) -> Column:
    """New correspondences keep the map one to one: two agree on the base side exactly if on the target side."""
    return F.forall(new, lambda n: F.forall(known, lambda k: (k["b"] == n["b"]) == (k["t"] == n["t"])))
