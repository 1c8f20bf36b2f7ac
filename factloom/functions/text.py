"""Columns over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of document nodes by coarse role; any other type narrates.
ROLES = {
    "segment": ("document", "section"),
    "narrate": ("paragraph", "list", "list_item", "figure", "table", "block"),
    "assert": ("theorem", "definition", "assumption", "remark", "proof", "problem_statement", "answer_key"),
    "formalize": ("equation",),
    "meta": ("grading_scheme", "editor_notes", "metadata_field"),
    "exemplify": ("example", "riddle", "problem"),
    "refer": ("bib_reference", "citation", "cross_reference"),
}


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


def role_for(node_type: Column) -> Column:
    out = F.lit("narrate")
    for role, types in ROLES.items():
        out = F.when(node_type.isin(list(types)), role).otherwise(out)
    return out


def normalize_markdown(text: Column) -> Column:
    """Line ends as \\n, comments dropped, lines and the whole stripped, at most one blank line in a row."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, "(?U)[\\s&&[^\n]]+(?=\n|\\z)", "")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "(?U)^\\s+|\\s+\\z", "")


def strip_comments(text: Column) -> Column:
    """LaTeX comments up to the line end, which stays; an escaped percent sign is text."""
    return F.regexp_replace(text, "(?s)(\\\\.)|%[^\n]*", "$1")


def collapse_whitespace(text: Column) -> Column:
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, "\n[ \t]*\n([ \t]*\n)+", "\n\n")
    text = F.regexp_replace(text, "(?U)[\\s&&[^\n]]+(?=\n|\\z)", "")
    return F.regexp_replace(text, "(?U)^\\s+|\\s+\\z", "")


def strip_to_body(text: Column) -> Column:
    """What stands between the begin and the first end of the document, if both are there."""
    body = F.regexp_extract(text, "(?s)\\\\begin\\{document\\}(.*?)\\\\end\\{document\\}", 1)
    return F.when(text.rlike("(?s)\\\\begin\\{document\\}.*\\\\end\\{document\\}"), body).otherwise(text)


def sanitize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(title), "^\\*+", ""))


def is_real_label(label: Column) -> Column:
    return (F.coalesce(F.trim(label), F.lit("")) != "") & ~label.contains("=") & ~F.trim(label).startswith("\\")


def first_int(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "-?[0-9]+", 0), F.lit("")).cast("long")


def unit_of(text: Column) -> Column:
    return F.regexp_extract(text, "[0-9]+\\s+([A-Za-z]+)", 1)


def fmt_quantity(value: Column, unit: Column) -> Column:
    one = F.when((value == 1) & unit.endswith("s"), F.regexp_replace(unit, "s$", "")).otherwise(unit)
    shown = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return F.trim(F.concat_ws(" ", shown, one))


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
