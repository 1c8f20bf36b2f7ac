import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import checks, html, latex, lift, markdown

MD = "# One\n\nText a\nmore\n\n- **Key:** value\n- item two\n\n## Two\n\n> said\n> so\n\n```\ncode # no heading\n```\n\n# Three\n\nend"
TEX = r"""\documentclass{article}\newcommand{\R}{\mathbb{R}}\newcommand{\pair}[2]{(#1,#2)}
\begin{document}
\section{Intro}\label{sec:a} % note
Text on \R{} and \pair{x}{y}, see \cite{k1,k2} and \ref{thm:m}. 50\% sure.
\begin{theorem}[Main]\label{thm:m} It holds. \end{theorem}
\begin{proof} By \ref{sec:a}. \end{proof}
\[ x = 1 \]
\begin{itemize}\item one \item two \begin{equation} y \end{equation} more \end{itemize}
\subsection{Sub} As \eqref{gone}.
\end{document}"""
BBL = r"\begin{thebibliography}{9}\bibitem{k1} First   entry. \bibitem[x]{k2} Second.\end{thebibliography}"
PAGE = """<html><body><div class="ltx_page_content"><section class="ltx_section"><h2 class="ltx_title"><span class="ltx_tag">1 </span>Start</h2>
<div class="ltx_para"><p class="ltx_p">Hello <a class="ltx_ref" href="#bib.b1">1</a> and <a class="ltx_ref" href="#S9">9</a>.</p></div>
<div class="ltx_theorem ltx_theorem_remark"><h6 class="ltx_title">Remark</h6><p>So.</p></div>
<div class="ltx_para">Before <table class="ltx_equation"><tr><td><math class="ltx_Math" alttext="x=1">x=1</math></td></tr></table> after</div></section>
<section class="ltx_bibliography"><ul><li class="ltx_bibitem" id="bib.b1">Entry</li></ul></section></div></body></html>"""


def kinds(doc):
    return [(n["type"], n["title"], n["depth"]) for n in doc["nodes"]]


def test_markdown_tree():
    doc = markdown.extract(MD, "d")
    assert kinds(doc) == [("document", "d", 0), ("section", "One", 1), ("paragraph", None, 2), ("list", None, 2), ("metadata_field", "Key", 3), ("list_item", None, 3), ("section", "Two", 2), ("block", None, 3), ("block", None, 3), ("section", "Three", 1), ("paragraph", None, 2)]
    ids = [n["id"] for n in doc["nodes"]]
    assert ids[4] == "d/section.1/list.1/metadata_field.1" and ids[-1] == "d/section.3/paragraph.2"
    spans = [(n["span"]["start"], n["span"]["end"]) for n in doc["nodes"] if n["type"] == "paragraph"]
    assert [MD[a:b] for a, b in spans] == ["Text a\nmore", "end"]


def test_markdown_riddles():
    doc = markdown.extract("> a\n\nb\n\n---\n\n> c\n\nd", "r")
    assert kinds(doc) == [("document", "r", 0), ("example", "riddle 1", 1), ("block", None, 2), ("paragraph", None, 2), ("example", "riddle 2", 1), ("block", None, 2), ("paragraph", None, 2)]
    assert doc["nodes"][2]["attrs"] == {"kind": '"source_analog"'} and doc["nodes"][3]["attrs"] == {"kind": '"target_analog"'}


def test_latex_normalization():
    body, log = latex.normalize(TEX)
    assert r"\mathbb{R}" in body and "(x,y)" in body and "note" not in body and r"50\% sure" in body and not body.startswith("\\documentclass")
    assert latex.normalize(body, {})[0] == body
    assert latex.extract_macros(TEX) == {"R": (0, r"\mathbb{R}"), "pair": (2, "(#1,#2)")}
    assert latex.strip_comments(r"a\%b%c" + "\nd") == ("a\\%b\nd", 2)
    assert latex.flatten("m", {"m": r"a \input{x} b \input{y} \input{x}", "x.tex": "X"}) == ("a X b  ", ["y"])


def test_latex_tree_and_references():
    doc = latex.extract(latex.normalize(TEX)[0], "t", BBL)
    types = [n["type"] for n in doc["nodes"]]
    assert types == ["document", "section", "paragraph", "theorem", "proof", "equation", "list", "list_item", "list_item", "paragraph", "equation", "paragraph", "section", "paragraph", "section", "bib_reference", "bib_reference"]
    edges = {(e["relation"], e["target"], e["resolved"]) for e in doc["edges"]}
    assert edges == {("cites", "t/bib.1", True), ("cites", "t/bib.2", True), ("refers_to", "t/section.1/theorem.1", True), ("refers_to", "gone", False)}
    assert doc["nodes"][-1]["text"] == "Second." and doc["nodes"][3]["title"] == "Main" and doc["nodes"][12]["depth"] == 2


def test_html_tree():
    doc = html.extract(PAGE, "p")
    assert kinds(doc) == [("document", "p", 0), ("section", "Start", 1), ("paragraph", None, 2), ("remark", "Remark", 2), ("paragraph", None, 2), ("equation", None, 2), ("paragraph", None, 2), ("section", "References", 1), ("bib_reference", None, 2)]
    assert [(e["relation"], e["resolved"]) for e in doc["edges"]] == [("cites", True), ("refers_to", False)]
    assert html.extract("", "e")["nodes"][0]["type"] == "document" and html.outline_of_page("<h1>A</h1><p>x<p>y", "q")["nodes"][1]["title"] == "A"


@pytest.fixture(scope="module")
def decomposed(spark):
    docs = spark.createDataFrame([("a", TEX, BBL), ("b", None, None)], "slug string, text string, bbl string")
    out = latex.decompose(docs).cache()
    return markdown.node_rows(out).cache(), markdown.edge_rows(out).cache(), out


def test_checks(spark, decomposed):
    nodes, edges, out = decomposed
    lengths = out.select("slug", F.col("n_chars").alias("length"))
    got = {(r["scope"], r["name"]): r["passed"] for r in checks.run_all(nodes, edges, lengths, 0.3).collect()}
    assert got["a", "unique_ids"] and got["a", "acyclic_tree"] and got["a", "reference_integrity"] and got["a", "schema_valid"] and got["a", "character_coverage"]
    twice = nodes.unionByName(nodes.filter("type = 'proof'"))
    assert not checks.unique_ids(twice).filter("scope = 'a'").first()["passed"]
    lost = edges.withColumn("target", F.lit("nothing")).withColumn("attrs", F.expr("cast(map() as map<string,string>)"))
    assert not checks.reference_integrity(nodes, lost).filter("scope = 'a'").first()["passed"]
    cut = nodes.filter("type <> 'document'")
    assert not checks.acyclic_tree(cut).filter("scope = 'a'").first()["passed"]


def test_sweep(spark):
    s = spark.createDataFrame([("d", "1", 0, 7), ("d", "2", 5, 10), ("d", "3", 8, 9), ("e", "1", 0, 5), ("e", "2", 5, 10)], "slug string, id string, start int, end int")
    assert {(r["slug"], r["covered"], r["overlap"]) for r in checks.sweep(s, ["slug"]).collect()} == {("d", 10, 3), ("e", 10, 0)}


def test_lift(spark, decomposed):
    nodes, edges, _ = decomposed
    c, r = lift.concepts(nodes).cache(), lift.relations(nodes, edges).cache()
    counts = {x["predicate"]: x["count"] for x in r.filter("slug = 'a'").groupBy("predicate").count().collect()}
    assert counts == {"contains": 16, "cites": 2, "refers_to": 2, "proves": 1, "derives_from": 1}
    assert [x["id"] for x in r.filter("slug = 'a'").orderBy("seq").limit(2).collect()] == ["r.1", "r.2"]
    proof = r.filter("predicate = 'proves'").first()
    assert proof["object"] == "a/section.1/theorem.1" and proof["higher_order"]
    assert lift.renaming_invariant(c, r)
    s = {x["slug"]: (x["n_higher_order_relations"], x["max_reasoning_depth"], x["systematicity_score"]) for x in lift.systematicity(r).collect()}
    assert s["a"] == (2, 1, 4)
    assert {x["passed"] for x in checks.run_concept_checks(c, r, edges).collect()} == {True}
    loop = spark.createDataFrame([("l", "a", "b", True), ("l", "b", "a", True)], "slug string, subject string, object string, higher_order boolean")
    assert not checks.reasoning_acyclic(loop).first()["passed"]
    lines = [x["line"] for x in lift.ntriples(c, r).filter("slug = 'a'").orderBy("part", "k1", "k2", "k3").collect()]
    assert lines[0] == '<op:a> <op:kind> "document" .' and '<op:a/section.1/paragraph.1> <op:cites> <op:a/bib.1> .' in lines
    vec = {x["feature"]: x["cnt"] for x in lift.content_vector(c, r).filter("id = 'a'").collect()}
    assert vec["rel:contains"] == 16 and vec["attr:theorem"] == 1
    assert lift.dgroup(c, r).filter("part = 'higher_order'").count() == 2


def test_text_columns(spark):
    df = spark.createDataFrame([("a \r\n<!-- x\ny -->b\n\n\n\nc  ",)], "t string")
    once = T.normalize_markdown(F.col("t"))
    assert df.select(once.alias("x")).first()["x"] == "a\nb\n\nc" and df.select((T.normalize_markdown(once) == once).alias("x")).first()["x"]
    row = spark.range(1).select(T.content_hash(F.lit("x")).alias("h"), T.role_for(F.lit("proof")).alias("r"), T.role_for(F.lit("new")).alias("n"), T.sanitize_title(F.lit("* A ")).alias("s"), T.is_real_label(F.lit("a=b")).alias("l"), T.strip_comments(F.lit("a\\%b%c\nd")).alias("c")).first()
    assert (row["h"], row["r"], row["n"], row["s"], row["l"], row["c"]) == ("sha256:2d711642b726b044", "assert", "narrate", "A", False, "a\\%b\nd")


def test_title_comparison(spark):
    page = '<h2><span class="ltx_tag">1 </span>Intro</h2><h3>Report Issue</h3><h2>Method &amp; Data</h2><div class="ltx_theorem"></div>'
    assert checks.section_titles(page) == ["Intro", "Method & Data"] and checks.theorem_count(page) == 1
    df = spark.createDataFrame([("d", ["Introduction", "Methods and data", "Other"], ["Introductions", "Methods and datas"])], "slug string, ours array<string>, theirs array<string>")
    row = checks.compare_sections(df).first()
    assert (row["n"], row["matched"], row["recall"]) == (3, 2, 0.6667)


def test_used_up_rounds_are_told(spark):
    from factloom.operators import checks, lift

    nodes = spark.createDataFrame([("s", str(i), str(i - 1) if i else None) for i in range(5)], "slug string, id string, parent_id string")
    chain = spark.createDataFrame([("s", str(i), str(i + 1), True) for i in range(5)], "slug string, subject string, object string, higher_order boolean")
    with pytest.raises(ValueError, match="acyclic_tree"):
        checks.acyclic_tree(nodes, rounds=2)
    with pytest.raises(ValueError, match="systematicity"):
        lift.systematicity(chain, rounds=2)
