"""SentencePiece, PII, toxicity, WARC and URL operators."""

import gzip
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import pii, queries, reputation, toxicity, warc
from factloom.llm import sentencepiece_codec as S

MODEL = S.MODEL
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer model here")
LONG = "word " * 40_000


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return S.Codec(f.read())


@needs_model
def test_ids_are_the_librarys(codec):
    import random

    import sentencepiece

    lib, draw = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(5)
    letters = "abcdehirstn  ▁▁\n\t.,!?1290éü中文한🙂<0x0A>_--()"
    for _ in range(300):
        x = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        assert codec.encode(x) == lib.encode(x) and codec.decode(codec.encode(x)) == x.replace("▁", " ")
        spaced = S.SPACE + x.replace(" ", S.SPACE) if x else ""
        assert [i for p in codec.encode_stream(spaced) for i in codec._ids_of(p)] == lib.encode(x)


@needs_model
def test_stream_commits_before_the_end(codec):
    taken = []

    def chars():
        for c in "▁the▁quick▁brown▁fox" * 40:
            taken.append(c)
            yield c

    first = next(iter(codec.encode_stream(chars())))
    assert first == "▁the" and len(taken) < 200


@needs_model
def test_whole_documents_are_streamed():
    """Windows are committed all along a document, each no longer than a few pieces, and the ids are the library's."""
    import random

    import sentencepiece

    with open(MODEL, "rb") as f:
        codec = S.Codec(f.read())
    lib, draw = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(8)
    words = ["".join(draw.choice("abcdefghilmnorstuäé-") for _ in range(draw.randint(1, 12))) for _ in range(300)]
    for n in (10, 400, 3000):
        text = draw.choice([" ", "\n"]).join(draw.choice(words) for _ in range(n)) + "x" * n
        want = lib.encode(text)
        codec.commits = codec.window = 0
        got = [i for p in codec.encode_stream(S.SPACE + text.replace(" ", S.SPACE)) for i in codec._ids_of(p)]
        assert got == want and codec.commits > n / 2 and codec.window <= 64 * codec.longest
        fresh = S.Codec(open(MODEL, "rb").read())
        assert fresh.encode(text) == want and 0 < fresh.commits  # the query's way, through the same encoder
        before = fresh.commits
        assert fresh.encode(" ".join(text.split())) and fresh.commits >= before


@needs_model
def test_stream_does_little_a_character():
    """Words made of known parts take few steps a character, counted in lines run, so that no clock is needed."""
    import random
    import sys

    with open(MODEL, "rb") as f:
        codec = S.Codec(f.read())
    draw = random.Random(4)
    parts = ["th", "on", "tion", "er", "ing", "ea", "sh", "the", "ou", "re", "nd", "ha"]
    words = [S.SPACE + "".join(draw.choice(parts) for _ in range(draw.randint(2, 5))) for _ in range(6000)]
    lines = 0

    def trace(frame, event, _):
        nonlocal lines
        if frame.f_code.co_filename != S.__file__:
            return None
        lines += event == "line"
        return trace

    for x in words[:5000]:
        list(codec.encode_stream(x))
    before = sys.gettrace()
    sys.settrace(trace)
    try:
        for x in words[5000:]:
            list(codec.encode_stream(x))
    finally:
        sys.settrace(before)
    assert lines < 25 * sum(map(len, words[5000:]))


@needs_model
def test_ids_when_little_is_kept(monkeypatch):
    import random

    import sentencepiece

    for name, most in (("MOVES", 40), ("PAIRS", 15)):
        monkeypatch.setattr(S, name, most, raising=False)
    with open(MODEL, "rb") as f:
        codec = S.Codec(f.read())
    lib, draw = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(6)
    for n in range(200):
        x = "".join(draw.choice("abcdehirstno  \n.,129éü中🙂-") for _ in range(n))
        spaced = S.SPACE + x.replace(" ", S.SPACE) if x else ""
        assert [i for p in codec.encode_stream(spaced) for i in codec._ids_of(p)] == lib.encode(x) == codec.encode(x)
    assert codec.room == 0 and codec.pairs <= 15 and sum(map(len, codec.fits.values())) <= 15


def test_pieces_fit_if_merging_both_leaves_them():
    """Against plain merging, also where a longer piece has the higher score and where scores are equal."""
    import random

    from sentencepiece import sentencepiece_model_pb2 as pb

    def merged(text, scores):
        parts = list(text)
        while True:
            best = max((scores[a + b] for a, b in zip(parts, parts[1:], strict=False) if a + b in scores), default=None)
            if best is None:
                return parts
            i = next(i for i in range(len(parts) - 1) if scores.get(parts[i] + parts[i + 1]) == best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    draw = random.Random(9)
    for _ in range(40):
        scores = {c: -99.0 for c in "abc"} | {"".join(draw.choice("abc") for _ in range(draw.randint(2, 5))): float(-draw.randint(1, 12)) for _ in range(25)}
        m = pb.ModelProto()
        m.trainer_spec.model_type, m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = 2, "identity", False
        m.pieces.add(piece="<unk>", score=0.0, type=2)
        for p, s in scores.items():
            m.pieces.add(piece=p, score=s, type=1)
        c = S.Codec(m.SerializeToString())
        for p in scores:
            assert c.follows(None, p) == (merged(p, scores) == [p])
            for before in [*scores, "x"]:
                assert c.follows(before, p) == (merged(before + p, scores) == [before, p])


def test_unigram_viterbi_is_the_best_segmentation():
    from itertools import product

    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.normalizer_spec.name = 1, "identity"
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, False
    scores = {"▁": -2.0, "a": -1.5, "b": -1.7, "ab": -2.5, "▁a": -2.9, "ba": -2.6, "bab": -3.9, "aab": -3.8}
    m.pieces.add(piece="<unk>", score=0.0, type=2)
    for p, s in scores.items():
        m.pieces.add(piece=p, score=s, type=1)
    c = S.Codec(m.SerializeToString())

    def best(text):
        if not text:
            return 0.0
        return max((scores[text[:n]] + best(text[n:]) for n in range(1, 4) if text[:n] in scores), default=-1e9)

    for n in range(1, 8):
        for x in product("ab ", repeat=n):
            text = "".join(x)
            got = [c.pieces[i] for i in c.encode(text)]
            assert "".join(got) == "▁" + text.replace(" ", "▁") and abs(sum(scores[p] for p in got) - best("".join(got))) < 1e-9
    assert c.encode("azb")[1:] != [] and c.unknown in c.encode("azzb") and c.encode("azzb").count(c.unknown) == 1


@needs_model
def test_encoding_of_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "a b", 3), (3, LONG, 4), (3, LONG, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")  # ids clashes with a result
    got = {(r["doc_id"], r["n_tokens"], r["round_trip"]) for r in S.encode_documents(df).collect()}
    assert got == {(1, 0, True), (2, 0, True), (None, 2, True), (3, 40_001, True)}
    assert S.encode_documents(df.limit(0)).count() == 0
    back = S.decode_documents(S.encode_documents(df.filter("doc_id = 3").limit(1)))
    assert back.first()["text"] == LONG


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for n, (kind, rx) in enumerate(KINDS.items()):
        for m in re.finditer(rx, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or luhn % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), n, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


ODD = [
    None, "", "a@b.c_d@e.f x@y", "é a.b+c@d-e.fr. 1.2.3.4.5.6.7.8 999.1.1.1 256.1.1.1 001.2.3.004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (389) 555-5010, +12 3, +1234567890123456 +1.....",
    "🙂 mail x@y.zz at 10.0.0.1 key=4111111111111111", "7" * 5000, "a" * 20_000, "1 " * 3000, "." * 5000 + "@" * 50, "+1" + "(" * 3000, "a@" * 2000, "@a.b", "token = \"7ccfcfa5a2be00bd5a9b3425282c8cfa808515fc\" and password=cf56f5256e617c382b",
]


def test_base_spans_are_the_plain_ones(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)], "doc_id long, text string, spans long")
    got = {r["doc_id"]: r for r in pii.detect(df).select("doc_id", pii.span_string(F.col("base")).alias("base"), pii.span_string(F.col("spans")).alias("spans")).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        assert got[i]["base"] == plain_spans(t), t
        assert set(filter(None, got[i]["base"].split(","))) <= set(got[i]["spans"].split(","))
    assert pii.detect(df.limit(0)).count() == 0
    assert got[len(ODD) - 1]["spans"].count("secret") == 2


def test_private_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no tables here")
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    for r in queries.op6_personal_data(spark, sf).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["n_email"] == want.count("email") and r["n_card"] == want.count("card")


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail x@y.zz, now"), (2, None), (3, "none")], "doc_id long, text string")
    out = pii.detect(df, carry=True).select("doc_id", pii.redact(F.col("row.text"), F.col("spans")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in out.collect()} == {1: "mail [email], now", 2: None, 3: "none"}


def test_expectation_maximisation_tells_good_labelers():
    patterns = [((1, 1, 1), 90), ((1, 1, -1), 10), ((-1, -1, 1), 100), ((-1, -1, -1), 100), ((1, -1, 1), 4)]
    rate, table = pii.reliabilities(patterns)
    assert table[0][1][0] > 0.9 > 0.1 > table[0][1][1] and 0.2 < rate < 0.5
    assert pii.posterior((1, 1, -1), rate, table) > 0.9 > 0.1 > pii.posterior((-1, -1, 1), rate, table)
    w = pii.fit_classifier(patterns)
    assert w[1] > abs(w[3]) and pii.fit_classifier([]) == [0.0] * 6


def test_kinds_have_their_own_reliabilities():
    """A labeler that is right about one kind and wrong about another counts for each as it should."""
    votes = [((1, 1, 1), 80), ((-1, -1, -1), 80), ((1, -1, 1), 5)]
    turned = [((-1, 1, 1), 80), ((1, -1, -1), 80)]
    more = [(1.0, 0.0, 1.0), (1.0, 0.0, 0.0), (1.0, 0.0, 1.0), (0.0, 1.0, 1.0), (0.0, 1.0, 0.0)]
    w = pii.fit_classifier(votes + turned, [0, 0, 0, 1, 1], more)
    assert len(w) == 1 + 3 + 3 and w[6] > 0.5  # the feature that goes with the posteriors
    logit = lambda v, x: w[0] + sum(a * b for a, b in zip(w[1:], (*v, *x), strict=True))
    assert logit((1, 1, 1), more[0]) > 0 > logit((-1, -1, -1), more[1]) and logit((-1, 1, 1), more[3]) > 0 > logit((1, -1, -1), more[4])


def test_base_spans_have_scores(spark):
    texts = ["mail to ann@example.org or 10.1.2.3", "version 1.2.3.4 of it", "card 4111 1111 1111 1111", "call +1 389 555 5010 now"] * 5
    got = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(F.explode("spans").alias("x")).select("x.*").collect()
    assert len(got) == 25 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got}) > 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_edit_distance():
    import random

    draw = random.Random(3)
    terms = [("idiot", False), ("scum", False), ("disgusting", False), ("worthless", False), ("vequ", True)]
    a = toxicity.Automaton(terms)
    tokens = ["", "idiot", "idi0t", "idot", "idioot", "diiot", "scum", "scun", "disgsting", "disgustngg", "worthles", "vequ", "vequeur", "veq", "xvequ", "z" * 5000]
    tokens += ["".join(draw.choice("idotscumvequwrhlgn") for _ in range(draw.randint(1, 11))) for _ in range(3000)]
    for t in tokens:
        whole = [edits(t, w) for w, s in terms if not s and len(t) < 100 and edits(t, w) <= toxicity.allowed_edits(w, False)]
        want = min(whole) if whole else None
        if t.startswith("vequ") and want != 0:
            want = 0
        got = a.match(t)
        assert (None if got is None else got[1]) == want, t


def test_misspelled_stems_and_short_words():
    a = toxicity.Automaton([("idiot", True), ("vequ", True), ("scum", False), ("idiotic", False)])
    for token, want in [("idiots", (0, 0)), ("idi0ts", (0, 1)), ("idots", (0, 1)), ("xidiots", (0, 1)), ("idiioting", (0, 1)), ("idi0tic", (3, 1)), ("idioms", None), ("idio", None), ("i0i0ts", None), ("veqx", None), ("scvm", (2, 1)), ("scum", (2, 0)), ("sum", None), ("scums", None), ("sxvm", None)]:
        assert a.match(token) == want, token
    rows = [("idiot", True, 30, 0), ("idiots", False, 15, 0), ("idiotic", False, 15, 0), ("scum", False, 20, 0)]
    assert {(t, s) for t, s, _, _ in toxicity.choose_terms(rows, 60, 600)} == {(t, s) for t, s, _, _ in rows}


TOXIC = [(i, f"plain words number {i} here and you are a stupid moron today", 1) for i in range(1, 60)] + [(i, f"plain words number {i} here and nothing bad at all today", 0) for i in range(60, 400)]


def test_toxicity_on_held_out_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in TOXIC] + [(1000, "a MORN and a stupidd thing, moron", 0.1, "y"), (1001, None, 0.1, "y"), (1002, "", 0.1, "y"), (None, "fine", 0.1, "y"), (1001, None, 0.2, "z")], "doc_id long, text string, score double, held_out string")
    labels = spark.createDataFrame([(i, y) for i, _, y in TOXIC] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(TOXIC) + 5
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == y for i, _, y in TOXIC) and by[1000]["predicted"] == 1 and by[1001]["score"] == by[1002]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in TOXIC)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(TOXIC) - 59 + 4


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in TOXIC], "doc_id long, text string")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = spark.createDataFrame([(i, y) for i, _, y in TOXIC], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert (a.terms, a.weights) == (b.terms, b.weights)
    none = toxicity.score_documents(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1 and toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_only_hit_misspelled_or_quoted(spark):
    """A misspelled term is caught where it is the only hit; a quoted one scores lower than a plain one."""
    extra = [(2000 + i, f"plain words {w} here today") for i, w in enumerate(["m0ron", "morom", "stupd", "moron", 'he wrote "moron"', "maroon", "number"])]
    rows = [(i, f"plain words {'maroon' if i % 2 and not y else ''} {('moron', 'stupid')[i % 2] if y else 'number'} here today", y) for i, _, y in TOXIC]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).filter("doc_id >= 2000").collect()}
    assert min(score[2000], score[2001], score[2002], score[2003]) >= 0.5 > score[2005]  # maroon is a usual word
    assert score[2004] < score[2003] and score[2006] < 0.5


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in TOXIC], "doc_id long, text string")
    many = docs.unionByName(docs.filter("doc_id < 100").withColumn("text", F.concat("text", F.lit(" z"))))
    labels = spark.createDataFrame([(i, y) for i, _, y in TOXIC], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, labels), toxicity.fit(many.unionByName(many), labels)
    assert (a.terms, a.weights, a.usual) == (b.terms, b.weights, b.usual)


def test_signs_and_folds():
    """Near words of clean rows in both folds are usual; a term whose near words are common gets no weight."""
    terms = [("moron", False, 6.0, 100), ("stupid", False, 6.0, 100)]
    got = toxicity.misspelled_weights(terms, [{"oron": 50, "stupida": 40}, {"oron": 30, "stupido": 60}], 400, 3000)
    assert got[0][3] > 2 and got[1][3] == 0
    m = toxicity.Matcher(got, frozenset(["oron"]))
    assert m["m0ron"] == (0, 1) and m["oron"] is None and m["stupids"] is None and m["stupid"] == (1, 0)
    assert m.corrupted("a Moron, here") != "a Moron, here" and m.features(m.corrupted("a moron here"))[:2][0] == 0 < m.features(m.corrupted("a moron here"))[1]
    w = toxicity.fit_logistic(np.array([[0.0, 1, 1, 0, 0]] * 5 + [[1.0, 0, 0, 0, 0]] * 5), np.array([0.0] * 5 + [1.0] * 5), np.ones(10))
    assert w[2] == 0 == w[3]


def test_quoted_terms_count_apart():
    m = toxicity.Matcher([("moron", False, 5.0, 3.0)])
    plain, quoted, said = m.features("you moron there"), m.features('he wrote "you moron" there'), m.features("she said moron then")
    assert plain[0] > 0 == plain[2] and quoted[2] > 0 == quoted[0] and said[2] > 0 and m.features(None) == [0.0] * 5


def test_url_parts_and_rules(spark):
    urls = [(1, "http://A.Example.NET/en/1?x#y"), (2, "https://example.net"), (3, "http://b.example.com/de/x"), (4, "http://q.org/fr/"), (5, "http://q.org/fr"), (6, None), (7, "no scheme"), (8, "x://user:pw@host:80#f"), (9, "a://b.net/http://c.org/fr/"), (10, "http://notexample.net/en/"), (10, "http://net/"), (None, "http://examplenet/")]
    df = spark.createDataFrame([(*u, "clash") for u in urls], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0)], "page_id long, good int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in reputation.judge(df, labels).collect()}
    assert got == {
        (1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "example.net", "", None, "allow"), (3, "b.example.com", "/de/x", "example.com/de/", "block"), (4, "q.org", "/fr/", "org/fr/", "allow"),
        (5, "q.org", "/fr", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "user:pw@host:80", "", None, "allow"), (9, "b.net", "/http://c.org/fr/", "net/", "block"),
        (10, "notexample.net", "/en/", "net/", "block"), (10, "net", "/", "net/", "block"), (None, "examplenet", "/", None, "allow"),
    }
    assert reputation.judge(df.limit(0), labels).count() == 0 and reputation.judge(df, labels.limit(0)).count() == len(urls)


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [(i, f"http://bad.site.org/{i}") for i in range(60)] + [(100 + i, f"http://good.site.org/{i}") for i in range(60)] + [(300, "http://new.site.org/")]
    labels = [(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(60)]
    df, l = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")
    got = {r["host"]: r for r in reputation.judge(df, l, rules=()).collect()}
    assert got["bad.site.org"]["verdict"] == "block" and got["good.site.org"]["verdict"] == "allow" and got["new.site.org"]["verdict"] == "allow"
    assert got["bad.site.org"]["host_rate"] < got["new.site.org"]["host_rate"] < got["good.site.org"]["host_rate"]


HTML = '<html lang="fr"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One<br>two &eacute; 1 < 2</p><a href="/l?a=1&amp;b">L</a></body></html>'


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", HTML, "z"), (2, None, None, "z"), (3, "u", "", "z"), (3, "u", "", "z")], "page_id long, url string, html string, record_id string")
    records = warc.responses(pages)
    made = warc.derivatives(records, "page_id").collect()
    assert len(made) == 8
    import json

    source = {r["page_id"]: r for r in records.collect()}
    one = {r["type"]: r for r in made if r["page_id"] == 1}
    assert one["conversion"]["block"].decode() == "A & B\nOne\ntwo é 1 < 2\nL"
    about = json.loads(one["metadata"]["block"].decode())
    assert about["links"] == ["/l?a=1&b"] and about["title"] == "A & B" and about["language"] == "fr" and about["conversion"] == one["conversion"]["record_id"]
    assert about["source-headers"][0] == ["Content-Type", "text/html; charset=utf-8"] and about["source-payload-digest"] == warc.digest(HTML.encode()) == source[1]["headers"]["WARC-Payload-Digest"]
    for r in made:
        assert r["refers_to"] == source[r["page_id"]]["record_id"] == r["headers"]["WARC-Refers-To"] and r["headers"]["WARC-Block-Digest"] == warc.digest(bytes(r["block"])) and int(r["headers"]["Content-Length"]) == len(r["block"])
    members = [bytes(r["member"]) for r in warc.warc_bytes(records).orderBy("record_id").collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "b.warc").write_bytes(b"".join(gzip.decompress(m) for m in members))
    for name in ("a.warc.gz", "b.warc"):
        back = warc.read_warc(spark, str(tmp_path / name))
        assert sorted((r["record_id"], bytes(r["block"])) for r in back.collect()) == sorted((r["record_id"], bytes(r["block"])) for r in records.collect())
        assert warc.derivatives(back).count() == 8
    assert warc.derivatives(records.limit(0)).count() == 0 and warc.derivatives(records.withColumn("type", F.lit("request"))).count() == 0


def test_hostile_pages_take_linear_time():
    """Openers without an end, a hundred thousand of them, and tags without a bracket."""
    import time

    began = time.process_time()
    for piece in ("<script>", "<!--", "<script", "<a ", "<html ", "<title>", "<title", "<style></script>", '<a href="', "<a href='x>", "</p", "<html lang"):
        page = piece * 100_000
        assert isinstance(warc.plain_text(page), str) and warc.about_page(page + ">", warc.shown(page + ">"))
    assert time.process_time() - began < 20


def test_shown_parts():
    assert warc.shown("a<!-- x -->b<SCRIPT x='1'>c</script >d<style>e") == "a b d<style>e" and warc.shown("<!-->x--> y") == "  y"
    assert warc.about_page("<title>a<b>c</TITLE><html lang=de>", "<html lang=de><a class=x href='u'>") == ("a<b>c", "de", ["u"])
    assert warc.about_page('<a href="x>y">', '<a href="x>y">')[2] == ["x>y"]


def test_ports_users_and_addresses_share_no_domain(spark):
    rows = [(1, "http://u:p@a.site.org:8080/x"), (2, "http://a.site.org/"), (3, "http://192.0.2.1:80/"), (4, "http://192.0.2.2/"), (5, "http://b.co.in/")]
    labels = spark.createDataFrame([(1, 0)] * 1 + [(3, 0)], "page_id long, good int")
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in reputation.judge(df, labels, rules=()).collect()}
    assert got[1]["host"] == "u:p@a.site.org:8080" and got[1]["host_rate"] == got[2]["host_rate"]
    levels = df.select("page_id", *[x.alias(n) for x, n in zip(reputation._levels(reputation.site_of(reputation.split_url(F.col("url"))[0]), (*reputation.SUFFIXES, "co.in")), ("d", "s"), strict=True)])
    assert {tuple(r) for r in levels.collect()} == {(1, "site.org", "org"), (2, "site.org", "org"), (3, "192.0.2.1", "address"), (4, "192.0.2.2", "address"), (5, "b.co.in", "co.in")}


def plain_page(page):
    """Title, links and text by patterns over the whole page, as far as all tags are closed."""
    import html

    kept = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", " ", page)
    title = re.search(r"(?is)<title\b[^>]*>(.*?)</title\s*>", page)
    links = [html.unescape(a or b or c) for a, b, c in re.findall(r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", kept)]
    text = re.sub(r"(?i)<(?:br|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|title|blockquote|pre))\b[^>]*>", "\n", kept)
    text = html.unescape(re.sub(r"<[/!?a-zA-Z][^>]*>", "", text))
    return html.unescape(title[1]).strip() if title else None, links, re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\v\xa0]+", " ", text)).strip()


def test_derivatives_of_the_table_are_the_plain_ones(spark):
    import json

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no tables here")
    pages = {i: (u, h or "") for i, u, h in duckdb.sql(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall()}
    rows = queries.op10_warc_derivatives(spark, sf).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        title, links, text = plain_page(pages[r["page_id"]][1])
        if r["type"] == "conversion":
            assert r["content"] == text
        else:
            about = json.loads(r["content"])
            assert about["links"] == links and (about["title"] or None) == (re.sub(r"[ \t\r\f\v\xa0]+", " ", title).strip() if title else None)


def plain_score(model, text):
    """A document's score by comparing each word with each term."""
    import math

    weights, words = model.weights, (text or "").lower().split()
    hits = []
    for i, token in enumerate(words):
        word, best = token.strip(toxicity.PUNCTUATION), None
        for n, (term, stem, _, near) in enumerate(model.terms):
            limit = toxicity.allowed_edits(term, stem)
            if stem:
                ends = [edits(word[:k], term) for k in range(1, len(word) + 1) if word[k - 1] == term[-1] and edits(word[: k - 1], term[:-1]) <= limit]
                cost = min((edits(word[: k - 1], term[:-1]) for k in range(1, len(word) + 1) if word[k - 1] == term[-1]), default=9) if ends else 9
            else:
                cost = edits(word, term) if len(term) > 4 else sum(a != b for a, b in zip(word, term, strict=False)) if len(word) == len(term) else 9
            if cost <= limit and (best is None or cost < best[0]):
                best = (cost, n)
        if best and not (best[0] and (word in model.usual or model.terms[best[1]][3] <= 0)):
            hits.append((i, *best))
    exact = near = quoted = crowd = meant = 0.0
    for k, (i, cost, n) in enumerate(hits):
        w = model.terms[n][3 if cost else 2]
        before, after = words[max(0, i - 8) : i], words[i + 1 : i + 9]
        opened = any(x[0] in toxicity.QUOTES for x in [*before, words[i]]) and any(x[-1] in toxicity.QUOTES for x in [words[i], *after])
        if opened or toxicity.REPORTING & set(before[-3:]):
            quoted += w
            continue
        meant += 1
        exact, near = (exact, near + w) if cost else (exact + w, near)
        if any(abs(i - j) <= 8 for j, _, _ in hits[max(0, k - 1) : k] + hits[k + 1 : k + 2]):
            crowd += w
    x = [math.log1p(exact), math.log1p(near), math.log1p(quoted), math.log1p(crowd), meant / (len(words) + 1)]
    z = weights[0] + sum(a * b for a, b in zip(weights[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_are_the_plain_ones():
    terms = [("moron", False, 6.0, 4.0), ("scum", False, 5.5, 4.0), ("worthless", False, 6.0, 0.0), ("stupid", False, 5.0, 3.0)]
    model = toxicity.Model(terms, [-4.0, 2.5, 2.0, 0.5, 1.0, 12.0], frozenset(["stupor", "morons"]))
    score = model.scorer()
    texts = [None, "", "plain words", "you m0ron", "you moron and scum here", "scvm", "sum", "worthles", "worthless!", 'he said "stupid" twice', "stupor stupd stupid.", "morons moroon", " ".join(["x"] * 50 + ["scum"] + ["y"] * 9 + ["stupit"])]
    for t in texts:
        assert abs(score(t) - plain_score(model, t)) < 1e-12, t


def test_plain_text_of_odd_pages():
    assert warc.plain_text("") == "" and warc.plain_text("a < b > c <unclosed") == "a < b > c <unclosed" and warc.plain_text("<p>a</p><script>never closed") == "a\nnever closed"
    assert warc.split_http(b"no head") == ("", [], b"no head") and warc.split_http(b"HTTP/1.1 200 OK\nA: 1\nA: 2\n\nbody") == ("HTTP/1.1 200 OK", [("A", "1"), ("A", "2")], b"body")
