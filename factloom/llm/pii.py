"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: Base kinds in their order. Runs are possessive, which changes no match and keeps long texts linear; a match
#: of email and ip can start only where a run does or where the match before ended, as the leftmost one must.
BASE = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?+[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Candidates of the kinds that the method adds. A candidate never overlaps a base span.
ADDED = {
    "secret": "(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+",
    "national": "(?<![0-9+])\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}(?![0-9])",
    "id": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = (*BASE, *ADDED)
#: Words that name a private value: of each base kind, and of the kinds that the method adds.
NAMES = {"email": ("mail", "email", "e-mail", "contact", "write", "to", "from"), "ip": ("ip", "host", "server", "address", "addr", "login", "from"), "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pay", "payment", "number"), "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "number", "at")}
GAZETTEER = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "key", "credential", "phone", "tel", "call", "fax", "ssn", "social", "id", "passport", "account")
#: Code points before a candidate that the context labelers see.
CONTEXT = 24
#: Passes of expectation-maximisation over the vote patterns of a kind.
PASSES = 40
LABELERS = ("shape", "gazetteer", "assigned", "mixed", "plain")
#: What the classifier sees besides the votes, each in a few steps from 0 to 3.
FEATURES = ("long", "digits", "classes", "distinct", "before")


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches: the pieces between the matches and the matches alternate, so lengths give places."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    none = F.expr("struct(0 as at, cast(array() as array<struct<start:int,end:int,kind:int,match:string>>) as spans)")
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("between"), m.alias("match")))
    return F.aggregate(pairs, none, step, lambda acc: acc["spans"])


def _luhn(digits: Column) -> Column:
    """Luhn's sum over a string of digits, from the right."""
    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str):
    def test(x: Column) -> Column:
        digits = F.regexp_replace(x["match"], "[^0-9]", "")
        if kind == "ip":
            return x["match"].rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$")
        if kind == "card":
            return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
        if kind == "phone":
            return F.length(digits).between(9, 15)
        return F.lit(True)

    return test


def _hint(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind the spans that pass its test, from the left."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,match:string>>)")
    return {k: F.when(_hint(text, k), F.filter(_matches(text, p, k), _valid(k))).otherwise(none) for k, p in BASE.items()}


def _votes(text: Column, x: Column) -> dict[str, Column]:
    """1 for private, -1 against, 0 abstains; the labeler of shapes and the gazetteer know the kinds."""
    before = F.lower(F.substr(text, F.greatest(F.lit(1), x["start"] + 1 - CONTEXT), F.least(x["start"], F.lit(CONTEXT))))
    n = F.length(F.regexp_replace(x["match"], "[^0-9]", ""))
    letters = F.length(F.regexp_replace(x["match"], "[^A-Za-z]", ""))
    of = lambda kind: x["kind"] == KINDS.index(kind)
    shape = F.when(of("secret"), x["match"].rlike("^[0-9a-f]+$|^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])")).when(of("email"), x["match"].rlike("[A-Za-z0-9]@.*\\.[A-Za-z]{2,}$"))
    shape = shape.when(of("ip"), ~x["match"].rlike("^0|\\.0[0-9]")).when(of("card"), x["match"].rlike("^[3-6]")).when(of("phone"), n.between(10, 13)).otherwise(True)
    words = F.lit("(?:^|[^a-z])(?:" + "|".join(GAZETTEER) + ")[^a-z]*$")
    for kind, names in NAMES.items():
        words = F.when(of(kind), "(?:^|[^a-z])(?:" + "|".join(names) + ")[^a-z]*$").otherwise(words)
    return {
        "shape": F.when(shape, 1).otherwise(-1),
        "gazetteer": F.when(F.regexp_like(before, words), 1).otherwise(0),
        "assigned": F.when(before.rlike("[:=]\\s?\"?$"), 1).otherwise(F.when(of("secret"), -1).otherwise(0)),
        "mixed": F.when((n > 2) & ((letters > 2) | ~of("secret")) | of("email"), 1).otherwise(-1),
        "plain": F.when(x["match"].rlike("^[A-Za-z]+$|^(.)\\1+$"), -1).otherwise(0),
    }


def _features(text: Column, x: Column) -> dict[str, Column]:
    """What the span itself and the character before it look like, in steps from 0 to 3."""
    size, last = F.length(x["match"]), F.substr(text, x["start"], F.lit(1))
    share = lambda n: F.least(F.lit(3), F.floor(4 * n / size)).cast("int")
    classes = sum((F.when(x["match"].rlike(c), 1).otherwise(0) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(-1))
    return {
        "long": F.least(F.lit(3), F.floor(size / 10)).cast("int"), "digits": share(F.length(F.regexp_replace(x["match"], "[^0-9]", ""))), "classes": classes,
        "distinct": share(F.size(F.array_distinct(F.split(x["match"], "")))), "before": F.when(x["start"] == 0, 0).when(last.rlike("\\s"), 1).when(last.rlike("[:=\"'(<]"), 2).otherwise(3),
    }


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], passes: int = PASSES, prior: float = 0.5) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over (votes, count): the rate of private spans, and for each labeler and vote its
    rate among private and other spans. Counts are smoothed towards labelers that are right more often than not."""
    n = len(patterns[0][0]) if patterns else 0
    start = {1: (0.6, 0.15), 0: (0.25, 0.25), -1: (0.15, 0.6)}
    rate, table = prior, [dict(start) for _ in range(n)]
    for _ in range(passes if patterns else 0):
        yes = [{v: 4 * start[v][0] for v in start} for _ in range(n)]
        no = [{v: 4 * start[v][1] for v in start} for _ in range(n)]
        up = down = 1.0
        for votes, count in patterns:
            p = posterior(votes, rate, table)
            up, down = up + count * p, down + count * (1 - p)
            for j, v in enumerate(votes):
                yes[j][v] += count * p
                no[j][v] += count * (1 - p)
        rate = up / (up + down)
        table = [{v: (yes[j][v] / sum(yes[j].values()), no[j][v] / sum(no[j].values())) for v in start} for j in range(n)]
    return rate, table


def posterior(votes: tuple[int, ...], rate: float, table: list[dict[int, tuple[float, float]]]) -> float:
    logit = math.log(rate / (1 - rate)) + sum(math.log(table[j][v][0] / table[j][v][1]) for j, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def fit_classifier(patterns: list[tuple[tuple[int, ...], int]], kinds: list[int] | None = None, more: list[tuple[float, ...]] | None = None, steps: int = 300) -> list[float]:
    """Logistic regression of the posteriors on the votes and more inputs of each pattern: a bias and a weight for each input.
    Each kind has reliabilities of its own. Accelerated descent with the step that the longest input allows."""
    kinds, more = kinds or [0] * len(patterns), more or [()] * len(patterns)
    fitted = {k: reliabilities([p for p, own in zip(patterns, kinds, strict=True) if own == k]) for k in set(kinds)}
    total = sum(c for _, c in patterns) or 1
    rows = [((1, *v, *x), c / total, posterior(v, *fitted[k])) for (v, c), k, x in zip(patterns, kinds, more, strict=True)]
    n = len(rows[0][0]) if rows else len(LABELERS) + 1
    step = 4 / max((sum(a * a for a in x) for x, _, _ in rows), default=1)
    w, ahead = [0.0] * n, [0.0] * n
    for t in range(steps if rows else 0):
        grad = [0.002 * a for a in ahead]
        for x, share, target in rows:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(a * b for a, b in zip(ahead, x, strict=True))))))
            for j, v in enumerate(x):
                grad[j] += share * (p - target) * v
        new = [a - step * g for a, g in zip(ahead, grad, strict=True)]
        ahead = [a + t / (t + 3) * (a - b) for a, b in zip(new, w, strict=True)]
        w = new
    return [round(x, 6) for x in w]


def detect(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, spans as an array of (start, end, kind, score) and base as the part of it that patterns and
    checksums alone give, for every row of docs.

    Candidates are the base spans and those of further kinds that overlap none of them. All get votes; EM estimates
    for each kind how far each labeler is right, and a logistic classifier of the votes, the kind and the span's own
    features, fitted to the posteriors, scores each. Base spans are kept whatever their score, others from threshold
    up. Only counts of patterns, whose number no input changes (votes, kinds and features have a few values each), reach
    the driver. Offsets are code points, ends exclusive. Null texts count as empty. Rows are independent, so
    repeated and null ids stay. carry adds the whole input row as a struct `row`.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))

    def with_candidates(df: DataFrame) -> DataFrame:
        spans = base_spans(text)
        df = df.withColumn("base", F.concat(*spans.values()))
        none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,match:string>>)")
        found = F.when(F.length(text) >= 11, F.concat(*[F.when(text.rlike(p), _matches(text, p, k)).otherwise(none) for k, p in ADDED.items()])).otherwise(none)
        free = F.filter(found, lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        df = df.withColumn("found", F.concat("base", free))
        seen = F.transform("found", lambda x: F.struct(x["start"], x["end"], x["kind"], *[v.alias(k) for k, v in (_votes(text, x) | _features(text, x)).items()]))
        return df.withColumn("found", F.array_sort(seen, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))).drop("base")

    rows = with_candidates(rows)
    rows = cut(rows.drop("text"))
    inputs = ["kind", *LABELERS, *FEATURES]
    counts = rows.select(F.explode("found").alias("x")).groupBy(*[F.col(f"x.{k}").alias(k) for k in inputs]).count().collect()
    counts = sorted(tuple(r) for r in counts)
    n = 1 + len(LABELERS)
    more = [(*(float(r[0] == k) for k in range(len(KINDS))), *(v / 3 for v in r[n:-1])) for r in counts]
    weights = fit_classifier([(r[1:n], r[-1]) for r in counts], [r[0] for r in counts], more)

    def score(x: Column) -> Column:
        if not counts:
            return F.lit(0.0)
        logit = F.lit(weights[0]) + F.element_at(F.array(*[F.lit(w) for w in weights[n : n + len(KINDS)]]), x["kind"] + 1)
        for k, w in zip(LABELERS, weights[1:n], strict=True):
            logit = logit + x[k] * F.lit(w)
        for k, w in zip(FEATURES, weights[n + len(KINDS) :], strict=True):
            logit = logit + x[k] / 3 * F.lit(w)
        return 1 / (1 + F.exp(-logit))

    scored = F.transform("found", lambda x: F.struct(x["start"], x["end"], x["kind"], F.round(score(x), 6).alias("score")))
    every = F.filter(scored, lambda x: (x["kind"] < len(BASE)) | (x["score"] >= threshold))
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    name = F.array(*[F.lit(k) for k in KINDS])

    def named(spans):
        return F.transform(spans, lambda x: F.struct(x["start"], x["end"], F.element_at(name, x["kind"] + 1).alias("kind"), *([x["score"]] if spans is every else [])))

    return rows.select("doc_id", *(["row"] if carry else []), named(every).alias("spans"), named(base).alias("base"))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; overlapping spans are merged under the first's kind."""
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, none, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))))
