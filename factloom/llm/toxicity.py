"""Toxicity: a Levenshtein automaton over a learned lexicon trie, and scores from the hits' contexts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the lexicon and the classifier are fitted on, at most; those of smallest hash are taken.
FIT_ROWS = 16_000
#: A term's log odds must be so high, after so many standard errors have been taken off.
LIFT, ERRORS = 1.5, 2.5
#: The share of a term's uses that are taken to be misspelled, and the weight of a misspelled copy of a toxic row.
MISSPELLED, COPY = 0.1, 0.5
#: Lengths of word beginnings that may become stems.
STEMS = range(4, 9)
#: Words on each side of a hit that count as its context.
WINDOW = 8
#: Partial counts of terms that a task holds before it passes them on.
HELD_COUNTS, PIECE = 200_000, 20_000
#: Tokens whose match a task keeps.
KEPT_TOKENS = 200_000
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”„‘’*_~`…-–—|/\\#%&$@+="
QUOTES = "\"«»“”„"
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word term dit disait écrit sagte sagt schrieb dijo dice escribió".split())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def allowed_edits(term: str, stem: bool) -> int:
    least = 5 if stem else 4
    return 0 if len(term) < least else 1 if stem or len(term) < 10 else 2


class Automaton:
    """The Levenshtein automata of all terms, intersected with the trie of the terms and made deterministic state
    by state as tokens need it. A state is the set of (trie node, edits so far) that a token's beginning can be at.

    A whole word matches within allowed_edits of its length, one of four letters by letters replaced only. A stem
    matches within its edits before its last letter, which must be there, whatever follows it: the state then has
    ~node too.
    """

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, int]] = {}  # node of a whole word: term, edits allowed
        self.stems: dict[int, int] = {}
        self.limits: dict[int, int] = {}  # edits allowed in a stem
        self.budget = [0]
        self.rigid: set[int] = set()  # nodes of the four-letter words, in a trie of their own
        short = self._node(-1, "")
        self.rigid.add(short)
        for n, (term, stem) in enumerate(terms):
            limit, at = allowed_edits(term, stem), short if len(term) == 4 and not stem else 0
            self.budget[at] = max(self.budget[at], limit)
            for c in term:
                at = self.children[at].get(c) or self._node(at, c)
                self.budget[at] = max(self.budget[at], limit)
            if stem:
                self.stems[at], self.limits[at] = n, limit
            else:
                self.ends[at] = (n, limit)
        self.letters = {c for x in self.children for c in x}
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stem_at: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0, short: 0})

    def _node(self, parent: int, c: str) -> int:
        new = len(self.children)
        self.children.append({})
        self.budget.append(0)
        if parent >= 0:
            self.children[parent][c] = new
            if parent in self.rigid:
                self.rigid.add(new)
        return new

    def _state(self, nodes: dict[int, int]) -> int:
        todo = [(node, e) for node, e in nodes.items() if node >= 0 and node not in self.rigid]
        while todo:  # letters of the term that the token lacks
            node, e = todo.pop()
            if nodes[node] == e:
                for child in self.children[node].values():
                    if e + 1 <= self.budget[child] and e + 1 < nodes.get(child, 99):
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            ends = [(e, *self.ends[n]) for n, e in key if n in self.ends and e <= self.ends[n][1]]
            self.accepts.append(min(ends)[:2] if ends else None)
            self.stem_at.append(min(((e, self.stems[~n]) for n, e in key if n < 0), default=None))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.budget[node] and e < nodes.get(node, 99):
                nodes[node] = e

        for node, e in self.members[state]:
            if node < 0:
                continue
            if node not in self.rigid:
                reach(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
                if letter == c and child in self.stems and e <= self.limits[child]:
                    nodes[~child] = min(e, nodes.get(~child, 99))
        to = self._state(nodes) if nodes else -1
        self.moves[state][c] = to
        return to

    def match(self, token: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term, or None."""
        state, stem = self.start, None
        for c in token:
            if c not in self.letters:
                c = ""  # letters of no term move alike
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
            ends = self.stem_at[state]
            if ends is not None and (stem is None or ends[0] <= stem[0]):
                stem = ends
        found = self.accepts[state] if state >= 0 else None
        if found and (stem is None or found[0] <= stem[0]):
            return found[1], found[0]
        return (stem[1], stem[0]) if stem is not None else None


class Matcher(dict):
    """Token to its match, through the automaton for tokens that are new.

    terms are (term, stem, weight, weight when misspelled). A misspelling that is one of the usual words, or of
    a term that has no weight when misspelled, is no match."""

    def __init__(self, terms: list[tuple[str, bool, float, float]], usual: frozenset = frozenset()) -> None:
        super().__init__()
        self.automaton, self.weights = Automaton([(t, s) for t, s, _, _ in terms]), [(w, n) for _, _, w, n in terms]
        self.usual = usual

    def __missing__(self, token: str):
        word = token.strip(PUNCTUATION)
        found = self.automaton.match(word)
        if found and found[1] and (word in self.usual or self.weights[found[0]][1] <= 0):
            found = None
        if len(self) >= KEPT_TOKENS:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """Evidence of exact hits, of misspelled ones, of quoted ones, of hits with another near, and hit density. A
        quoted hit counts as nothing else."""
        words = (text or "").lower().split()
        found = list(map(self.__getitem__, words))
        hits = [i for i, f in enumerate(found) if f is not None]
        exact = near = quoted = crowd = 0.0
        meant = 0
        for n, i in enumerate(hits):
            term, edits = found[i]
            w = self.weights[term][edits > 0]
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            opened = any(x[0] in QUOTES for x in (*before, words[i])) and any(x[-1] in QUOTES for x in (words[i], *after))
            if opened or not REPORTING.isdisjoint(before[-3:]):
                quoted += w
                continue
            meant += 1
            if edits:
                near += w
            else:
                exact += w
            if (n and i - hits[n - 1] <= WINDOW) or (n + 1 < len(hits) and hits[n + 1] - i <= WINDOW):
                crowd += w
        return [math.log1p(exact), math.log1p(near), math.log1p(quoted), math.log1p(crowd), meant / (len(words) + 1)]

    def corrupted(self, text: str) -> str:
        """text with each term of three letters or more misspelled by one edit, which its checksum chooses."""
        out = []
        for token in text.split():
            found, word = self[token.lower()], token.strip(PUNCTUATION)
            if found is not None and not found[1] and len(word) > 2:
                draw = zlib.crc32(word.lower().encode())
                at, kind = 1 + draw // 4 % (len(word) - 2), draw % 4 if len(word) > 4 else 1
                new = (word[:at] + word[at + 1 :], word[:at] + "013xyz"[draw // 64 % 6] + word[at + 1 :], word[:at] + word[at + 1] + word[at] + word[at + 2 :], word[:at] + word[at] + word[at:])[kind]
                token = token.replace(word, new)
            out.append(token)
        return " ".join(out)


def _count_terms(batches):
    """(term, stem, toxic, clean): partial counts of documents that hold a word, or a word with that beginning."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out():  # in pieces, which keeps each record batch small
        terms = list(counts[0].keys() | counts[1].keys())
        frame = pd.DataFrame({"term": [t for t, _ in terms], "stem": [s for _, s in terms], "toxic": [counts[1][t] for t in terms], "clean": [counts[0][t] for t in terms]})
        counts[0].clear()
        counts[1].clear()
        for at in range(0, len(frame), PIECE):
            yield frame.iloc[at : at + PIECE]

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            words = {w.strip(PUNCTUATION) for w in (text or "").lower().split()}
            words = {w for w in words if 3 <= len(w) <= 40}
            counts[int(toxic)].update((w, False) for w in words)
            counts[int(toxic)].update({(w[:n], True) for w in words for n in STEMS if len(w) > n})
            if len(counts[0]) + len(counts[1]) > HELD_COUNTS:
                yield from out()
    yield from out()


def log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def choose_terms(rows: list[tuple[str, bool, int, int]], n_toxic: int, n_clean: int, lift: float = LIFT, errors: float = ERRORS) -> list[tuple[str, bool, float, int]]:
    """(term, stem, log odds, toxic documents) of whole words and stems whose log odds are sure to be above lift. A stem is
    taken only if it covers clearly more toxic documents than any single word that begins so, and the longest of
    equally good stems. Words stay beside their stem, which is short of their ends."""
    def sure(toxic: int, clean: int) -> bool:
        return log_odds(toxic, clean, n_toxic, n_clean) - errors * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)) >= lift

    good = {(t, s): (a, log_odds(a, c, n_toxic, n_clean)) for t, s, a, c in rows if sure(a, c)}
    best_word: dict[str, int] = {}
    for (t, s), (a, _) in good.items():
        if not s:
            for n in STEMS:
                best_word[t[:n]] = max(best_word.get(t[:n], 0), a)
    stems = {t: x for (t, s), x in good.items() if s and x[0] >= 1.3 * best_word.get(t, 1)}
    kept: dict[tuple[str, bool], float] = {}
    for t, (a, w) in stems.items():
        longer = [x for u, (x, _) in stems.items() if len(u) > len(t) and u.startswith(t)]
        shorter = [u for u in stems if len(u) < len(t) and t.startswith(u) and stems[u][0] > a / 0.97]
        if not any(x >= 0.97 * a for x in longer) and not shorter:
            kept[t, True] = w
    for (t, s), (_, w) in good.items():
        if not s:
            kept[t, False] = w
    return [(t, s, round(w, 6), good[t, s][0]) for (t, s), w in sorted(kept.items())]


def misspelled_weights(terms: list[tuple[str, bool, float, int]], seen: list[dict[str, int]], n_toxic: int, n_clean: int) -> list[tuple[str, bool, float, float]]:
    """terms with their weight when misspelled, from how often near words are in the clean rows of two folds (seen).
    A near word that the other fold has too is a usual word and doesn't count; the misspelled uses of a term in
    toxic documents are taken to be MISSPELLED of all. Terms whose near words are common get no weight."""
    automaton, others = Automaton([(t, s) for t, s, _, _ in terms]), [0] * len(terms)
    for one, other in (seen, seen[::-1]):
        for word, n in one.items():
            if word not in other:
                others[automaton.match(word)[0]] += n
    return [(t, s, w, round(max(0.0, log_odds(MISSPELLED * a, others[i], n_toxic, n_clean)), 6)) for i, (t, s, w, a) in enumerate(terms)]


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the first is the bias."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A bias and the weights of the features. Neither misspelled nor quoted hits speak against toxicity, nor more for it
    than exact ones: where the free fit says so, the columns are tied, or the one is left out, and it is fitted anew."""
    w = _newton(x, y, weight)
    if w[2] > w[1]:
        w = np.insert(_newton(np.column_stack([x[:, 0] + x[:, 1], x[:, 2:]]), y, weight), 2, 0.0)
        w[2] = w[1]
    elif w[2] < 0:
        w = np.insert(_newton(np.delete(x, 1, axis=1), y, weight), 2, 0.0)
    w[3] = min(max(w[3], 0.0), max(w[1], 0.0))
    return w


class Model:
    """Terms, usual words and weights; bounded by the rows fitted on, so that it goes to the tasks as it is."""

    def __init__(self, terms: list[tuple[str, bool, float, float]], weights: list[float], usual: frozenset = frozenset()) -> None:
        self.terms, self.weights, self.usual = terms, weights, usual

    def scorer(self):
        matcher, w = Matcher(self.terms, self.usual), self.weights

        def score(text: str | None) -> float:
            z = w[0] + sum(a * b for a, b in zip(w[1:], matcher.features(text), strict=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn the lexicon and the classifier from labels (doc_id, toxic) that are not held out.

    At most fit_rows labelled ids are used; they are broadcast, which that number bounds, and of rows that repeat an
    id the one of least text is learned from. Contradicting labels of an id count as toxic, null ones not at all.
    Words near a term that clean rows use are usual words, no misspellings; rows are in two folds, and a row's
    features take the usual words of the other fold, so that they are as with new rows. Toxic rows are learned from a
    second time with their terms misspelled. Without both classes every score is the same: the smoothed rate of
    toxic rows.
    """
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = sample.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("fold")).persist()
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        sample.unpersist()
        rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Model([], [math.log(rate / (1 - rate)), 0.0, 0.0, 0.0, 0.0, 0.0])
    counts = sample.mapInPandas(_count_terms, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least = max(3, round(0.002 * n_toxic))
    rate = F.expr(f"(toxic + 0.5) / {n_toxic + 1} / ((clean + 0.5) / {n_clean + 1})")
    strong = counts.filter((F.col("toxic") >= least) & (rate >= math.exp(LIFT))).collect()
    chosen_terms = choose_terms([(r["term"], r["stem"], r["toxic"], r["clean"]) for r in strong], n_toxic, n_clean)

    def near(batches):
        automaton, seen, kept = Automaton([(t, s) for t, s, _, _ in chosen_terms]), (Counter(), Counter()), {}
        for pdf in batches:
            for text, toxic, fold in zip(pdf["text"], pdf["toxic"], pdf["fold"], strict=True):
                if not toxic:
                    words = {w.strip(PUNCTUATION) for w in (text or "").lower().split()}
                    for w in words - kept.keys():
                        found = automaton.match(w)
                        kept[w] = found is not None and found[1] > 0
                    seen[fold].update(w for w in words if kept[w])
        yield pd.DataFrame([(f, w, k) for f in (0, 1) for w, k in seen[f].items()], columns=["fold", "word", "n"])

    seen: list[dict[str, int]] = [{}, {}]
    for r in sample.mapInPandas(near, "fold int, word string, n long").groupBy("fold", "word").agg(F.sum("n").alias("n")).collect():
        seen[r["fold"]][r["word"]] = r["n"]
    terms, usual = misspelled_weights(chosen_terms, seen, n_toxic, n_clean), [frozenset(x) for x in seen]

    def features(batches):
        matchers = [Matcher(terms, usual[1]), Matcher(terms, usual[0])]
        for pdf in batches:
            found = []
            for text, toxic, fold in zip(pdf["text"], pdf["toxic"], pdf["fold"], strict=True):
                found.append([*matchers[fold].features(text), float(toxic), 1.0])
                if toxic:
                    copy = matchers[fold].features(matchers[fold].corrupted(text or ""))
                    if copy[1] > 0:
                        found.append([*copy, 1.0, COPY])
            yield pd.DataFrame(found, columns=[f"x{i}" for i in range(5)] + ["y", "weight"])

    got = sample.mapInPandas(features, ", ".join(f"x{i} double" for i in range(5)) + ", y double, weight double").toPandas().to_numpy()
    sample.unpersist()
    got = got[np.lexsort(got.T)]  # the same order of sums in each run
    return Model(terms, [round(float(w), 6) for w in fit_logistic(got[:, :5], got[:, 5], got[:, 6])], usual[0] | usual[1])


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs. Null and empty texts have no hits and the score
    that goes with it; equal texts have equal scores. Null ids count as held out. Extra columns are ignored."""
    model = fit(docs, labels, fit_rows)

    def run(batches):
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns."""
    model, at = fit(docs, labels, fit_rows), docs.columns.index("text")

    def run(batches):
        score = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
