"""Near duplicates, vectors, top-k, mixing, sharding and the pipeline."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from factloom.llm import common, minhash, mixing, sharding, topk, vectors  # noqa: E402


def closure(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7)]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 200: 100, 150: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    draw = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  \t ", "One", "one", "two words", "TWO  words"]
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(20, 120))]
        for _ in range(draw.randint(1, 12)):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // (4 * k)))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(" ".join(copy))
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(draw.choice(vocabulary) for _ in range(draw.randint(5, 90))) for _ in range(25)]
    texts += ["long " * 3000 + passage, texts[10], texts[10]]
    rows = [(i * 3 + 1, t, -1) for i, t in enumerate(texts)]
    sets = {i: brute_shingles(t, k) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = closure(sets, links)
    docs = spark.createDataFrame([*rows, (None, texts[10], -1)], "doc_id long, text string, component_id int")
    got = minhash.near_duplicates(docs, size=k).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), low[r["doc_id"]], low[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_of_repeated_ids(spark):
    """An id's sets all stand for it, whichever of them a partition holds first."""
    draw = random.Random(3)
    a, b, c = (" ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.randint(1, 9) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (5, c), (6, c), (6, a + " z"), (7, None), (7, "alone")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=2).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 7)}


def test_near_duplicates_in_many_tiles(spark, monkeypatch):
    """Small tiles, a large component, unlinked members and a crowd below the threshold."""
    monkeypatch.setattr(minhash, "TILE", 4)
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [draw.choice(vocabulary) for _ in range(100)]
    texts = []
    for changed in [2] * 40 + [8] * 40:
        copy = list(base)
        for at in draw.sample(range(100), changed):
            copy[at] = draw.choice(vocabulary)
        texts.append(" ".join(copy))
    sets = {i: brute_shingles(t, 2) for i, t in enumerate(texts)}
    links = [(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    low = closure(sets, links)
    assert 1 < len(set(low.values()))
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == low


def test_words_across_pieces(monkeypatch):
    draw = random.Random(5)
    text = " ".join("".join(draw.choice("abXY") for _ in range(draw.choice([1, 3, 40]))) for _ in range(200)).encode()
    whole = minhash.word_hashes(b"\t" + text + b"\r\n")
    monkeypatch.setattr(minhash, "PIECE", 7)
    assert (minhash.word_hashes(text) == whole).all() and len(whole) == 200
    assert minhash.word_hashes(text.lower()).tolist() == whole.tolist()
    assert len(minhash.word_hashes(b"")) == len(minhash.word_hashes(b" \n\x0b")) == 0


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0


def test_sketches_merge_and_estimate():
    a, b = minhash._coefficients(minhash.REGISTERS)
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    y = np.unique(np.concatenate([x[:700], rng.integers(0, 2**63, 150, dtype=np.uint64)]))
    rx, ry, both = (minhash.registers_of(s, a, b) for s in (x, y, np.union1d(x, y)))
    assert (np.maximum(rx, ry) == both).all()
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    got = minhash.joint_estimate(rx[None], ry[None], np.array([float(len(x))]), np.array([float(len(y))]))[0]
    assert abs(got - true) < 0.1


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(25):
            c = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 7))):
                v = c + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.14, 0.2])
                rows.append((n, [float(x) for x in v], label))
                n += 1
    rows += [(n + i, v, 0) for i, v in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0]])]
    rows += [(n + 10, rows[0][1], None), (n + 11, rows[0][1], 0), (n + 12, [2 * x for x in rows[0][1]], 0), (n + 13, [1e200 * x for x in rows[0][1]], 0)]
    return rows, spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, n_links int").cache()


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def test_near_vectors_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (4, [0.01, 1.0], 0), (4, [0.01, 1.0], 0), (7, [-1.0, 0.0], 0), (7, None, 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (4, 2, 1), (4, 2, 1), (7, 0, 7), (7, 0, 7)]


def test_collisions_are_counted_in_windows():
    rng = np.random.default_rng(4)
    rows, cols = rng.standard_normal((60, vectors.PROJECTIONS)), rng.standard_normal((80, vectors.PROJECTIONS))
    for width, count in ((0.6, 4), (1.0, 12), (2.0, 21)):
        want = (np.abs(rows[:, None] - cols) <= width).sum(axis=2) >= count
        got = np.zeros_like(want)
        got[vectors._collisions(rows, cols, width, count, False)] = True
        assert (got == want).all()
        same = np.triu((np.abs(rows[:, None] - rows) <= width).sum(axis=2) >= count, 1)
        assert set(zip(*vectors._collisions(rows, rows, width, count, True))) == set(zip(*np.nonzero(same)))


def test_near_vectors_against_brute_force(spark, cloud):
    rows, df = cloud
    good = [(i, np.array(v) / np.abs(v).max(), lab) for i, v, lab in rows if lab is not None and usable(v)]
    links = [(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    low, n = closure([r[0] for r in rows], links), dict.fromkeys([r[0] for r in rows], 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert got == {i: (n[i], low[i], low[i] == i) for i in low}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_calibration():
    assert vectors.calibrated_count(24, 1.0, 1e-6) == 24 and 12 <= vectors.calibrated_count(24, 0.9973, 1e-6) <= 22


@pytest.mark.parametrize("k,every", [(5, 3), (500, 50)])
def test_top_k_against_brute_force(spark, cloud, k, every):
    rows, _ = cloud
    rows = [r for r in rows if r[1] is None or all(x is None or not np.isfinite(x) or abs(x) < 1e6 for x in r[1])] + [(None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, rank int")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, x in good:
        if q % every == 0:
            scored = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:k]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(df, k, every).collect()}
    assert got == want
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_dual_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (12, 8))
    data = np.vstack([c + rng.integers(-9, 9, (300, 8)) for c in centres]).astype(float)
    ids = rng.permutation(len(data)).astype(np.int64)
    group = topk.Group(ids[:100], data[:100], 5, np.full(100, -np.inf))
    met = []
    meet = group.meet
    group.meet = lambda rows, i, y: (met.append(len(rows) * len(i)), meet(rows, i, y))
    group.search(ids, topk.CoverTree(data, 64))
    scores = data[:100] @ data.T
    for n in range(100):
        order = sorted((-scores[n, j], ids[j]) for j in range(len(data)) if ids[j] != ids[n])[:5]
        assert [(-s, i) for s, i in order] == list(zip(group.scores[n], group.found[n], strict=True))
    assert sum(met) < 0.7 * 100 * len(data)


def test_large_components_are_exact(spark):
    big = float(2**40)
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 3.0]), (2, [-big, 0.0]), (3, [big, 2.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.exact_top_k(df, 2, 10).orderBy("rank").collect()]
    cap = 2**63 - 1
    exact = {i: 65536 * (2**80 + j) for i, j in ((1, 3), (3, 2))}
    assert got == [(1, min(cap, exact[1])), (3, min(cap, exact[3]))]


def test_differencing():
    draw = random.Random(4)
    sizes = [draw.randint(1, 10_000) for _ in range(400)]
    placed = sharding.differencing([[s] + [0] * 7 for s in sizes], 8)
    sums = [0] * 8
    for s, p in zip(sizes, placed, strict=True):
        assert sorted(p) == list(range(8))
        sums[p[0]] += s
    assert max(sums) - min(sums) < 50 and sharding.differencing([], 4) == []


def test_sharding(spark):
    draw = random.Random(6)
    rows = [(i, "x" * draw.randint(0, 400) + str(i % 700)) for i in range(1500)] + [(2000 + i, "copy of a hot text") for i in range(300)] + [(3000, None), (3001, ""), (None, "é"), (5, "again")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, shard string")
    got = sharding.shard_by_bytes(df, 16, cell=64).collect()  # several levels of cells
    assert len(got) == len(rows)
    import zlib

    crc, slots, sums, where = {}, {}, [0] * 16, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        sums[r["shard"]] += r["size"]
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    text = {i: t or "" for i, t in rows if i != 5}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]].encode()) + 1, zlib.crc32(text[r["doc_id"]].encode())) for r in got if r["doc_id"] != 5)
    assert max(sums) - min(sums) < 0.02 * sum(sums) / 16
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


def spread(df, shards, cell):
    sums, where = [0] * shards, {}
    for r in sharding.shard_by_bytes(df, shards, cell=cell).collect():
        sums[r["shard"]] += r["size"]
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    return max(sums) - min(sums), sum(sums) / shards


def test_sharding_with_large_groups(spark):
    # cells of equal texts leave the same shards over, which a single large group must not make to add up
    even = [(i, f"{i:0199d}") for i in range(1900)]
    off, mean = spread(spark.createDataFrame([*even, (5000, "x" * 20000)], "doc_id long, text string"), 16, 64)
    assert off <= 200 < 0.01 * mean
    # more large groups than a cell holds, above a cell's room only once the larger ones are out
    draw = random.Random(7)
    steps = [(10000 + i, "y" * n + str(i)) for i, n in enumerate(sorted((draw.randint(800, 6000) for _ in range(150)), reverse=True))]
    small = [(i, "z" * draw.randint(1, 60) + str(i)) for i in range(1500)]
    off, mean = spread(spark.createDataFrame([*small, *steps], "doc_id long, text string"), 16, 64)
    assert off < 0.002 * mean


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, (1, 5), 1, weights={"domain": {}, "lang": {}, "source": {}}).collect()}
    # 602 tokens: 301 for each domain; web's languages 151 and 150; a gives its 10, b takes over what a lacks
    assert sum(got.values()) == 602 and got["a"] == 10 and got["d"] == 301 and got["b"] + 10 in (150, 151) and got["c"] in (150, 151)
    short = spark.createDataFrame([("web", "en", "a", 10), ("web", "de", "c", 20), ("books", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(short, (1, 2), 2, weights={"domain": {}, "lang": {}, "source": {}}).collect()}
    assert got == {"a": 20, "c": 40, "d": 455}


def test_weight_zero_takes_nothing(spark):
    rows = [(i, "a b c d", lang, "src0") for i, lang in enumerate(["en", "de", "fr"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, share=(1, 2), max_epochs=4, weights={"domain": {}, "lang": {"de": 0}, "source": {}})
    by = {r["lang"]: r["n"] for r in got.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).collect()}
    assert by["de"] == 0 and by["en"] + by["fr"] == 120
    none = mixing.mix(df, weights={"domain": {"web": 0}, "lang": {}, "source": {}})
    assert none.count() == 60 and none.filter("repeats > 0").count() == 0


def test_plain_differencing_is_the_same(spark):
    """A small table goes through one cell: groups, sizes and spread are those of differencing done plainly."""
    draw = random.Random(12)
    texts = ["x" * draw.randint(1, 900) + str(i) for i in range(120)] + ["copy"] * 9
    got = sharding.shard_by_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 16).collect()
    sums = [0] * 16
    for r in got:
        sums[r["shard"]] += r["size"]
    sizes = {}
    for t in texts:
        sizes[t] = sizes.get(t, 0) + len(t) + 1
    parts = [([n] + [0] * 15) for n in sizes.values()]
    while len(parts) > 1:  # the two of largest spread, largest with smallest
        parts.sort(key=lambda p: max(p) - min(p))
        a, b = sorted(parts.pop()), sorted(parts.pop(), reverse=True)
        parts.append([x + y for x, y in zip(a, b, strict=True)])
    assert max(sums) - min(sums) <= max(parts[0]) - min(parts[0]) + 4 and sum(sums) == sum(parts[0])


def test_mixing(spark):
    draw = random.Random(8)
    rows = [(i, "word " * draw.randint(0, 60), draw.choice(["en", "de", None]), draw.choice(["src0", "src0", "src3", "src9", None])) for i in range(2000)] + [(None, "a b", "en", "src0"), (7, "twice", "en", "src0")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, repeats int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    total, taken, by = 0, 0, {}
    for r in got:
        total += r["n_tokens"]
        taken += r["n_tokens"] * r["repeats"]
        by.setdefault((r["domain"], r["lang"], r["source"]), set()).add(r["repeats"])
    assert 0.97 * total / 2 < taken <= total / 2 and all(max(v) - min(v) <= 1 and max(v) <= 4 for v in by.values())
    assert sorted((r["doc_id"] or -1, r["repeats"]) for r in got) == sorted((r["doc_id"] or -1, r["repeats"]) for r in mixing.mix(df.repartition(7)).collect())
    assert mixing.mix(df.limit(0)).count() == 0
    every = mixing.mix(df, share=(1, 1), max_epochs=1).filter("repeats = 0 and n_tokens > 0")
    assert every.count() == 0


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated and missing ids, and columns whose names clash with those that operators make."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 9)] + [(9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = "one text of several words that comes again and again in this small table"
    rows = [(1, text), (1, text), (1, text + " more"), (2, text), (None, text), (None, "only here without an id and with enough words"), (None, "only here without an id and with enough words"), (None, None), (4, ""), (4, ""), (5, "another text that nothing else in the table is like at all")]
    docs = spark.createDataFrame([(*r, "en", "src1", 7, True, ["x"], "z") for r in rows], "doc_id long, text string, lang string, source string, component_id int, kept boolean, spans array<string>, row string")
    for df in (docs, docs.limit(0)):
        at, ids = df, {}
        for name, stage in corpus_pipeline.STAGES:
            at = common.cut(stage(spark, at, str(tmp_path)))
            ids[name] = sorted((r["doc_id"] or -1) for r in at.collect())
            if name != "sentencepiece":
                assert at.columns == docs.columns
        if df is docs:
            assert ids["toxicity"] == sorted((r[0] or -1) for r in rows)
            assert ids["near_duplicates"] == [-1, -1, 1, 4, 5] == ids["personal_data"]
        else:
            assert not any(ids.values())


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    draw = random.Random(9)
    words = [f"wort{i}" for i in range(400)]
    clean = [" ".join(draw.choice(words) for _ in range(40)) for _ in range(300)]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(clean)]
    bad = [(1000 + i, "you are a " + " ".join(draw.choice(words) for _ in range(20)) + " worthless moron", "en", "src1", 9) for i in range(60)]
    near = [(2000 + i, t + " tail", "en", "src2", 9) for i, t in enumerate(clean[:30])]
    odd = [(3000, "mail me at a.b@example.org now please friend", "de", None, 9), (3001, None, None, None, None), (3002, "", "en", "src1", 0), (None, "nobody knows this text at all", "en", "src1", 3)]
    docs = spark.createDataFrame([*rows, *bad, *near, *odd], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 1, 1) for r in bad], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = common.cut(stage(spark, at, str(tmp_path)))
        seen[name] = at
        if name != "sentencepiece":
            assert at.columns == docs.columns
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert not ids["toxicity"] & {r[0] for r in bad} and ids["toxicity"] >= {r[0] for r in rows} | {3000, 3001, 3002, None}
    assert ids["toxicity"] - ids["near_duplicates"] == {r[0] for r in near}
    assert ids["personal_data"] == ids["near_duplicates"] and seen["personal_data"].filter("doc_id = 3000").first()["text"] == "mail me at [email] now please friend"
    assert 0 < len(ids["mixing"]) <= len(ids["personal_data"]) and ids["sentencepiece"] == ids["mixing"]
    assert seen["sentencepiece"].filter(~F.col("round_trip")).count() == 0
    if os.environ.get("FACTLOOM_SLOW"):
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["sentencepiece"].count()
