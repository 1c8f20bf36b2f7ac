"""What queries shuffle, against their input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.plans import documents, numbers, star


def moved(spark, make) -> tuple[list, float]:
    """Rows of a query, and MB that it and its eager steps write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size())) / 1e6
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    rows = make().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, total() - before


@pytest.fixture(scope="module")
def prose(spark, tmp_path_factory):
    """Documents of 2 MB, some of which hold benchmark items, repeat an id or are near copies; and their texts."""
    draw, top = random.Random(4), tmp_path_factory.mktemp("prose")
    vocabulary = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(5000)]
    text = lambda n: draw.choices(vocabulary, k=n)
    items = [text(draw.randint(8, 30)) for _ in range(20)]
    docs = []
    for i in range(1000):
        words = text(draw.choice([3, 40, 300, 900]))
        if i % 10 == 0:
            words = words[:5] + items[i // 10 % 20] + words[5:] + items[i // 10 % 20][:9]
        docs.append((i - i % 97 // 96, " ".join(words)))
    docs += [(2000 + i, " ".join(t.split()[:-7] + text(12))) for i, (_, t) in enumerate(docs[:100])]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), sum(len(t) for _, t in docs) / 1e6


def oracle(top: str, sql: str) -> list:
    """Rows of a query by DuckDB over a folder's tables."""
    import os

    import duckdb

    c = duckdb.connect()
    for name in os.listdir(top):
        at = f"{top}/{name}/*.parquet" if os.path.isdir(f"{top}/{name}") else f"{top}/{name}"
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{at}')")
    return sorted(c.execute(sql).fetchall(), key=repr)


def plain(rows: list) -> list:
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["doc_residual", "doc_novelty", "doc_cover"])
def test_shingles_that_no_item_has_are_not_shuffled(spark, prose, name):
    rows, mb = moved(spark, lambda: documents.Q[name](spark, prose[0]))
    assert plain(rows) == oracle(prose[0], documents.SQL[name])
    assert mb < 0.2 * prose[1]


def test_lineage_shuffles_all_shingles_once(spark, prose):
    rows, mb = moved(spark, lambda: documents.Q["doc_lineage"](spark, prose[0]))
    assert plain(rows) == oracle(prose[0], documents.SQL["doc_lineage"])
    assert mb < 13 * prose[1]  # as an id has several texts, they are shuffled as text as well


@pytest.mark.parametrize("name", ["doc_nearest_prior", "doc_rank_dot"])
def test_words_are_counted_where_the_text_is(spark, prose, name):
    rows, mb = moved(spark, lambda: documents.Q[name](spark, prose[0]))
    assert plain(rows) == oracle(prose[0], documents.SQL[name])
    assert mb < 1.2 * prose[1]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["order_align", "order_infer", "order_confirm", "order_transfer", "order_novelty"])
def test_facts_of_an_order_travel_as_one_row(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        rows, mb = moved(spark, lambda: star.Q[name](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plain(rows) == oracle(SMALL, star.SQL[name])
    assert mb < 150e-6 * spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["emb_tables_topk", "emb_tables_recall"])
def test_candidates_of_the_tables_are_not_listed(spark, tmp_path, monkeypatch, name):
    x = np.random.default_rng(6).standard_normal((3000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows, mb = moved(spark, lambda: numbers.Q[name](spark, str(tmp_path)))
    assert mb < 6 * x.nbytes / 1e6
    monkeypatch.setattr(numbers, "QUERY_BLOCK", 64, raising=False)
    monkeypatch.setattr(numbers, "VECTOR_BLOCK", 500, raising=False)
    assert plain(rows) == plain(numbers.Q[name](spark, str(tmp_path)).collect()) == oracle(str(tmp_path), numbers.SQL[name])


@pytest.mark.parametrize("name", ["star_reify", "star_rebuild", "order_roles"])
def test_graph_and_roles_of_the_star_schema(spark, name):
    assert plain(star.Q[name](spark, SMALL).collect()) == oracle(SMALL, star.SQL[name])


def test_rounds_of_a_graph_end_with_its_facts(spark, facts, monkeypatch):
    from pyspark.sql import DataFrame

    from factloom.operators import graph, graphquery

    nodes, edges = graph.reify(facts({"r": ['["CAUSE",["A","x",["B"]],["C","y"]]', '["A","x"]']}))
    rounds, kept = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a, **k: rounds.append(1) or kept(df, *a, **k))
    texts = {r["text"] for r in graphquery.expr_strings(nodes, edges).collect()}
    assert {"CAUSE(A(x, B()), C(y))", "A(x, B())", "B()", "C(y)", "A(x)", "x", "y"} <= texts and len(rounds) <= 3
