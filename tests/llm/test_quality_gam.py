import numpy as np
from llm_cases import EDGES, table

from ticketlens.llm import quality_gam as Q

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = Q.train(docs, labels, learn_from=~Q.held_out("id"))
    rows = Q.score(docs.join(labels, "doc_id").filter(Q.held_out("doc_id")), model).select("quality", "score").toPandas()
    assert ((rows.score >= Q.THRESHOLD) == (rows.quality == 1)).mean() > 0.98
    # a null or empty text has a score as well; extra columns stay
    edges = table(spark, EDGES, clashing=True)
    scored = Q.score(edges, model).collect()
    assert len(scored) == len(EDGES) and all(0 <= r.score <= 1 for r in scored)
    assert Q.accepted(edges, model).columns == edges.columns
    assert Q.score(table(spark, []), model).count() == 0


def test_without_labels_or_with_one_class(spark):
    docs = table(spark, EDGES)
    for rows in ([], [(4, 1, 0), (6, 1, 0), (None, 0, 0), (7, None, 0)]):
        model = Q.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert not model.grids and all(0 < s < 1 for s in model.score(Q.measure_all(["", "a b"])))


def test_pairs_learn_an_interaction():
    maker = np.random.default_rng(0)
    values = maker.random((4000, 3))
    labels = (values[:, 0] > 0.5) ^ (values[:, 1] > 0.5)
    model = Q.fit_gam(values, labels, pairs=1)
    assert model.grids[0][:2] == (0, 1)
    assert ((model.score(values) > 0.5) == labels).mean() > 0.9


def test_score_is_the_sum_of_looked_up_bins():
    maker = np.random.default_rng(1)
    values = maker.random((500, 4))
    model = Q.fit_gam(values, values[:, 2] > 0.3, rounds=5, pair_rounds=3)
    for row in values[:50]:
        bins = [int(np.searchsorted(e, v, side="right")) for e, v in zip(model.edges, row)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
        total += sum(g[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for i, j, g in model.grids)
        assert np.isclose(model.score(row[None])[0], 1 / (1 + np.exp(-total)))


def test_one_id_on_many_rows_counts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fit_gam", lambda values, labels: seen.append(len(labels)))
    docs = table(spark, [(1, f"text {i}") for i in range(3000)] + [(2, None), (3, "three")])
    Q.train(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int"), max_rows=10)
    assert seen == [3]
