"""Registered queries do their whole job, on small tables made here."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from orebody.operators import graph, itemsets, recommend
from orebody.plans import registry
from orebody.sources import views


def test_girvan_newman_takes_the_graph_of_shared(spark, tmp_path):
    """Two triangles and a bridge; each two neighbours share just SHARED parts."""
    bought = []
    for k, pair in enumerate([*combinations((1, 2, 3), 2), *combinations((4, 5, 6), 2), (3, 4)]):
        bought += [(user, 100 * k + part) for user in pair for part in range(registry.SHARED)]
    spark.createDataFrame([(i, u) for i, (u, _) in enumerate(bought)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, p) for i, (_, p) in enumerate(bought)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["girvan_newman"](spark, str(tmp_path))
    assert {(r["id"], r["component"]) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)}


@pytest.mark.parametrize("name", ["gbt_predict", "gbt_predict_wide", "hybrid_blend"])
def test_recommenders_predict_for_all_orders(spark, sf, monkeypatch, name):
    """Every order's pair has a prediction, those of unknown users and businesses where features may be missing."""
    monkeypatch.setattr(recommend, "predict_trees", lambda train, asked, *_, **__: asked.select("user_id", "business_id", F.lit(3.0).alias("prediction")))
    key, orders = F.col("o_orderkey"), views.table(spark, sf, "orders")
    user = F.when(key % 350 == 0, F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey"))
    business = F.when(key % 550 == 0, 1_000_000_000).otherwise(key % 97 + 1)
    asked = {tuple(r) for r in orders.select(user, business).distinct().collect()}
    if name != "gbt_predict_wide":
        known = views.reviews(spark, sf)
        users, items = ({r[0] for r in known.select(c).distinct().collect()} for c in ("user_id", "business_id"))
        asked = {(u, b) for u, b in asked if u in users and b in items}
    got = [(r["user_id"], r["business_id"]) for r in registry.QUERIES[name](spark, sf).collect()]
    assert sorted(got) == sorted(asked)


def test_recommenders_use_the_models_of_the_reference(spark, sf, monkeypatch):
    used = []

    def record(train, asked, features, **params):
        used.append(recommend.TREES | params)
        return asked.select("user_id", "business_id", F.lit(3.0).alias("prediction"))

    monkeypatch.setattr(recommend, "predict_trees", record)
    for name in ("gbt_predict", "gbt_predict_wide", "hybrid_blend"):
        registry.QUERIES[name](spark, sf)
    names = ("trees", "depth", "rate", "columns", "share", "least", "l1", "l2")
    assert [tuple(x[n] for n in names) for x in used] == [(300, 17, 0.02, 0.5, 0.8, 101, 0.2765, 9.927), (300, 17, 0.02, 0.6, 0.8, 101, 0.2765, 9.927), (200, 15, 0.05, 0.3, 1.0, 1, 10.0, 1.0)]


def test_son_mines_until_a_level_is_empty(spark):
    rows = spark.createDataFrame([(i, [1, 2, 3, 4, 5]) for i in range(4)] + [(4, [1, 6])], "key long, items array<long>")
    got = {(tuple(r["itemset"]), r["support"]) for r in itemsets.son(rows, 3, 5).collect()}
    assert got == {(s, 5 if s == (1,) else 4) for k in range(1, 6) for s in combinations(range(1, 6), k)}


def test_bfs_reaches_the_end_of_a_long_chain(spark):
    edges = spark.range(70).selectExpr("id AS src", "id + 1 AS dst")
    got = {(r["id"], r["depth"]) for r in graph.bfs_depths(edges, 0).collect()}
    assert got == {(i, i) for i in range(71)}


@pytest.mark.parametrize("params", [{"columns": 0.3}, {"columns": 0.7}, {"columns": 1.0}, {"columns": 0.7, "share": 0.8, "least": 20}])
def test_trees_are_fitted_on_all_rows(spark, params, monkeypatch):
    """120,000 rows, of which the old fit took 100,000: edges and models are those of all rows, in the ways of sums, cells and rows."""
    import numpy as np

    from orebody.operators import boosting

    rows = spark.range(120_000).selectExpr("cast(pmod(xxhash64(id), 3001) AS double) / 7 AS a", "pmod(xxhash64(id, 1), 9) AS b", "IF(id % 1000 = 0, NULL, pow(pmod(xxhash64(id, 2), 4001), 3)) AS c", "1 AS d", "id")
    rows = rows.selectExpr("*", "cast(floor(2 + sin(a / 40) + b / 4 + IF(c > 1e9, 1, 0)) AS double) AS y").repartition(7)
    data = np.array([[x or 0 for x in r] for r in rows.orderBy("id").select("a", "b", "c", "d", "y").collect()], float)
    x, y = data[:, :4], data[:, 4]
    if params["columns"] == 1.0:
        monkeypatch.setattr(boosting, "CELLS", 1000)
    params = {"trees": 12, "depth": 5, "rate": 0.2, "l1": 0.3} | params
    got, want = boosting.fit_rows(rows, ["a", "b", "c", "d"], "y", **params), boosting.fit(x, y, **params)
    assert [c.tolist() for c in got["cuts"]] == [c.tolist() for c in want["cuts"]]
    p = boosting.predict(got, x)
    away = np.abs(p - boosting.predict(want, x))
    assert away.mean() < 0.05 if "share" in params else away.max() < 1e-9  # with a share, trees see other rows than there
    assert boosting.predict(boosting.fit_rows(rows.where("id < 0"), ["a", "b"], "y", **params), x[:2, :2]).tolist() == [0.5, 0.5]
