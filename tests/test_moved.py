"""What the joins move between tasks stays near what they read, and results are the same on every way a join may take."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from orebody.operators import recommend, similarity
from orebody.plans import registry
from orebody.sources import views


def moved(spark, run):
    """The rows that stages wrote to shuffles while run() ran."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def rows():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = rows()
    run()
    return rows() - before


def ratings(spark, users=150, items=60, each=40):
    rows = [(u, (u * 7 + k) % items, float((u * 5 + k * k * 3) % 5 + 1)) for u in range(users) for k in range(each)]
    train = spark.createDataFrame(rows, "user_id long, business_id long, stars double").repartition(3)
    return train, train.select("user_id").distinct().select("user_id", F.inline(F.expr("transform(array(1, 2, 1000), i -> named_struct('business_id', cast(i AS long)))")))


def test_item_based_moves_no_pairs_of_a_users_items(spark):
    """150 users of 40 items have 240,000 pairs of items; 6000 ratings and 450 asked pairs are given."""
    train, asked = ratings(spark)
    train.cache().count()
    assert moved(spark, lambda: recommend.predict_item_based(train, asked).collect()) < 30_000
    train.unpersist()


@pytest.mark.parametrize("sent", [0, 1, 30, 70])
def test_item_based_is_the_same_however_the_weights_go(spark, monkeypatch, sent):
    train, asked = ratings(spark, 30, 60, 12)
    more = spark.createDataFrame([(999, 1), (3, None), (None, 2)], "user_id long, business_id long")
    asked, key = asked.unionByName(more), lambda r: tuple((x is not None, x or 0) for x in r)
    want = sorted(map(tuple, recommend.predict_item_based(train, asked).collect()), key=key)
    assert len(want) == 93 and {p for u, _, p in want if u in (999, None)} == {3.5}
    monkeypatch.setattr(recommend, "SENT", sent or 1)
    if not sent:
        monkeypatch.setattr(recommend, "sent", lambda rows, tag: rows)
    assert sorted(map(tuple, recommend.predict_item_based(train, asked).collect()), key=key) == want


def test_item_based_with_weights_of_zero_only(spark):
    """The only neighbour has the weight 0: 0 / 0 within [1, 5] is 5 in the SQL."""
    rows = [(1, 10, 4.0), (1, 20, 5.0), (1, 30, 3.0), (1, 40, 0.0), (2, 10, 4.0), (2, 20, 1.0), (2, 30, 3.0), (2, 40, 4.0), (3, 20, 4.0), (3, 50, 2.0)]
    train = spark.createDataFrame(rows, "user_id long, business_id long, stars double")
    asked = spark.createDataFrame([(3, 10)], "user_id long, business_id long")
    assert [tuple(r) for r in recommend.predict_item_based(train, asked).collect()] == [(3, 10, 5.0)]


def test_hybrid_joins_lines_and_orders_once(spark, sf, monkeypatch):
    """sf0.001 has 6000 lines and 1500 orders; the ratings are moved by order once, and by user twice for the neighbours."""
    fitted = []

    def stand_in(train, asked, *_, **__):
        fitted.append(train.count())
        return asked.select("user_id", "business_id", F.lit(3.0).alias("prediction"))

    monkeypatch.setattr(recommend, "predict_trees", stand_in)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = moved(spark, lambda: registry.QUERIES["hybrid_blend"](spark, sf).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert fitted == [views.table(spark, sf, "lineitem").count()]
    assert rows < 40_000


def texts(spark, path, n=400):
    """Texts of 60 words out of 4000, each with one of 10 common lines of 30; every tenth is a near copy of the one before, ids 7 and 8 share a text."""
    rng, rows = random.Random(3), []
    for i in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(60)] + [f"c{i % 10}x{k}" for k in range(30)]
        words = rows[-1][1].split(" ")[:-2] + ["Changed"] if i % 10 == 9 else words
        rows.append((i, " ".join(words)))
    rows += [(n, None), (n + 1, " "), (7, "one more row of an id"), (n + 2, rows[8][1]), (None, rows[8][1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    sets = {}
    for i, text in rows:
        if i is not None and text is not None:
            sets.setdefault(i, set()).update(set(text.lower().split(" ")) - {""})
    return {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a, b in combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) > 0}, sum(map(len, sets.values()))


def test_jaccard_pairs_moves_about_the_beginnings_of_sets(spark, tmp_path, monkeypatch):
    """Half of the elements are joined on, none is dealt otherwise; the ways with and without marks give the same pairs."""
    monkeypatch.setattr(similarity, "BUCKETS", 64)
    want, elements = texts(spark, tmp_path)
    run = lambda: {tuple(r) for r in registry.QUERIES["jaccard_pairs"](spark, str(tmp_path)).collect()}
    got = []
    assert moved(spark, lambda: got.append(run())) < 1.3 * elements and got == [want] and len(want) > 30
    for limit, value in (("WORDS", 2), ("MARKED", 0), ("HELD", 0)):
        monkeypatch.setattr(similarity, limit, value)
        assert run() == want
