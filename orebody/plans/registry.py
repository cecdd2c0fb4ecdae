"""Registered queries of the mining operators: name -> (spark, sf_dir) -> DataFrame, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions.scalars import DRAW_PRIME, STREAM_PRIME
from orebody.operators import cluster, explore, graph, itemsets, recommend, similarity, sketches
from orebody.plans.durable import durable
from orebody.sources import files, views

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the registered queries.
YEAR, BATCH, SHARED, BASKET, DRAWS, FUNCTIONS, BAND_ROWS, JACCARD = 1998, 100, 7, 3, 11, 100, 5, 0.5
PAIR_SHARE, TRIPLE_SHARE, LABELS, NEAR, CLOSE = 0.002, 0.0003, 5, 16.0, 3.0
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_reviews = views.with_sql("reviews")


# Exploration


@query(f"{_reviews} SELECT user_id, business_id, stars FROM reviews")
def project_reviews(spark, d):
    return explore.project(views.reviews(spark, d))


@query(f"{_reviews} SELECT count(*) AS n_review FROM reviews")
def review_count(spark, d):
    return explore.row_count(views.reviews(spark, d), "n_review")


@query(f"{_reviews} SELECT count(*) FILTER (year(date) = {YEAR}) AS n_review_year FROM reviews")
def count_year(spark, d):
    return explore.count_year(views.reviews(spark, d), YEAR)


@query(f"{_reviews} SELECT count(*) AS n_user FROM (SELECT DISTINCT user_id FROM reviews)")
def distinct_users(spark, d):
    return explore.distinct_count(views.reviews(spark, d), "user_id", "n_user")


@query(f"{_reviews} SELECT count(*) AS n_business FROM (SELECT DISTINCT business_id FROM reviews)")
def distinct_businesses(spark, d):
    return explore.distinct_count(views.reviews(spark, d), "business_id", "n_business")


@query(f"{_reviews} SELECT user_id, count(*) AS n FROM reviews GROUP BY user_id")
def count_by_user(spark, d):
    return explore.count_by(views.reviews(spark, d), "user_id")


@query(f"{_reviews} SELECT user_id, count(*) AS n FROM reviews GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top10_users(spark, d):
    return explore.top(views.reviews(spark, d), "user_id")


@query(f"{_reviews} SELECT business_id, count(*) AS n FROM reviews GROUP BY business_id ORDER BY n DESC, business_id LIMIT 10")
def top10_businesses(spark, d):
    return explore.top(views.reviews(spark, d), "business_id")


_top = "(SELECT '[' || string_agg('[' || id || ',' || n || ']', ',' ORDER BY n DESC, id) || ']' FROM (SELECT {0} AS id, count(*) AS n FROM reviews GROUP BY {0} ORDER BY n DESC, {0} LIMIT 10))"


@query(
    f"""{_reviews} SELECT '{{"n_review":' || count(*) || ',"n_review_year":' || count(*) FILTER (year(date) = {YEAR}) || ',"n_user":' || count(DISTINCT user_id)
    || ',"top10_user":' || {_top.format("user_id")} || ',"n_business":' || count(DISTINCT business_id) || ',"top10_business":' || {_top.format("business_id")} || '}}' AS report FROM reviews"""
)
def review_report(spark, d):
    return explore.report(views.reviews(spark, d), YEAR)


@query(f"{_reviews} SELECT CAST(5 AS BIGINT) AS n_partition, count(*) AS n_items FROM reviews")
def partition_counts(spark, d):
    found = explore.partition_counts(views.reviews(spark, d), "business_id", 5)
    return found.agg(F.count("*").alias("n_partition"), F.sum("n_items").alias("n_items"))


@query(f"{_reviews} SELECT 'default' AS kind, count(*) AS n_items FROM reviews UNION ALL SELECT 'customized', count(*) FROM reviews")
def partition_report(spark, d):
    found = explore.partition_report(views.reviews(spark, d), "business_id", 5)
    return found.select("kind", F.aggregate("n_items", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_items"))


_city = views.with_sql("reviews", "business_city")


@query(f"{_city} SELECT city, stars FROM reviews JOIN business_city USING (business_id)")
def join_city_stars(spark, d):
    return explore.city_stars(views.reviews(spark, d), views.business_city(spark, d))


@query(f"{_city} SELECT city, round(avg(stars), 6) AS stars FROM reviews JOIN business_city USING (business_id) GROUP BY city ORDER BY stars DESC, city")
def avg_stars_by_city(spark, d):
    rows = explore.city_stars(views.reviews(spark, d), views.business_city(spark, d))
    return explore.average_by(rows, "city", "stars", "stars").orderBy(F.col("stars").desc(), "city")


@query(f"{_city} SELECT city, round(avg(stars), 6) AS stars FROM reviews JOIN business_city USING (business_id) GROUP BY city ORDER BY stars DESC, city LIMIT 10")
def top10_city(spark, d):
    return explore.top_average(explore.city_stars(views.reviews(spark, d), views.business_city(spark, d)), "city", "stars")


@query(f"{_reviews} SELECT user_id, round(avg(stars), 6) AS avg_stars FROM reviews GROUP BY user_id")
def user_avg_rating(spark, d):
    return explore.average_by(views.reviews(spark, d), "user_id", "stars", "avg_stars")


@query("""SELECT event_id, CASE WHEN isnan(v) THEN -1 ELSE round(v, 6) END AS stars FROM (SELECT event_id, TRY_CAST(raw AS DOUBLE) AS v FROM
    (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'abc' WHEN event_id % 11 = 0 THEN 'nan' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END AS raw FROM events)) WHERE v IS NOT NULL""")
def valid_ratings(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, "abc").when(F.col("event_id") % 11 == 0, "nan").otherwise(F.floor(F.col("value") * 100).cast("bigint").cast("string"))
    rows = files.valid_numbers(views.table(spark, d, "events").select("event_id", raw.alias("stars")), "stars")
    return rows.select("event_id", F.when(F.isnan("stars"), F.lit(-1.0)).otherwise(F.round("stars", 6)).alias("stars"))


# Baskets and itemsets


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-' || ltrim(CAST(o_custkey AS VARCHAR), '0') AS key FROM orders")
def basket_key(spark, d):
    orders = views.table(spark, d, "orders")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    raw = orders.select("o_orderkey", quoted(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), quoted(F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("customer"))
    return raw.select("o_orderkey", files.basket_key(F.col("date"), F.col("customer")).alias("key"))


_pairs = views.with_sql("pairs")


@query(f"{_pairs} SELECT key, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items FROM pairs GROUP BY key")
def baskets(spark, d):
    return itemsets.baskets(views.basket_pairs(spark, d), "key", "item").select("key", itemsets.listed().alias("items"))


@query(f"{_pairs} SELECT item AS key, string_agg(CAST(key AS VARCHAR), ',' ORDER BY key) AS items FROM pairs GROUP BY item")
def baskets_case2(spark, d):
    return itemsets.baskets(views.basket_pairs(spark, d), "item", "key").select("key", itemsets.listed().alias("items"))


@query(f"{_pairs} SELECT key, count(*) AS size FROM pairs GROUP BY key HAVING count(*) > {BASKET}")
def filtered_baskets(spark, d):
    rows = itemsets.larger_than(itemsets.baskets(views.basket_pairs(spark, d), "key", "item"), BASKET)
    return rows.select("key", F.size("items").cast("bigint").alias("size"))


@query(f"{_pairs} SELECT c.item || ',' || (c.item + 1) AS itemset, count(b.key) AS support FROM (SELECT DISTINCT item FROM pairs) c LEFT JOIN pairs a ON a.item = c.item LEFT JOIN pairs b ON b.key = a.key AND b.item = c.item + 1 GROUP BY c.item")
def itemset_support(spark, d):
    pairs = views.basket_pairs(spark, d)
    asked = pairs.select("item").distinct().select(F.array(F.col("item"), F.col("item") + 1).alias("itemset"))
    return itemsets.support_of(asked, pairs, "key", "item").select(itemsets.listed("itemset").alias("itemset"), "support")


def _support(pairs: DataFrame, share: float) -> int:
    return max(2, int(pairs.select("key").distinct().count() * share))


def _sql_support(share: float) -> str:
    return f"(SELECT greatest(2, CAST(floor(count(DISTINCT key) * {share}) AS BIGINT)) FROM pairs)"


_one = f"SELECT CAST(item AS VARCHAR) AS itemset, count(*) AS support FROM pairs GROUP BY item HAVING count(*) >= {_sql_support(PAIR_SHARE)}"
_two = f"SELECT a.item || ',' || b.item AS itemset, count(*) AS support FROM pairs a JOIN pairs b ON a.key = b.key AND a.item < b.item GROUP BY a.item, b.item HAVING count(*) >= {_sql_support(PAIR_SHARE)}"
_three = "SELECT a.item || ',' || b.item || ',' || c.item AS itemset, count(*) AS support FROM pairs a JOIN pairs b ON a.key = b.key AND a.item < b.item JOIN pairs c ON b.key = c.key AND b.item < c.item GROUP BY a.item, b.item, c.item HAVING count(*) >= {}"


def _frequent(spark: SparkSession, d: str, share: float, level: int) -> DataFrame:
    pairs = views.basket_pairs(spark, d)
    return itemsets.frequent(pairs, "key", "item", _support(pairs, share), level)


def _named(sets: DataFrame) -> DataFrame:
    return sets.select(itemsets.listed("itemset").alias("itemset"), F.col("support").cast("bigint").alias("support"))


@query(f"{_pairs} {_one}")
def freq_items(spark, d):
    return _named(_frequent(spark, d, PAIR_SHARE, 1))


@query(f"{_pairs} {_two}")
def freq_pairs(spark, d):
    return _named(_frequent(spark, d, PAIR_SHARE, 2))


@query(f"{_pairs} {_three.format(_sql_support(TRIPLE_SHARE))}")
def freq_triples(spark, d):
    return _named(_frequent(spark, d, TRIPLE_SHARE, 3))


#: All sets of items that lie within a basket, counted: every level at once.
_subsets = f"WITH RECURSIVE {views.SQL['pairs']}, within AS (SELECT key, [item] AS s FROM pairs UNION ALL SELECT w.key, list_append(w.s, p.item) FROM within w JOIN pairs p ON p.key = w.key AND p.item > w.s[-1]), found AS (SELECT s, count(*) AS support FROM within GROUP BY s HAVING count(*) >= {_sql_support(PAIR_SHARE)})"
_all_levels = f"{_subsets} SELECT array_to_string(s, ',') AS itemset, support FROM found"


@query(_all_levels)
def freq_itemsets_fpgrowth(spark, d):
    pairs = views.basket_pairs(spark, d)
    rows = durable(itemsets.baskets(pairs, "key", "item"), "baskets")
    total = rows.count()
    return _named(itemsets.fp_growth(rows, max(2, int(total * PAIR_SHARE)), total))


@query(_all_levels)
def son_itemsets(spark, d):
    rows = durable(itemsets.baskets(views.basket_pairs(spark, d), "key", "item"), "baskets")
    total = rows.count()
    return _named(itemsets.son(rows, max(2, int(total * PAIR_SHARE)), total))


@query(f"""{_pairs}, two AS (SELECT a.item AS x, b.item AS y FROM pairs a JOIN pairs b ON a.key = b.key AND a.item < b.item GROUP BY a.item, b.item HAVING count(*) >= {_sql_support(PAIR_SHARE)})
    SELECT p.x || ',' || p.y || ',' || q.y AS itemset FROM two p JOIN two q ON p.x = q.x AND p.y < q.y JOIN two r ON r.x = p.y AND r.y = q.y""")
def itemset_candidates(spark, d):
    return itemsets.candidates(durable(_frequent(spark, d, PAIR_SHARE, 2), "pairs")).select(itemsets.listed("itemset").alias("itemset"))


def _candidate_query(mode: str):
    def run(spark, d):
        found = durable(_frequent(spark, d, PAIR_SHARE, 1), "items")
        return itemsets.candidates(found, mode).select(itemsets.listed("itemset").alias("itemset"))

    return run


for _mode in ("extend", "combos"):
    QUERIES[f"itemset_candidates_{_mode}"] = _candidate_query(_mode)
    SQL[f"itemset_candidates_{_mode}"] = f"{_pairs}, one AS (SELECT item FROM pairs GROUP BY item HAVING count(*) >= {_sql_support(PAIR_SHARE)}) SELECT p.item || ',' || q.item AS itemset FROM one p JOIN one q ON p.item < q.item"


@query(f"""{_subsets}, asked AS (SELECT DISTINCT [item] AS s FROM pairs UNION ALL
    SELECT s FROM (SELECT list_append(a.s, b.s[-1]) AS s FROM found a JOIN found b ON len(a.s) = len(b.s) AND a.s[:-2] = b.s[:-2] AND a.s[-1] < b.s[-1]) c
    WHERE (SELECT count(*) FROM (SELECT unnest(range(1, len(c.s) + 1)) AS i) JOIN found f ON f.s = list_concat(c.s[: i - 1], c.s[i + 1 :])) = len(c.s)),
    rows AS (SELECT 'Candidates' AS section, s FROM asked UNION ALL SELECT 'Frequent Itemsets', s FROM found)
    SELECT section, CAST(len(s) AS INTEGER) AS k, string_agg(name, ',' ORDER BY name) AS line FROM (SELECT section, s, '(' || chr(39) || array_to_string(s, chr(39) || ', ' || chr(39)) || chr(39) || ')' AS name FROM rows) GROUP BY section, len(s)""")
def itemset_report(spark, d):
    pairs = views.basket_pairs(spark, d)
    return itemsets.report(pairs, "key", "item", _support(pairs, PAIR_SHARE))


@query(f"{views.with_sql('sets')} SELECT elem, dense_rank() OVER (ORDER BY elem) - 1 AS number FROM (SELECT DISTINCT elem FROM sets)")
def dict_encode(spark, d):
    return explore.dict_encode(views.token_sets(spark, d), "elem")


# Similarity


@query(f"{_reviews} SELECT business_id, count(*) AS n_users, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS users FROM (SELECT DISTINCT business_id, user_id FROM reviews) GROUP BY business_id")
def item_user_sets(spark, d):
    rows = itemsets.baskets(views.reviews(spark, d), "business_id", "user_id")
    return rows.select(F.col("key").alias("business_id"), F.size("items").cast("bigint").alias("n_users"), itemsets.listed().alias("users"))


@query(f"{_reviews} SELECT business_id, count(*) AS n_users, sum(stars) AS total FROM (SELECT business_id, user_id, stars, row_number() OVER (PARTITION BY business_id, user_id ORDER BY date DESC, seq DESC, stars DESC) AS r FROM reviews) WHERE r = 1 GROUP BY business_id")
def item_rating_map(spark, d):
    rows = recommend.rating_map(views.reviews(spark, d))
    return rows.select("business_id", F.size("ratings").cast("bigint").alias("n_users"), F.aggregate(F.map_values("ratings"), F.lit(0.0), lambda a, x: a + x).alias("total"))


_numbers = f"{views.with_sql('sets')}, coded AS (SELECT id, dense_rank() OVER (ORDER BY elem) - 1 AS x FROM sets)"
_coefficients = ", ".join(f"({i}, CAST({a} AS BIGINT), CAST({b} AS BIGINT))" for i, (a, b) in enumerate(similarity.coefficients(FUNCTIONS, 13)))
_sigs = f"{_numbers}, f(i, a, b) AS (VALUES {_coefficients}), sig AS (SELECT id, i, min((x % {similarity.PRIME} * a + b) % {similarity.PRIME}) AS v FROM coded, f GROUP BY id, i)"
_banded = f"{_sigs}, band AS (SELECT id, i // {BAND_ROWS} AS band, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS key FROM sig GROUP BY id, i // {BAND_ROWS}), cand AS (SELECT DISTINCT p.id AS a, q.id AS b FROM band p JOIN band q ON p.band = q.band AND p.key = q.key AND p.id < q.id)"
_sizes = "n AS (SELECT id, count(*) AS n FROM sets GROUP BY id)"


def _coded(spark: SparkSession, d: str) -> DataFrame:
    sets = views.token_sets(spark, d)
    return sets.join(explore.dict_encode(sets, "elem"), "elem").select("id", F.col("number").alias("elem"))


@query(f"{_sigs} SELECT id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS sig FROM sig GROUP BY id")
def minhash_signatures(spark, d):
    return similarity.signatures(_coded(spark, d), FUNCTIONS).select("id", itemsets.listed("sig").alias("sig"))


@query(f"{_banded} SELECT a, b FROM cand")
def lsh_candidates(spark, d):
    return similarity.candidate_pairs(similarity.signatures(_coded(spark, d), FUNCTIONS), BAND_ROWS)


@query(f"""{_banded}, {_sizes}, i AS (SELECT c.a, c.b, count(*) AS i FROM cand c JOIN sets x ON x.id = c.a JOIN sets y ON y.id = c.b AND y.elem = x.elem GROUP BY c.a, c.b)
    SELECT a, b, round(i / (p.n + q.n - i), 6) AS similarity FROM i JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE i / (p.n + q.n - i) >= {JACCARD}""")
def lsh_pairs(spark, d):
    sets = durable(_coded(spark, d), "sets")
    return similarity.verified(similarity.candidate_pairs(similarity.signatures(sets, FUNCTIONS), BAND_ROWS), sets, JACCARD)


@query(f"""{views.with_sql("sets")}, {_sizes}, i AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM sets x JOIN sets y ON x.elem = y.elem AND x.id < y.id GROUP BY x.id, y.id)
    SELECT a, b, round(i / (p.n + q.n - i), 6) AS similarity FROM i JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE i / (p.n + q.n - i) >= {JACCARD}""")
def jaccard_pairs(spark, d):
    return similarity.jaccard_hashed(views.token_hashes(spark, d), JACCARD)


@query(f"{_reviews}, r AS (SELECT DISTINCT business_id, user_id FROM reviews) SELECT p.business_id AS a, q.business_id AS b, count(*) AS n FROM r p JOIN r q ON p.user_id = q.user_id AND p.business_id < q.business_id GROUP BY p.business_id, q.business_id")
def item_corater_counts(spark, d):
    return similarity.co_occurrence(views.reviews(spark, d), "business_id", "user_id")


# Recommendation

_given = " + ".join(f"pow(CAST((c_custkey + {i}) % {i + 3} AS DOUBLE), {recommend.POWER})" for i in range(len(files.COMPLIMENTS)))
_user = f"""users AS (SELECT c_custkey AS user_id, CAST(c_custkey % 5 + 1 AS DOUBLE) AS average_stars, CAST(coalesce(n, 0) AS DOUBLE) AS review_count, CAST(c_custkey % 17 AS DOUBLE) AS useful, CAST(c_custkey % 13 AS DOUBLE) AS funny,
    CAST(c_custkey % 11 AS DOUBLE) AS cool, CAST(c_custkey % 7 AS DOUBLE) AS fans, round({_given}, 6) AS compliments, CASE WHEN c_mktsegment IS NOT NULL AND c_mktsegment <> 'BUILDING' AND c_mktsegment <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS elite_flag
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""
_business = """business AS (SELECT s_suppkey AS business_id, CAST((s_suppkey % 9) / 2 + 0.5 AS DOUBLE) AS business_stars, CAST(s_suppkey % 100 AS DOUBLE) AS business_reviews,
    CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS kids, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 4 + 1 AS DOUBLE) ELSE 0.0::DOUBLE END AS price FROM supplier)"""


@query(f"WITH {_user} SELECT * FROM users")
def user_features(spark, d):
    return recommend.user_features(views.users(spark, d))


@query(f"WITH {_business} SELECT * FROM business")
def business_features(spark, d):
    return recommend.business_features(views.business(spark, d))


_asked = f"WITH {views.SQL['asked']}, {_user}, {_business}"


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return recommend.user_features(views.users(spark, d)), recommend.business_features(views.business(spark, d))


@query(f"{_asked} SELECT * FROM asked JOIN users USING (user_id) JOIN business USING (business_id)")
def features_inner(spark, d):
    return recommend.features_inner(views.asked_pairs(spark, d), *_features(spark, d))


_zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in recommend.WIDE_USER + recommend.WIDE_BUSINESS)


@query(f"{_asked} SELECT user_id, business_id, {_zero} FROM asked LEFT JOIN users USING (user_id) LEFT JOIN business USING (business_id)")
def features_left(spark, d):
    return recommend.features_left(views.asked_pairs(spark, d), *_features(spark, d))


_train = views.with_sql("reviews", "asked")


@query(f"{_train}, m AS (SELECT user_id, avg(stars) AS mean FROM reviews GROUP BY user_id) SELECT user_id, business_id, round(CASE WHEN mean IS NULL THEN {recommend.UNKNOWN} ELSE least(greatest(mean, 1), 5) END, 6) AS prediction FROM asked LEFT JOIN m USING (user_id)")
def cf_user_mean(spark, d):
    return recommend.predict_user_mean(views.reviews(spark, d), views.asked_pairs(spark, d))


@query(f"""{_train}, rated AS (SELECT user_id, business_id, avg(stars) AS stars FROM reviews GROUP BY ALL), m AS (SELECT user_id, avg(stars) AS mean FROM reviews GROUP BY user_id),
    dev AS (SELECT user_id, business_id, stars - mean AS dev FROM rated JOIN m USING (user_id)),
    wanted AS (SELECT a.user_id, a.business_id, v.business_id AS other, v.dev FROM asked a JOIN dev v ON v.user_id = a.user_id AND v.business_id <> a.business_id),
    s AS (SELECT w.business_id, w.other, round(sum(x.dev * y.dev), 9) AS xy, round(sum(x.dev * x.dev), 9) AS xx, round(sum(y.dev * y.dev), 9) AS yy FROM (SELECT DISTINCT business_id, other FROM wanted) w
        JOIN dev x ON x.business_id = w.business_id JOIN dev y ON y.business_id = w.other AND y.user_id = x.user_id GROUP BY ALL),
    w AS (SELECT business_id, other, round(xy / sqrt(xx * yy), 6) AS w FROM s WHERE xx > 0 AND yy > 0),
    near AS (SELECT user_id, business_id, dev, w, row_number() OVER (PARTITION BY user_id, business_id ORDER BY w DESC, other) AS r FROM wanted JOIN w USING (business_id, other)),
    shift AS (SELECT user_id, business_id, sum(w * dev) / sum(abs(w)) AS shift FROM near WHERE r <= 15 GROUP BY ALL)
    SELECT user_id, business_id, round(CASE WHEN mean IS NULL THEN {recommend.UNKNOWN} ELSE least(greatest(mean + coalesce(shift, 0), 1), 5) END, 4) AS prediction FROM asked LEFT JOIN m USING (user_id) LEFT JOIN shift USING (user_id, business_id)""")
def cf_item_based(spark, d):
    return recommend.predict_item_based(views.reviews(spark, d), views.asked_pairs(spark, d))


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    """The ratings of all reviews; lines and orders are joined once."""
    return durable(views.reviews(spark, d).select("user_id", "business_id", "stars"), "ratings")


def _narrow(spark: SparkSession, d: str, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    user = recommend.sent(train.groupBy("user_id").agg(F.avg("stars").alias("user_avg"), F.count("*").cast("double").alias("user_count")), "users")
    business = recommend.sent(train.groupBy("business_id").agg(F.avg("stars").alias("business_avg"), F.count("*").cast("double").alias("business_count")), "businesses")
    return recommend.features_inner(train, user, business), recommend.features_inner(views.asked_pairs(spark, d), user, business)


@query()
def gbt_predict(spark, d):
    return recommend.predict_trees(*_narrow(spark, d, _ratings(spark, d)), recommend.NARROW)


@query()
def gbt_predict_wide(spark, d):
    rows = views.reviews(spark, d).select("user_id", "business_id", "stars")
    both = [recommend.features_left(x, *_features(spark, d)) for x in (rows, views.asked_pairs(spark, d))]
    return recommend.predict_trees(*both, recommend.WIDE_USER + recommend.WIDE_BUSINESS, **recommend.WIDE_TREES)


@query()
def hybrid_blend(spark, d):
    train = _ratings(spark, d)
    neighbours = recommend.predict_item_based(train, views.asked_pairs(spark, d))
    return recommend.blend(recommend.predict_trees(*_narrow(spark, d, train), recommend.NARROW, **recommend.BLEND_TREES), neighbours)


# Graphs

_graph = f"""WITH RECURSIVE {views.SQL["bought"]}, edges AS (SELECT p."user" AS src, q."user" AS dst, count(*) AS n FROM bought p JOIN bought q ON p.item = q.item AND p."user" < q."user" GROUP BY ALL HAVING count(*) >= {SHARED}),
    both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), ids AS (SELECT DISTINCT src AS id FROM both_ways)"""
_reach = f"{_graph}, reach AS (SELECT id, id AS r FROM ids UNION SELECT b.dst, x.r FROM reach x JOIN both_ways b ON b.src = x.id), parts AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return durable(graph.edges_of(views.bought(spark, d), "user", "item", SHARED), "edges")


@query(f"{_graph} SELECT src, dst, n FROM edges")
def cooccurrence_edges(spark, d):
    return graph.edges_of(views.bought(spark, d), "user", "item", SHARED)


@query(f"{_graph} SELECT id FROM ids")
def graph_vertices(spark, d):
    return graph.vertices(_edges(spark, d))


@query(f"{_graph} SELECT src, dst FROM both_ways")
def symmetric_edges(spark, d):
    return graph.symmetric(_edges(spark, d))


@query(f"{_graph} SELECT src AS id, count(*) AS degree FROM both_ways GROUP BY src")
def degree(spark, d):
    return graph.degree(_edges(spark, d))


@query(f"{_reach} SELECT id, component FROM parts")
def connected_components(spark, d):
    return graph.connected_components(_edges(spark, d))


_labels = f"{_graph}, l0 AS (SELECT id, id AS label FROM ids)" + "".join(
    f", l{i + 1} AS (SELECT id, label FROM (SELECT b.src AS id, l.label, row_number() OVER (PARTITION BY b.src ORDER BY count(*) DESC, l.label) AS r FROM both_ways b JOIN l{i} l ON l.id = b.dst GROUP BY b.src, l.label) WHERE r = 1)"
    for i in range(LABELS)
)


@query(f"{_labels} SELECT id, label FROM l{LABELS}")
def label_propagation(spark, d):
    return graph.label_propagation(_edges(spark, d), LABELS)


@query(f"{_labels} SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members, CAST(count(*) AS INTEGER) AS size FROM l{LABELS} GROUP BY label")
def label_groups(spark, d):
    return graph.groups(graph.label_propagation(_edges(spark, d), LABELS)).select(itemsets.listed("members").alias("members"), "size")


@query(f"{_labels} SELECT CAST(count(*) AS INTEGER) AS size, string_agg('''' || id || '''', ', ' ORDER BY id) AS line FROM l{LABELS} GROUP BY label")
def community_report(spark, d):
    from orebody.sources.sinks import community_lines

    return community_lines(graph.groups(graph.label_propagation(_edges(spark, d), LABELS)))


@query(f"""{_graph}, walk AS (SELECT min(id) AS id, 0 AS depth FROM ids UNION SELECT b.dst, w.depth + 1 FROM walk w JOIN both_ways b ON b.src = w.id WHERE w.depth < (SELECT count(*) FROM ids))
    SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE id IS NOT NULL GROUP BY id""")
def bfs_depths(spark, d):
    edges = _edges(spark, d)
    return graph.bfs_depths(edges, graph.vertices(edges).agg(F.min("id")).first()[0])


#: Walks of each length between each two vertices; the shortest ones are paths, and an edge (u, v) lies on as many from
#: s to t as there are from s to u and from v to t, if their lengths add up.
_between = f"""{_graph}, walks AS (SELECT id AS s, id AS t, 0 AS n, 1.0::DOUBLE AS c FROM ids UNION ALL SELECT w.s, b.dst, w.n + 1, sum(w.c) FROM walks w JOIN both_ways b ON b.src = w.t WHERE w.n < (SELECT count(*) FROM ids) GROUP BY w.s, b.dst, w.n),
    short AS (SELECT s, t, min(n) AS n, arg_min(c, n) AS c FROM walks GROUP BY s, t),
    between AS (SELECT e.src AS a, e.dst AS b, round(sum(x.c * y.c / z.c), 9) AS betweenness FROM edges e JOIN short x ON x.t = e.src JOIN short y ON y.s = e.dst JOIN short z ON z.s = x.s AND z.t = y.t AND z.n = x.n + 1 + y.n GROUP BY e.src, e.dst)"""


@query(f"{_between} SELECT a, b, betweenness FROM between")
def edge_betweenness(spark, d):
    return graph.edge_betweenness(_edges(spark, d))


@query(f"{_between} SELECT a, b, betweenness FROM between WHERE betweenness = (SELECT max(betweenness) FROM between)")
def gn_top_edges(spark, d):
    return graph.top_edges(durable(graph.edge_betweenness(_edges(spark, d)), "betweenness"))


@query(f"""{_reach}, deg AS (SELECT src AS id, count(*) AS k FROM both_ways GROUP BY src), m AS (SELECT count(*) AS m FROM edges)
    SELECT round(m.m / m.m - (SELECT sum(t * t) FROM (SELECT sum(k) AS t FROM parts JOIN deg USING (id) GROUP BY component)) / (4 * m.m * m.m), 9) AS modularity FROM m""")
def modularity(spark, d):
    edges = _edges(spark, d)
    return graph.modularity(graph.connected_components(edges), edges)


@query()
def girvan_newman(spark, d):
    return graph.girvan_newman(_edges(spark, d))


# Streams

_batches = f"{views.with_sql('stream')}, b AS (SELECT seq, user_id, (seq - 1) // {BATCH} AS batch_id FROM stream)"
_number = f"CAST(list_reduce(list_transform(string_split(user_id, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda acc, x: (acc * 256 + x) % {STREAM_PRIME}, CAST(0 AS BIGINT)) AS BIGINT)"
_ab = ", ".join(f"({i}, CAST({a} AS BIGINT), CAST({b} AS BIGINT))" for i, (a, b) in enumerate(sketches.coefficients()))


@query(f"{_batches} SELECT batch_id, count(*) AS n, count(DISTINCT user_id) AS n_distinct FROM b GROUP BY batch_id")
def stream_batches(spark, d):
    return sketches.batch_sizes(views.stream(spark, d), BATCH)


@query(f"{_batches}, f AS (SELECT user_id, min(batch_id) AS f FROM b GROUP BY user_id) SELECT batch_id, round(count(DISTINCT user_id) FILTER (f < batch_id) / {BATCH}, 6) AS rate FROM b JOIN f USING (user_id) GROUP BY batch_id")
def stream_repeat_rate(spark, d):
    return sketches.repeat_rate(views.stream(spark, d), BATCH)


@query(f"""{_batches}, f AS (SELECT user_id, min(batch_id) AS f, {_number} AS x FROM b GROUP BY user_id), c(i, a, b) AS (VALUES {_ab}), p AS (SELECT DISTINCT user_id, f, (x * a + b) % {STREAM_PRIME} % {sketches.BITS} AS bit FROM f, c),
    s AS (SELECT bit, min(f) AS s FROM p GROUP BY bit), u AS (SELECT user_id, f, max(s) AS s FROM p JOIN s USING (bit) GROUP BY user_id, f), r AS (SELECT f AS batch_id, count(*) FILTER (s < f) / count(*) AS r FROM u GROUP BY f)
    SELECT batch_id, round(coalesce(r, 0), 6) AS fpr FROM (SELECT DISTINCT batch_id FROM b) LEFT JOIN r USING (batch_id)""")
def bloom_fpr(spark, d):
    return sketches.bloom_rate(views.stream(spark, d), BATCH)


@query(f"""{_batches}, c(i, a, b) AS (VALUES {_ab}), h AS (SELECT batch_id, i, (x * a + c.b) % {sketches.FM_MODULUS} AS h FROM (SELECT batch_id, {_number} AS x FROM b), c),
    z AS (SELECT batch_id, i, max(CASE WHEN h = 0 THEN 1 ELSE bit_count((h & -h) - 1) END) AS z FROM h GROUP BY batch_id, i)
    SELECT batch_id, n_distinct, round(pow(2.0, avg(z)), 6) AS estimate FROM z JOIN (SELECT batch_id, count(DISTINCT user_id) AS n_distinct FROM b GROUP BY batch_id) USING (batch_id) GROUP BY batch_id, n_distinct""")
def fm_distinct(spark, d):
    return sketches.fm_estimates(views.stream(spark, d), BATCH)


@query()
def reservoir_compat(spark, d):
    return sketches.reservoir(views.stream(spark, d))


@query()
def reservoir_batches(spark, d):
    return sketches.reservoir(views.stream(spark, d), batch=30)


def _drawn(x: str, seed: int) -> str:
    return f"(({x} % {DRAW_PRIME} + {DRAW_PRIME}) * 48271 + {seed}) % {DRAW_PRIME} * 69621 % {DRAW_PRIME}"


@query(f"{views.with_sql('stream')} SELECT seq, user_id FROM stream ORDER BY {_drawn('seq', sketches.SEED)}, seq LIMIT {sketches.RESERVOIR}")
def reservoir_sample(spark, d):
    return sketches.bottom_sample(views.stream(spark, d))


# Clusters

_dims = views.with_sql("dims")
_centers = f"{_dims}, cent AS (SELECT label AS cluster, dim, sum(x) / count(*) AS m, sqrt(greatest(sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)), 0)) AS s FROM dims GROUP BY label, dim)"
_nearest = f"{_centers}, g AS (SELECT id, cluster, round(sqrt(sum(pow((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 2))), 9) AS g FROM dims JOIN cent USING (dim) GROUP BY id, cluster), best AS (SELECT id, cluster, g, row_number() OVER (PARTITION BY id ORDER BY g, cluster) AS r FROM g)"


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return cluster.moments(views.points(spark, d).withColumnRenamed("label", "cluster"))


def _centers_of(spark: SparkSession, d: str) -> DataFrame:
    return durable(cluster.centroids(_stats(spark, d)), "centers")


@query(f"SELECT vec_id AS id, {_drawn('vec_id', DRAWS)} % 5 AS chunk FROM embeddings")
def chunk_split(spark, d):
    return cluster.chunk_split(views.points(spark, d), 5, DRAWS).select("id", "chunk")


@query()
def kmeans_sizes(spark, d):
    return cluster.kmeans(views.points(spark, d), 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"{_dims} SELECT label AS cluster, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(sum(x), 6) AS sum, round(sum(x * x), 6) AS sumsq FROM dims GROUP BY label, dim")
def cluster_moments(spark, d):
    return _stats(spark, d).select("cluster", "dim", "n", F.round("sum", 6).alias("sum"), F.round("sumsq", 6).alias("sumsq"))


@query(f"{_nearest} SELECT id, cluster, round(g, 6) AS distance FROM best WHERE r = 1")
def nearest_centroid(spark, d):
    return cluster.nearest(views.points(spark, d), _centers_of(spark, d))


@query()
def bfr_init_outliers(spark, d):
    kept, out = cluster.initial_outliers(views.points(spark, d).select("id", "features"), 10)
    return kept.select("id", F.lit(False).alias("outlier")).unionByName(out.select("id", F.lit(True).alias("outlier")))


@query("WITH g AS (SELECT vec_id AS id, CASE WHEN vec_id % 40 = 0 THEN 1000 + vec_id ELSE label END AS cluster FROM embeddings) SELECT id, count(*) OVER (PARTITION BY cluster) = 1 AS outlier FROM g")
def bfr_singletons(spark, d):
    points = views.points(spark, d).select("id", "features", F.when(F.col("id") % 40 == 0, F.col("id") + 1000).otherwise(F.col("label")).alias("cluster"))
    several, alone = cluster.split_singletons(points)
    return several.select("id", F.lit(False).alias("outlier")).unionByName(alone.select("id", F.lit(True).alias("outlier")))


@query(f"{_nearest} SELECT id, cluster FROM best WHERE r = 1 AND round(g, 6) < {NEAR}")
def bfr_assign(spark, d):
    return cluster.assign(views.points(spark, d).select("id", "features"), _centers_of(spark, d), NEAR)[0].select("id", "cluster")


@query(f"{_centers} SELECT a, b, distance FROM (SELECT p.cluster AS a, q.cluster AS b, round(sqrt(sum((p.m - q.m) * (p.m - q.m))), 6) AS distance FROM cent p JOIN cent q ON p.dim = q.dim AND p.cluster < q.cluster GROUP BY p.cluster, q.cluster) WHERE distance < {CLOSE}")
def bfr_close(spark, d):
    return cluster.close_centers(_centers_of(spark, d), CLOSE)


_merged = f"""WITH RECURSIVE {_centers.removeprefix("WITH ")}, near AS (SELECT p.cluster AS a, q.cluster AS b FROM cent p JOIN cent q ON p.dim = q.dim AND p.cluster <> q.cluster GROUP BY p.cluster, q.cluster HAVING round(sqrt(sum((p.m - q.m) * (p.m - q.m))), 6) < {CLOSE}),
    reach AS (SELECT DISTINCT cluster, cluster AS r FROM cent UNION SELECT n.b, x.r FROM reach x JOIN near n ON n.a = x.cluster), names AS (SELECT cluster, min(r) AS into_ FROM reach GROUP BY cluster)"""


@query(f"{_merged} SELECT into_ AS cluster, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(sum(x), 6) AS sum, round(sum(x * x), 6) AS sumsq FROM dims JOIN names ON names.cluster = dims.label GROUP BY into_, dim")
def bfr_merge(spark, d):
    rows = cluster.merge_close(durable(_stats(spark, d), "moments"), CLOSE)
    return rows.select("cluster", "dim", "n", F.round("sum", 6).alias("sum"), F.round("sumsq", 6).alias("sumsq"))


@query()
def bfr_rounds(spark, d):
    return cluster.bfr(views.points(spark, d).select("id", "features"), 10)[0]


@query()
def bfr_assignments(spark, d):
    return cluster.bfr(views.points(spark, d).select("id", "features"), 10)[1]
