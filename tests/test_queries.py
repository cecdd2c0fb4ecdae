"""Every registered query of the mining operators against its SQL on the small tables."""

import math

import duckdb
import pytest

from orebody.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


#: At this size a graph of users with 7 parts in common has thousands of edges; its loops run on the small graphs below.
SLOW = {"edge_betweenness", "gn_top_edges", "girvan_newman", "bfs_depths"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in registry.SQL:
        found = duck.execute(registry.SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert plain(got, df.columns) == plain(found.fetchall(), names)


def test_every_listed_key_is_registered():
    listed = """project_reviews review_count count_year distinct_users distinct_businesses count_by_user top10_users top10_businesses review_report
    partition_counts join_city_stars avg_stars_by_city top10_city user_avg_rating valid_ratings basket_key baskets baskets_case2 filtered_baskets
    itemset_support freq_items freq_pairs freq_triples freq_itemsets_fpgrowth son_itemsets itemset_candidates itemset_report dict_encode
    item_user_sets item_rating_map minhash_signatures lsh_candidates lsh_pairs jaccard_pairs item_corater_counts user_features
    business_features features_inner features_left cf_user_mean cf_item_based gbt_predict gbt_predict_wide hybrid_blend cooccurrence_edges
    graph_vertices symmetric_edges degree connected_components label_propagation label_groups community_report bfs_depths edge_betweenness
    gn_top_edges modularity girvan_newman stream_batches stream_repeat_rate bloom_fpr fm_distinct reservoir_compat reservoir_sample
    chunk_split kmeans_sizes cluster_moments nearest_centroid bfr_init_outliers bfr_assign bfr_merge bfr_rounds"""
    assert set(listed.split()) <= set(registry.QUERIES)
