"""Operators 4, 7 and 9, and the pipeline."""

import random
import re
from collections import Counter, defaultdict
from math import ceil, floor, log

import numpy as np
import pytest

from orebody.llm import mixing, ngrams, rules
from orebody.plans.durable import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return tuple((x is None, x) for x in row)


def prose(rng, n, v=400):
    return " ".join(f"w{rng.randrange(v)}" for _ in range(n))


# N-gram Jaccard join


def shingle_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> (set size, component) for rows (doc_id, text) with different ids."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {rows[i][0]: (len(sets[i]), min(groups[find(i)])) for i in range(len(rows))}


def near_copies(seed, bases=14, copies=6):
    rng = random.Random(seed)
    passage = prose(rng, 30)
    rows = []
    for _ in range(bases):
        words = prose(rng, rng.choice([3, 5, 6, 9, 14, 25, 60, 150, 400])).split()
        if rng.random() < 0.4:
            words += passage.split()
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            if rng.random() < 0.3:
                w = w[: -rng.randrange(1, 1 + len(w) // 6)] if len(w) > 6 else w
            rows.append(rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rows = near_copies(seed)
    got = ngrams.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


@pytest.mark.parametrize("pivots", [1, 3])
def test_components_in_small_blocks(spark, monkeypatch, pivots):
    monkeypatch.setattr(ngrams, "RUN_BLOCK", 3)
    monkeypatch.setattr(ngrams, "NODE_BLOCK", 4)
    monkeypatch.setattr(ngrams, "PIVOTS", pivots)
    monkeypatch.setattr(ngrams, "SMALL", 0)
    rows = near_copies(3, bases=5, copies=14)
    got = ngrams.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_a_task_of_many_short_texts(spark):
    """More distinct sets in one task than a place has numbers; each odd row is its neighbour and a word more."""
    text = "concat(hex(id - id % 2), ' a b c d ', hex(id - id % 2), if(id % 2 = 0, ' e', ' e f'))"
    docs = spark.range(0, 72_000, 1, 1).selectExpr("id AS doc_id", f"{text} AS text")
    got = ngrams.jaccard_components(docs)
    assert got.where("component_id = doc_id - doc_id % 2").count() == got.count() == 72_000


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 7, 8, 12, 16, 31, 33, 64, 100, 127, 300, 700]:
        for _ in range(12):
            a = rng.choice(2**62, n, replace=False)
            keep = ceil(0.75 * n)
            grow = rng.integers(0, n // 3 + 1)
            pool = rng.choice(2**62, n, replace=False)
            b = np.concatenate([a[: max(keep, n - int(rng.integers(0, n // 7 + 1)))], pool[:grow]])
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            sets = [np.sort(x.astype(np.uint64)) for x in (a, b)]
            s, r = ngrams.signatures(np.concatenate(sets), np.array([0, len(a), len(a) + len(b)]))
            assert set(s[r == 0].tolist()) & set(s[r == 1].tolist())
            x, y = ngrams.sketches(np.concatenate(sets), np.array([0, len(a), len(a) + len(b)]))
            size = min(len(x), len(y))
            assert np.bitwise_count(ngrams._folded(x, size) ^ ngrams._folded(y, size)).sum() <= ngrams.differ_at_most(len(a), len(b))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_a_polynomial_hash_takes_for_equal_stay_apart(spark):
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, word), (4, f"{word} {other}"), (5, f"{other} {word}")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngrams.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_sets_with_one_hash_are_named_anew(spark, monkeypatch):
    """Node ids of 3 bits: nearly all sets clash until the second hash names them."""
    plain = ngrams._set_hash
    monkeypatch.setattr(ngrams, "_set_hash", lambda h, o, salt: plain(h, o, salt) & np.uint64(7) if salt == 0x8CB92BA72F3D8DD7 else plain(h, o, salt))
    rows = near_copies(6, bases=5)
    h, o = ngrams.shingles(*ngrams.utf8(__import__("pyarrow").array([t for _, t in rows])))
    first = ngrams.node_ids(h, o)
    clashing = frozenset(first.tolist())
    renamed, sets = ngrams.node_ids(h, o, clashing).tolist(), [frozenset(h[a:b].tolist()) for a, b in zip(o[:-1], o[1:], strict=True)]
    assert len(set(first.tolist())) <= 4 and len(set(renamed)) == len(set(sets)) == len(set(zip(renamed, sets, strict=True)))


def test_a_signature_need_is_met_by_every_link():
    rng = np.random.default_rng(7)
    for n in [*range(1, 30), 64, 100, 300]:
        for _ in range(10):
            a = rng.choice(2**62, n, replace=False).astype(np.uint64) * np.uint64(4)
            b = np.concatenate([a[: n - int(rng.integers(0, n // 4 + 1))], rng.choice(2**62, int(rng.integers(0, n // 3 + 1)), replace=False).astype(np.uint64) * np.uint64(4)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            hashes, offsets = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
            sig, row = ngrams.signatures(hashes, offsets)
            need = ngrams.shared_at_least(hashes, offsets).max(axis=0)
            common = np.intersect1d(sig[row == 0], sig[row == 1])
            assert any(np.count_nonzero((common & np.uint64(1)) == np.uint64(q)) >= need[q] for q in (0, 1))


def test_jaccard_edges(edge, empty, edge_rows):
    got = sorted((tuple(r) for r in ngrams.jaccard_components(edge).collect()), key=key)
    truth = brute([(i, r[1]) for i, r in enumerate(edge_rows)])
    ids = [r[0] for r in edge_rows]
    groups = defaultdict(list)
    for i, (_, c) in truth.items():
        groups[c].append(ids[i])
    least = {c: min((x for x in g if x is not None), default=None) for c, g in groups.items()}
    want = sorted(((ids[i], n, least[c] if n else ids[i]) for i, (n, c) in truth.items()), key=key)
    assert got == want
    assert ngrams.jaccard_components(empty).collect() == []


def test_keep_one(spark, edge, empty):
    kept = ngrams.keep_one(edge)
    assert kept.columns == edge.columns
    texts = Counter(r["text"] for r in kept.collect())
    assert texts["one two three four five six"] == 1 and texts[None] == 2 and texts[""] == 1
    assert ngrams.keep_one(empty).collect() == []
    rows = near_copies(5, bases=6)
    truth = brute(rows)
    kept = ngrams.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in truth.values()})


def test_components_of_a_long_path(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**6), 200)
    links = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long")
    assert {r["component"] for r in ngrams.components(links).collect()} == {min(names)}
    assert ngrams.components(links.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_a_small_graph_is_joined_without_rounds(spark, monkeypatch, seed):
    """The components are those that rounds of shuffles make, and nothing else is written on the way."""
    rng = random.Random(seed)
    pairs = [(x, x) if rng.random() < 0.1 else (x, rng.randrange(-200, 200)) for x in (rng.randrange(-200, 200) for _ in range(150))]
    links = spark.createDataFrame(pairs + [(7 * 10**18, -7 * 10**18), (None, 3)], "a long, b long")
    before = len(written(spark))
    got = ngrams.components(links)
    assert len(written(spark)) == before + 1
    monkeypatch.setattr(ngrams, "SMALL", 0)
    rounds = ngrams.components(links)
    assert got.dtypes == rounds.dtypes and sorted(got.collect()) == sorted(rounds.collect())


# Mixing


def scatter(v):
    return v % mixing.PRIME * mixing.FIRST % mixing.PRIME * mixing.SECOND % mixing.PRIME


def mixed(v):
    return scatter(scatter(v) + (v >> 31))


def swap_or_not(x, n, seed):
    for i in range(mixing.ROUNDS):
        one = scatter(seed * mixing.ROUNDS + i)
        partner = ((one * 2**31 + scatter(one + 1)) % n - x + n) % n
        high = max(x, partner)
        if (scatter(one + high + (high >> 31) * 7919) >> 13) % 2:
            x = partner
    return x


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """By repeated sharing: whoever is above the limit stops there."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            break
        level = (left - sum(most * sizes[s] for s in full)) / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level >= most * sizes[s]]
        if not over:
            break
        full |= set(over)
    for s in order:
        target[s] = float(most * sizes[s]) if s in full else w[s] * level
    return order, target


def plain_taken(rows, block, seed=7):
    """(doc_id, size, source_size, target, taken) by walking the blocks; rows: (doc_id, source, text)."""
    sized = [(i, s, len(WORD.findall(t or ""))) for i, s, t in rows]
    total = defaultdict(int)
    for _, s, n in sized:
        total[s] += n
    order, target = plain_targets(dict(total))
    out = []
    for sid, s in enumerate(order):
        bucket = lambda d: mixed(mixed((d[0] or 0) & (2**62 - 1)) + d[1]) % max(1, -(-len(rows) // mixing.BUCKET))
        docs = sorted(((i, n) for i, x, n in sized if x == s), key=lambda d: (bucket(d), d[0] is not None, d[0] or 0, d[1]))
        size, n_blocks = total[s], -(-total[s] // block)
        times = np.zeros(size + 1, int)
        left, epoch = floor(target[s]), 0
        while left > 0:
            for j in range(n_blocks):
                b = swap_or_not(j, n_blocks, seed * 1009 + sid * 31 + epoch)
                k = min(block, size - b * block, left)
                times[b * block : b * block + k] += 1
                left -= k
                if left <= 0:
                    break
            epoch += 1
        at = 0
        for i, n in docs:
            out.append((i, n, size, target[s], int(times[at : at + n].sum())))
            at += n
    return sorted(out, key=key)


@pytest.mark.parametrize("seed,block", [(1, 16), (2, 7), (3, 256)])
def test_mixing_against_a_walk(spark, seed, block, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 10 * seed)
    monkeypatch.setattr(mixing, "LEVEL", 3)
    rng = random.Random(seed)
    rows = [(i if i % 17 else None, rng.choice(["a", "b", "b", "b", "ü", "Z", None]), rng.choice([None, "", "x", prose(rng, rng.randrange(1, 200))])) for i in range(150)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = sorted((tuple(r) for r in mixing.taken(df, block=block).collect()), key=key)
    want = plain_taken(rows, block)
    for g, w in zip(got, want, strict=True):
        assert (g[0], g[1], g[2], g[4]) == (w[0], w[1], w[2], w[4]) and abs(g[3] - w[3]) < 1e-6
        assert g[4] <= 2 * g[1]


def test_mixing_edges(edge, empty, edge_rows):
    got = mixing.taken(edge).collect()
    assert len(got) == len(edge_rows)
    by = defaultdict(int)
    for r in got:
        by[(r["source_size"], r["target"])] += r["taken"]
    assert all(abs(t - n) <= 1 for (_, t), n in by.items())
    assert mixing.taken(empty).collect() == []
    assert mixing.mix(empty).collect() == []


def test_mix_rows_are_the_taken_words(spark, edge):
    placed = mixing.mix_rows(edge, block=64)
    assert placed.columns == ["place", "row"]
    rows = mixing.mix(edge, block=64)
    assert rows.columns == edge.columns
    taken = Counter()
    for r in rows.collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
    want = Counter()
    for r in mixing.taken(edge, block=64).collect():
        want[r["doc_id"]] += r["taken"]
    assert taken == +want
    source = {r["doc_id"]: r["text"] for r in edge.collect()}
    assert all(r["text"] in source[r["doc_id"]] for r in rows.where("doc_id in (6, 8, 10)").collect())


def quotas(spark, numbers):
    first = np.cumsum(numbers) - numbers
    return spark.createDataFrame([(i, int(f), int(n)) for i, (f, n) in enumerate(zip(first, numbers, strict=True))], "sid long, first long, slots long")


def test_shards_draw_multinomially(spark):
    """Chi-square of the shards' source counts: neither exact shares nor far from them."""
    numbers = np.array([30_000, 12_000, 6_000, 2_000])
    counts = {(r["shard"], r["sid"]): r["n"] for r in mixing.draws(quotas(spark, numbers), 500, 3).groupBy("shard", "sid").count().withColumnRenamed("count", "n").collect()}
    want = 500 * numbers / numbers.sum()
    chi = [sum((counts.get((s, i), 0) - w) ** 2 / w for i, w in enumerate(want)) for s in range(100)]
    assert sum(counts.values()) == 50_000 and 2 < np.mean(chi) < 4 and max(chi) < 30


def test_shards_share_out_all_slots(spark, corpus, monkeypatch):
    docs, _ = corpus
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "CHUNK", 64)
    sizes = docs.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("source_size"))
    sources = mixing.targets(sizes).cache()
    slots = mixing.slots(sources, 64, shard=100).collect()
    places = [r["shard"] * 100 + r["slot"] for r in slots]
    assert sorted(places) == list(range(len(places)))
    words, times = Counter(), Counter()
    for r in slots:
        words[r["sid"]] += r["words"]
        times[(r["sid"], r["idx"])] += 1
    assert words == {r["sid"]: floor(r["target"]) for r in sources.collect() if r["target"] >= 1}
    for r in sources.collect():
        of = [n for (sid, _), n in times.items() if sid == r["sid"]]
        assert not of or max(of) - min(of) <= 1 or len(of) < -(-r["source_size"] // 64) and max(of) == 1
    by_shard = Counter(r["shard"] for r in slots)
    assert all(len({r["sid"] for r in slots if r["shard"] == s}) > 3 for s, n in by_shard.items() if n == 100)


def test_mix_is_in_the_order_of_its_shards(spark, corpus):
    """Neighbouring rows of a file come from different sources as often as the sources' shares let them."""
    docs, _ = corpus
    rows = mixing.mix(docs, block=64, shard=50).collect()
    share = Counter(r["source"] for r in rows)
    changes = np.mean([a["source"] != b["source"] for a, b in zip(rows, rows[1:], strict=False)])
    assert changes > 0.7 * (1 - sum((n / len(rows)) ** 2 for n in share.values()))


def test_stages_keep_columns_of_any_name(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ["shard", "slot", "a", "gone_id", "gone_node", "place", "row", "own", "core", "size", "k", "j", "idx", "label", "key", "n"]
    docs = docs.selectExpr("*", *(f"doc_id AS `{x}`" for x in names)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.where(" OR ".join(f"`{x}` <> doc_id" for x in names)).count() == 0, name


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    lit = lambda x: F.lit(x).cast("long")
    rows = spark.range(n).select("id", mixing.permuted(F.col("id"), lit(n), lit(5)).alias("x")).select("*", mixing.permuted(F.col("x"), lit(n), lit(5), inverse=True).alias("back")).collect()
    assert sorted(r["x"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)
    assert [r["x"] for r in rows] == [swap_or_not(i, n, 5) for i in range(n)]


# Quality rules


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_base(edge, empty, edge_rows):
    got = sorted((tuple(r)[:8] for r in rules.judge(edge).collect()), key=key)
    want = []
    for row in edge_rows:
        c = plain_counts(row[1])
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((row[0], *c, failed))
    assert [g[:7] for g in got] == sorted(want, key=key)
    assert all(not (failed and kept) for *_, failed, kept in got)
    assert rules.judge(empty).collect() == []


def test_windows_of_very_long_texts_are_compared_by_their_words(spark):
    n = 2_500_000
    docs = spark.range(1).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, {n}), i -> hex(i)), ' ') AS text")
    row = rules.counts(docs).first()
    assert (row["n_words"], row["n_repeat_words"], row["n_doubled"]) == (n, 0, 0)
    cycle = spark.createDataFrame([(1, "a b c d " * 3 + "x a b y c d a"), (2, "a " * 9)], "doc_id long, text string")
    assert [r["n_repeat_words"] for r in rules.counts(cycle).orderBy("doc_id").collect()] == [plain_counts(t)[4] for _, t in [tuple(r) for r in cycle.collect()]]


def test_em_against_plain_python(spark, corpus):
    docs, _ = corpus
    voted = rules.LabelModel().vote(rules.counts(docs)).cache()
    model = rules.LabelModel().fit(voted)
    names = list(rules.RULES)
    votes = [tuple(r[f"v_{n}"] for n in names) for r in voted.collect()]
    prior, s = rules.START["prior"], rules.START
    good, bad = [(s["g1"], s["g0"])] * len(names), [(s["b1"], s["b0"])] * len(names)
    chance = lambda v, r: sum(log(y if x == 1 else n if x == 0 else 1 - y - n) for x, (y, n) in zip(v, r, strict=True))
    for _ in range(rules.ITERATIONS):
        p = [1 / (1 + np.exp(log(1 - prior) + chance(v, bad) - log(prior) - chance(v, good))) for v in votes]
        g, b = sum(p), len(p) - sum(p)
        prior = min(0.99, max(0.01, (g + 1) / (len(p) + 2)))
        part = lambda j, k, q: sum(x for x, v in zip(q, votes, strict=True) if v[j] == k)
        good = [((part(j, 1, p) + 1) / (g + 3), (part(j, 0, p) + 1) / (g + 3)) for j in range(len(names))]
        rest = [1 - x for x in p]
        bad = [((part(j, 1, rest) + 1) / (b + 3), (part(j, 0, rest) + 1) / (b + 3)) for j in range(len(names))]
    assert abs(model.prior - prior) < 1e-6
    for j, n in enumerate(names):
        assert np.allclose(model.good[n], good[j], atol=1e-6) and np.allclose(model.bad[n], bad[j], atol=1e-6)


def test_verdicts_follow_the_labels(corpus):
    docs, labels = corpus
    rows = rules.judge(docs).join(labels, "doc_id").collect()
    open_ = [r for r in rows if not r["base_failed"]]
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in open_]) > 0.95


def test_keep_good(edge, empty):
    kept = rules.keep_good(edge)
    assert kept.columns == edge.columns
    good = Counter((r["doc_id"]) for r in rules.judge(edge).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == good
    assert rules.keep_good(empty).collect() == []


# Pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept.append(out.cache())
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] > ids[1] > ids[2] >= ids[3] >= ids[4]
    truth = brute(sorted((r["doc_id"], r["text"]) for r in kept[2].collect()))
    assert ids[3] == {c for _, c in truth.values()}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[4], sf)
    pieces = kept[4].count()
    assert packed.count() >= pieces


def test_pipeline_on_nothing(spark, sf, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
