"""Operators 1, 3 and 5: learned models."""

import random
import zlib
from itertools import product

import numpy as np
import pytest

from orebody.llm import convnet, learn, pages, toxicity

WORDS = "an be ca do en fi ga he in jo ka lo".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def scores(rows):
    return {(r["doc_id"], r["score"]) for r in rows}


@pytest.mark.parametrize("module,fit,mod,rest", [(convnet, convnet.fit_quality, 5, 0), (toxicity, toxicity.fit_toxicity, 4, 2)])
def test_edges(spark, edge, empty, labels, module, fit, mod, rest, monkeypatch):
    monkeypatch.setattr(convnet, "UPDATES", 20)
    model = fit(edge, labels)
    rows = module.score(edge, model).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % mod == rest)
    texts = dict((r["doc_id"], r["text"]) for r in edge.collect())
    assert texts[4] == texts[5]
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert module.score(empty, model).collect() == []
    assert len(module.score(edge, fit(empty, labels)).collect()) == len(rows)
    assert len(module.score(edge, fit(edge, labels.limit(0))).collect()) == len(rows)


def test_sample_is_bounded_and_never_held_out(corpus):
    docs, labels = corpus
    few = learn.sample(docs, labels, "quality", 5, 0, total=20_000).collect()
    assert 0 < sum(len(r["text"].encode()) for r in few) <= 20_000
    got = learn.sample(docs, labels, "quality", 5, 0, rows=20, longest=4000).collect()
    assert 0 < len(got) <= 20
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 and len(r["text"].encode()) <= 4000 for r in got)


def quality_texts(count, seed):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        t = prose(rng, rng.randint(40, 300))
        kind = i % 8
        if kind == 0:
            t = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in t.split())
        elif kind == 1:
            t = " ".join(w for w in t.split()[:40] for _ in range(7))
        out.append((t.encode(), float(kind > 1)))
    return out


def test_convnet_learns_symbols_and_repetition(monkeypatch):
    monkeypatch.setattr(convnet, "UPDATES", 400)
    train, test = quality_texts(480, 1), quality_texts(160, 2)
    net = convnet.scorer(convnet.train([t for t, _ in train], np.array([y for _, y in train])))
    blob, offsets = b"".join(t for t, _ in test), np.cumsum([0] + [len(t) for t, _ in test])
    got = net(np.frombuffer(blob, np.uint8), offsets)
    assert np.mean((got >= 0.3) == np.array([y for _, y in test])) > 0.95


def test_convnet_against_a_plain_one():
    rng = np.random.default_rng(0)
    p = {"filters": rng.normal(0, 1, (convnet.WIDTH, 256, convnet.FILTERS)), "filter_bias": rng.normal(0, 1, convnet.FILTERS), "units": rng.normal(0, 1, (convnet.FILTERS + 1, convnet.UNITS)), "unit_bias": rng.normal(0, 1, convnet.UNITS), "out": rng.normal(0, 1, convnet.UNITS), "out_bias": np.array(0.3)}
    texts = [b"", b"hello world", bytes(rng.integers(32, 120, 500).astype(np.uint8)), b"abc " * 100]
    got = convnet.Net(p)(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    half = convnet.HALF
    for text, score in zip(texts, got, strict=True):
        padded = text + bytes(-(-max(1, len(text)) // half) * half + half + 16 - len(text))
        best = np.full(convnet.UNITS, -np.inf)
        for c in range(max(1, -(-len(text) // half) - 1)):
            a, b = c * half, c * half + 2 * half
            n = max(1, min(b, len(text)) - a)
            h = np.zeros(convnet.FILTERS + 1)
            for i in range(a, b, convnet.STRIDE):
                if i < len(text):
                    h[:-1] += np.maximum(p["filter_bias"] + sum(p["filters"][j][padded[i + j]] for j in range(convnet.WIDTH)), 0)
            h[:-1] *= convnet.STRIDE / n
            h[-1] = max(sum(padded[i] == padded[i - lag] for i in range(max(a, lag), min(b, len(text)))) for lag in convnet.LAGS) / n
            best = np.maximum(best, np.maximum(h @ p["units"] + p["unit_bias"], 0))
        assert abs(score - 1 / (1 + np.exp(-(best @ p["out"] + p["out_bias"])))) < 1e-4


def test_noisy_or_and_offending_sentences(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        sentences = [prose(rng, 8).replace(".", "") for _ in range(6)]
        if i % 4 == 0:
            k = rng.randrange(6)
            sentences[k] += " " + rng.choice(["zwxgrob", "qqfies"])
        rows.append((i, ". ".join(sentences) + "."))
    model = toxicity.train([t.encode() for _, t in rows[:300]], np.array([float(i % 4 == 0) for i, _ in rows[:300]]))
    docs = spark.createDataFrame(rows[300:], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(300, 400))
    found = toxicity.offending(docs, model).collect()
    assert {r["doc_id"] for r in found} == {i for i in range(300, 400) if i % 4 == 0}
    assert all("zwxgrob" in r["sentence"] or "qqfies" in r["sentence"] for r in found)
    assert {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()} == {i for i in range(300, 400) if i % 4}
    scorer = toxicity.Scorer(model)
    data = rows[300][1].encode()
    p, _, _, each = scorer(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert abs(p[0] - (1 - np.prod(1 - each))) < 1e-9


def test_sentence_scores_against_plain_ones():
    """Words, sentences and features of a second, plain making; the same weights."""
    import re

    from orebody.llm.common import span_hash

    rng, vocabulary = random.Random(4), ["grolp", "Über", "zwxgrob", "a", "no", "quartzes", "ärger", "naïveté", "x1y"]
    texts = ["", "!?.\n", *(" ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".", "!", "?!", "\n", " 7 "]) for _ in range(rng.randrange(1, 40))) for _ in range(60))]
    weight = np.random.default_rng(2).exponential(1.5, toxicity.WEIGHTS) * (np.random.default_rng(3).random(toxicity.WEIGHTS) < 0.6)
    scorer = toxicity.Scorer({"bias": toxicity.BIAS, "at": np.flatnonzero(weight), "weight": weight[weight > 0]})
    name = lambda x, k=0: (int(span_hash(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) + k) % 2**64 % toxicity.WEIGHTS
    blob = [t.encode() for t in texts]
    got, row, _, each = scorer(np.frombuffer(b"".join(blob), np.uint8), np.cumsum([0] + [len(b) for b in blob]))
    logistic = lambda z: 1 / (1 + np.exp(-z))
    for i, text in enumerate(blob):
        clear, scores = 1.0, []
        for sentence in re.findall(rb"[^\n!.?]*[\n!.?]+|[^\n!.?]+", text.lower()):
            words = re.findall(rb"[a-z\x80-\xff]+", sentence)
            found = {name(w) for w in words} | {name(w[:k], k) for w in words for k in toxicity.BEGINNINGS if len(w) > k}
            logit = toxicity.BIAS + sum(weight[f] for f in found)
            share = (1 - logistic(logit)) / (1 - logistic(toxicity.BIAS))
            scores.append(1 - share)
            clear *= share
        assert abs(got[i] - (1 - clear)) < 1e-4
        assert np.allclose(each[row == i], scores, atol=1e-4)


def test_sentences_without_known_words_add_nothing():
    words = "bad word of the worst kind".split()
    texts = [f"{w} {x}." for w in words for x in "ab"] * 4
    model = toxicity.train([t.encode() for t in texts], np.array([float("bad" in t) for t in texts]))
    scorer = toxicity.Scorer(model)
    clean = "Xylo quartz jumps.\n\n1 2 3.\n" * 20_000
    for text, toxic in ((clean, False), (clean + "A bad one.", True)):
        data = np.frombuffer(text.encode(), np.uint8)
        p, _, sentence, _ = scorer(data, np.array([0, len(data)]))
        assert len(sentence) >= 40_000
        assert p[0] >= 0.3 if toxic else p[0] == 0


def test_keep_clean_keeps_all_columns(edge, empty, labels):
    model = toxicity.fit_toxicity(edge, labels)
    kept = toxicity.keep_clean(edge, model)
    assert kept.columns == edge.columns
    bad = {r["text"] for r in toxicity.score(edge, model).join(edge.select("doc_id", "text"), "doc_id").where("predicted = 1").collect()}
    assert kept.count() == sum(r["text"] not in bad for r in edge.collect())
    assert toxicity.keep_clean(empty, model).collect() == []


@pytest.fixture(scope="module")
def weights():
    return pages.fit_extractor()


def test_field_on_held_out_pages(weights):
    extract, wrong, total = pages.Extractor(weights), 0, 0
    for page, label in pages.labelled_pages(120, seed=77):
        found = pages.blocks(page)
        for b, y in zip(found, extract.labels(found), strict=True):
            wrong, total = wrong + (label[b[0]] != y), total + 1
    assert wrong / total < 0.03


def test_viterbi_is_the_best_labelling(weights):
    extract = pages.Extractor(weights)
    for page, _ in pages.labelled_pages(12, seed=5):
        found = pages.blocks(page)[:9]
        x = pages.matrix(found)
        s = x @ weights["emit"] + weights["bias"][0]

        def value(y, s=s):
            return weights["start"][y[0]] + weights["end"][y[-1]] + sum(s[i] * k for i, k in enumerate(y)) + sum(weights["pair"][a, b] for a, b in zip(y, y[1:], strict=False))

        best = max(product((0, 1), repeat=len(found)), key=value)
        assert abs(value(best) - value(tuple(extract.labels(found)))) < 1e-6


def test_only_code_and_the_title_are_no_blocks(weights):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>A title of it</h1><p>The formula <math><mi>x</mi></math> holds, as is well known to all.</p><noscript><p>A paragraph for readers without scripts, of some length.</p></noscript><script>var a;</script><p>And <svg><text>here</text></svg> it ends.</p></article><form><button>Go</button></form><footer>© Foot, all rights.</footer>"
    assert pages.Extractor(weights)(page) == "A title of it The formula x holds, as is well known to all. A paragraph for readers without scripts, of some length. And here it ends."
    assert [b[0] for b in pages.blocks("<div>a<iframe>b</iframe><object>c</object><template>d</template></div>")] == ["a", "b", "c", "d"]


def test_pages_are_read_in_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 40_000 + "</x>" * 40_000, "<foo>" * 40_000 + "<p></p>" * 40_000, '<a "x>" ' * 50_000, "<li><div>" + "<foo>" * 20_000 + "<li></li>" * 20_000):
        pages.blocks(page)
    assert time.time() - began < 30


def test_page_edges(spark, weights):
    page = "<nav><a href=x>Menu</a></nav><article><h1>A &amp; B&nbsp;c</h1><p>Some <b>bold</b>\n text,<br>and more of it here.<p>Unclosed paragraph with some words &lt;x&gt;.</article><footer>© Foot, all rights.</footer>"
    rows = [(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<p>" * 3000, "t"), (5, "u", "no markup at all, only words.", "t"), (None, "u", "<script>x</script", "t"), (1, "u", page, "t"), (6, "u", "<div><p>" + "Very long words, again. " * 20000, "t"), (7, "u", "<!-- never closed <p>a</p>", "t"), (8, "u", "<a <b> & &# &#x110000; <", "t")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in pages.main_text(table, weights=weights).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, _, t, n in got)
    texts = {i: t for i, _, t, _ in got}
    assert texts[1] == "A & B c Some bold text, and more of it here. Unclosed paragraph with some words <x>."
    assert texts[2] == texts[3] == texts[4] == texts[None] == texts[7] == ""
    assert len(texts[6]) > 400_000
    assert pages.main_text(table.limit(0), weights=weights).collect() == []


def test_articles_of_the_pages_table(spark, weights):
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in pages.main_text(table, weights=weights).collect()}
    for r in table.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(" ".join(html.unescape(re.sub("</?b>", "", x)) for x in re.split("</?(?:p|h1|br)>", inner)).split())
        assert got[r["page_id"]] == want
