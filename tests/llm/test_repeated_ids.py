"""Rows that share a doc_id bring their own texts once each."""

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import jaccard_join


def test_rows_of_one_id_do_not_multiply(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(1, " ".join(f"w{k}" for k in rng.integers(0, 10**6, 30))) for _ in range(60)]
    rows += [(2, rows[7][1] + " more"), (3, rows[7][1])]
    seen, plain = [], jaccard_join.sketches
    monkeypatch.setattr(jaccard_join, "sketches", lambda texts, *a: seen.append(texts.count()) or plain(texts, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, n=3, percent=80).collect()
    assert seen == [61]  # 60 texts of the first id, and the longer one; the last repeats a class
    assert sorted(r.component_id for r in got) == [1] * 62
    one = jaccard_join.jaccard_components(docs.withColumn("doc_id", F.unhex(F.md5(F.concat("doc_id", "text").cast("binary")))), n=3, percent=80)
    assert one.select("component_id").distinct().count() == 60


def test_toxicity_by_a_plain_loop():
    import pyarrow as pa

    from lodestar.llm import toxicity

    texts = ["you worthless thing, you", "a warm day", "worthless", "", "so it is is is", "été à la mer"] * 4
    m = toxicity.Model(texts, np.array([1.0, 0, 1, 0, 0, 0] * 4))
    want = []
    for t in texts[:6]:
        words = "".join(c.lower() if c.isascii() and c.isalpha() else c if c.isdigit() or not c.isascii() else " " for c in t).split()
        value = []
        for w in words:
            ids, _ = toxicity.grams([w])
            value.append(np.mean(m.flat[ids].astype(float)))
        z = m.bias
        for size, a in zip(toxicity.WINDOWS, m.mix):
            if value:
                n = size or len(value)
                z += a * max(sum(value[k : k + n]) / n for k in range(max(len(value) - n + 1, 1)))
        want.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    np.testing.assert_allclose(m.scores(pa.array(texts[:6], pa.large_string())), want, rtol=1e-6)


def test_shards_grow_with_the_text(spark, tmp_path):
    from lodestar.llm import contracts, tokens

    docs = spark.createDataFrame([(k, "some words in a text " * 20) for k in range(50)], "doc_id long, text string")
    shards, folder = tokens.write_tokens(docs, contracts.vocabulary("byte_bpe_50k.json"), folder=f"file://{tmp_path}/t", shard_bytes=2000)
    assert shards.where("records > 0").count() > 8 and shards.count() >= 11
    got = tokens.read_tokens(shards, folder).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(50)) and [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])


def test_hosts_of_very_many_labels(spark):
    from lodestar.llm import contracts, url_filter

    rules = url_filter.listed(spark, contracts.URL_RULES, contracts.spam_urls(spark))
    long = ".".join(["a"] * 50_000)
    pages = spark.createDataFrame([(1, f"http://{long}.com/en/x"), (2, f"http://{long}.example.com/en/7"), (3, f"http://{long}.example.org/"), (4, "http://com/en/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filtered(pages, rules).collect()}
    assert got == {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: (None, "allow"), 4: ("com/en/", "block")}


def test_short_items_are_never_missed():
    """Each choice of as many places as must agree holds a set of places."""
    import itertools
    import math

    from lodestar.llm import decontamination

    for n in range(1, decontamination.SHORT):
        for overlap in (0.3, 0.6, 0.8, 1.0):
            sets = [set(p) for p in decontamination.places(n, overlap)]
            least = max(1, math.ceil(overlap * n - 1e-9))
            assert all(any(s <= set(c) for s in sets) for c in itertools.combinations(range(n), least))
            assert all(max(s) < n for s in sets)


def test_recall_of_items_of_each_length(spark):
    from lodestar.llm import decontamination

    rng, rows, items = np.random.default_rng(4), [], []
    for n in range(1, 15):
        for _ in range(30):
            i = len(items)
            q = [f"i{i}x{j}" for j in range(n)]
            items.append((i, " ".join(q)))
            for j in rng.choice(n, n - int(np.ceil(0.6 * n - 1e-9)), replace=False):
                q[j] = f"o{j}"
            rows.append((i, " ".join(["a"] * 20 + q + ["b"] * 20)))
    out = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id == r.item_id and r.first_word == 20 for r in out)
    found = np.bincount([r.doc_id // 30 + 1 for r in out], minlength=15)
    assert (found[1:12] == 30).all() and (found[12:] >= 27).all()


def test_figures_keep_other_columns(spark):
    from lodestar.llm import quality_rules

    row = quality_rules.judged(spark.createDataFrame([(1, "some words", "a", "b", 3)], "doc_id long, text string, _w string, _p string, n_words int")).first()
    assert (row["_w"], row["_p"], row["n_words"]) == ("a", "b", 2)
