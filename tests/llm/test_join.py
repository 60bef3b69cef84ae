"""The n-gram join on large groups of near copies, most of them just under the bound."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import jaccard_join
from lodestar.llm.components import starred

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n, percent):
    """Components by comparing all pairs of sets, as rows of a 0/1 matrix."""
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set() for w in (WORD.findall(t.lower()) for _, t in rows)]
    names = {g: k for k, g in enumerate({g for s in sets for g in s})}
    has = np.zeros((len(rows), len(names)), np.float32)
    for k, s in enumerate(sets):
        has[k, [names[g] for g in s]] = 1
    both, size = has @ has.T, has.sum(1)
    linked = (100 * both >= percent * (size[:, None] + size[None] - both)) & (both > 0)
    root = np.arange(len(rows))
    while True:
        new = np.where(linked | np.eye(len(rows), dtype=bool), root[None], len(rows)).min(1)
        if (new == root).all():
            break
        root = new
    return {i: (len(s), rows[r][0]) for (i, _), s, r in zip(rows, sets, root)}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_group_of_near_misses(spark, monkeypatch, n, percent):
    """Texts of one family with 1 to 40 changes each: few link, and the sharp sketch leaves few of the others."""
    rng = np.random.default_rng(n)
    base = [f"v{v}" for v in rng.integers(0, 4000, 300)]
    rows = []
    for i in range(700):
        w = list(base)
        for k in rng.choice(300, rng.integers(1, 40), replace=False):
            w[k] = f"r{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(w)))
    asked = []
    check = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda docs, pairs, *more: (asked.append(pairs.count()), check(docs, pairs, *more))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, n, percent).collect()}
    assert got == brute(rows, n, percent)
    assert len({c for _, c in got.values()}) > 100 and sum(asked) < 10 * len(rows)


def test_chains_and_bands(spark):
    """Links only between neighbours of a chain that grows through many size bands."""
    words = [f"c{k}" for k in range(900)]
    rows = [(1000 - k, " ".join(words[: 20 + 5 * (k % 170)])) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    rows.sort()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 3, 95).collect()}
    assert got == brute(rows, 3, 95)


def test_no_pairs_within_what_is_linked(spark, monkeypatch):
    """A long chain takes many rounds of stars; the last join pairs no two texts that known links connect already."""
    words = [f"c{k}" for k in range(1000)]
    rows = [(k * 37 % 150, " ".join(words[3 * k : 3 * k + 200])) for k in range(150)]
    known, rest = [], []
    star, store = jaccard_join.starred, jaccard_join.stored

    def starred_seen(links, *more):
        known.append([(r.a, r.b) for r in links.select("a", "b").collect()])
        return star(links, *more)

    def stored_seen(df, what):
        out = store(df, what)
        if what == "jaccard-rest":
            rest.extend((r.a, r.b) for r in out.collect())
        return out

    monkeypatch.setattr(jaccard_join, "starred", starred_seen)
    monkeypatch.setattr(jaccard_join, "stored", stored_seen)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 5, 80).collect()}
    assert got == brute(sorted(rows), 5, 80)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in known[1]:
        root[find(a)] = find(b)
    assert known[1] and not [(a, b) for a, b in rest if find(a) == find(b)]


def test_words_of_a_linked_pair_meet():
    """Of two sets that differ in d members, some word is left out by neither."""
    rng = np.random.default_rng(5)
    bands = jaccard_join.Bands(80)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        out = rng.integers(0, bands.most_apart(2 * size) // 2 + 1)
        b = np.concatenate([a[out:], rng.integers(0, 2**63, out).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        k = max(bands.of(len(a)), bands.of(len(b)))
        assert k in bands.spans(len(a)) and k in bands.spans(len(b))
        p, s, _, _ = bands.shape(k)
        kept = []
        for x in (a, b):
            long, n = jaccard_join.dealt(x, p)
            keys = long + np.arange(p, dtype=np.uint64) * np.uint64(1 << 50)
            kept.append(set(keys[np.lexsort((keys, n))[s:]].tolist()))
        assert kept[0] & kept[1]


def test_repeated_ids(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "other words that nobody else has here"), (2, "a b c d e f g h"), (3, "other words that nobody else has here")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit(0)).withColumn("rep", F.lit("x"))
    out = Counter((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df, 3, 90).collect())
    assert out == Counter({(1, 1): 90, (2, 1): 30, (3, 1): 30})


def test_stars_in_parts(spark):
    """Chains, stars and a cycle, linked in three parts with a round after each: names hold at every time, and at the end the smallest node's."""
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(50, 90)] + [(200 + k, 200 + (k + 7) % 15) for k in range(15)] + [(300, 300), (None, 301)]
    rng = np.random.default_rng(2)
    rng.shuffle(links)
    smallest = {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, *range(50, 90)], 50), **dict.fromkeys(range(200, 215), 200)}
    edges = spark.createDataFrame([], "a long, b long")
    for part, rounds in ((links[0::3], 1), (links[1::3], 1), (links[2::3], None)):
        edges, names = starred(edges.union(spark.createDataFrame([tuple(None if x is None else int(x) for x in e) for e in part], "a long, b long")), rounds)
        got = {r.node: r.component for r in names.collect()}
        assert len(got) == names.count() and all(smallest[n] == smallest[c] and c <= n for n, c in got.items())
    assert got == smallest


def test_few_shuffles(spark):
    """The tasks of a join over few rows, in which each shuffle has 16 partitions: 211 of them make a run as long as its shuffles are many."""
    rng = np.random.default_rng(9)
    base = [f"v{v}" for v in rng.integers(0, 4000, 200)]
    rows = [(i, " ".join(f"r{i}" if k in (i % 150, i % 150 + 40) else w for k, w in enumerate(base))) for i in range(60)] + [(100 + i, f"text {i} of its own") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    new = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("few-shuffles", "")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 3, 90).collect()}
        track = spark.sparkContext.statusTracker()
        stages = {s for j in track.getJobIdsForGroup("few-shuffles") for s in track.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for s in stages if (x := track.getStageInfo(s)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sparkContext._jsc.clearJobGroup()
    assert got == brute(rows, 3, 90)
    assert tasks < 1000, tasks
