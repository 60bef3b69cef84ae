"""The corpus operators against brute force on small tables, and on odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import contracts, decontamination, jaccard_join, license_scan, quality_classifier, quality_rules, sentencepiece_sampling, sharding, tokens, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30000))
ODD = [
    (23, "  if a:\n        b =  c   \n" + "\u4e2d\u6587\U0001f600" * 400 + "    end   ", 0), (21, "x <|endoftext|>y <|endoftext|> z<|endoftext|>", 0), (22, "\u3000a\u3000 b\x85 c\x1c d \u00a0", 0),
    (1, "", 0), (2, None, 0), (None, "a null key with a text", 0), (3, LONG, 0), (4, LONG, 0), (5, "twice", 1), (5, "twice", 1), (6, "ab", 2),
    (7, "All rights  reserved.\n\nCC-BY cc by; GENERAL public\tlicense É é", 3), (8, "\u2581 mark \u2581\u2581x\0 \ue000 \U0001f600 tail ", 4), (9, " \t\n\x0b lead\x1ctail\u00a0 \n\n", 5),
]


def lower(s):
    return s.translate({k: k + 32 for k in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n long").withColumn("band", F.lit("x")).withColumn("key", F.lit(1))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_license(spark, odd, none, docs, texts):
    def want(t):
        w, hits = ALNUM.findall(lower(t or "")), []
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            hits += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        at = [k for k, _ in hits]
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    for df, rows in ((docs, [(i, t) for i, t in texts.items()]), (odd, [(i, t) for i, t, _ in ODD])):
        got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(df).collect())
        assert got == Counter((i, *want(t)) for i, t in rows)
    assert license_scan.scan(none).count() == 0
    mit = "noise " + license_scan.TEMPLATES["mit"].replace("charge", "cost") + " noise"
    r = license_scan.scan(spark.createDataFrame([(1, mit)], "doc_id long, text string")).first()
    assert r.labels == "mit" and r.score > 0.9 and r.spans[0].first == 1


def test_license_chain_has_no_look_back():
    def brute(runs):
        runs, best = sorted(runs), []
        for d, t, n in runs:
            value = n
            for (dj, tj, nj), had in zip(runs, best):
                gain = n - max(0, tj + nj - t)
                if dj + nj <= d and tj < t and gain > 0:
                    value = max(value, had + gain)
            best.append(value)
        return max(best)

    long = [(0, 0, 30), *((40 + 6 * k, 5, 4) for k in range(300)), (2000, 30, 30)]
    assert license_scan.chained(long) == (60, 0, 2030)
    rng = np.random.default_rng(1)
    for _ in range(200):
        runs = [(int(d), int(t), int(n)) for d, t, n in zip(rng.integers(0, 60, 25), rng.integers(0, 30, 25), rng.integers(1, 9, 25))]
        assert license_scan.chained(runs)[0] == brute(runs)


def test_license_spans_by_brute_force(spark):
    """Labels, score and spans against all maximal runs of each template, on texts cut and mixed from the templates."""

    def chain(runs):
        best = []
        for d, t, n in runs:
            value = (n, d)
            for (dj, tj, nj), (had, begin) in zip(runs, best):
                gain = n - max(0, tj + nj - t)
                if dj + nj <= d and tj < t and gain > 0 and had + gain > value[0]:
                    value = (had + gain, begin)
            best.append(value)
        return max(v[0] for v in best) if best else 0

    def want(text, templates, least, share):
        w, out = ALNUM.findall(lower(text)), {}
        for name, other in templates.items():
            q = ALNUM.findall(lower(other))
            runs = []
            for d in range(len(w)):
                for t in range(len(q)):
                    if w[d] == q[t] and not (d and t and w[d - 1] == q[t - 1]):
                        n = 0
                        while d + n < len(w) and t + n < len(q) and w[d + n] == q[t + n]:
                            n += 1
                        if n >= least:
                            runs.append((d, t, n))
            out[name] = chain(sorted(runs)) / len(q)
        return {k for k, v in out.items() if v >= share}, max(out.values())

    templates = dict(license_scan.TEMPLATES, twice="one two three four five one two three four six one two three four seven", part="to any person obtaining a copy of this work and so on")
    rng, rows, words = np.random.default_rng(3), [], [ALNUM.findall(lower(t)) for t in templates.values()]
    for i in range(60):
        text = []
        for _ in range(rng.integers(1, 6)):
            q = words[rng.integers(0, len(words))]
            a, b = sorted(rng.integers(0, len(q) + 1, 2))
            text += [*q[a:b], *["noise"] * int(rng.integers(0, 3))]
        rows.append((i, " ".join(text)))
    rows.append((100, "x one two three four seven"))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}, templates).collect()}
    for i, t in rows:
        labels, score = want(t, templates, 4, 0.5)
        assert set(filter(None, got[i].labels.split(","))) == labels and abs(got[i].score - score) < 1e-9, (i, t)
        assert {x.label for x in got[i].spans} == labels and all(0 <= x.first < x.end <= got[i].n_words for x in got[i].spans)


def test_tokens(spark, odd, none, docs, texts):
    from tokenizers import Tokenizer

    path = contracts.vocabulary("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    assert plain.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    for df, rows in ((docs, list(texts.items())), (odd, [(i, t) for i, t, _ in ODD])):
        got = tokens.read_tokens(*tokens.write_tokens(df, path)).collect()
        size = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [2]
        crc = lambda t: zlib.crc32(np.array(size(t), "<u4").tobytes())
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(size(t)), crc(t)) for i, t in rows)
        got.sort(key=lambda r: r.start)
        assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert tokens.read_tokens(*tokens.write_tokens(none, path)).count() == 0


def test_encoder_against_the_library(monkeypatch):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path, draw = contracts.vocabulary("byte_bpe_50k.json"), random.Random(1)
    marks = ["a", "B", "é", " ", " ", " ", "\n", "\t", "'s", "1", "<|endoftext|>", "\u00a0", "\u3000", "日", "😀", "_", "-", "\x1c", "\x85", "word"]
    texts = ["".join(draw.choices(marks, k=draw.randint(0, 14))) for _ in range(4000)]
    monkeypatch.setattr(tokens, "MEMORY", 50)
    for special in (True, False):
        plain, enc = Tokenizer.from_file(path), tokens.Encoder(path, special)
        plain.encode_special_tokens = not special
        for k in range(0, len(texts), 500):
            ids, sizes = enc.encode(pa.array(texts[k : k + 500], pa.large_string()), 2)
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts[k : k + 500]]


def test_damaged_record():
    data = bytearray(tokens.framed(7, np.array([1, 2, 3], np.uint16)))
    assert tokens.unframed(bytes(data), 0)[1].tolist() == [1, 2, 3]
    data[15] ^= 1
    with pytest.raises(ValueError):
        tokens.unframed(bytes(data), 0)


def test_decontamination(spark, none, docs, texts):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    items = {r.item_id: ALNUM.findall(r.text.lower()) for r in bench.collect()}
    for i, t in texts.items():
        w = " ".join(ALNUM.findall(t.lower()))
        for k, q in items.items():
            assert ((i, k) in got) or f" {' '.join(q)} " not in f" {w} "
    item = [f"t{k}" for k in range(20)]
    changed = [x if k % 5 != 4 else "other" for k, x in enumerate(item)]
    rows = [(1, "pre fix " + " ".join(changed) + " post"), (2, " ".join(item[:6])), (3, None), (None, " ".join(item)), (4, "a b c"), (4, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9))
    b = spark.createDataFrame([(1, " ".join(item)), (2, "A b, c"), (3, ""), (None, "x y")], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(df, b).collect()}
    assert set(out) == {(1, 1), (4, 2)} and out[1, 1].n_matched == 16 and out[1, 1].first_word == 2
    assert decontamination.contaminated(none, b).count() == 0 and decontamination.contaminated(df, b.where("false")).count() == 0


def overlaps(texts, items, overlap, masks, band):
    """(doc, item) -> (matched, diagonal), by looking at every diagonal of every text and item."""
    out = {}
    for i, t in texts:
        w = ALNUM.findall((t or "").lower())
        for k, q in items.items():
            hits = []
            for d in range(-len(q) + 1, len(w)):
                same = [0 <= d + j < len(w) and w[d + j] == x for j, x in enumerate(q)]
                short = decontamination.places(len(q), overlap) if len(q) < decontamination.SHORT else []
                if any(all(same[j + c] for c in range(len(m)) if m[c] == "1") for m in masks for j in range(len(q) - len(m) + 1)) or any(all(same[p] for p in at) for at in short):
                    hits.append((d, same))
            for d, _ in hits:
                n = sum(any(s[j] for e, s in hits if d <= e <= d + band) for j in range(len(q)))
                if n >= overlap * len(q):
                    out[i, k] = max(out.get((i, k), (0, 0)), (n, -d))
    return {k: (n, -d) for k, (n, d) in out.items()}


def test_decontamination_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(60)]
    items = {k: [str(x) for x in rng.choice(words, int(n))] for k, n in enumerate(rng.integers(1, 40, 25))}
    rows = [(0, None), (1, ""), (2, "w1")]
    for i in range(3, 70):
        text = []
        for _ in range(rng.integers(1, 4)):
            text += [str(x) for x in rng.choice(words, rng.integers(0, 30))]
            q = list(items[int(rng.integers(0, len(items)))])
            for j in range(len(q)):
                if rng.random() < 0.3:
                    q[j] = "changed"
            if rng.random() < 0.4 and q:
                q.insert(int(rng.integers(0, len(q))), "more")
            text += q[int(rng.integers(0, 4)) :]
        rows.append((i, " ".join(text)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(q)) for k, q in items.items()], "item_id long, text string")
    want = overlaps(rows, items, 0.6, decontamination.MASKS, decontamination.BAND)
    for most in (1_000_000, 1):
        monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", most)
        got = {(r.doc_id, r.item_id): (r.n_matched, r.first_word) for r in decontamination.contaminated(df, bench).collect()}
        assert got == want


def test_texts_without_hits_are_not_shuffled(spark, monkeypatch):
    item = " ".join(f"i{k}" for k in range(14))
    rows = [(k, " ".join(f"t{k}x{j}" for j in range(60))) for k in range(500)] + [(1000 + k, f"a{k} {item} b{k}") for k in range(5)] + [(1000, f"c {item}")]
    df, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    passed, may_hold = [], decontamination.may_hold
    monkeypatch.setattr(decontamination, "may_hold", lambda *a: passed.append(may_hold(*a)) or passed[-1])
    monkeypatch.setattr(decontamination, "BROADCAST_BLOCKS", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = decontamination.contaminated(df, items)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.doc_id, r.item_id, r.n_matched) for r in out.collect()) == [(1000 + k, 7, 14) for k in range(5)]
        assert "LeftSemi" not in plan  # it would be pushed below the filter, and all texts shuffled
        assert 6 <= passed[-1].count() <= 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decontamination_recall(spark):
    """Items of 15 to 30 words of which 60 % stay at random places; scattered scraps are no overlap."""
    rng, rows, items = np.random.default_rng(4), [], []
    for i in range(400):
        n = (15, 18, 20, 30)[i % 4]
        q = [f"i{i}x{j}" for j in range(n)]
        items.append((i, " ".join(q)))
        for j in rng.choice(n, int(n * 0.4), replace=False):
            q[j] = f"o{j}"
        rows.append((i, " ".join(["a"] * 50 + q + ["b"] * 50)))
    q = [f"s{j}" for j in range(30)]
    items.append((900, " ".join(q)))
    rows.append((900, " ".join([*q[20:28], *["a"] * 200, *q[10:18], *["b"] * 200, *q[:8]])))
    out = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id == r.item_id and r.first_word == 50 for r in out)
    found = Counter((15, 18, 20, 30)[r.doc_id % 4] for r in out if r.doc_id < 900)
    assert found[15] > 90 and found[18] > 95 and found[20] > 95 and found[30] == 100 and 900 not in {r.doc_id for r in out}


def components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard(spark, odd, none, n, percent):
    rng = np.random.default_rng(n)
    rows = []
    for base in range(6):
        words = [f"b{base}v{v}" for v in rng.integers(0, 500, 10 + 60 * base)]
        for _ in range(8):
            w = list(words)
            for k in rng.integers(0, len(w), rng.integers(0, 1 + len(w) // 25)):
                w[k] = f"r{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, n, percent).collect()}
    assert got == components(rows, n, percent)
    if n == 3:
        want = components([(i, t) for i, t, _ in ODD if i is not None], n, percent)
        out = jaccard_join.jaccard_components(odd, n, percent).collect()
        assert len(out) == len(ODD) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in out if r.doc_id is not None)
        assert jaccard_join.jaccard_components(none, n, percent).count() == 0


def test_quality_rules(odd, none, docs, texts):
    def want(t):
        t = t or ""
        w = WORD.findall(t)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)

    for df, rows in ((docs, list(texts.items())), (odd, [(i, t) for i, t, _ in ODD])):
        out = quality_rules.judged(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == Counter((i, *want(t)) for i, t in rows)
        assert not any(r.kept and r.base_failed for r in out)
    assert quality_rules.judged(none).count() == 0


def test_sharding(spark, odd, none, docs, texts):
    limit = 60_000
    out = sharding.sharded(docs, limit).collect()
    assert len(out) == len(texts)
    sums = Counter()
    for r in out:
        sums[r.shard] += len(texts[r.doc_id].encode())
        assert r.overflow == (r.shard_bytes > limit)
    assert all(r.shard_bytes == sums[r.shard] for r in out) and all(v <= limit for s, v in sums.items() if len(s) < 128)
    assert not any(a != b and b.startswith(a) for a in sums for b in sums)
    parents = Counter()
    for r in out:
        if r.shard:
            parents[r.shard[:-1]] += 0
    for p in parents:  # only oversized buckets split
        assert sum(v for s, v in sums.items() if s.startswith(p)) > limit
    assert sharding.sharded(none, limit).count() == 0
    rows = sharding.sharded(odd, 10).collect()
    assert len(rows) == len(ODD) and {r.overflow for r in rows if r.bytes > 10} == {True}


def _auc(s, y):
    r = np.argsort(np.argsort(s, kind="stable")) + 1
    p = y.sum()
    return (r[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_classifiers_on_held_out(spark, odd, none):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas().set_index("doc_id")
    for name, label, least in (("op7_quality_classifier", "quality", 0.9), ("op8_toxicity", "toxic", 0.9)):
        out = contracts.QUERIES[name](spark, data).toPandas().set_index("doc_id")
        both = out[out.held_out].join(labels, how="inner")
        assert out.score.between(0, 1).all() and ((out.score >= 0.5) == out.predicted).all()
        assert _auc(both.score.to_numpy(), both[label].to_numpy()) > least, name
    few = spark.createDataFrame([(7, 1, 0), (8, 0, 1), (8, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for some in (few, few.where("false")):
        model = quality_classifier.fitted(odd, some, F.lit(True))
        assert quality_classifier.scored(odd, *model).where("score between 0 and 1").count() == len(ODD)
        assert toxicity.scored(odd, toxicity.fitted(odd, some, F.lit(True))).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.scored(none, toxicity.fitted(none, few, F.lit(True))).count() == 0


def test_misspelling():
    import pyarrow as pa

    bad, good = ["you worthless thing", "worthless", "so worthless it is"], ["a warm day", "this thing", "you are so it is"]
    m = toxicity.Model(bad * 5 + good * 5, np.repeat([1.0, 0.0], 15))
    s = m.scores(pa.array(["worthles", "wworthless", "warm thing", ""], pa.large_string()))
    assert s[0] > 0.5 and s[1] > 0.5 and s[2] < 0.5


def test_combinations_of_ordinary_words():
    import pyarrow as pa

    bad = ["please drop dead", "drop dead now", "you should drop dead today", "oh drop dead will you"]
    good = ["drop it here", "the sea is dead", "a dead tree in the sea", "drop the bag now", "please come today", "you should drop by", "a dead end here", "oh will you", "dead", "drop"]
    m = toxicity.Model(bad * 5 + good * 5, np.repeat([1.0, 0.0], [20, 50]))
    s = m.scores(pa.array(["they said drop dead to him", "drop it, the sea is dead", "dead", "drop", "the sea is here"], pa.large_string()))
    assert s[0] > 0.5 and (s[1:] < 0.5).all()


def test_windows_by_brute_force():
    rng = np.random.default_rng(2)
    counts = np.array([1, 5, 2, 9])
    word, begin = rng.normal(size=counts.sum()), np.cumsum(counts) - counts
    for size in (1, 2, 4, 16, 0):
        w = toxicity.Windows(counts, size)
        want = [(d, word[b + k : b + k + (min(size, n) or n)].sum() / (size or n)) for d, (b, n) in enumerate(zip(begin, counts)) for k in range(max(n - size + 1, 1) if size else 1)]
        got = w.means(toxicity._cumulated(word))
        assert list(w.doc) == [d for d, _ in want] and np.allclose(got, [v for _, v in want])
        # the gradient of a sum of means
        g = rng.normal(size=len(got))
        bumped = [(w.means(toxicity._cumulated(word + 1e-6 * (np.arange(len(word)) == k))) - got) @ g / 1e-6 for k in range(len(word))]
        assert np.allclose(w.spread(g, len(word)), bumped, atol=1e-4)


def test_a_long_text_leaves_the_toxicity_sample_whole(spark, monkeypatch):
    rows = [(k, f"a {('warm', 'worthless')[k % 2]} day {k}", k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    first = df.orderBy(F.xxhash64("doc_id")).first().doc_id
    long = df.withColumn("text", F.when(F.col("doc_id") == first, F.concat("text", F.expr("repeat(' plain words', 1000000)"))).otherwise(F.col("text")))
    wide = df.withColumn("text", F.when(F.col("doc_id") == first, F.concat("text", F.expr("repeat(' w', 3000)"))).otherwise(F.col("text")))
    for some, most in ((long, 32_000_000), (wide, 5_000)):
        monkeypatch.setattr(toxicity, "SAMPLE_BYTES", most)
        out = toxicity.scored(df, toxicity.fitted(some, df, F.lit(True))).collect()
        assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in out)


def test_repeated_ids_do_not_swell_the_sample(spark):
    df = spark.createDataFrame([(k % 3, f"text {k % 5}") for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, y int")
    assert quality_classifier.one_text_each(df, labels).count() == 3


def test_sentencepiece(spark, odd, none, docs, texts):
    path = contracts.vocabulary("piece_bpe_32k.model")
    for df, rows in ((docs, list(texts.items())), (odd, [(i, t) for i, t, _ in ODD])):
        enc = sentencepiece_sampling.encoded(df, path)
        out = enc.collect()
        assert all(r.lossless and r.n_tokens == len(r.ids) for r in out)
        assert Counter((r.doc_id, r.text) for r in sentencepiece_sampling.decoded(enc, path).collect()) == Counter((i, t or "") for i, t in rows)
        again = sentencepiece_sampling.encoded(df.repartition(3), path).collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in again) == Counter((r.doc_id, tuple(r.ids)) for r in out)
    other = {r.doc_id: r.ids for r in sentencepiece_sampling.encoded(docs, path, seed=2).collect()}
    assert any(other[r.doc_id] != r.ids for r in sentencepiece_sampling.encoded(docs, path).collect())
    assert sentencepiece_sampling.encoded(none, path).count() == 0


def test_sampling_has_the_lattice_distribution():
    """Against all paths through the lattice of the whole text, runs of spaces included."""
    import pyarrow as pa

    lat, n = sentencepiece_sampling.lattices(contracts.vocabulary("piece_bpe_32k.model"), 1.0), 20000
    assert sum(set(x) == {"\u2581"} and len(x) > 1 for x in lat.pieces) > 10

    def paths(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in lat.pieces:
                i, w = lat.pieces[s[:k]]
                for rest, v in paths(s[k:]):
                    yield (i, *rest), w * v

    for word in ("then", " a   b", "     ", "in  x "):
        want = dict(paths(word.replace(" ", "\u2581")))
        total = sum(want.values())
        ids, sizes = lat.sample(pa.array([word] * n, pa.large_string()), np.arange(n).astype(np.uint64), 5)
        got = Counter(tuple(x) for x in np.split(ids, np.cumsum(sizes)[:-1]))
        assert set(got) <= set(want)
        for p, w in want.items():
            assert abs(got[tuple(p)] / n - w / total) < 0.02, word


def test_long_units_are_drawn_from_their_whole_lattice():
    """How often a piece ends at each place, against sums over all paths from both ends."""
    import math

    import pyarrow as pa

    lat, n = sentencepiece_sampling.lattices(contracts.vocabulary("piece_bpe_32k.model"), 1.0), 4000
    for word in ("internationalization" * 12, "x" * 2000 + "\u4e2d\u6587" * 40):
        w = lambda t: lat.pieces[t][1] if t in lat.pieces else lat.rare if len(t) == 1 else 0.0

        def sums(step):
            out, scale = [1.0], [0]  # times 2 ** scale
            for k in range(1, len(word) + 1):
                total = 0.0
                for m in range(1, min(16, k) + 1):
                    t = word[k - m : k] if step > 0 else word[len(word) - k : len(word) - k + m]
                    total += math.ldexp(w(t) * out[k - m], scale[k - m] - scale[k - 1])
                x, e = math.frexp(total)
                out.append(x)
                scale.append(e + scale[k - 1])
            return out, scale

        (f, fs), (b, bs) = sums(1), sums(-1)
        size = len(word)
        want = np.array([math.ldexp(f[k] * b[size - k] / f[size], fs[k] + bs[size - k] - fs[size]) for k in range(1, size)])
        ids, sizes = lat.sample(pa.array([word] * n, pa.large_string()), np.arange(n).astype(np.uint64), 5)
        length = np.array([len(x.replace("\u2581", " ")) for x in lat.names])
        length[list(lat.bytes.values())] = -1
        got, at = np.zeros(size + 1), 0
        for s in sizes:
            row = ids[at : at + s]
            at += s
            if (length[row] < 0).any():
                ends = np.cumsum([len(x) for x in _spelled(lat, row)])
            else:
                ends = np.cumsum(length[row])
            got[ends] += 1
        assert np.abs(got[1:size] / n - want).max() < 0.05


def _spelled(lat, row):
    """The strings of a row of ids; the bytes of one character are one string."""
    out, left = [], b""
    back = {i: bytes([k]) for k, i in lat.bytes.items()}
    for i in row.tolist():
        if i in back:
            left += back[i]
            try:
                out.append(left.decode())
                left = b""
            except UnicodeDecodeError:
                pass
        else:
            out.append(lat.names[i])
    return out


def test_urls(spark):
    rows = [(1, "http://a.example.com/en/75?x"), (2, "https://EXAMPLE.net/de/8#y"), (3, "https://x.org/es"), (4, None), (5, "no scheme"), (6, "http://spam-farm.example.org/fr/12.html"), (6, "http://www.spam-farm.example.org/fr/12/"), (None, "ftp://net/de/"), (7, ""), (8, "http://badexample.com/en/7"), (9, "http://org/es/?q://z")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("key", F.lit("k"))
    rules = url_filter.listed(spark, contracts.URL_RULES, contracts.spam_urls(spark))
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filtered(df, rules).collect())
    assert got == Counter([(1, "a.example.com", "/en/75", "example.com/en/7", "allow"), (2, "example.net", "/de/8", "example.net/de/8", "block"), (3, "x.org", "/es", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "spam-farm.example.org", "/fr/12.html", None, "block"), (6, "www.spam-farm.example.org", "/fr/12/", None, "block"), (None, "net", "/de/", "net/de/", "block"), (7, "", "", None, "allow"), (8, "badexample.com", "/en/7", "com/en/", "block"), (9, "org", "/es/", "org/es/", "block")])
    assert url_filter.filtered(df.where("false"), rules).count() == 0
    assert url_filter.filtered(df, rules.where("false")).where("verdict = 'allow'").count() == len(rows)


def test_query_gives_the_verdicts_of_its_contract(spark, tmp_path):
    rows = [(1, "http://a.net/de/1"), (2, "https://net/de/"), (3, "http://x.example.net/de/7"), (4, "http://x.example.net/de/81"), (5, "http://example.com/en/6"), (6, "http://b.example.com/en/7"), (7, "http://a.org/es/"), (8, "http://spam-farm.example.net/de/1"), (9, "http://anet/de/")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in contracts.op10_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("com/en/", "block"), 6: ("example.com/en/7", "allow"), 7: ("org/es/", "block"), 8: ("net/de/", "allow"), 9: (None, "allow")}


def test_listed_hosts_have_no_id_range(spark):
    rows = [(k, f"https://{h}.example.com/{lang}/{k}.html") for k in (0, 999, 1000, 9992, 123456789) for h in ("spam-farm", "www.cheap-pills") for lang in ("en", "fr")]
    rows += [(1, "http://m.spam-farm.example.net"), (2, "http://cheap-pills.example.org/?q")]
    free = [(3, "http://x.spam-farm.example.net/fr/1"), (4, "http://spam-farm.example.nets/fr/1"), (5, "http://a.test/spam-farm.example.net")]
    pages = spark.createDataFrame(rows + free, "page_id long, url string")
    out = url_filter.filtered(pages, url_filter.listed(spark, (), contracts.spam_urls(spark)))
    assert Counter((r.page_id, r.verdict) for r in out.collect()) == Counter([(i, "block") for i, _ in rows] + [(i, "allow") for i, _ in free])
    exact = url_filter.listed(spark, (), spark.createDataFrame([("a.test/x",)], "url string"))
    pages = spark.createDataFrame([(1, "http://a.test/x/"), (2, "http://a.test/y"), (3, "http://a.test")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.filtered(pages, exact).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_filter_passes_what_is_listed_and_little_else(spark, monkeypatch):
    urls = spark.range(3000).select(F.expr("concat('h', id % 50, '.test/p/', id)").alias("url"))
    rules = url_filter.listed(spark, (("test", "/p/1", "allow"),), urls)
    other = [(-k, f"http://h{k % 50}.test/q/{k}") for k in range(1, 2000)] + [(-5000, "http://h1.test/" + "x" * 100000), (-5000, "http://" + "a." * 300 + "test/p/1")]
    pages = urls.select(F.expr("cast(split(url, '/')[2] as long)").alias("page_id"), F.concat(F.lit("http://"), "url").alias("url")).union(spark.createDataFrame(other, "page_id long, url string"))

    def judge():
        return Counter((r.page_id, r.rule, r.verdict, r.listed) for r in url_filter.filtered(pages, rules).collect())

    want = Counter((k, "test/p/1" if str(k).startswith("1") else None, "allow" if str(k).startswith("1") else "block", True) for k in range(3000))
    want += Counter((k, None, "allow", False) for k, _ in other[:-1]) + Counter([(-5000, "test/p/1", "allow", False)])
    assert judge() == want
    plan = url_filter.filtered(pages, rules)._jdf.queryExecution().toString()
    assert len(plan) < 100_000
    for name in ("BROADCAST_KEYS", "BROADCAST_BLOCKS"):
        monkeypatch.setattr(url_filter, name, 1)
    assert judge() == want
    # false positives of the filter, of keys that are not listed
    words = url_filter.bloom(rules, 256)
    block, h = url_filter._bits("key", 256)
    asked = spark.range(20000).select(F.concat(F.lit("u\tnot"), "id").alias("key")).withColumn("block", F.expr(block)).join(words, "block")
    mask = " and ".join(f"(shiftrightunsigned(w{i}, cast(shiftrightunsigned({h}, {6 * i}) & 63 as int)) & 1) = 1" for i in range(url_filter.WORDS))
    assert asked.where(mask).count() < 200
    missed = rules.withColumn("block", F.expr(block)).join(words, "block").where(f"not ({mask})").count()
    assert missed == 0


def test_pipeline_classifier_rejects(spark):
    import corpus_pipeline as p

    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    good, bad = ([k for k, y in labels.items() if y == want and zlib.crc32(str(k).encode()) % 3 == 1] for want in (1, 0))
    ones = docs.where(F.col("doc_id").isin([k for k, y in labels.items() if y == 1]) | F.col("doc_id").isin(bad))
    left = {r.doc_id for r in p.classifier(spark, ones, data).select("doc_id").collect()}
    assert len(set(bad) & left) < len(bad) / 2 and len(set(good) & left) > 0.9 * len(good)


def test_pipeline(spark):
    import corpus_pipeline as p

    out = p.run(spark, DATA)
    ids = [r.doc_id for r in out.collect()]
    kept = {r.doc_id for r in quality_rules.judged(spark.read.parquet(f"{DATA}/documents.parquet")).where("kept").collect()}
    leaks = {r.doc_id for r in contracts.op3_decontamination(spark, DATA).collect()}
    assert ids and len(ids) == len(set(ids)) and set(ids) <= kept and not set(ids) & leaks
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.doc_id in set(ids)]
    assert all(root == i for i, (_, root) in components(rows, 5, 80).items())
