"""Packing, alignment and the conversation trie against brute force, and on odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import alignment, contracts, conversation_trie, packing

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(9000))
ODD = [
    (1, "", 0), (2, None, 0), (None, "a null key", 0), (3, LONG, 0), (4, LONG, 0), (5, "twice", 1), (5, "twice", 1), (6, " a<|startoftext|>b  C ", 1), (7, "A<|ENDOFTEXT|>b It's <|", 1),
    (8, "É\u0301 é \u0301x ΑΣ don't.'s a1b2 x_y ª Ⅷ x₂ ﬁ", 0), (9, "a b\u3000c\x1cd\x85e \n\n f \u2581 g\u2581", 0), (10, "  if a:\n        b =  c   \n" + "\u4e2d\u6587\U0001f600" * 300 + "    end   ", 0), (11, "x <s> y </s> <unk> <0x41> <|endoftext|>z", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n long").withColumn("piece", F.lit("x")).withColumn("rank", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def _naive(lengths, most):
    """Room left in each sequence, by best-fit decreasing piece after piece."""
    bins = []
    for size in sorted(lengths, reverse=True):
        fit = [(r, k) for k, r in enumerate(bins) if r >= size]
        if fit:
            bins[min(fit)[1]] -= size
        else:
            bins.append(most - size)
    return sorted(bins)


def test_best_fit_plan_is_that_of_single_pieces():
    rng = np.random.default_rng(3)
    for trial in range(120):
        most = int(rng.choice([1, 2, 7, 16, 50, 100]))
        lengths = rng.integers(1, most + 1, int(rng.integers(0, 200))) if trial % 2 else rng.choice([most, max(1, most // 2), max(1, most // 3), 1], 80)
        runs, made = packing.best_fit_decreasing(np.bincount(lengths, minlength=most + 1), most)
        bins, seen = defaultdict(list), Counter()
        for size, rank, first, per, offset, n in runs.tolist():
            assert seen[size] == rank
            seen[size] += per * n
            for k in range(per * n):
                bins[first + k // per].append((offset + k % per * size, size))
        assert seen == Counter(lengths.tolist())
        for held in bins.values():
            held.sort()
            assert [o for o, _ in held] == [0, *np.cumsum([s for _, s in held])[:-1]]
        left = sorted(most - sum(s for _, s in held) for held in bins.values())
        assert left == _naive(lengths.tolist(), most) and len(left) == made


def test_packing(spark, odd, docs):
    from tokenizers import Tokenizer

    path = contracts.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for df, most in ((odd, 50), (docs, 2048)):
        want, ids = Counter(), {}
        for r in df.collect():
            all_ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(all_ids), most):
                some = np.array(all_ids[k : k + most], "<u4")
                want[(r.doc_id, k // most, k, len(some), zlib.crc32(some.tobytes()))] += 1
                ids[(r.doc_id, k // most)] = some.tobytes()
        found = packing.pieces(df.repartition(3), path, most)
        got = packing.packed(found, most)
        rows = got.collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
            assert bytes(r.ids) == ids[(r.doc_id, r.piece)]
        for held in bins.values():
            held.sort()
            assert [o for o, _ in held] == [0, *np.cumsum([s for _, s in held])[:-1]] and sum(s for _, s in held) <= most
        assert sorted(most - sum(s for _, s in held) for held in bins.values()) == _naive([r.length for r in rows], most)
        made = packing.sequences(got).collect()
        assert len(made) == len(bins) and all(len(r.ids) == 4 * r.n_tokens == 4 * sum(p.length for p in r.pieces) for r in made)
        by = {(r.sequence_id, r.offset): bytes(r.ids) for r in rows}
        assert all(bytes(r.ids) == b"".join(by[(r.sequence_id, p.offset)] for p in r.pieces) for r in made)
    assert packing.packed(packing.pieces(odd.where("false"), path)).count() == 0


def test_parts_are_forgotten(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lodestar.llm import parts

    monkeypatch.setattr(parts, "MEMORY", 20)
    monkeypatch.setattr(packing, "_PARTS", {})
    path = contracts.vocabulary("word_bpe_49k.json")
    tok, rng = Tokenizer.from_file(path), np.random.default_rng(1)
    for _ in range(20):
        texts = [" ".join(f"w{k}," for k in rng.integers(0, 60, 9)) for _ in range(3)]
        ids, sizes = packing.ids_of(path, pa.array(texts, pa.large_string()))
        each = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for e in each for i in e] and sizes.tolist() == list(map(len, each))


def _tokens(a, b, text):
    """(ids of A, ids of B, byte ends of A, byte ends of B), or None where a text has no tokens."""
    if not text:
        return None
    stands, names = alignment.byte_characters(), {i: s for s, i in a.get_vocab().items()}
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelled = [bytes(stands[c] for c in names[i]) for i in ids[0]], [bytes([int(s[3:5], 16)]) if b.is_byte(i) else s.replace("\u2581", " ").encode() for i, s in ((i, b.id_to_piece(i)) for i in ids[1])]
    if any(b"".join(x) != (" " + text).encode() for x in spelled):
        return None
    return (*ids, *(np.cumsum(list(map(len, x))).tolist() for x in spelled))


def test_alignment(spark, odd, docs):
    import hashlib

    import sentencepiece
    from tokenizers import Tokenizer

    paths = contracts.vocabulary("byte_bpe_50k.json"), contracts.vocabulary("piece_bpe_32k.model")
    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    for df in (odd, docs.where("length(text) < 3000")):
        rows, links, shown = [], [], {}
        for r in df.select("doc_id", "text").collect():
            got = _tokens(a, b, r.text)
            if got is None:
                rows.append((r.doc_id, 0, 0, 0, [], ""))
                continue
            ia, ib, ea, eb = got
            cuts = sorted(set(ea) & set(eb))
            begin = lambda ends, k: ends[k - 1] if k else 0
            linked, j = [], 0
            for i in range(len(ia)):
                while eb[j] <= begin(ea, i):
                    j += 1
                k = j
                while k < len(ib) and begin(eb, k) < ea[i]:
                    linked.append((ia[i], ib[k]))
                    k += 1
            spans, at, i, j = [], 0, 0, 0
            for c in cuts:
                to = ea.index(c, i) + 1, eb.index(c, j) + 1
                spans.append((ia[i : to[0]], ib[j : to[1]], at, c))
                (i, j), at = to, c
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y, _, _ in spans)
            rows.append((r.doc_id, len(ia), len(ib), len(cuts), linked, hashlib.sha256(text.encode()).hexdigest()))
            links += linked
            shown[r.doc_id] = spans
        count, top = Counter(links), Counter()
        for (_, y), n in count.items():
            top[y] = max(top[y], n)
        want = Counter((i, na, nb, ng, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), sha) for i, na, nb, ng, x, sha in rows)
        found = alignment.aligned(df.repartition(3), *paths)
        pairs = alignment.pair_counts(found, 32_000)
        assert {(r.id_a, r.id_b): r.links for r in pairs.collect()} == dict(count)
        for most in (alignment.BROADCAST, 0):
            assert Counter(map(tuple, alignment.scored(found, pairs, most).collect())) == want
        spans = defaultdict(list)
        for r in alignment.groups(df, *paths).collect():
            spans[r.doc_id].append((r.group, r.ids_a, r.ids_b, r.first, r.last))
        for i, got in shown.items():
            assert [(k, *s) for k, s in enumerate(got)] == sorted(spans[i])[: len(got)] or i == 5
    none = alignment.aligned(odd.where("false"), *paths)
    assert alignment.scored(none, alignment.pair_counts(none, 32_000)).count() == 0


def _trie(rows, group=100, most=6):
    """The nodes of the trie of rebuilt conversations, by brute force."""
    import hashlib

    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        full[c] = tuple(own.get(c - int(np.fmod(c, group)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = set()
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _made(rng, n, letters, longest):
    """Conversations with turns of few texts, so that many prefixes are shared."""
    rows = []
    for c in rng.choice(900, n, replace=False).tolist():
        for t in range(int(rng.integers(1, longest + 1))):
            rows.append((c, t, ["user", "bot"][t % 2], "é" * int(rng.integers(0, letters))))
    return rows


def test_runs_of_the_trie_add_up(spark):
    """Few turns and many partitions: all nodes near the root are on borders."""
    rng, kind = np.random.default_rng(5), "conv_id long, turn long, role string, text string"
    for n, letters, longest, parts in ((1, 1, 1, 1), (40, 2, 4, 1), (150, 2, 6, 3), (300, 3, 5, 7), (250, 1, 12, 4)):
        rows = _made(rng, n, letters, longest)
        convs = conversation_trie.stored(conversation_trie.rebuilt(spark.createDataFrame(rows, kind)), "rebuilt")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [tuple(r) for r in conversation_trie.trie(convs).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert len(got) == len(set(got)) and set(got) == _trie(rows)


def test_trie_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)
    kind = "conv_id long, turn long, role string, text string, path string, root int"
    rows = [
        (7, 1, "user", "b"), (7, None, None, "a"), (7, 0, "user", None), (None, 0, "user", "no conversation"), (100, 0, "user", ""), (101, 0, "x", "y"), (203, 5, "user", "own"), (203, 5, "bot", "own"), (203, 5, "bot", "own"),
        (-5, 0, "user", "below"), (-100, 0, "user", "root below"), *((k, 0, "user", "same") for k in range(300, 340)), *((k, t, "user", f"long {t}") for k in (400, 401, 455) for t in range(300)),
    ]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], kind)
    got = [tuple(r) for r in conversation_trie.trie(conversation_trie.stored(conversation_trie.rebuilt(df), "rebuilt")).collect()]
    assert len(got) == len(set(got)) and set(got) == _trie(rows)
    assert conversation_trie.trie(conversation_trie.rebuilt(df.where("false"))).count() == 0


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in contracts.op11_conversation_trie(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == _trie(rows)
