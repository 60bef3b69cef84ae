"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, conversation_trie, decontamination, jaccard_join, license_scan, packing, quality_classifier, quality_rules, sentencepiece_sampling, sharding, tokens, toxicity, url_filter
from .common import crc_mod, stored, table

#: The rules of op10's contract, as (host, path, verdict).
CONTRACT_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: The rules as the SQL of op10 has them, which is fixed: of net/de/ it says block, where the contract says allow.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Hosts below example.com, example.net and example.org whose pages op10 blocks, whatever their path.
SPAM_HOSTS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
SHARD_BYTES = 1 << 20


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark, sf_dir):
    """Licence phrases and templates in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_token_records(spark, sf_dir):
    """Token ids of all documents, written to record files and read back."""
    shards, folder = tokens.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return tokens.read_tokens(shards, folder)


def op3_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark, sf_dir):
    """Components of documents under 3-gram Jaccard of 0.9 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_quality_rules(spark, sf_dir):
    """Quality figures and verdicts of all documents."""
    out = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_sharding(spark, sf_dir):
    """Shards of all documents by extendible hashing."""
    return sharding.sharded(table(spark, sf_dir, "documents"), SHARD_BYTES)


def _predicted(scores, held):
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_classifier(spark, sf_dir):
    """Quality scores of all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fitted(docs, labels, crc_mod("doc_id", 3) != 1)
    return _predicted(quality_classifier.scored(docs, *model), crc_mod("doc_id", 3) == 1)


def op8_toxicity(spark, sf_dir):
    """Toxicity scores of all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fitted(docs, labels, crc_mod("doc_id", 5) != 0)
    return _predicted(toxicity.scored(docs, model), crc_mod("doc_id", 5) == 0)


def op9_sentencepiece(spark, sf_dir):
    """Sampled segmentations of all documents."""
    return sentencepiece_sampling.encoded(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def spam_urls(spark):
    """The list of canonical URLs that op10 blocks: each spam host under three domains, with all its pages."""
    return spark.createDataFrame([(f"{h}.example.{t}",) for h in SPAM_HOSTS for t in ("com", "net", "org")], "url string")


def op10_url_filter(spark, sf_dir):
    """Verdicts on all pages."""
    out = url_filter.filtered(table(spark, sf_dir, "pages"), url_filter.listed(spark, CONTRACT_RULES, spam_urls(spark)))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_trie(spark, sf_dir):
    """Nodes of the prefix trie of all rebuilt conversations."""
    convs = conversation_trie.rebuilt(table(spark, sf_dir, "conversations"), group=100, most=6)
    return conversation_trie.trie(stored(convs, "rebuilt"))


def op12_token_alignment(spark, sf_dir):
    """Figures on the alignment of two vocabularies' tokens in all documents."""
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    found = alignment.aligned(table(spark, sf_dir, "documents"), a, b)
    return alignment.scored(found, alignment.pair_counts(found, 32_000))


def op13_best_fit_packing(spark, sf_dir):
    """Places of all documents' pieces in sequences of 2048 tokens."""
    found = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), most=2048)
    return packing.packed(found, most=2048, ids=False)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_records, op3_decontamination, op4_ngram_jaccard_join, op5_quality_rules, op6_sharding, op7_quality_classifier, op8_toxicity, op9_sentencepiece, op10_url_filter, op11_conversation_trie, op12_token_alignment, op13_best_fit_packing)}


def _op5_sql() -> str:
    fails = {r.name: r.fails() for r in quality_rules.RULES}
    base = " OR ".join(f"({fails[n]})" for n in quality_rules.BASE)
    rest = " OR ".join(f"({f})" for n, f in fails.items() if n not in quality_rules.BASE)
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    word = r"[^\x20\x09-\x0D]"
    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM documents),
    tri AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM (SELECT doc_id, p, ws[p] AS a, ws[p + 1] AS b, ws[p + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w))),
    rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM tri WHERE k > 1) GROUP BY 1),
    f AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      len(ls) AS n_lines, len(list_intersect(list_distinct(ws), [{stops}])) AS n_stop_words, len(regexp_extract_all(t, '!')) AS n_exclamations, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '\\|')) AS n_bars FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({base}) AS base_failed, NOT ({base}) AND NOT (n_words > 0 AND ({rest})) AS kept FROM f"""


def _op10_sql() -> str:
    rules = ", ".join(str(r) for r in URL_RULES)
    return f"""WITH u AS (SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS k FROM pages),
    h AS (SELECT page_id, CASE WHEN k = 0 THEN '' ELSE translate(regexp_extract(substr(url, k + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host, CASE WHEN k = 0 THEN '' ELSE regexp_extract(substr(url, k + 3), '^[^/?#]*([^?#]*)', 1) END AS path FROM u),
    m AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM h LEFT JOIN (VALUES {rules}) r(rh, rp, v) ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2, 3)
    SELECT page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN regexp_matches(regexp_replace(host, '^(www|m|blog)[.]', ''), '^({'|'.join(SPAM_HOSTS)})[.]example[.](com|net|org)$') THEN 'block' ELSE 'allow' END AS verdict FROM m"""


def _op11_sql() -> str:
    """CRC-32 by its table of 256 values; ids of turns as in the query; each node added to all above it."""
    step = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"""WITH crc AS (SELECT list({step} ORDER BY i) AS t FROM range(256) r(i)),
    turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({{'i': md5(length(role) || ':' || role || text), 'n': length(text)}} ORDER BY turn NULLS FIRST, role, text) AS o FROM turns GROUP BY 1),
    h AS (SELECT conv_id, o, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, crc),
    full_ AS (SELECT h.conv_id, list_concat(coalesce(list_slice(r.o, 1, h), []), list_slice(h.o, h + 1, len(h.o))) AS s FROM h LEFT JOIN own r ON r.conv_id = h.conv_id - h.conv_id % 100),
    nodes AS (SELECT list_slice(s, 1, d) AS p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM full_) GROUP BY 1, 2),
    kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
    one AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids ON kids.p = nodes.p),
    sums AS (SELECT list_slice(p, 1, e) AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * CASE WHEN d = 0 THEN 0 ELSE p[d].n END) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM one) GROUP BY 1)
    SELECT one.conv_id, one.d AS depth, up.conv_id AS parent_conv_id, one.n AS n_convs, one.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(one.ends) AS ends_sha256
    FROM one JOIN sums ON sums.p = one.p LEFT JOIN nodes up ON one.d > 0 AND up.d = one.d - 1 AND up.p = list_slice(one.p, 1, one.d - 1)"""


#: Scores, drawn segmentations, files and spans have no SQL; their queries are tested against brute force.
ORACLES = {"op5_quality_rules": _op5_sql(), "op10_url_filter": _op10_sql(), "op11_conversation_trie": _op11_sql()}
