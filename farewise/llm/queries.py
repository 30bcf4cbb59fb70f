"""One registered query per operator, over whole tables, and the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from farewise.llm import (
    byte_bpe, divergence, exact_dedup, fill_middle, host_rules, id_planes, near_dedup, packing, pii, quality_net, section_counts, sentencepiece_viterbi, url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The rules of the URL filter query.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_id_planes")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return id_planes.store_and_read(table(spark, folder, "documents"), vocabulary, end_id=2, kind="byte")


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query(
    "op4_url_filter",
    f"""
    WITH rules(rh, rp, rv) AS (VALUES {_RULES}),
    urls AS (
        SELECT page_id, row_number() OVER () AS n,
            CASE WHEN url LIKE '%://%' THEN
                translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{url_rules.UPPER}', '{url_rules.SMALL}') ELSE '' END AS host,
            CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
        FROM pages),
    hits AS (
        SELECT n, rh || rp AS rule, rv,
            row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC) AS place
        FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
    FROM urls LEFT JOIN (SELECT * FROM hits WHERE place = 1) USING (n)
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, folder, "pages"), rules)


@query(
    "op5_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    index = exact_dedup.fresh_index(docs)
    verdicts = exact_dedup.deduplicate_in_batches(docs, index)
    index.drop()  # this query judges one table by itself; a lasting index is for batches to come
    return verdicts


@query("op8_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, folder, "documents"), vocabulary, end_id=1)


@query("op1_sentencepiece")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_viterbi.encode_documents(table(spark, folder, "documents"), path)


@query("op3_pii")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(table(spark, folder, "documents"))


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return section_counts.count_tokens(table(spark, folder, "documents"), vocabulary)


@query("op7_quality_net")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality_net.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(
    "op9_host_rules",
    f"""
    WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
    win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS pos, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS s FROM w WHERE len(ws) >= 8),
    twice AS (SELECT doc_id, pos FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    hit AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id),
    ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    m AS (
        SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN hit USING (doc_id)),
    f AS (SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEATED} * n_words AS base_failed FROM m),
    h AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed)::DOUBLE AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
    t AS (SELECT sum(bad) / sum(n) AS mean, sum(n) AS d, count(*) AS k, sum(bad * bad / n) AS s2, sum(n * n) AS n2 FROM h),
    p AS (SELECT mean, mean * (1 - mean) AS noise, s2 - d * mean * mean - (k - 1) * mean * (1 - mean) AS between_, d - n2 / d AS unit FROM t),
    wt AS (SELECT mean, CASE WHEN between_ > 0 AND unit > 0
            THEN least({host_rules.PRIOR_WEIGHT[1]}, greatest({host_rules.PRIOR_WEIGHT[0]}, noise * unit / between_ - 1)) ELSE {host_rules.PRIOR_WEIGHT[1]} END AS weight FROM p),
    v AS (SELECT source, (bad + mean * weight) / (n + weight) > {host_rules.HOST_LIMIT} AS host_failed FROM h, wt)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT coalesce(host_failed, false) AS kept, coalesce(host_failed, false) AS host_failed
    FROM f LEFT JOIN v USING (source)
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    judged = host_rules.judge_documents(table(spark, folder, "documents"))
    return judged.select("doc_id", *host_rules.MEASURES, "base_failed", "kept", "host_failed")


@query(
    "op10_near_dedup",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.SMALL}')")} AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 85 * (na.n + nb.n - common)),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON r = a),
    g AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM g LEFT JOIN n USING (doc_id)
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.link_documents(table(spark, folder, "documents"), percent=85).drop("text_key")


@query("op11_byte_bpe")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, folder, "documents"), ranks)


_SHARE = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * terms)"


@query(
    "op12_divergence",
    rf"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.SMALL}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
        FROM documents),
    t AS (SELECT row, lang, source, unnest(ts) AS term FROM (SELECT *, row_number() OVER () AS row FROM d)),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
    langs AS (SELECT d.lang, count(kept.term) AS terms, coalesce(sum(kept.n), 0) AS total
        FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN kept USING (lang) GROUP BY d.lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
    g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
    p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="coalesce(c.n, 0)", total="g.total")} AS p,
            {_SHARE.format(n="kept.n", total="langs.total")} AS q
        FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    rows AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows
    QUALIFY part = 'pair' OR rank <= 10
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


@query(
    "op13_fill_middle",
    r"""
    WITH u AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
        FROM documents),
    h AS (
        SELECT doc_id, t, units, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
            ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
        FROM u),
    c AS (
        SELECT doc_id, t, n,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
            array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
            array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
            array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
        FROM h)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM c
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, folder, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
