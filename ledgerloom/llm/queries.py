"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, langid, line_dedup, main_text, ngram_join, periodic_runs, perplexity, quality, secret_scan, source_audit, token_store, url_filter
from .common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM m JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.train_from_documents(docs)))


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.filter_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "lower", "upper"
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d),
bs AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                       WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


#: Fixed by the query's contract.
URL_RULES = [
    url_filter.Rule("block", "com/en/"),
    url_filter.Rule("allow", "example.com/en/7"),
    url_filter.Rule("allow", "net/de/"),
    url_filter.Rule("block", "example.net/de/8"),
    url_filter.Rule("block", "org/es/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch() as run:
        kept = line_dedup.LineIndex.build(docs).drop_lines(docs, kept="kept", counts=("n_lines", "n_dropped"))
        digests = kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
        return run.result(digests, "line-dedup")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch() as run:
        return run.result(token_store.TokenFiles.write(table(spark, sf_dir, "documents")).digests(), "token-files")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = langid.predict(docs, langid.train(docs, langid.learnable()))
    return predicted.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.report(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (t.n + 2 * v.v) AS BIGINT) AS p,
             CAST(1 + 1000000000 * (k.n + 2)::HUGEINT // (v.n + 2 * v.v) AS BIGINT) AS q
      FROM t JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM term UNION ALL SELECT * FROM pair))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.scan(periodic_runs.looped(table(spark, sf_dir, "documents"))))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    with Scratch() as run:
        texts = main_text.extract(pages.select("page_id", "url", "html"), main_text.learn(pages))
        return run.result(texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))


OP7_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM parts),
keyed AS (
  SELECT doc_id, line, i,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (SELECT k FROM (SELECT DISTINCT doc_id, k FROM keyed) WHERE k <> '' GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o ON keyed.k = o.k GROUP BY doc_id
"""


def queries() -> dict[str, Query]:
    found = (
        op1_ngram_join,
        op2_secret_scan,
        op3_perplexity,
        op4_decontaminate,
        op5_byte_bpe,
        op6_url_filter,
        op7_line_dedup,
        op8_token_files,
        op9_language_id,
        op10_quality,
        op11_source_audit,
        op12_periodic_runs,
        op13_html_text,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op4_decontaminate": OP4_SQL, "op7_line_dedup": OP7_SQL, "op11_source_audit": OP11_SQL}
