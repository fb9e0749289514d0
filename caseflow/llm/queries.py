"""Registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.llm import chat_render, orchard_codes, secret_links, sliced_weights, url_templates
from caseflow.llm.frames import fold, table

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def language_model(docs):
    """Learned from the rows outside the held-out fold."""
    from caseflow.llm import langid
    return langid.fit(docs, F.coalesce(fold("doc_id", 4) != 2, F.lit(False)))


@register("op1_language_id")
def op1(spark, sf_dir):
    from caseflow.llm import langid
    docs = table(spark, sf_dir, "documents")
    model = language_model(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return langid.identify(rows, model, ["doc_id", "held_out"],
                           "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


@register("op3_pair_quality")
def op3(spark, sf_dir):
    from caseflow.llm import pair_quality
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pair_quality.fit(docs, labels, fold("doc_id", 5) == 0)
    return pair_quality.rate(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@register("op5_robust_rules")
def op5(spark, sf_dir):
    from caseflow.llm import robust_rules
    return robust_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op7_qgram_filter")
def op7(spark, sf_dir):
    from caseflow.llm import qgram_filter
    return qgram_filter.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), stride=1)


_OP9 = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
p AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id <> b.doc_id
   AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, pairs.b FROM r JOIN pairs ON r.b = pairs.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM s JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, s.g"""


@register("op9_ngram_join", _OP9)
def op9(spark, sf_dir):
    from caseflow.llm import ngram_join
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op10_sp_tokens")
def op10(spark, sf_dir):
    from caseflow.llm import sp_tokens
    return sp_tokens.tokenize(table(spark, sf_dir, "documents"), sp_tokens.read_model())


@register("op6_pii_tagger")
def op6(spark, sf_dir):
    from caseflow.llm import pii_tagger
    docs = table(spark, sf_dir, "documents")
    return pii_tagger.find(docs, pii_tagger.fit(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


_OP2 = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND row_number() OVER w > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND row_number() OVER w > 1 THEN first(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY sha1(coalesce(html, '')) ORDER BY page_id DESC)"""


@register("op2_warc_writer", _OP2)
def op2(spark, sf_dir):
    from caseflow.llm import warc_writer
    from caseflow.session import scratch_folder
    folder = scratch_folder(spark, "warc")
    warc_writer.write(table(spark, sf_dir, "pages"), folder)
    return warc_writer.read(spark, folder)


@register("op4_secret_links", secret_links.oracle())
def op4(spark, sf_dir):
    return secret_links.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@register("op8_url_templates", url_templates.oracle())
def op8(spark, sf_dir):
    return url_templates.judge(table(spark, sf_dir, "pages"))


@register("op11_sliced_weights", sliced_weights.oracle())
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sliced_weights.rank(sliced_weights.weigh(docs, sliced_weights.gains(docs, table(spark, sf_dir, "benchmark"))))


@register("op12_orchard_codes", orchard_codes.oracle())
def op12(spark, sf_dir):
    codes, books = orchard_codes.compress(table(spark, sf_dir, "embeddings"))
    return (orchard_codes.with_label_error(codes).drop("label")
            .withColumn("codebooks_sha256", F.lit(books.sha256())))


@register("op13_chat_render", chat_render.oracle())
def op13(spark, sf_dir):
    return chat_render.read_back(chat_render.render(chat_render.with_hostile(table(spark, sf_dir, "conversations"))))
