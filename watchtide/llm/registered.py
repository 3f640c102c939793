"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from watchtide.llm import (bpe, collocations, common, decontaminate, exact_dedup, html_text, langid, mixture, ngram_join, substring_dedup,
                           token_planes, toxicity, vector_codes, warc)
from watchtide.session import tune

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages, html_text.train(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256,
       CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op5_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
           1 + ((CAST('0x' || substr(hex, CAST(1 + (i // 8) * 10 AS INT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS INT), 1)
           for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    captures = warc.captures(spark, path)
    return captures.select("page_id", "main.payload_bytes", "main.payload_digest", "main.record_type", "refers_to")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out().alias("held_out"), "score", "predicted")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")


@query("op8_token_planes")
def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-planes")
    token_planes.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_planes.read(spark, path, F.crc32("ids").alias("ids_crc32"))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


_NEAREST = """{a} AS (SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT v.id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN {b} b ON b.part = v.part AND b.place = v.place
  GROUP BY v.id, v.part, b.entry) GROUP BY id, part)"""
_REFINED = """{c} AS (SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM {b} b LEFT JOIN (
  SELECT v.part, a.entry, v.place, CAST(floor(CAST(sum(v.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM v JOIN {a} a ON a.id = v.id AND a.part = v.part
  GROUP BY v.part, a.entry, v.place) m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place)"""


@query("op11_vector_codes", f"""
WITH kept AS (SELECT vec_id, label, embedding, len(embedding) // 16 AS width, row_number() OVER (ORDER BY vec_id) AS id FROM embeddings
              WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
 long AS (SELECT id, width, unnest(range(len(embedding))) AS d, unnest(embedding) AS e FROM kept),
 v AS (SELECT id, d // width AS part, d % width AS place, CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) AS x FROM long),
 b0 AS (SELECT part, id - 1 AS entry, place, x FROM v WHERE id <= 64),
 {_NEAREST.format(a='a1', b='b0')}, {_REFINED.format(c='b1', b='b0', a='a1')},
 {_NEAREST.format(a='a2', b='b1')}, {_REFINED.format(c='b2', b='b1', a='a2')},
 {_NEAREST.format(a='a3', b='b2')},
 coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY id)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b2) AS codebooks_sha256
FROM coded JOIN kept USING (id)""")
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


@query("op12_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 numbered AS (SELECT row_number() OVER () AS p, lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS w FROM pieces),
 words AS (SELECT p, lang, unnest(range(len(w))) AS i, unnest(w) AS w FROM numbered),
 places AS (SELECT lang, w AS w1, lead(w, 1) OVER piece AS w2, lead(w, 2) OVER piece AS w3 FROM words WINDOW piece AS (PARTITION BY p ORDER BY i)),
 f AS (SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM places GROUP BY ALL
       UNION ALL SELECT lang, 2, concat(w1, ' ', w2), count(*) FROM places WHERE w2 IS NOT NULL GROUP BY ALL
       UNION ALL SELECT lang, 3, concat(w1, ' ', w2, ' ', w3), count(*) FROM places WHERE w3 IS NOT NULL GROUP BY ALL),
 n AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
 c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 10),
 cuts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
          FROM c CROSS JOIN (VALUES (1), (2)) AS ks(k) WHERE k < m),
 scored AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r,
                   CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
            FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail),
 best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
 longer AS (SELECT lang, phrase, max(a) AS a FROM (
   SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE m = 3
   UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE m = 3) GROUP BY 1, 2),
 ranked AS (SELECT best.lang, best.phrase, best.a, l, r, score,
                   row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) AS rank
            FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
            WHERE nth = 1 AND (longer.a IS NULL OR 100 * longer.a < 50 * best.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@query("op13_mixture")
def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))
