"""Registered queries of the training-data operators and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chat import digests, expand_targets
from .collocations import collocations
from .common import fresh_path, materialise, table
from .decontaminate import contamination, contamination_digest
from .exact_dedup import exact_groups
from .jaccard import similar_groups
from .language import identify_languages
from .licences import licence_scan
from .periodic import periodic_runs, run_digests
from .quality import quality_scores
from .secrets import scan_secrets, secret_digest
from .sentencepieces import decode_documents, encode_documents
from .substrings import repeat_digests
from .tokenfile import read_documents, write_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query("""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query(r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
        length(role) + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''))) + 15
        + length(text) + (length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))) AS size FROM c),
e AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto, role = 'assistant' OR i = n AS ends FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE ends))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(materialise(expand_targets(turns)))


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


@query()
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


@query()
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1, vocabulary=49408)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the digest of the text that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    # Written in between, so that one Python worker a core encodes and then decodes.
    back = decode_documents(materialise(encode_documents(table(spark, sf_dir, "documents"), path)), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"), "ids")


@query()
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(u.piece, '[^ \t]+') AS ws
      FROM (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d) u),
w AS (SELECT lang, piece, unnest(ws) AS w1, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS m, ws FROM p),
g AS (SELECT lang, w1, CASE WHEN i < m THEN ws[i + 1] END AS w2, CASE WHEN i + 1 < m THEN ws[i + 2] END AS w3 FROM w),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
inside AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, w1 AS x, w2 AS y, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
c2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, l.f AS l, r.f AS r, (1000000::HUGEINT * f2.f * f2.f) // (l.f::HUGEINT * r.f) AS score
       FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.w1 = f2.w1 JOIN f1 r ON r.lang = f2.lang AND r.w1 = f2.w2
       LEFT JOIN inside i ON i.lang = f2.lang AND i.x = f2.w1 AND i.y = f2.w2 WHERE coalesce(100 * i.f < 50 * f2.f, true)),
c3 AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, a1.f AS l1, b23.f AS r1, b12.f AS l2, a3.f AS r2,
         (1000000::HUGEINT * t.f * t.f) // (a1.f::HUGEINT * b23.f) AS s1, (1000000::HUGEINT * t.f * t.f) // (b12.f::HUGEINT * a3.f) AS s2
       FROM f3 t JOIN f1 a1 ON a1.lang = t.lang AND a1.w1 = t.w1 JOIN f1 a3 ON a3.lang = t.lang AND a3.w1 = t.w3
       JOIN f2 b12 ON b12.lang = t.lang AND b12.w1 = t.w1 AND b12.w2 = t.w2 JOIN f2 b23 ON b23.lang = t.lang AND b23.w1 = t.w2 AND b23.w2 = t.w3),
c AS (SELECT * FROM c2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, rank, phrase, a, l, r, n.n, score::BIGINT AS score FROM k JOIN n USING (lang) WHERE rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(table(spark, sf_dir, "documents")))


@query()
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
