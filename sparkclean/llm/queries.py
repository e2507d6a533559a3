"""The numbered queries: each applies its operator to the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sparkclean.llm import (
    ann, collocations, decontaminate, importance, jaccard, lattice, licenses, lines, packing, prefix_tokens, quality,
    substrings, warc,
)
from sparkclean.llm.common import LOWER, UPPER, fold_of, read_table
from sparkclean.queries.registry import Query

LLM_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        LLM_QUERIES[name] = (fn, sql)
        return fn

    return add


@query("op7_quality_classifier")
def quality_classifier(spark, sf):
    docs = read_table(spark, sf, "documents")
    model = quality.fit(docs, read_table(spark, sf, "labels"))
    found = quality.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query("op4_prefix_token_counts")
def prefix_token_counts(spark, sf):
    docs = read_table(spark, sf, "documents")
    return prefix_tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query("op6_best_fit_packing")
def best_fit_packing(spark, sf):
    found = packing.pieces(read_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(found)


@query("op9_benchmark_decontamination")
def benchmark_decontamination(spark, sf):
    return decontaminate.contaminated(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@query("op10_lattice_scores")
def lattice_scores(spark, sf):
    return lattice.score(read_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_substring_dedup")
def substring_dedup(spark, sf):
    found = substrings.deduplicated(read_table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_jaccard_join")
def jaccard_join(spark, sf):
    return jaccard.classes(read_table(spark, sf, "documents"), n=3, percent=90)


@query("op5_nearest_neighbours")
def nearest_neighbours(spark, sf):
    return ann.nearest(read_table(spark, sf, "embeddings"))


@query("op8_license_scan")
def license_scan(spark, sf):
    docs = read_table(spark, sf, "documents")
    return licenses.scan(docs, licenses.fit(docs))


@query("op1_line_dedup")
def line_dedup(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    found = lines.deduplicated(docs)
    return found.select(
        "doc_id", (F.size(F.split(F.coalesce("text", F.lit("")), "\n")) + F.size("dropped_lines")).alias("n_lines"),
        "dropped_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


_PHRASES_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
occ AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM occ GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (
  SELECT lang, k, phrase, a, ws, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:k], ' ') AS tail
  FROM cand, (VALUES (1), (2), (3)) t(c) WHERE c < k),
best AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, ((2000000::HUGEINT * cuts.a) // (x.a + y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (2000000::HUGEINT * cuts.a) // (x.a + y.a), c) = 1),
parts AS (
  SELECT lang, a, unnest(list_transform(range(1, k - s + 2), lambda i: array_to_string(ws[i:i + s - 1], ' '))) AS phrase
  FROM cand, (VALUES (2), (3)) t(s) WHERE s < k),
gone AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN parts p ON p.lang = f.lang AND p.phrase = f.phrase WHERE 100 * p.a >= 80 * f.a),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b ANTI JOIN gone USING (lang, phrase))
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000
"""


@query("op11_collocations", _PHRASES_SQL)
def collocation_mining(spark, sf):
    return collocations.mine(read_table(spark, sf, "documents"))


@query("op12_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS kept FROM p)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM m
""")
def warc_round_trip(spark, sf):
    found = warc.round_trip(read_table(spark, sf, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# DuckDB has no crc32: eight shifts a byte, over the distinct words
_RESAMPLING_SQL = f"""
WITH own AS (
  SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
word AS (SELECT side, doc_id, unnest(ws) AS word FROM own),
bucket AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(word)) // 2),
    lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM word)),
n AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM word JOIN bucket USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM n),
weight AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM word JOIN bucket USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT o.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || o.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM own o LEFT JOIN weight w ON w.doc_id = o.doc_id WHERE side = 0),
able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank
FROM scored s LEFT JOIN able a ON a.doc_id = s.doc_id
"""


@query("op13_importance_resampling", _RESAMPLING_SQL)
def importance_resampling(spark, sf):
    found = importance.resample(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
