"""The registered queries of this package and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.llm import line_rules, near_graph, phrases, turns, vector_dups
from panelcast.llm.bpe import token_digests
from panelcast.llm.common import documents
from panelcast.llm.curriculum import mix
from panelcast.llm.katz import score_texts
from panelcast.llm.pii import find_pii
from panelcast.llm.repeats import remove_repeats
from panelcast.llm.shards import ROW_BYTES, shard_by_bytes
from panelcast.llm.simhash import near_duplicates
from panelcast.llm.toxicity import severities


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_by_bytes(documents(spark, sf_dir))
    return sharded.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), vocabulary())


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality(documents(spark, sf_dir))


def op5_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severities(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long")))
    position = F.round("position", 9).alias("position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", position)


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_near_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_graph.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.audits(turns.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {
    "op1_shards": op1_shards,
    "op2_pii": op2_pii,
    "op3_bpe": op3_bpe,
    "op4_line_rules": op4_line_rules,
    "op5_vector_dups": op5_vector_dups,
    "op6_toxicity": op6_toxicity,
    "op7_curriculum": op7_curriculum,
    "op8_katz": op8_katz,
    "op9_repeats": op9_repeats,
    "op10_simhash": op10_simhash,
    "op11_phrases": op11_phrases,
    "op12_near_graph": op12_near_graph,
    "op13_turns": op13_turns,
}

ORACLES: dict[str, str] = {
    "op4_line_rules": """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY r
), lines AS (
  SELECT r, host, text, l FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')
), dups AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r
), plain AS (
  SELECT r, host, text, len(w) AS n,
    translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
  FROM (SELECT r, host, text, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') AS w FROM lines)
), common AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM plain GROUP BY ALL) c
  JOIN (SELECT host, count(DISTINCT text) AS texts FROM docs GROUP BY host) s USING (host)
  WHERE n > 20 AND n > texts * 0.02
), removed AS (SELECT r, sum(n) AS n FROM plain JOIN common USING (host, line) GROUP BY r
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed
  FROM docs JOIN words USING (r) LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed * 100 <= n_words * 70 AS kept
FROM counted
""",
    "op5_vector_dups": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, min(reach.b) AS component_id,
  v.vec_id = min(reach.b) AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id
""",
    "op9_repeats": """
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
), first_ids AS (SELECT win, min(doc_id) AS low FROM windows GROUP BY win
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p
  FROM windows JOIN first_ids USING (win) WHERE doc_id IS NULL AND low IS NOT NULL OR low < doc_id
), places AS (
  SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM words)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM places ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
""",
    "op7_curriculum": """
WITH sized AS (
  SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents
), items AS (
  SELECT source, doc_id, size, count(*) AS copies, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM sized GROUP BY ALL
), starts AS (
  SELECT *, CAST(coalesce(sum(size * copies) OVER (PARTITION BY source ORDER BY k, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM items
), sources AS (
  SELECT source, CAST(sum(size * copies) AS BIGINT) AS source_size FROM items GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk, CAST(3 * source_size AS DOUBLE) AS cap
  FROM sources
), weighed AS (SELECT *, CAST(rk % 3 + 1 AS DOUBLE) AS w FROM ranked
), levels AS (
  SELECT *, row_number() OVER o AS turn_at, cap / w AS ratio,
    (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - sum(w) OVER o + w) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), level AS (SELECT min_by(level, turn_at) AS level FROM levels WHERE level <= ratio
), targets AS (
  SELECT source, source_size, least(cap, level.level * w) AS target, rk % 3 AS kind FROM levels, level
), taken AS (
  SELECT s.*, t.source_size, t.target, t.kind, CAST(round(t.target) AS BIGINT) AS quota
  FROM starts s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
, uses AS (
  SELECT *, greatest(0, least(size * copies, quota - start)) // copies AS u0,
    greatest(0, least(size * copies, quota - start - source_size)) // copies AS u1,
    greatest(0, least(size * copies, quota - start - 2 * source_size)) // copies AS u2 FROM taken
), asked AS (
  SELECT u.*, r0, r1, r2, (r0 + r1) / 4 AS half, (start + source_size * CASE WHEN u0 > 0 THEN 0 WHEN u1 > 0 THEN 1 ELSE 2 END)
    / target * ((r0 + r1) / 4 + (r1 + r2) / 4) AS need
  FROM uses u JOIN (VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), (1, 0.5, 1.0, 1.5), (2, 1.5, 1.0, 0.5)) k(kind, r0, r1, r2) USING (kind)
), placed AS (
  SELECT *, CASE WHEN u0 + u1 + u2 = 0 THEN NULL
    WHEN need <= 0 THEN 0.0
    WHEN need <= half THEN 2 * need / (r0 + sqrt(greatest(0.0, r0 * r0 + 2 * ((r1 - r0) / 0.5) * need)))
    WHEN need - half <= 0 THEN 0.5
    ELSE 0.5 + 2 * (need - half) / (r1 + sqrt(greatest(0.0, r1 * r1 + 2 * ((r2 - r1) / 0.5) * (need - half)))) END AS position FROM asked
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target, CAST(u0 + u1 + u2 AS BIGINT) AS taken,
  round(position, 9) AS position
FROM sized d JOIN placed t ON d.source IS NOT DISTINCT FROM t.source
  AND d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.size = t.size
""",
    "op11_phrases": """
WITH pieces AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
      SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
      FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS m FROM pieces) WHERE len(w) >= m))
  GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT lang, a, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
    SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM candidates))
), kept AS (
  SELECT c.* FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)
), cuts AS (
  SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, l.f AS l, r.f AS r, n,
    CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.head
  JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank,
  phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""",
}
