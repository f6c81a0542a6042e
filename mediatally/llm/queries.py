"""The registered queries of this subpackage: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediatally.llm import codes, counts, encoding, exact, language, lines, mixing, pseudo, repeats, resampling, simhash, tiling, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def as_manifests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("manifest_id"), F.col("text").alias("body"))


def as_items(docs: DataFrame, *more: str) -> DataFrame:
    names = {"source": "site", "lang": "lang"}
    return docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("title"), *[F.col(c).alias(names[c]) for c in more])


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::BIGINT AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source IS NULL, source) AS n FROM w),
a AS (SELECT *, ((SELECT sum(source_size) FROM o) - coalesce(sum(3 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM o),
f AS (SELECT min(n) AS first, min_by(share, n) AS level FROM a WHERE share * w <= 3 * source_size),
t AS (SELECT source, source_size, CASE WHEN n < first THEN (3 * source_size)::DOUBLE ELSE level * w END AS target FROM a, f),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1|' || doc_id || '|' || t), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                         < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""


@query("op3_mix_sources", MIX_SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sites(as_items(given(spark, sf_dir, "documents"), "source"))
    return mixed.select(F.col("item_id").alias("doc_id"), "size", F.col("site_size").alias("source_size"), "target", "copies", "taken")


COPIES_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
           FROM documents),
g AS (SELECT bare, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM d JOIN g USING (bare)
"""


@query("op5_exact_dedup", COPIES_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_copies(as_manifests(given(spark, sf_dir, "documents")))
    return found.select(F.col("manifest_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("body_sha256").alias("text_sha256"))


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i AS start, array_to_string(lines[i + 1:i + 3], chr(10)) AS win
      FROM (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 0))) AS i FROM d)),
later AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS n FROM w) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, start + k AS pos FROM later, (SELECT unnest(range(0, 3)) AS k)),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM d),
kept AS (SELECT doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.pos IS NULL), '') AS kept
         FROM l LEFT JOIN covered c USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM kept
"""


@query("op10_line_dedup", LINES_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.drop_repeated_lines(as_manifests(given(spark, sf_dir, "documents")))
    return clean.select(F.col("manifest_id").alias("doc_id"), "n_lines", "n_removed", "kept_sha256")


def remainder(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % n


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.similar_titles(as_items(given(spark, sf_dir, "documents")))
    return found.select(F.col("item_id").alias("doc_id"), F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("item_id", 3) == 1, F.lit(False))
    items = as_items(given(spark, sf_dir, "documents"), "lang").withColumn("held_out", held_out)
    named = language.title_languages(items, ~F.col("held_out"))
    return named.select(F.col("item_id").alias("doc_id"), "held_out", "lang_pred", "score")


@query("op4_token_binary")
def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    read = encoding.encode_titles(as_items(given(spark, sf_dir, "documents")), tokenizer=path)
    return read.select(F.col("item_id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    reserved = given(spark, sf_dir, "benchmark").select(F.col("item_id").alias("reserved_id"), "text")
    found = tiling.reserved_in_titles(as_items(given(spark, sf_dir, "documents")), reserved)
    return found.select(F.col("item_id").alias("doc_id"), F.col("reserved_id").alias("item_id"), "coverage", "tiles")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("item_id", 5) == 0, F.lit(False))
    labels = given(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "toxic").filter(~held_out)
    items = as_items(given(spark, sf_dir, "documents")).withColumn("held_out", held_out)
    scored = toxicity.title_toxicity(items, labels)
    return scored.select(F.col("item_id").alias("doc_id"), "held_out", "score", "predicted")


PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i AS start, array_to_string(words[i + 1:i + 35], ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 34, 0))) AS i FROM d)),
twice AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, start + k AS pos FROM w JOIN twice USING (win), (SELECT unnest(range(0, 35)) AS k)),
l AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM d),
kept AS (SELECT doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE g.pos IS NULL) AS kept
         FROM l LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op8_substring_dedup", PASSAGES_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    clean = repeats.drop_repeated_passages(docs.select(F.col("doc_id").alias("log_id"), F.col("text").alias("msg")))
    return clean.select(F.col("log_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pseudo.title_likelihood(as_items(given(spark, sf_dir, "documents")))
    return scored.select(F.col("item_id").alias("doc_id"), F.col("n_words").alias("n_tokens"),
                         F.col("log_likelihood").alias("log_prob"), F.col("per_word").alias("score"))


# CRC-32 byte by byte over a table of 256 entries that its own rule makes
DRAW_SQL = r"""
WITH byte AS (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                          ORDER BY i) AS tab FROM range(0, 256) r(i)),
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
f AS (SELECT side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
n AS (SELECT side, doc_id, word, count(*) AS n FROM f GROUP BY ALL),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)),
                                     lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
        FROM (SELECT DISTINCT word FROM n), byte),
c AS (SELECT side, doc_id, bucket, sum(n)::BIGINT AS n FROM n JOIN crc USING (word) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::BIGINT AS t FROM c GROUP BY bucket),
a AS (SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM s),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM s, a),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
      FROM c JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= able * 10 // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""


@query("op11_importance_resampling", DRAW_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = given(spark, sf_dir, "benchmark").select(F.col("text").alias("title"))
    drawn = resampling.draw_like(as_items(given(spark, sf_dir, "documents")), target)
    return drawn.select(F.col("item_id").alias("doc_id"), "n_features", "weight", "score", "rank")


def codes_sql(rounds: int = 2) -> str:
    """Lloyd's rounds written out: `a` holds every part's entry and squared distance, `c` the entries."""
    steps = [r"""
k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, w, pos, v[pos * w + 1:(pos + 1) * w] AS part FROM k, range(0, 16) r(pos)),
c0 AS (SELECT pos, e, part FROM (SELECT pos, part, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 64)"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS (SELECT vec_id, pos, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
      SELECT vec_id, pos, e, list_sum(list_transform(range(1, w + 1), lambda i: (p.part[i] - c.part[i]) * (p.part[i] - c.part[i])))::BIGINT AS dist
      FROM p JOIN c{n} c USING (pos)) GROUP BY vec_id, pos)""")
        if n < rounds:
            steps.append(f"""
m{n} AS (SELECT pos, e, list(mean ORDER BY i) AS part FROM (
      SELECT pos, e, i, floor(sum(x)::DOUBLE / count(*)::DOUBLE)::BIGINT AS mean
      FROM (SELECT pos, e, unnest(part) AS x, unnest(range(0, w)) AS i FROM p JOIN a{n} USING (vec_id, pos)) GROUP BY pos, e, i) GROUP BY pos, e),
c{n + 1} AS (SELECT pos, e, coalesce(m.part, c.part) AS part FROM c{n} c LEFT JOIN m{n} m USING (pos, e))""")
    return "WITH " + ",".join(steps) + rf""",
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, e, i)) AS digest FROM (SELECT pos, e, unnest(part) AS x, unnest(range(0, len(part))) AS i FROM c{rounds})),
v AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY pos) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM v JOIN k USING (vec_id), h
"""


@query("op12_vector_codes", codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.compress_vectors(given(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = counts.title_tokens(as_items(given(spark, sf_dir, "documents")), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return counted.select(F.col("item_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
