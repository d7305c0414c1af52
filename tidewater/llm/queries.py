"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, exact_dedup, html_text, langid, lm, minhash, mixing, packing, quality, simhash, suffix_dedup, trie
from .common import WORD_PATTERN, id_crc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_read(spark, sf_dir, "documents"), distance=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_main_text(_read(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), length=200)
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_to_weights(_read(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_crc("doc_id") % 10 == 0
    scores = lm.interpolated_scores(_read(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(id_crc("doc_id") % 5 != 0))
    held_out = (id_crc("doc_id") % 5 == 0).alias("held_out")
    return langid.identify_languages(docs, model, "text", F.col("doc_id"), held_out).select("doc_id", "held_out", "lang_pred", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_best_fit(_read(spark, sf_dir, "documents"), path, capacity=4096, end_id=1)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"), keep="max")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Trees:
    return quality.fit_quality(docs, labels.where(id_crc("doc_id") % 4 != 2))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_model(docs, _read(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select(
        "doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"), every=20, most=3)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = codes.vector_codes(_read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.codebooks_sha256(books)).alias("codebooks_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup, op2_nearest_neighbours, op3_main_text, op4_suffix_dedup, op5_source_mixing, op6_lm_scoring, op7_language_id,
        op8_best_fit_packing, op9_exact_dedup, op10_quality_classifier, op11_minhash_dedup, op12_prefix_trie, op13_vector_codes,
    )
}

def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd rounds by comparing every part with every entry, a round after the other."""
    away = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r, list_transform(embedding, lambda y: floor({codes.SCALE} * y::DOUBLE)::BIGINT) AS v
                               FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, range({parts}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, p.part, any_value(x) AS x, min({away} * {entries} + entry) AS m FROM p JOIN b{n} b ON b.part = p.part GROUP BY r, p.part)")
        if n < rounds:
            steps += [
                f"u{n} AS (SELECT part, m % {entries} AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, 4097) t(i) WHERE i <= len(x) GROUP BY ALL)",
                f"n{n} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM u{n} GROUP BY part, entry)",
                f"b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{n} b LEFT JOIN n{n} n ON n.part = b.part AND n.entry = b.entry)",
            ]
    return f"""WITH {", ".join(steps)},
        h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS y, unnest(range(len(c))) AS i FROM b{rounds})),
        e AS (SELECT r, string_agg(printf('%02x', (m % {entries})::INT), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN k USING (r), h"""


ORACLE_SQL = {
    # sets as sorted lists, all pairs that share a shingle, and the closure of their links
    "op11_minhash_dedup": r"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             h AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                       ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM d),
             u AS MATERIALIZED (SELECT s, row_number() OVER () AS node, min(doc_id) AS least FROM h WHERE len(s) > 0 GROUP BY s),
             e AS MATERIALIZED (SELECT node, len(s) AS n, unnest(s) AS g FROM u),
             l AS MATERIALIZED (SELECT a.node AS x, b.node AS y FROM e a JOIN e b ON a.g = b.g AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
                                GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
             c AS (SELECT node AS x, node AS y FROM u UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y),
             m AS (SELECT c.x AS node, min(u.least) AS component_id FROM c JOIN u ON u.node = c.y GROUP BY c.x)
        SELECT h.doc_id, len(h.s) AS n_shingles, CASE WHEN len(h.s) = 0 THEN h.doc_id ELSE m.component_id END AS component_id,
               h.doc_id IS NOT DISTINCT FROM (CASE WHEN len(h.s) = 0 THEN h.doc_id ELSE m.component_id END) AS kept
        FROM h LEFT JOIN u ON u.s = h.s LEFT JOIN m ON m.node = u.node
    """,
    # crc32 bit by bit; paths as lists of turns, and every node joined to the nodes of its subtree
    "op12_prefix_trie": r"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) - 1 AS place
                   FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
                          xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: list_transform(range(8), lambda j: (ascii(s) >> j) & 1))),
                                          lambda r, b: xor(r >> 1, 3988292384 * (xor(r, b) & 1))), 4294967295) % 4 AS h
                   FROM (SELECT DISTINCT conv_id FROM t)),
             r AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN t ON t.conv_id = c.base WHERE place < h
                   UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE place >= h),
             p AS (SELECT c.conv_id, coalesce(list(sha256(role || chr(1) || text) ORDER BY part, place) FILTER (role IS NOT NULL), []) AS path,
                          coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY part, place) FILTER (role IS NOT NULL), []) AS words
                   FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
             m AS (SELECT conv_id, depth, array_to_string(path[1:depth], ',') AS node, array_to_string(path[1:depth - 1], ',') AS above, CASE WHEN depth = 0 THEN 0 ELSE words[depth] END AS words, path, len(path) = depth AS ends
                   FROM (SELECT *, unnest(range(len(path) + 1)) AS depth FROM p)),
             n AS (SELECT node, any_value(above) AS above, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(path[1:depth]) AS path,
                          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
                   FROM m GROUP BY node, depth),
             k AS (SELECT above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
             s AS (SELECT array_to_string(path[1:up], ',') AS node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
                   FROM (SELECT *, unnest(range(depth + 1)) AS up FROM n) n LEFT JOIN k ON k.node = n.node GROUP BY 1)
        SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM n JOIN s ON s.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n a ON n.depth > 0 AND a.node = n.above
    """,
    "op13_vector_codes": _codes_sql(),
    # the sources' shares by the water level, and the documents below each source's threshold
    "op5_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(1) || coalesce(text, chr(0)) || chr(1)), 1, 13))::BIGINT >> 2 AS h FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
             r AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM s),
             l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                             / sum(weight) OVER (ORDER BY most / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
             t AS (SELECT source, source_size, least(most, (SELECT arg_min(level, most / weight) FROM l WHERE level <= most / weight) * weight) AS target FROM l),
             b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
             k AS (SELECT source, h, sum(size) AS held FROM d GROUP BY source, h),
             c AS (SELECT b.*, target - copies * source_size AS budget, h, held, sum(held) OVER (PARTITION BY k.source ORDER BY h) AS upto
                   FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source),
             e AS (SELECT source, source_size, target, copies, budget > 0 AND (upto <= budget OR (upto - held < budget AND (budget - (upto - held)) * 2 > held)) AS more, h FROM c)
        SELECT d.doc_id, d.size, e.source_size, e.target, (e.copies + e.more::BIGINT) * d.size AS taken
        FROM d JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.h = d.h
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g ON d.body = g.body
    """,
}
