"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import (
    curriculum_mix,
    exact_dedup,
    importance_resampling,
    license_scan,
    line_dedup,
    ngram_join,
    order_minhash,
    prefix_trie,
    private_data,
    quality_gam,
    sentencepiece_codec,
    substring_dedup,
    toxicity,
)

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_private_data(spark: SparkSession, folder: str) -> DataFrame:
    found = private_data.extract(_table(spark, folder, "documents"))
    counts = [private_data.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in private_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(private_data.written(F.col("base")), 256).alias("base_sha256"),
                        private_data.written(F.concat("base", "discovered")).alias("spans"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.train(docs, _table(spark, folder, "labels"), learn_from=~toxicity.held_out("id"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, folder, "documents"))
    listed = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["template"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), listed.alias("findings"),
                        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    coded = sentencepiece_codec.encode(_table(spark, folder, "documents"), PIECE_MODEL)
    return coded.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"), "parity")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(_table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_classes(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = curriculum_mix.by_first_position(curriculum_mix.mix(_table(spark, folder, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality_gam.train(docs, _table(spark, folder, "labels"), learn_from=~quality_gam.held_out("id"))
    scored = quality_gam.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality_gam.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= quality_gam.THRESHOLD).cast("int").alias("predicted"))


def op9_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.fingerprints(_table(spark, folder, "documents"))


def op10_content_sort(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.content_sort(_table(spark, folder, "documents"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.without_common_lines(_table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, folder, "conversations"))


QUERIES = {
    "op1_private_data": op1_private_data,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_curriculum_mix": op7_curriculum_mix,
    "op8_quality_gam": op8_quality_gam,
    "op9_order_minhash": op9_order_minhash,
    "op10_content_sort": op10_content_sort,
    "op11_line_dedup": op11_line_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op5_substring_dedup": r"""
        WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS a FROM documents),
        s AS (SELECT doc_id, a, unnest(range(1, len(a) - 18)) AS i FROM w WHERE len(a) >= 20),
        k AS (SELECT doc_id, i, md5(array_to_string(a[i:i + 19], ' ')) AS g FROM s),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS o FROM k) WHERE o > 1),
        c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM r),
        d AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
        SELECT w.doc_id, len(a) AS n_words, coalesce(len(ps), 0) AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN a ELSE list_select(a, list_filter(range(1, len(a) + 1), lambda p: NOT list_contains(ps, p))) END, ' '), ''))
                   AS kept_sha256
        FROM w LEFT JOIN d USING (doc_id)""",
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x20\x09-\x0D]+') AS a FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
                  ELSE list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' ')) END) AS g FROM w WHERE len(a) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 185 * c >= 85 * (x.n + y.n)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(v, o) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.o)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.o, w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(o) AS o FROM r GROUP BY v) m ON m.v = w.doc_id""",
    "op7_curriculum_mix": r"""
        WITH d AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM d GROUP BY source),
        r AS (SELECT *, 3.0 * source_size AS ceiling, 3.0 * source_size / weight AS ratio FROM s),
        l AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER before_it, 0.0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER before_it, 0.0)) AS level
            FROM r WINDOW before_it AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
            SELECT source, source_size,
                   CAST(least(ceiling, weight * coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio >= level), 'inf'::DOUBLE))
                        AS DOUBLE) AS target FROM l),
        p AS (
            SELECT doc_id, size, source_size, target,
                   CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * least(passes + CASE WHEN earlier + size / 2.0 <= target - passes * source_size THEN 1 ELSE 0 END, 3)
                    AS BIGINT) AS taken
        FROM p""",
    "op10_content_sort": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        g AS (SELECT k.*, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS goes FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
        FROM g GROUP BY doc_id""",
    "op12_importance_resampling": r"""
        WITH RECURSIVE steps(b, n, c) AS (
            SELECT b, 0, CAST(b AS BIGINT) FROM range(256) AS r(b)
            UNION ALL SELECT b, n + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM steps WHERE n < 8),
        crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE n = 8),
        texts AS (SELECT doc_id, text, false AS target FROM documents UNION ALL SELECT NULL, text, true FROM benchmark),
        w AS (SELECT row_number() OVER () AS r, doc_id, target, coalesce(regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS a FROM texts),
        f AS (SELECT r, target, unnest(a || list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS feature FROM w),
        h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM f)),
        b AS (SELECT feature, xor(4294967295, list_reduce(
                  list_transform(range(1, len(x), 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1),
                  lambda c, o: xor(c // 256, t[xor(c % 256, o) + 1]), 4294967295)) % 10000 AS bucket FROM h, crc),
        n AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM f JOIN b USING (feature) GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln(((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE))) AS gain
              FROM n),
        m AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
              FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE NOT target GROUP BY r),
        p AS (SELECT doc_id, len(a) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                     coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))
                         AS BIGINT) AS score
              FROM w LEFT JOIN m USING (r) WHERE NOT target),
        o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM p)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_words >= 20 AND place <= (SELECT count(*) * 25 // 100 FROM p WHERE n_words >= 20) THEN place END AS rank
        FROM o""",
    "op13_prefix_trie": r"""
        WITH RECURSIVE steps(b, n, c) AS (
            SELECT b, 0, CAST(b AS BIGINT) FROM range(256) AS r(b)
            UNION ALL SELECT b, n + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM steps WHERE n < 8),
        crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE n = 8),
        i AS (SELECT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
        c AS (SELECT conv_id, xor(4294967295, list_reduce(
                  list_transform(range(1, len(x), 2), lambda k: (instr('0123456789ABCDEF', x[k]) - 1) * 16 + instr('0123456789ABCDEF', x[k + 1]) - 1),
                  lambda a, o: xor(a // 256, t[xor(a % 256, o) + 1]), 4294967295)) % 4 AS h FROM i, crc),
        u AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        y AS (SELECT *, md5(strlen(role) || ':' || role || text) AS g FROM u),
        t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, g) AS pos FROM y),
        r AS (SELECT c.conv_id, 0 AS part, pos, g, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
              UNION ALL SELECT conv_id, 1, pos, g, text FROM c JOIN t USING (conv_id) WHERE pos > h),
        q AS (SELECT conv_id, g, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                     row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
        l AS (SELECT conv_id, list(g ORDER BY depth) AS a FROM q GROUP BY conv_id),
        m AS (SELECT conv_id, coalesce(a, []) AS a FROM c LEFT JOIN l USING (conv_id)),
        d AS (SELECT conv_id, a, unnest(range(0, len(a) + 1)) AS depth FROM m),
        p AS (SELECT conv_id, depth, depth = len(a) AS ends, md5(coalesce(array_to_string(list_slice(a, 1, depth), ','), '')) AS node,
                     CASE WHEN depth > 0 THEN md5(coalesce(array_to_string(list_slice(a, 1, depth - 1), ','), '')) END AS parent FROM d),
        n AS (SELECT node, depth, max(parent) AS parent, min(p.conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(words), 0) AS words
              FROM p LEFT JOIN q USING (conv_id, depth) GROUP BY node, depth),
        k AS (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent),
        v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS tokens FROM n LEFT JOIN k USING (node)),
        b AS (SELECT DISTINCT x.node, z.node AS below FROM p x JOIN p z ON x.conv_id = z.conv_id AND x.depth <= z.depth),
        s AS (SELECT b.node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(tokens) AS BIGINT) AS saved_tokens
              FROM b JOIN v ON v.node = b.below GROUP BY b.node),
        e AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM p WHERE ends GROUP BY node)
        SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens,
               coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM v JOIN s USING (node) LEFT JOIN n o ON o.node = v.parent LEFT JOIN e USING (node)""",
}
