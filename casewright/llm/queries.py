"""One query for each operator of this package, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casewright.llm.common import Workspace
from casewright.llm.exact_dedup import exact_groups
from casewright.llm.jaccard_join import near_components
from casewright.llm.line_dedup import repeated_units
from casewright.llm.lm_score import score
from casewright.llm.piece_codec import encode
from casewright.llm.quality_model import score_quality
from casewright.llm.quality_rules import apply_rules
from casewright.llm.source_mix import mix
from casewright.llm.token_counts import token_counts
from casewright.llm.warc import round_trip

#: The vocabulary of the token counter and the codec.
VOCABULARY = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"), Workspace(spark, "warc"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Workspace(spark, "rules"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"), Workspace(spark, "exact"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"), Workspace(spark, "lm"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), Workspace(spark, "mix")).drop("source")


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(_table(spark, sf_dir, "documents"), Workspace(spark, "lines"), min_words=1).drop("row")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"), Workspace(spark, "jaccard"), words=4, percent=85).drop("class_size")


QUERIES = {
    f.__name__: f
    for f in (op1_warc_chunks, op2_token_counts, op3_quality_rules, op4_exact_dedup, op5_lm_score, op6_source_mix, op7_piece_codec, op8_line_dedup, op9_quality_model, op10_jaccard_join)
}

#: Base32 of a hexadecimal digest, five bits a letter.
_BITS = "array_to_string(list_transform(range(1, 41), lambda i: list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], instr('0123456789abcdef', substr(h, i, 1)))), '')"
_LETTERS = "array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), lambda k: CAST(substr(b, 5 * j + k, 1) AS INTEGER) * (32 >> k))) AS BIGINT), 1)), '')"

SQL = {
    "op1_warc_chunks": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), f AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last, sha1(body) AS h FROM p), g AS (SELECT *, {_BITS} AS b FROM f)
        SELECT page_id, strlen(body) AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g""",
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM t""",
    "op6_source_mix": r"""
        WITH m AS (SELECT doc_id, source, coalesce(text, '') AS body, md5('17:' || doc_id) AS h FROM documents),
        d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                     0.5e0 + 1.5e0 * strlen(regexp_replace(body, '[\x00-\x08\x0E-\x1B\x21-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) / greatest(1, strlen(body)) AS quality,
                     (CAST(('0x' || substr(h, 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496.0e0 AS u FROM m),
        k AS (SELECT *, -ln(u) / quality AS key FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_extract([5.0e0, 2.0e0, 1.0e0], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS weight FROM k GROUP BY source),
        r AS (SELECT *, 2.0e0 * source_size AS cap, 2.0e0 * source_size / weight AS room FROM s),
        l AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
        c AS (SELECT arg_min(level, room) AS level FROM l WHERE level <= room),
        t AS (SELECT source, source_size, CASE WHEN c.level IS NULL OR room < c.level THEN cap ELSE least(cap, c.level * weight) END AS target FROM l CROSS JOIN c),
        w AS (SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
        e AS (SELECT w.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(size * epochs + greatest(0, least(size, floor(target - epochs * source_size - before))) AS BIGINT) AS taken FROM e""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.first AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS first FROM reach GROUP BY a) r ON r.a = d.doc_id""",
}
