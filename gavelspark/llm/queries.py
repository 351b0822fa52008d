"""The registered queries of this package, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gavelspark.llm import (
    decontaminate, html_text, jaccard_join, language_id, mixing, pii, quality_classifier, quality_rules, spelling, substring_dedup, url_filter, warc, whitening,
)
from gavelspark.llm.shared import shared_folder, table


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    forest = quality_rules.fit(docs, table(spark, folder, "labels"))
    return quality_rules.verdicts(docs, forest)


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.identified(docs, language_id.fit(docs))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_classifier.scored(docs, quality_classifier.fit(docs, table(spark, folder, "labels")))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_copies(table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), any_length=True)


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages"))


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filter.judged(pages, url_filter.fit(url_filter.seeded(pages)))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark)
    warc.write(table(spark, folder, "pages"), archives)
    return warc.read(spark, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.shortened(table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.report(table(spark, folder, "embeddings"))


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontamination": op6_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_url_filters": op8_url_filters,
    "op9_warc": op9_warc,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_whitening": op11_whitening,
    "op12_pii": op12_pii,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op9_warc": r"""
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), digests AS (
    SELECT page_id, strlen(payload) AS payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            CAST((CAST('0x' || substr(hex, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '')
            AS payload_digest
    FROM payloads
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts""",
    "op2_mixing": r"""
WITH sizes AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), grouped AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
    FROM sizes GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS all_size FROM grouped
), ordered AS (
    SELECT *, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
        all_size - CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT) AS size_left,
        CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_left
    FROM weighed WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
    SELECT *, cap * weight_left <= size_left * weight AS is_full FROM ordered
), rest AS (
    SELECT CAST(coalesce(sum(cap) FILTER (is_full), 0) AS BIGINT) AS cap_full, CAST(coalesce(sum(weight) FILTER (is_full), 0) AS BIGINT) AS weight_full
    FROM filled
), sources AS (
    SELECT source, rank, source_size, CAST(greatest(1, least(65536, ceil(docs / 256))) AS BIGINT) AS blocks,
        CASE WHEN is_full THEN CAST(cap AS DOUBLE)
             ELSE CAST((all_size - cap_full) * weight AS DOUBLE) / CAST(all_weight - weight_full AS DOUBLE) END AS target
    FROM filled, rest
), parts AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM sources
), docs AS (
    SELECT doc_id, size, source_size, target, rank, rounds, target - rounds * source_size AS left_over,
        CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % blocks AS block,
        CAST('0x' || substr(md5('0:doc:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
    FROM sizes JOIN parts ON sizes.source IS NOT DISTINCT FROM parts.source
), blocks AS (
    SELECT rank, block, CAST(sum(size) AS BIGINT) AS words, any_value(left_over) AS left_over,
        CAST('0x' || substr(md5('0:block:' || rank || ':' || block), 1, 15) AS BIGINT) AS place
    FROM docs GROUP BY rank, block
), placed AS (
    SELECT rank, block, words, left_over, CAST(sum(words) OVER (PARTITION BY rank ORDER BY place, block ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM blocks
), rooms AS (
    SELECT rank, block, left_over - (upto - words) > 0 AND words > 0 AS extra,
        CASE WHEN upto > left_over THEN left_over - (upto - words) END AS room FROM placed
), zero AS (
    SELECT docs.*, extra, room, extra AND room IS NULL AS whole FROM docs JOIN rooms USING (rank, block)
), gap1 AS (
    SELECT *, extra AND room IS NOT NULL AND size > 0 AND size <= room AS fits1 FROM zero
), one AS (
    SELECT *, fits1 AND sum(CASE WHEN fits1 THEN size ELSE 0 END)
        OVER (PARTITION BY rank, block ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) <= room AS got1 FROM gap1
), gap2 AS (
    SELECT *, room - sum(CASE WHEN got1 THEN size ELSE 0 END) OVER (PARTITION BY rank, block) AS room2 FROM one
), fit2 AS (
    SELECT *, extra AND room IS NOT NULL AND NOT got1 AND size > 0 AND size <= room2 AS fits2 FROM gap2
), two AS (
    SELECT *, got1 OR (fits2 AND sum(CASE WHEN fits2 THEN size ELSE 0 END)
        OVER (PARTITION BY rank, block ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) <= room2) AS got2 FROM fit2
), gap3 AS (
    SELECT *, room - sum(CASE WHEN got2 THEN size ELSE 0 END) OVER (PARTITION BY rank, block) AS room3 FROM two
), fit3 AS (
    SELECT *, extra AND room IS NOT NULL AND NOT got2 AND size > 0 AND size <= room3 AS fits3 FROM gap3
), three AS (
    SELECT *, got2 OR (fits3 AND sum(CASE WHEN fits3 THEN size ELSE 0 END)
        OVER (PARTITION BY rank, block ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) <= room3) AS got3 FROM fit3
)
SELECT doc_id, size, source_size, target, size * (rounds + CASE WHEN whole OR coalesce(got3, false) THEN 1 ELSE 0 END) AS taken FROM three""",
    "op5_jaccard_join": r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s
    FROM texts
), tokens AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), met AS (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common
    FROM tokens x JOIN tokens y USING (token) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM met WHERE 100 * common >= 80 * (na + nb - common)
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
    least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id
FROM sets""",
}
