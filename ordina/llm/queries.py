"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import band_join, decontamination, html_extraction, license_scan, near_duplicates, pii, quality_classifier, quality_rules, secret_scan, sentencepieces, substring_dedup, token_alignment, token_counts

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_pii": pii.op4_pii,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_decontamination": decontamination.op6_decontamination,
    "op8_near_duplicates": near_duplicates.op8_near_duplicates,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op9_sentencepieces": sentencepieces.op9_sentencepieces,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_band_join": band_join.op12_band_join,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op12_band_join": band_join.BAND_SQL,
    "op13_substring_dedup": substring_dedup.REPEATS_SQL,
    "op6_decontamination": f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format(_LOW.format("text"))}, []) AS w FROM documents),
 v AS (SELECT item_id, {_WORDS.format(_LOW.format("text"))} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
 i AS (SELECT item_id, w, least(10, len(w)) AS n FROM v WHERE len(w) > 0),
 k AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
 p AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS s FROM d, (SELECT DISTINCT n FROM k))),
 h AS (SELECT doc_id, item_id, s, p.n FROM p JOIN k ON p.n = k.n AND p.g = k.g),
 c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM h) GROUP BY doc_id),
 m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id""",
}
