"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from biblark.llm import decontaminate, html_text, manifest, packing, pii, quality, simhash, spelling, sql, token_counts, toxicity, url_reputation, vectors, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_pii": pii.op3_pii,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_embedding_near_dedup": vectors.op6_embedding_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_warc": warc.op9_warc,
    "op10_html_extraction": html_text.op10_html_extraction,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_url_filters": url_reputation.op13_url_filters,
}

ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT h, min(page_id) AS m FROM p WHERE strlen(h) >= 100 GROUP BY h)
        SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
               CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN m <> page_id THEN m END AS refers_to
        FROM p LEFT JOIN f USING (h)""",
    "op6_embedding_near_dedup": sql.EMBEDDINGS,
    "op11_merkle_manifest": sql.MANIFEST,
    "op12_spelling_variants": sql.SPELLING,
    "op13_url_filters": sql.URLS,
}
