"""Registered queries of this package."""

from __future__ import annotations

from repochron.llm.ann import op3_rp_forest
from repochron.llm.decontam import op8_lsa_decontamination
from repochron.llm.licenses import op11_rare_token_licenses
from repochron.llm.packing import op2_bestfit_packing
from repochron.llm.periodic import op13_tiled_runs
from repochron.llm.pii import op4_feistel_pseudonyms
from repochron.llm.sharding import op10_feistel_sharding
from repochron.llm.simhash import op7_simhash_near_dedup
from repochron.llm.suffixdedup import op6_suffix_dedup
from repochron.llm.tokencount import op9_edit_counts
from repochron.llm.toxicity import op1_nnpu_toxicity
from repochron.llm.variants import op12_vgram_variants
from repochron.llm.warc import op5_arc_to_warc

QUERIES = {
    "op1_nnpu_toxicity": op1_nnpu_toxicity,
    "op2_bestfit_packing": op2_bestfit_packing,
    "op3_rp_forest": op3_rp_forest,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_arc_to_warc": op5_arc_to_warc,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_lsa_decontamination": op8_lsa_decontamination,
    "op9_edit_counts": op9_edit_counts,
    "op10_feistel_sharding": op10_feistel_sharding,
    "op11_rare_token_licenses": op11_rare_token_licenses,
    "op12_vgram_variants": op12_vgram_variants,
    "op13_tiled_runs": op13_tiled_runs,
}

SQL: dict[str, str] = {
    "op5_arc_to_warc": """
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
               sha256(coalesce(html, '')) AS payload_digest,
               CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > first THEN 'revisit'
                    ELSE 'response' END AS record_type,
               CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > first THEN first END AS refers_to
        FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
    """,
}
