"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tallyloom.llm.bpe_codec import op8_bpe_codec
from tallyloom.llm.clusters import op12_centroid_clusters, op12_sql
from tallyloom.llm.licences import op11_license_scans
from tallyloom.llm.media import op5_matroska_media
from tallyloom.llm.minhash import op3_minhash_dedup
from tallyloom.llm.packing import op2_best_fit_packing
from tallyloom.llm.quality import op9_quality_classifier
from tallyloom.llm.spelling import op13_spelling_variants, op13_sql
from tallyloom.llm.substring_dedup import op10_substring_dedup
from tallyloom.llm.suffix_dedup import op7_suffix_array_dedup
from tallyloom.llm.token_counts import op1_token_counts
from tallyloom.llm.topk import OP4_SQL, op4_exact_topk
from tallyloom.llm.url_filter import op6_sql, op6_url_filters


def queries():
    import corpus_pipeline  # at the repository's top; the operators do without it

    ops = [op1_token_counts, op2_best_fit_packing, op3_minhash_dedup, op4_exact_topk, op5_matroska_media, op6_url_filters, op7_suffix_array_dedup, op8_bpe_codec, op9_quality_classifier, op10_substring_dedup, op11_license_scans, op12_centroid_clusters, op13_spelling_variants]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    import corpus_pipeline

    return {"op4_exact_topk": OP4_SQL, "op6_url_filters": op6_sql(), "op12_centroid_clusters": op12_sql(), "op13_spelling_variants": op13_sql()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
