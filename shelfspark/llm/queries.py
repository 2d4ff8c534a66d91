"""Registered queries of the operators and the DuckDB statement each must equal, where SQL can say it."""

from shelfspark.llm import (
    alignment,
    chat,
    codes,
    decontaminate,
    language_id,
    licenses,
    mixing,
    near_vectors,
    paragraph_dedup,
    pii,
    simhash_dedup,
    topk,
    url_filter,
)

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_simhash_near_dedup": simhash_dedup.op2_simhash_near_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_pii": pii.op7_pii,
    "op8_mixing": mixing.op8_mixing,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_paragraph_dedup": paragraph_dedup.op10_paragraph_dedup,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_near_vectors": near_vectors.op13_near_vectors,
}

ORACLE: dict[str, str] = {
    "op5_exact_topk": topk.ORACLE_SQL,
    "op7_pii": pii.ORACLE_SQL,
    "op12_vector_codes": codes.ORACLE_SQL,
    "op13_near_vectors": near_vectors.ORACLE_SQL,
}
