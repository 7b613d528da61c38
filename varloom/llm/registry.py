"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import chat, exact, infilling, language, language_model, mixing, near, packing, quality, token_counts, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packed_ids": packing.op1_packed_ids,
        "op2_language_model": language_model.op2_language_model,
        "op3_warc_derivatives": warc.op3_warc_derivatives,
        "op4_vector_packing": packing.op4_vector_packing,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_near_duplicates": near.op7_near_duplicates,
        "op8_exact_groups": exact.op8_exact_groups,
        "op9_language": language.op9_language,
        "op10_line_quality": quality.op10_line_quality,
        "op11_chat_format": chat.op11_chat_format,
        "op12_embedding_whitening": whitening.op12_embedding_whitening,
        "op13_fill_in_middle": infilling.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_groups": exact.OP8_SQL, "op11_chat_format": chat.OP11_SQL, "op13_fill_in_middle": infilling.OP13_SQL}
