"""The operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from gridloom.llm import alignment, bpe, chat, decontaminate, language, lengths, licenses, lines, quality, sharding, simhash, spelling, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_language_id": language.op3_language_id,
        "op4_sharding": sharding.op4_sharding,
        "op5_warc": warc.op5_warc,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_chat_snapshots": chat.op7_chat_snapshots,
        "op8_token_lengths": lengths.op8_token_lengths,
        "op9_simhash": simhash.op9_simhash,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_alignment": alignment.op12_alignment,
        "op13_line_dedup": lines.op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.SQL,
        "op2_decontamination": decontaminate.SQL,
        "op5_warc": warc.SQL,
        "op7_chat_snapshots": chat.SQL,
        "op13_line_dedup": lines.SQL,
    }
