"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat, decontam, fim, htmltext, licenses, linedup, packing, quality, repair, simhash, tokencount, urlrules, warc

QUERIES = {
    f.__name__: f
    for f in (
        licenses.op1_license_scan,
        warc.op2_warc_archive,
        simhash.op3_simhash_near_dedup,
        urlrules.op4_url_filter,
        linedup.op5_line_dedup,
        packing.op6_sequence_packing,
        quality.op7_quality_rules,
        chat.op8_chat_format,
        decontam.op9_decontamination,
        htmltext.op10_html_text,
        tokencount.op11_token_counts,
        fim.op12_fill_in_middle,
        repair.op13_conversation_repair,
    )
}

ORACLE_SQL = {
    "op2_warc_archive": warc.OP2_SQL,
    "op4_url_filter": urlrules.OP4_SQL,
    "op5_line_dedup": linedup.OP5_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op9_decontamination": decontam.OP9_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
    "op13_conversation_repair": repair.OP13_SQL,
}
