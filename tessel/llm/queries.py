"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessel.llm import decontamination, html, mixing, neighbours, quality, secrets, sentences, simhash, substrings, warc

QUERIES = {
    "op1_secret_scans": secrets.op1,
    "op2_decontamination": decontamination.op2,
    "op3_simhash_near_dedup": simhash.op3,
    "op4_quality_classifier": quality.op4,
    "op5_suffix_array_dedup": substrings.op5,
    "op6_warc_fixity": warc.op6,
    "op7_html_extraction": html.op7,
    "op8_mixing": mixing.op8,
    "op9_nearest_neighbours": neighbours.op9,
    "op10_sentence_spans": sentences.op10,
}

SQL = {
    "op6_warc_fixity": warc.SQL,
    "op8_mixing": mixing.SQL,
}
