"""Queries of the training-data operators and their SQL, for the driver's entry module."""

from __future__ import annotations

from tidemark.llm.alignment import op13_align
from tidemark.llm.decontaminate import OP5_SQL, op5_decontaminate
from tidemark.llm.hash_forest import op11_nearest
from tidemark.llm.html_extract import op1_html_text
from tidemark.llm.language import op2_language
from tidemark.llm.merkle import OP12_SQL, op12_merkle
from tidemark.llm.near_vectors import OP7_SQL, op7_near_vectors
from tidemark.llm.ngram_join import OP4_SQL, op4_ngram_join
from tidemark.llm.packing import op6_pack
from tidemark.llm.secrets import OP10_SQL, op10_secret_scan
from tidemark.llm.token_counts import op3_token_counts
from tidemark.llm.token_output import op8_token_output
from tidemark.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_language": op2_language,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_join": op4_ngram_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_pack": op6_pack,
    "op7_near_vectors": op7_near_vectors,
    "op8_token_output": op8_token_output,
    "op9_warc": op9_warc,
    "op10_secret_scan": op10_secret_scan,
    "op11_nearest": op11_nearest,
    "op12_merkle": op12_merkle,
    "op13_align": op13_align,
}
ORACLE_SQL: dict[str, str] = {"op4_ngram_join": OP4_SQL, "op5_decontaminate": OP5_SQL, "op7_near_vectors": OP7_SQL, "op9_warc": OP9_SQL, "op10_secret_scan": OP10_SQL, "op12_merkle": OP12_SQL}
