"""Queries of the llm operators and the SQL that DuckDB holds them against."""

from __future__ import annotations

from quandrel.llm.conversations import op13_conversation_repair
from quandrel.llm.decontaminate import OP8_SQL, op8_decontaminate
from quandrel.llm.exact_dedup import OP12_SQL, op12_exact_dedup
from quandrel.llm.jaccard import OP7_SQL, op7_ngram_jaccard
from quandrel.llm.html_text import op3_html_text
from quandrel.llm.line_dedup import OP1_SQL, op1_line_dedup
from quandrel.llm.pieces import op6_sentencepiece
from quandrel.llm.pii import op9_pii_surrogates
from quandrel.llm.quality import op5_quality
from quandrel.llm.repeats import op4_suffix_dedup
from quandrel.llm.token_links import op11_token_links
from quandrel.llm.url_filter import OP2_SQL, op2_url_filter
from quandrel.llm.vectors import OP10_SQL, op10_near_vectors

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_html_text": op3_html_text,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality": op5_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_near_vectors": op10_near_vectors,
    "op11_token_links": op11_token_links,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op2_url_filter": OP2_SQL, "op7_ngram_jaccard": OP7_SQL, "op8_decontaminate": OP8_SQL, "op10_near_vectors": OP10_SQL, "op12_exact_dedup": OP12_SQL}
