"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from trajframe.llm.chat import OP13_SQL, op13_chat
from trajframe.llm.divergence import OP12_SQL, op12_divergence
from trajframe.llm.langid import op7_language
from trajframe.llm.licenses import op3_licenses
from trajframe.llm.lines import OP1_SQL, op1_lines
from trajframe.llm.mixing import OP10_SQL, op10_mixing
from trajframe.llm.pieces import op9_pieces
from trajframe.llm.pii import op2_pii
from trajframe.llm.quality import op4_quality
from trajframe.llm.search import OP8_SQL, op8_search
from trajframe.llm.simhash import op5_simhash
from trajframe.llm.spelling import OP11_SQL, op11_spelling
from trajframe.llm.urls import OP6_SQL, op6_urls

QUERIES = {
    "op1_lines": op1_lines,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_urls": op6_urls,
    "op7_language": op7_language,
    "op8_search": op8_search,
    "op9_pieces": op9_pieces,
    "op10_mixing": op10_mixing,
    "op11_spelling": op11_spelling,
    "op12_divergence": op12_divergence,
    "op13_chat": op13_chat,
}
SQL = {
    "op1_lines": OP1_SQL,
    "op6_urls": OP6_SQL,
    "op8_search": OP8_SQL,
    "op10_mixing": OP10_SQL,
    "op11_spelling": OP11_SQL,
    "op12_divergence": OP12_SQL,
    "op13_chat": OP13_SQL,
}
