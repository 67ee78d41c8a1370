"""Queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from ratelake.llm import chat_format, fill_middle, ngram_join, spelling, substring_dedup
from ratelake.llm.chat_format import op3_chat_format
from ratelake.llm.decontamination import op10_decontamination
from ratelake.llm.fill_middle import op12_fill_middle
from ratelake.llm.line_dedup import op8_line_dedup
from ratelake.llm.mixing import op2_mixing
from ratelake.llm.ngram_join import op13_jaccard_join
from ratelake.llm.ordinal_classifier import op5_quality_classifier
from ratelake.llm.quality_rules import op1_quality_rules
from ratelake.llm.simhash import op6_simhash
from ratelake.llm.spelling import op11_spelling
from ratelake.llm.substring_dedup import op9_substring_dedup
from ratelake.llm.token_output import op7_token_output
from ratelake.llm.url_filter import op4_url_filter

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_chat_format": op3_chat_format,
    "op4_url_filter": op4_url_filter,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_simhash": op6_simhash,
    "op7_token_output": op7_token_output,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_spelling": op11_spelling,
    "op12_fill_middle": op12_fill_middle,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat_format.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_spelling": spelling.ORACLE_SQL,
    "op12_fill_middle": fill_middle.ORACLE_SQL,
    "op13_jaccard_join": ngram_join.ORACLE_SQL,
}
