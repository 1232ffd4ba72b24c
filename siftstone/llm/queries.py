"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from siftstone.llm.decontaminate import op5_decontaminate
from siftstone.llm.html_text import op10_html_text
from siftstone.llm.line_dedup import OP3_SQL, op3_line_dedup
from siftstone.llm.quality_classifier import op7_quality_classifier
from siftstone.llm.quality_rules import op2_quality_rules, op2_sql
from siftstone.llm.simhash_dedup import op9_simhash
from siftstone.llm.source_mixing import OP6_SQL, op6_source_mixing
from siftstone.llm.substring_dedup import OP8_SQL, op8_substring_dedup
from siftstone.llm.token_counts import op1_token_counts
from siftstone.llm.toxicity import op4_toxicity


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality_rules": op2_quality_rules,
        "op3_line_dedup": op3_line_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_decontaminate": op5_decontaminate,
        "op6_source_mixing": op6_source_mixing,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_simhash": op9_simhash,
        "op10_html_text": op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": op2_sql(),
        "op3_line_dedup": OP3_SQL,
        "op6_source_mixing": OP6_SQL,
        "op8_substring_dedup": OP8_SQL,
    }
