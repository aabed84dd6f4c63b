"""The package's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from newslens.llm.bpe import op13_byte_bpe
from newslens.llm.chat import OP10_SQL, op10_chat_format
from newslens.llm.decontaminate import OP6_SQL, op6_decontamination
from newslens.llm.fim import OP12_SQL, op12_fill_in_middle
from newslens.llm.linededup import OP7_SQL, op7_line_dedup
from newslens.llm.lm import op3_lm_scoring
from newslens.llm.mixing import OP4_SQL, op4_mixing
from newslens.llm.negatives import OP11_SQL, op11_hard_negatives
from newslens.llm.paragraphs import op9_paragraph_dedup
from newslens.llm.quality import op8_quality_rules
from newslens.llm.simhash import op1_simhash
from newslens.llm.suffixes import op5_suffix_dedup
from newslens.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_paragraph_dedup": op9_paragraph_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op4_mixing": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
