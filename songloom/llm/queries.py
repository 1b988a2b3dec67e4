"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

import corpus_pipeline
from songloom.llm.bloom_lm import op5_lm_scoring
from songloom.llm.collocations import OP13_SQL, op13_collocations
from songloom.llm.decontaminate import OP10_SQL, op10_benchmark_decontamination
from songloom.llm.fill_middle import OP11_SQL, op11_fill_in_middle
from songloom.llm.host_rules import OP2_SQL, op2_host_rules
from songloom.llm.html_templates import op12_html_extraction
from songloom.llm.line_dedup import op9_line_dedup
from songloom.llm.mixing import OP7_SQL, op7_mixing
from songloom.llm.near_join import op4_ngram_jaccard_join
from songloom.llm.token_files import op8_token_files
from songloom.llm.toxicity import op6_toxicity
from songloom.llm.url_templates import OP3_SQL, op3_url_filters
from songloom.llm.weak_labels import op1_quality_classifier

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_classifier": op1_quality_classifier,
    "op2_host_rules": op2_host_rules,
    "op3_url_filters": op3_url_filters,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_html_extraction": op12_html_extraction,
    "op13_collocations": op13_collocations,
}
SQL = {
    "op2_host_rules": OP2_SQL,
    "op3_url_filters": OP3_SQL,
    "op7_mixing": OP7_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
