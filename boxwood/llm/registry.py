"""The queries of this subpackage, and the SQL for those that SQL expresses."""

from __future__ import annotations

from boxwood.llm.chat_formatting import op6_chat_formatting
from boxwood.llm.decontamination import OP12_SQL, op12_decontamination
from boxwood.llm.html_extraction import op5_html_extraction
from boxwood.llm.jaccard_join import OP4_SQL, op4_jaccard_join
from boxwood.llm.lm_scoring import op7_lm_scoring
from boxwood.llm.mixing import op8_mixing
from boxwood.llm.packing import op9_best_fit_packing
from boxwood.llm.quality_rules import op2_quality_rules
from boxwood.llm.secret_scans import op3_secret_scans
from boxwood.llm.token_alignment import op13_token_alignment
from boxwood.llm.topk_search import OP1_SQL, op1_topk_search
from boxwood.llm.url_filters import OP10_SQL, op10_url_filters
from boxwood.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_topk_search, op2_quality_rules, op3_secret_scans, op4_jaccard_join, op5_html_extraction, op6_chat_formatting, op7_lm_scoring, op8_mixing, op9_best_fit_packing, op10_url_filters, op11_whitening, op12_decontamination, op13_token_alignment)}
ORACLE_SQL = {"op1_topk_search": OP1_SQL, "op4_jaccard_join": OP4_SQL, "op10_url_filters": OP10_SQL, "op12_decontamination": OP12_SQL}
