"""Queries of this subpackage and their SQL, as the entry module registers them."""

from __future__ import annotations

from .conversation_trie import OP13_SQL, op13_conversation_trie
from .decontaminate import op9_decontaminate
from .language_model import op12_language_model
from .line_dedup import OP5_SQL, op5_line_dedup
from .minhash import op6_minhash
from .packing import op10_best_fit_packing
from .periodic_runs import OP11_SQL, op11_periodic_runs
from .quality_rules import OP2_SQL, op2_quality_rules
from .rule_ensemble import op4_rule_ensemble
from .secrets import op3_secret_scan
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .url_filter import OP1_SQL, op1_url_filter
from .warc import OP7_SQL, op7_warc

QUERIES = {"op1_url_filter": op1_url_filter, "op2_quality_rules": op2_quality_rules, "op3_secret_scan": op3_secret_scan, "op4_rule_ensemble": op4_rule_ensemble, "op5_line_dedup": op5_line_dedup, "op6_minhash": op6_minhash, "op7_warc": op7_warc, "op8_substring_dedup": op8_substring_dedup, "op9_decontaminate": op9_decontaminate, "op10_best_fit_packing": op10_best_fit_packing, "op11_periodic_runs": op11_periodic_runs, "op12_language_model": op12_language_model, "op13_conversation_trie": op13_conversation_trie}
ORACLES = {"op1_url_filter": OP1_SQL, "op2_quality_rules": OP2_SQL, "op5_line_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op11_periodic_runs": OP11_SQL, "op13_conversation_trie": OP13_SQL}
