"""The corpus queries, one per operator, and the SQL that checks them where SQL can."""

from __future__ import annotations

from stationwise.llm.bpe import op12_transducer_bpe
from stationwise.llm.collocations import OP11_SQL, op11_rabin_karp
from stationwise.llm.decontaminate import op5_latent_semantic
from stationwise.llm.filter_audit import OP13_SQL, op13_sql_folds
from stationwise.llm.html_extract import op8_wrapper_induction
from stationwise.llm.line_dedup import OP2_SQL, op2_cuckoo_lines
from stationwise.llm.lm import op3_gated_recurrent
from stationwise.llm.mixing import op1_pivotal_rounding
from stationwise.llm.near_dup import op9_multi_index_minhash
from stationwise.llm.quality import op10_compression_bands
from stationwise.llm.sharding import op6_jump_hash
from stationwise.llm.substring import OP4_SQL, op4_fm_index
from stationwise.llm.warc import OP7_SQL, op7_loser_tree_merge

QUERIES = {f.__name__: f for f in (op1_pivotal_rounding, op2_cuckoo_lines, op3_gated_recurrent, op4_fm_index, op5_latent_semantic, op6_jump_hash, op7_loser_tree_merge, op8_wrapper_induction, op9_multi_index_minhash, op10_compression_bands, op11_rabin_karp, op12_transducer_bpe, op13_sql_folds)}
ORACLES: dict[str, str] = {"op2_cuckoo_lines": OP2_SQL, "op4_fm_index": OP4_SQL, "op7_loser_tree_merge": OP7_SQL, "op11_rabin_karp": OP11_SQL, "op13_sql_folds": OP13_SQL}
