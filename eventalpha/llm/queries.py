"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat_format import op7_budgeted_windows
from .decontamination import op5_bm25_wand
from .line_dedup import OP10_SQL, op10_site_line_dedup
from .personal_data import op12_context_bootstrap
from .phrase_dedup import OP8_SQL, op8_phrase_automata
from .quality_model import op1_rule_ensemble
from .quality_rules import OP4_SQL, op4_host_rules
from .secrets import OP2_SQL, op2_secret_randomness
from .sharding import op9_hypergeometric_shards
from .simhash import op3_simhash_gray
from .subword_sampling import op6_gumbel_lattice
from .token_alignment import op11_shared_cuts
from .whitening import op13_mixed_precision

QUERIES = {
    f.__name__: f
    for f in (op1_rule_ensemble, op2_secret_randomness, op3_simhash_gray, op4_host_rules, op5_bm25_wand, op6_gumbel_lattice, op7_budgeted_windows, op8_phrase_automata, op9_hypergeometric_shards, op10_site_line_dedup, op11_shared_cuts, op12_context_bootstrap, op13_mixed_precision)
}

ORACLE_SQL = {"op2_secret_randomness": OP2_SQL, "op4_host_rules": OP4_SQL, "op8_phrase_automata": OP8_SQL, "op10_site_line_dedup": OP10_SQL}
