"""Queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from .curves import op4_hilbert_ann
from .decontaminate import OP1_SQL, op1_decontaminate
from .fim import OP13_SQL, op13_fill_in_middle
from .jaccard import OP3_SQL, op3_jaccard_join
from .langid import op2_language_id
from .licenses import OP8_SQL, op8_licenses
from .lm import op10_lattice_lm
from .mixing import op7_mix
from .pii import op5_pii
from .reshard import op6_reshard
from .suffix_dedup import OP9_SQL, op9_suffix_dedup
from .toxicity import op11_toxicity
from .trie import OP12_SQL, op12_prefix_trie

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_hilbert_ann": op4_hilbert_ann,
    "op5_pii": op5_pii,
    "op6_reshard": op6_reshard,
    "op7_mix": op7_mix,
    "op8_licenses": op8_licenses,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_lattice_lm": op10_lattice_lm,
    "op11_toxicity": op11_toxicity,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {
    "op1_decontaminate": OP1_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op8_licenses": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
