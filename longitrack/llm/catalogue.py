"""The queries of this package and their SQL twins."""

from __future__ import annotations

from longitrack.llm.byte_bpe import op8_byte_bpe
from longitrack.llm.collocations import OP11_SQL, op11_collocations
from longitrack.llm.fingerprints import op2_fingerprints
from longitrack.llm.host_reputation import OP1_SQL, op1_host_reputation
from longitrack.llm.html_text import op5_html_text
from longitrack.llm.orc_tokens import op3_orc_tokens
from longitrack.llm.packing import op9_pack_documents
from longitrack.llm.periodic_runs import op12_periodic_runs
from longitrack.llm.private_data import op13_private_data
from longitrack.llm.quadratic_quality import op7_quadratic_quality
from longitrack.llm.similarity import OP10_SQL, op10_jaccard_join
from longitrack.llm.toxicity import op4_toxicity
from longitrack.llm.weak_quality import op6_weak_quality

QUERIES = {
    "op1_host_reputation": op1_host_reputation,
    "op2_fingerprints": op2_fingerprints,
    "op3_orc_tokens": op3_orc_tokens,
    "op4_toxicity": op4_toxicity,
    "op5_html_text": op5_html_text,
    "op6_weak_quality": op6_weak_quality,
    "op7_quadratic_quality": op7_quadratic_quality,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_pack_documents": op9_pack_documents,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_private_data": op13_private_data,
}
SQL = {
    "op1_host_reputation": OP1_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op11_collocations": OP11_SQL,
}
