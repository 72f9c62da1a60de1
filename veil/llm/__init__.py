"""Operators for training data. `QUERIES` and `ORACLES` hold their registered queries."""

from veil.llm.chat import ORACLE as CHAT_SQL
from veil.llm.chat import op2_chat_format
from veil.llm.decontaminate import op1_decontamination
from veil.llm.langid import op7_language_id
from veil.llm.merkle import ORACLE as MERKLE_SQL
from veil.llm.merkle import op11_merkle_manifest
from veil.llm.mixing import op4_mixing
from veil.llm.output import op9_token_output
from veil.llm.pii import op6_pii
from veil.llm.quality import op10_quality
from veil.llm.repair import ORACLE as REPAIR_SQL
from veil.llm.repair import op12_structure_repair
from veil.llm.repeats import ORACLE as REPEATS_SQL
from veil.llm.repeats import op13_substring_dedup
from veil.llm.simhash import op3_simhash
from veil.llm.tokens import op8_token_counts
from veil.llm.vectors import op5_embedding_dedup

_ALL = (
    op1_decontamination, op2_chat_format, op3_simhash, op4_mixing, op5_embedding_dedup, op6_pii, op7_language_id, op8_token_counts,
    op9_token_output, op10_quality, op11_merkle_manifest, op12_structure_repair,
    op13_substring_dedup,
)
QUERIES = {q.__name__: q for q in _ALL}
ORACLES = {"op2_chat_format": CHAT_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_structure_repair": REPAIR_SQL, "op13_substring_dedup": REPEATS_SQL}
