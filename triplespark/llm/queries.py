"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from triplespark.llm.ann import op2_nearest
from triplespark.llm.chat import OP1_SQL, op1_chat_formatting
from triplespark.llm.decontamination import op6_decontamination
from triplespark.llm.language_id import op7_language_id
from triplespark.llm.packing import op4_best_fit_packing
from triplespark.llm.pii import OP3_SQL, op3_pii
from triplespark.llm.quality import op5_quality
from triplespark.llm.simhash import op9_simhash
from triplespark.llm.token_counts import op8_token_counts
from triplespark.llm.toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_nearest, op3_pii, op4_best_fit_packing, op5_quality, op6_decontamination,
    op7_language_id, op8_token_counts, op9_simhash, op10_toxicity)}
ORACLES = {"op1_chat_formatting": OP1_SQL, "op3_pii": OP3_SQL}
