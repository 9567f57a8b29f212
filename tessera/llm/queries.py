"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from tessera.llm.decontaminate import op3_decontaminate
from tessera.llm.langid import op7_langid
from tessera.llm.mixing import OP8_SQL, op8_mixing
from tessera.llm.near_dedup import op9_near_dedup
from tessera.llm.quality_model import op10_quality
from tessera.llm.quality_rules import OP1_SQL, op1_quality_rules
from tessera.llm.suffix_dedup import op5_suffix_dedup
from tessera.llm.token_counts import op2_token_counts
from tessera.llm.token_output import op6_tokens
from tessera.llm.url_filters import OP4_SQL, op4_url_filters

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_decontaminate, op4_url_filters, op5_suffix_dedup, op6_tokens, op7_langid, op8_mixing, op9_near_dedup, op10_quality)}
SQL = {"op1_quality_rules": OP1_SQL, "op4_url_filters": OP4_SQL, "op8_mixing": OP8_SQL}
