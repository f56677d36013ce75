"""The operators as named queries over the given tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_repair import OP12_SQL, op12_conversation_repair
from .decontamination import OP1_SQL, op1_decontamination
from .embedding_dedup import op6_embedding_dedup
from .language_model import op5_lm_scoring
from .lexical_search import OP13_SQL, op13_lexical_search
from .licenses import OP10_SQL, op10_licenses
from .line_dedup import OP8_SQL, op8_line_dedup
from .near_dedup import op2_near_dedup
from .mixing import OP3_SQL, op3_mixing
from .secret_scan import OP4_SQL, op4_secret_scan
from .sharding import OP11_SQL, op11_sharding
from .toxicity import op9_toxicity
from .token_counts import op7_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_decontamination, op2_near_dedup, op3_mixing, op4_secret_scan, op5_lm_scoring, op6_embedding_dedup, op7_token_counts, op8_line_dedup, op9_toxicity,
    op10_licenses, op11_sharding, op12_conversation_repair, op13_lexical_search)}

SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op3_mixing": OP3_SQL, "op4_secret_scan": OP4_SQL, "op8_line_dedup": OP8_SQL,
                       "op10_licenses": OP10_SQL, "op11_sharding": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_lexical_search": OP13_SQL}
