"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.decontaminate import op4_decontaminate
from tidewell.llm.html_text import op9_html_text
from tidewell.llm.jaccard import OP6_SQL, op6_jaccard_join
from tidewell.llm.language import op7_language_id
from tidewell.llm.middle import OP11_SQL, op11_fill_in_middle
from tidewell.llm.multi_index import OP13_SQL, op13_embedding_dedup
from tidewell.llm.negatives import OP12_SQL, op12_hard_negatives
from tidewell.llm.packing import op5_best_fit_packing
from tidewell.llm.pii import op1_sanitise
from tidewell.llm.quality import op8_quality
from tidewell.llm.secrets import OP3_SQL, op3_secret_scan
from tidewell.llm.token_tree import op10_token_counts
from tidewell.llm.topk import OP2_SQL, op2_exact_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sanitise": op1_sanitise,
    "op2_exact_topk": op2_exact_topk,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op9_html_text": op9_html_text,
    "op10_token_counts": op10_token_counts,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_embedding_dedup": op13_embedding_dedup,
}

#: DuckDB twins of those queries that SQL can express.
SQL: dict[str, str] = {
    "op2_exact_topk": OP2_SQL,
    "op3_secret_scan": OP3_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_embedding_dedup": OP13_SQL,
}
