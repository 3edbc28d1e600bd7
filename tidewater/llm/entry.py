"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import oracles
from tidewater.llm.op9_embeddings import op9_embeddings
from tidewater.llm.op10_packing import op10_packing
from tidewater.llm.op11_merkle import op11_merkle
from tidewater.llm.op12_langid import op12_langid
from tidewater.llm.op13_turns import op13_turns
from tidewater.llm.op1_jaccard import op1_jaccard
from tidewater.llm.op2_hmm import op2_hmm
from tidewater.llm.op3_repeats import op3_repeats
from tidewater.llm.op4_backtrack_bpe import op4_bpe_codec
from tidewater.llm.op5_trie_counts import op5_token_counts
from tidewater.llm.op6_fingerprints import op6_fingerprints
from tidewater.llm.op7_rans_files import op7_token_files
from tidewater.llm.op8_quality import op8_quality

_QUERIES = (op1_jaccard, op2_hmm, op3_repeats, op4_bpe_codec, op5_token_counts, op6_fingerprints, op7_token_files, op8_quality, op9_embeddings, op10_packing, op11_merkle, op12_langid, op13_turns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard": oracles.OP1, "op3_repeats": oracles.OP3, "op9_embeddings": oracles.OP9, "op11_merkle": oracles.OP11, "op13_turns": oracles.OP13}
