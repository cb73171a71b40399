"""One query per operator, applied with production parameters to whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talus.llm import bpe, language, licenses, mixing, periodic, quality, rules, scoring, sharding, simhash, topk, toxicity, whitening
from talus.llm.common import table

TOKENIZER = "word_bpe_49k.json"
Query = Callable[[SparkSession, str], DataFrame]


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_language": _documents(language.digest),
    "op2_lm_score": _documents(scoring.score),
    "op3_toxicity": lambda s, d: toxicity.digest(table(s, d, "documents"), table(s, d, "labels")),
    "op4_top_k": lambda s, d: topk.digest(table(s, d, "embeddings")),
    "op5_sharding": _documents(sharding.digest),
    "op6_mixing": _documents(mixing.digest),
    "op7_bpe": _documents(lambda docs: bpe.digest(docs, public_tokenizers.path(TOKENIZER))),
    "op8_simhash": _documents(simhash.digest),
    "op9_quality": _documents(quality.digest),
    "op10_licenses": _documents(lambda docs: licenses.digest(docs, licenses.NOTICES + licenses.NAMED, licenses.CONTRACT_BASE)),
    "op11_whitening": lambda s, d: whitening.digest(table(s, d, "embeddings")),
    "op12_periodic_runs": _documents(periodic.digest),
    "op13_quality_classifier": lambda s, d: rules.digest(table(s, d, "documents"), table(s, d, "labels")),
}

SQL: dict[str, str] = {"op4_top_k": topk.SQL, "op5_sharding": sharding.SQL}
