"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausewright.llm.common import table
from clausewright.llm.decontaminate import contamination_digest
from clausewright.llm.fingerprints import fingerprint_digest
from clausewright.llm.infill import infill_digest
from clausewright.llm.licenses import license_digest
from clausewright.llm.mixing import mix_digest
from clausewright.llm.neighbours import classify_quality
from clausewright.llm.passages import passages_digest
from clausewright.llm.phrases import collocations
from clausewright.llm.repeats import repeats_digest
from clausewright.llm.rules import quality_rules
from clausewright.llm.secrets import secret_digest
from clausewright.llm.simhash import near_duplicates
from clausewright.llm.sql import ORACLE_SQL
from clausewright.llm.tokens import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def on_documents(operator: Callable[..., DataFrame], *others: str) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), *(table(spark, sf_dir, name) for name in others))


QUERIES: dict[str, Query] = {
    "op1_secret_scans": on_documents(secret_digest),
    "op2_suffix_array_dedup": on_documents(repeats_digest),
    "op3_license_scans": on_documents(license_digest),
    "op4_quality_classifier": on_documents(classify_quality, "labels"),
    "op5_token_counts": on_documents(count_tokens),
    "op6_quality_rules": on_documents(quality_rules, "labels"),
    "op7_substring_dedup": on_documents(passages_digest),
    "op8_simhash_near_dedup": on_documents(near_duplicates),
    "op9_benchmark_decontamination": on_documents(contamination_digest, "benchmark"),
    "op10_source_mixing": on_documents(mix_digest),
    "op11_document_fingerprints": on_documents(fingerprint_digest),
    "op12_phrase_collocations": on_documents(collocations),
    "op13_fill_in_middle": on_documents(infill_digest),
}

__all__ = ["ORACLE_SQL", "QUERIES"]
