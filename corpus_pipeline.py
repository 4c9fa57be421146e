"""The corpus pipeline: quality, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs``, and
returns a DataFrame; all but the last return the columns of ``docs``. What
they do with nulls, ties and odd columns is told in ``sparktrend.llm.stages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparktrend.llm import stages
from sparktrend.llm.common import discard, materialize, scoped, table

STAGES = [("quality", stages.quality_stage), ("simhash_near_dedup", stages.dedup_stage), ("pii", stages.pii_stage), ("mixing", stages.mixing_stage), ("packing", stages.packing_stage)]

#: SQL can't express the fitted classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


@scoped
def _written(name: str, stage: Callable[..., DataFrame], spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return materialize(stage(spark, docs, sf_dir), name)


@scoped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written and read again, and deleted after the next, as is what a stage has written on its way."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = _written(name, stage, spark, docs, sf_dir)
        discard(*written)
        written = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads the pieces that it has written
    discard(*written)
    return packed
