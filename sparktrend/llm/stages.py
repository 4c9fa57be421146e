"""The stages of the corpus pipeline: quality, near-duplicates, personal data, mixture, packing.

Each takes (spark, docs, sf_dir), works on all rows of ``docs``, and returns a
DataFrame; all but the last return the columns of ``docs``, in their order.
``docs`` has doc_id, text and source; further columns of any name, also such
as the operators use themselves, come back as they were (but n_chars, which
follows a changed text). All stages take null texts as empty ones, texts of any
length whole, rows with null ids or sources, repeated rows and equal ids, and
an empty table, which gives no rows. None of them uses a column's order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrend.llm import mixing, packing, pii, quality, simhash
from sparktrend.llm.common import fresh, table
from sparktrend.llm.queries import DEMO_KEY, vocabulary

#: A document stays if its chance of good quality is at least this.
QUALITY = 0.3
#: Words that a worker of the last stage remembers, twice; executors also hold what the stages before have left.
WORDS = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rule ensemble, fitted on the labels of ``sf_dir``, gives a chance of good quality of ``QUALITY`` or more.

    Rows are scored each by its own text, so repeated rows go or stay together;
    a score of exactly ``QUALITY`` stays. Null and empty texts are scored like
    others. Without usable labels all score 0.5 and stay. The fit joins labels
    and rows by doc_id: null ids are not fitted on, equal ones each count.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh("__quality", docs.columns)
    return quality.score(docs, model, name=name).filter(F.col(name) >= QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of near-duplicates: a similarity of 0.8 or more on shingles of five words.

    Repeated rows are one group. Of rows that share the kept doc_id the least
    by text stays. Null and empty texts, and all others without words, are one
    group. Null ids take part and lose against any other.
    """
    return simhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by pseudonyms; n_chars, where there is one, follows the text.

    Every row stays. Null texts stay null (and so does their n_chars), empty ones empty.
    """
    moved = pii.pseudonymise(docs, DEMO_KEY)
    return moved.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else moved


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mixture takes them (a row for each take), sorted by training position.

    Null and empty texts have no words and are never taken. Rows of one source
    follow the hash of their doc_id; equal ids a hash of the text; equal rows
    are interchangeable. A null source is a source of its own.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}  # mixing adds columns of its own
    renamed = docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns])
    mixed = mixing.training_order(renamed, whole=True)
    return mixed.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens: a row for each piece (see ``packing.pack_documents``).

    Each row is a document of its own, repeated ones included; null and empty texts are one token.
    """
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 2048, entries=WORDS)
