"""Five filtering and packing stages over ``documents``, each written as Parquet and read again by the next.

Every stage decides on rows, not on ids: a null or repeated ``doc_id`` neither saves a row nor takes another one with it. The columns of the input pass
through as they are, whatever their names. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.decontaminate import with_matches
from corpusmill.llm.jaccard_join import without_duplicates
from corpusmill.llm.packing import packed_documents
from corpusmill.llm.secrets import without_secrets
from corpusmill.llm.toxicity import held_out, scored, train
from corpusmill.sources.tables import table, written

_ROW = "corpus_pipeline_row"


def _rows(docs: DataFrame) -> DataFrame:
    """The input's columns as one struct beside what a stage looks at, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW), F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")


def _back(rows: DataFrame) -> DataFrame:
    return rows.select(f"{_ROW}.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text the classifier rejects at the threshold of their language.

    Null and empty texts hold no evidence and stay; equal texts of one language share a verdict; long texts are scored whole; without labels of both kinds all stay.
    """
    rows = _rows(docs)
    model, thresholds = train(rows.select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id"))))
    return _back(scored(rows, model, thresholds).where("lang_predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked or equal texts: the one with the smallest id (nulls last; of rows that repeat an id, one).

    Null texts and texts without words link with nothing and stay, repeated or not.
    """
    return without_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item. Null and empty texts match nothing, nor do items without words."""
    return _back(with_matches(_rows(docs), table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in which a secret was found. Null and empty texts hold none; equal texts share a verdict."""
    return _back(without_secrets(_rows(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens: a row for each piece. A null text is empty and has its end token alone; repeated rows are packed each."""
    import public_tokenizers

    # Little is remembered here: the stages before have filled the executors.
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_bytes=24 << 20, keep=False)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: Stages 1, 3 and 5 use a trained model, a latent space and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
