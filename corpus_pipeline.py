"""A training corpus from the documents table, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the
columns of documents; the last writes the token blocks and returns what is read back from them. Texts go to Python
in small batches (small_batches), as an executor's memory has to hold them beside its full heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import decontam, minhash, mixing, quality, tokens
from quire.llm.common import Stages, small_batches, table
from quire.llm.queries import tokenizer_path

#: A document whose quality score is below this goes.
QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as one empty passage, repeated rows fare alike, and texts of one id are
    scored apart. An empty table, or one without labels, goes on as it is: every score is 0.5 then.
    """
    small_batches(spark)
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where(F.col("score") >= QUALITY).select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays, once.

    Rows equal in id and text are one document, and so are the texts of one id: the first by its text
    stays. Texts without words, and rows without an id, are linked with nothing and all stay.
    An empty table stays empty.
    """
    small_batches(spark)
    stages = Stages(spark, "kept")
    gone = stages.put(minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    named, nameless = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    twice = stages.put(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    left = named.join(gone, "doc_id", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return left.unionByName(nameless)
    text = F.coalesce("text", F.lit(""))
    own = F.struct((~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), text.alias("words"), F.struct("*").alias("row"))  # a text with words first
    first = left.join(twice, "doc_id", "left_semi").select(docs.columns).groupBy("doc_id").agg(F.min(own).alias("own"))
    alone = left.join(twice, "doc_id", "left_anti").select(docs.columns)
    return alone.unionByName(first.select("own.row.*").select(docs.columns)).unionByName(nameless)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside any benchmark window are cut out of the texts, until no window is left; all rows stay.

    Null texts stay null, repeated rows are cut alike; an empty benchmark, or an empty table, changes nothing.
    """
    small_batches(spark)
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(now.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says.

    Rows of one id each come as often as the id's greatest rate says, those without an id as null's; null and
    empty texts have a rate as all others have. An empty table stays empty.
    """
    small_batches(spark)
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    rates = mixing.mix(docs, labelled, mixing.TARGETS, mixing.BUDGET)
    rates = rates.groupBy(F.col("doc_id").alias("rated_id")).agg(F.max("copies").alias("copies")).where("copies > 0")
    out = docs.join(rates, F.col("doc_id").eqNullSafe(F.col("rated_id"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in blocks, by ascending id; a document that the mix repeats is repeated.

    Null and empty texts are the end id alone, a null id comes first. An empty table gives no rows.
    """
    small_batches(spark)
    return tokens.read_tokens(tokens.write_tokens(docs, tokenizer_path()))


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("token_output", token_stage)]

#: Trained models and a tokenizer: SQL can't express these stages. tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stages = table(spark, sf_dir, "documents"), Stages(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stages.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
