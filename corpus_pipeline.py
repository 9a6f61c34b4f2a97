"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last
return the columns of documents; n_chars follows the text. Rows that share a doc_id are decided alike,
but for near duplicates, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subgrove.llm.components import stored
from subgrove.llm.decontamination import decontaminate
from subgrove.llm.line_templates import line_templates
from subgrove.llm.ngram_jaccard import ngram_jaccard
from subgrove.llm.registry import held_out, tokenizer_path
from subgrove.llm.toxic_spans import toxic_spans, train
from subgrove.llm.vector_packing import best_fit_packing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = ids.select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. The model learns from labelled rows of the documents that come in. Null and empty texts are not toxic; repeated rows are scored alike; of a very long text every token counts."""
    model = train(docs, _read(spark, sf_dir, "labels"), ~held_out())
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    return toxic_spans(docs, model, threshold=0.3, carry=rest).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays. In documents that are mostly such lines and that the next stage would link, only lines that recur
    beyond their linked copies go, so that the one copy that stays keeps its own text. Null and empty texts stay as they are; repeated rows count as documents."""
    out = line_templates(docs, copies=(75, 100), carry=("lang", "source", "n_chars"))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked rows one stays, that of the least doc_id (a null one only where there is no other; of rows of one doc_id that of the
    least text hash, of equal texts the least of the other columns). Rows without words are linked with nothing, and rows of equal doc_id and text count as one."""
    named = docs.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text"))))
    classes = ngram_jaccard(named.select("row", "text"), n=5, similarity=(75, 100), id_col="row").groupBy(F.col("doc_id").alias("row")).agg(F.first("component_id").alias("component_id"), F.count("*").alias("times"))
    first = F.min(F.struct(F.col("row").startswith("-:").alias("none"), F.regexp_replace("row", ":[0-9A-F]*$", "").try_cast(docs.schema["doc_id"].dataType).alias("id"), "row", "times"))
    kept = stored(classes.groupBy("component_id").agg(first.alias("first")).select("first.row", "first.times"))
    single = named.join(kept.where("times = 1"), "row", "left_semi").select(*COLUMNS)
    alike = named.join(kept.where("times > 1"), "row", "left_semi").groupBy("row").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("d"))
    return single.unionByName(alike.select("d.*").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their length, with all rows of their doc_id (null ids, too). Null and empty texts hold none and stay; without items all stay."""
    return _without(docs, decontaminate(docs, _read(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of documents in sequences of at most 2048 tokens. Null texts are empty; longer texts are cut; repeated rows are packed each; no rows give none."""
    return best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The model, alignment and tokenizer can't be expressed in SQL. Tests hold every stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
