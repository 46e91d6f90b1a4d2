"""From raw documents to packed sequences: toxicity, exact and near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again for the next one. All but the last return the columns of documents.

The stages that drop copies decide by row, so of a group one row stays, whether ids are
null or repeated: a row is known by its file and its place there. Texts are never
shuffled; a stage finds the rows to drop by digests or signatures and takes those out
where the documents lie.

In every stage a null text counts as empty, texts of any length are taken whole, further
columns of docs are kept as they are (packing leaves them out), and an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from basketry.llm._spark import Scratch, saved, sized

#: The column that numbers rows within a stage.
ROW = "__row_number__"
#: Bits of a row's number that are its place in its file.
PLACE_BITS = 40


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row that is the same in every scan of its files. What doesn't come from files is written first. The table of file numbers that is broadcast has a row for each file, as the driver's own list of files has."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = saved(docs, "rows")
    path = F.col("_metadata.file_path")
    files = sorted(r[0] for r in docs.select(path.alias("path")).distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "__file_number__ long, __file__ string")
    placed = docs.select("*", path.alias("__path__"), F.col("_metadata.row_index").alias("__place__"))
    placed = placed.join(F.broadcast(numbers), F.col("__path__") == F.col("__file__"))
    return placed.select(*docs.columns, (F.shiftleft("__file_number__", PLACE_BITS) + F.col("__place__")).alias(ROW))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered docs but for the rows of a saved table (gone), without the numbers. Few rows to drop are broadcast, more are shuffled."""
    return docs.join(sized(gone), docs[ROW] == gone["gone"], "left_anti").drop(ROW)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, by a model of the labels that aren't held out. Fitting reads the labels' own documents. Repeated rows and null ids are scored each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")), label_column="toxic")
    return toxicity.without_toxic(docs, model, threshold=0.7)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest text, of those the least id (null ids last), of those the first row."""
    docs, scratch = numbered(docs), Scratch(spark)
    found = exact_dedup.exact_duplicates(docs, row_column=ROW)
    return without(docs, scratch.save(found.where(~F.col("kept")).select(F.col("row_key").alias("gone")), "gone"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles with a similarity of 0.8 or more: the one with the least id (null ids last), of those by a hash of the text, of those the first row. Rows that share an id but aren't linked stay."""
    docs, scratch = numbered(docs), Scratch(spark)
    near = near_dedup.near_duplicates(docs, shingle=5, percent=80, id_column=ROW).select(F.col("doc_id").alias("member"), F.col("component_id").alias("component"))
    # A component of more than one row is known by the rows that don't name it.
    shared = scratch.save(near.where("member != component").select("component").distinct(), "shared")
    members = scratch.save(near.join(sized(shared), "component", "left_semi"), "members")
    slim = docs.select(ROW, "doc_id", F.xxhash64("text").alias("text_hash"))
    members = slim.join(sized(members), F.col(ROW) == F.col("member")).select("component", "member", "doc_id", "text_hash")
    members = scratch.save(members, "members of components")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "member")
    stays = scratch.save(members.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.member").alias("stays")), "stays")
    gone = scratch.save(members.join(sized(stays), members["member"] == stays["stays"], "left_anti").select(F.col("member").alias("gone")), "gone")
    scratch.drop("shared", "members", "members of components", "stays")
    return without(docs, gone)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten consecutive words of a benchmark item (or a shorter item) occur. Rows are judged each by its text alone."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths up to 1024 tokens, with their ids. Every row is packed, whatever its id."""
    from public_tokenizers import path

    return packing.pack(docs, path("byte_bpe_50k.json"), longest=1024)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_exact_copies),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: Neither the learned scores nor the tokenizer's ids can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
