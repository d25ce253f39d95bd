"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads
it again as the next one's docs. All but the last return the columns of documents, in their order and with further ones
that documents has, whatever their names. A stage neither adds nor repeats rows: rows that repeat an id are judged each by the first
two, stay or go together in the third, and lose the same words in the fourth if their texts are equal. Tables without rows stay so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import ngram_join, packing, quality_classifier, substrings, toxicity
from tallyframe.llm.common import Scratch

#: No SQL expresses the classifiers; the tests compare the stages with brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity.

    Null and empty texts score as texts without evidence; a row without an id is scored like any other. Where no labelled row
    is left to learn from, nothing is toxic.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is 0.5 or more.

    Null texts count as empty ones, null metadata as a value of its own. Without labelled rows everything has 0.5 and stays.
    """
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, _labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 0.8 over five-word shingles join, the one with the smallest id.

    Rows without an id or without words link with nothing and stay.
    """
    return ngram_join.one_each(docs, ngram_join.Rule(words=5, num=80, den=100))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 50-word windows that start in a document with a smaller id too.

    A text that loses words becomes those kept, one space between, and n_chars its length; others stay as they are, null and
    empty texts and rows without an id among them.
    """
    # The operator adds columns by name, so all others get names that can't clash.
    apart = {c: c if c in ("doc_id", "text") else f"own{i}" for i, c in enumerate(docs.columns)}
    out, lost = substrings.deduplicate(docs.toDF(*apart.values())), F.col("n_removed") > 0
    size = F.when(lost, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col(apart["n_chars"]))
    new = {"text": F.when(lost, F.col("kept")).otherwise(F.col("text")), "n_chars": size}
    return out.select(*(new.get(c, F.col(own)).alias(c) for c, own in apart.items()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens; a null text is an empty one: just the end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
