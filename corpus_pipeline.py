"""The corpus pipeline: toxicity filter, line dedup, SimHash near-dedup, source
mix and packing, each an operator of ``salesledger.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result in the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger.llm import line_dedup, mixing, packing, simhash, toxicity
from salesledger.llm.common import freeze, read
from salesledger.llm.queries import tokenizer_path

#: The models and the packing plan have no SQL form; tests use brute force.
ORACLE_SQL = None


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic, each row as it
    is: nulls, empty texts and repeated rows are scored like any other, so clean ones
    stay. Without labels the built-in word lists judge alone; an empty table stays
    empty."""
    return _columns(toxicity.score(docs, read(spark, sf_dir, "labels")).where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later copies of runs of lines; n_chars follows
    the text. A null text stays null; the first copy by (doc_id, null first, then a
    hash of the text) stays; repeated rows are cleaned alike and none is dropped."""
    found = line_dedup.remove_repeated_runs(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return _columns(found, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id
    (null last), of ties the least hash of its text, of equal rows one. Texts without
    a word, nulls included, form one group."""
    return _columns(simhash.keep_one(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row for each time that the mix takes the
    document, to the nearest whole number of times. One document of a source at
    most is taken in part; documents without words are never taken."""
    mixed = mixing.mix(docs)
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    rows = mixed.withColumn("_times", times).where("_times > 0").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return _columns(rows, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 4096, a row per piece. A null
    or empty text is its end id alone; rows that repeat a document are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = freeze(docs)
    return docs
