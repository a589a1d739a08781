"""A corpus pipeline: language, near-duplicates, benchmark passages, personal data, and a mix of the sources.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept; each result is written as
Parquet and read again. All stages but the last return the columns of documents, the last adds the mix's.
Null, empty and letterless texts go with the first stage (they have no language); very long texts are read whole by all. Of rows that repeat an
id and a text one stays after the second. Rows without an id pass the second (nothing names them as copies) and take part in the others.
Other columns are kept, whatever their names, but for those that the mix replaces. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.op1_decontaminate import clean
from nearfield.llm.op2_pii import redacted
from nearfield.llm.op6_mix import mixture
from nearfield.llm.op8_jaccard import BROADCAST_IDS, jaccard_groups, with_set
from nearfield.llm.op10_language import train, with_language
from nearfield.llm.scratch import Scratch

#: Words of a shingle and similarity, in hundredths, of near-duplicates.
SHINGLE, SIMILAR = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter (null and empty texts among them) or with no language ahead of the others go.

    Of languages that tie the first by code point counts, which then has half of the score at most and may go. Repeated rows are decided alike; nothing is learned
    from an empty table or one without lang, and then no document stays.
    """
    return with_language(docs, train(docs), least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id. Texts that share an id are told apart; of equal ones, or of one group, one stays.

    Ids that go or repeat are looked up by a broadcast where there are at most BROADCAST_IDS of them, by a shuffled join beyond.
    """
    scratch = Scratch(spark, "pipeline")
    again = scratch.table(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    repeated = again.count()
    groups = jaccard_groups(docs, words=SHINGLE, num=SIMILAR, den=100, named=repeated > 0)
    gone = scratch.table(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").union(again).distinct(), "gone")
    small = lambda ids, n: F.broadcast(ids) if n <= BROADCAST_IDS else ids
    single = docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    if not repeated:
        return single
    again = small(again, repeated)
    stay = groups.where(F.col("doc_id") == F.col("component_id")).join(again, "doc_id", "left_semi")
    stay = stay.select(F.col("doc_id").alias("_doc"), F.col("set_id").alias("_own"), F.col("group").alias("_group")).distinct()
    rows = with_set(docs.join(again, "doc_id", "left_semi").select(*docs.columns), "_set", words=SHINGLE)
    rows = rows.join(stay, (F.col("doc_id") == F.col("_doc")) & F.col("_set").eqNullSafe(F.col("_own")))
    rows = rows.withColumn("_text", F.when(F.col("_group").isNull(), F.col("text"))).dropDuplicates(["doc_id", "_group", "_text"])
    return single.unionByName(rows.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found, null and empty texts and rows without an id among them; repeated rows are decided alike. Without test items all stay."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind (of spans that overlap, the first and then the longest); n_chars follows. Null and empty texts, ids and repeated rows stay as they are."""
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with size, source_size, target and taken (the words that the mix takes), which replace columns of those names.

    Those go of which the mix takes no word. Rows without an id and rows that repeat one count as any other.
    """
    return mixture(docs, whole=True).where("taken > 0")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs


#: Language models, the random field and the overlap of passages are beyond SQL.
ORACLE_SQL = None
