"""The corpus pipeline: five stages in order, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``:

1. toxicity: documents that the classifier chain (trained on ``labels``) calls toxic go.
2. SimHash near-dedup: in the order of doc_ids, a document goes if its five-word shingles have a similarity of at least 0.8 with a
   document that stays. Pigeonring chains of wide SimHash fingerprints name the pairs to compare; each is counted over whole texts.
3. PII: every span of personal data is replaced by its kind.
4. mixing: documents appear as often, and as far, as the mix to target weights takes them.
5. byte-level BPE: each text becomes token ids, which are decoded again to show that nothing is lost.

Nulls and odd input are handled as each operator says: null texts are clean, empty and alike among themselves; rows without
doc_id stay; an empty table gives an empty result. Columns besides those of ``documents`` pass through stages 1 to 4.
"""

from pyspark.sql import functions as F

from graphloom.llm import bpe, mixing, pii, simhash, toxicity
from graphloom.sources.ship import ship

#: The classifier chain, EM and the mix's draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def reject_toxic(spark, docs, sf_dir):
    ship(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    ship(spark)
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def redact(spark, docs, sf_dir):
    return pii.redact(docs)


def mix(spark, docs, sf_dir):
    ship(spark)
    return mixing.mixed_documents(docs)


def tokenize(spark, docs, sf_dir):
    ship(spark)
    coded = bpe.code(docs)
    same = F.col("decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("toxicity", reject_toxic), ("simhash near-dedup", near_dedup), ("pii", redact), ("mixing", mix), ("byte-level bpe", tokenize)]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
