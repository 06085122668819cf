"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns the packed pieces with a digest of their ids. A stage's output is written as Parquet in the
shared folder and read again by the next.

Documents without a text, or without a letter in it, have no language and go, as do those whose language is in doubt;
what fails a quality rule goes; of each group of near-duplicates, texts that share 80 percent or more of their five-word
shingles, the one with the least id stays, once; the mix repeats
or leaves out documents until the sources come near their targets, so its output holds some documents several times, and
is written shard by shard in the random order that the mix draws; packing takes the records as they stand there. An empty
table passes through all stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language, mixing, neardup, packing, quality
from quillon.llm.common import staged

#: Below this score a language is in doubt: no language has half of the probability.
LEAST_SCORE = 0.5
#: Similarity, in hundredths, from which texts are near-duplicates.
NEAR_PERCENT = 80
TOKENIZER = "word_bpe_49k.json"


def _same(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.predict(docs, language.fit(docs))
    lang, score = F.col(language.P + "lang"), F.col(language.P + "score")
    return _same(docs, found.where((lang != "und") & (score >= LEAST_SCORE)))


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.representatives(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _same(docs, mixing.shuffled(mixing.mix(docs), mixing.slices_for(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_texts(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained network and drawn blocks are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
