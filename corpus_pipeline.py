"""Documents to tokens in five stages; each takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.llm import langid, linededup, mixing, nbest, neardup
from herdlens.llm.common import discard, stored
from herdlens.llm.queries import vocabulary


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough certainty, with that language as lang."""
    return langid.filter_languages(docs, langid.learn(docs, ~langid.held_out(F.col("doc_id"))))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the text that is left of each and its length; those of which nothing but blanks is left go."""
    out = linededup.dedup_lines(docs).where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest doc_id. Five-word shingles, similarity 0.8 or more."""
    return neardup.dedup(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row's best segmentations, with their digests."""
    return nbest.encode(docs, vocabulary("piece_bpe_32k.model"), cache=100_000)  # workers hold what earlier stages left, too


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: Language ID, MinHash and the piece lattice are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all that the stages keep. What a stage returned goes when the next one's result is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{i + 1}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
