"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import annuli, importance, langid, licenses, linededup, mixing, nbest, neardup, pivots, sharding, tokenbin, toxicity, vptree
from .common import documents

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_license_scan(spark, sf_dir):
    """score: the share of the text's words within a span."""
    found = licenses.scan(documents(spark, sf_dir))
    names = "array_join(array_sort(array_distinct(transform({}, s -> s.label))), ',')"
    base = "filter(spans, s -> not s.template)"
    covered = "aggregate(spans, named_struct('to', 0L, 'n', 0L), (a, s) -> named_struct('to', greatest(a.to, s.first_word + s.n_words), 'n', a.n + greatest(0L, s.first_word + s.n_words - greatest(a.to, s.first_word))), a -> a.n)"
    return found.selectExpr(
        "doc_id",
        "n_words",
        f"cast(size({base}) as bigint) n_base",
        f"array_min(transform({base}, s -> s.first_word)) first_word",
        f"array_max(transform({base}, s -> s.first_word)) last_word",
        f"{names.format(base)} base_labels",
        f"{names.format('spans')} labels",
        f"case when n_words > 0 then {covered} / n_words else 0D end score",
    )


def op2_minhash_near_dedup(spark, sf_dir):
    out = neardup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), k=4)
    return out.select(F.col("nd_doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("nd_doc") == F.col("component")).alias("kept"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_ids(spark, sf_dir):
    return tokenbin.read_digests(tokenbin.write_ids(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("word_bpe_49k.json")))


def op4_line_dedup(spark, sf_dir):
    out = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_nbest_pieces(spark, sf_dir):
    return nbest.encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op6_sharding(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.assign(docs, "doc_id", SHARDS)


def op7_vantage_point_ann(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vptree.search(vptree.build(vectors, "vec_id", "embedding"), vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", k=10)


def op8_exact_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return pivots.top_k(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20)


def op9_source_mixing(spark, sf_dir):
    out = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.learn(docs, ~langid.held_out(F.col("doc_id")))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op11_importance_resampling(spark, sf_dir):
    out = importance.resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    return toxicity.predict(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return annuli.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", "label")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_token_ids": op3_token_ids,
    "op4_line_dedup": op4_line_dedup,
    "op5_nbest_pieces": op5_nbest_pieces,
    "op6_sharding": op6_sharding,
    "op7_vantage_point_ann": op7_vantage_point_ann,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_source_mixing": op9_source_mixing,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_toxicity": op12_toxicity,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op2_minhash_near_dedup": neardup.ORACLE_SQL,
    "op4_line_dedup": linededup.ORACLE_SQL,
    "op8_exact_top_k": pivots.ORACLE_SQL,
    "op9_source_mixing": mixing.ORACLE_SQL,
    "op11_importance_resampling": importance.ORACLE_SQL,
    "op13_hard_negatives": annuli.ORACLE_SQL,
}
