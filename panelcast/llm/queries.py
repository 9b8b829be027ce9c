"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_bpe, centroids, decontamination, divergence, exact_dedup, language_crf, license_scan, mixing, ngram_join, rp_forest, secret_scan, substring_chains, suffix_dedup
from .common import table


def op5_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_language_crf(spark, sf_dir):
    return language_crf.identify(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op1_substring_chains(spark, sf_dir):
    return substring_chains.passages(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark, sf_dir):
    return ngram_join.groups(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.copies(table(spark, sf_dir, "documents"))


def op10_rp_forest(spark, sf_dir):
    return rp_forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_eenns_clusters(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_decontamination(spark, sf_dir):
    return decontamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_substring_chains, op2_suffix_dedup, op3_ngram_jaccard, op4_mixing, op5_byte_bpe, op6_exact_dedup, op7_license_scan, op8_secret_scan, op9_language_crf, op10_rp_forest, op11_eenns_clusters, op12_source_divergence, op13_decontamination)}
ORACLE_SQL = {"op4_mixing": mixing.SQL, "op6_exact_dedup": exact_dedup.SQL, "op7_license_scan": license_scan.SQL, "op8_secret_scan": secret_scan.SQL, "op11_eenns_clusters": centroids.SQL, "op12_source_divergence": divergence.SQL, "op13_decontamination": decontamination.SQL}
