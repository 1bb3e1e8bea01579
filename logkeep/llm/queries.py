"""Queries of the training-data operators, and their SQL twins."""

import corpus_pipeline
from logkeep.llm import (
    bpe, credentials, decontamination, divergence, fingerprints, graydedup, langprofiles, merkle, pii,
    quality, recompression, simple8b, suffixtree)

QUERIES = {}
ORACLES = {}


def _register(name, function, sql=None):
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, sf_dir)

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


for _query in (
    suffixtree.op1_suffix_tree,
    graydedup.op2_simhash_groups,
    pii.op3_pii,
    simple8b.op4_token_files,
    credentials.op5_secrets,
    fingerprints.op7_fingerprints,
    bpe.op9_bpe,
    quality.op10_quality,
    langprofiles.op11_language_profiles,
):
    _register(_query.__name__, _query)
_register("op6_repeated_passages", recompression.op6_repeated_passages, recompression.SQL)
_register("op8_decontamination", decontamination.op8_decontamination, decontamination.SQL)
_register("op12_source_divergence", divergence.op12_source_divergence, divergence.SQL)
_register("op13_merkle_manifest", merkle.op13_merkle_manifest, merkle.SQL)
_register("pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
