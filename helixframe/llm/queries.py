"""Queries of this subpackage, by name; each applies one operator to its whole table."""

from __future__ import annotations

import importlib

from . import oracles
from .frames import table

#: Folder of the public tokenizer files.
TOKENIZERS = "/opt/tokenizers"


def op1_token_counts(spark, sf_dir):
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op2_language_id(spark, sf_dir):
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op3_fingerprints(spark, sf_dir):
    from .fingerprints import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    from .license_scan import summary

    return summary(table(spark, sf_dir, "documents"))


def op6_debruijn_dedup(spark, sf_dir):
    from .debruijn_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op7_source_mix(spark, sf_dir):
    from .source_mix import taken

    return taken(table(spark, sf_dir, "documents"))


def op8_merge_dropout(spark, sf_dir):
    from .merge_dropout import digests

    return digests(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", rate=0.1, seed=1)


def op9_pivot_index(spark, sf_dir):
    from .pivot_index import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_jaccard_forest(spark, sf_dir):
    from .jaccard_forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_fingerprints, op4_suffix_dedup, op5_license_scan, op6_debruijn_dedup, op7_source_mix, op8_merge_dropout, op9_pivot_index, op10_jaccard_forest, pipeline)}
ORACLES = {"op6_debruijn_dedup": oracles.OP6, "op9_pivot_index": oracles.OP9, "op10_jaccard_forest": oracles.OP10}
