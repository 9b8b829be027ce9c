"""From raw documents to training tokens: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from panelcast.llm import byte_bpe, exact_dedup, language_crf, mixing, ngram_join
from panelcast.llm.common import table, written


def language(spark, docs, sf_dir):
    """Documents whose language the conditional random field can't tell (no letter, or a low score) go; what it tells
    fills in a missing lang, by which a later stage mixes."""
    return language_crf.determined(docs)


def exact(spark, docs, sf_dir):
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark, docs, sf_dir):
    """Of each group that 3-gram Jaccard of 0.9 or more links, the row with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def mix(spark, docs, sf_dir):
    """Each leaf's documents, as often as its budget takes them."""
    return mixing.mixed(docs)


def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, and digests of the ids and of what they decode to."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encode),
]

#: SQL can't express a trained model or BPE; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the table documents, each written and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
