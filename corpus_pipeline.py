"""A corpus from raw documents: language, exact copies, near copies, benchmark passages, token ids.

Every stage takes what the one before it kept, is written as Parquet to the
shared scratch folder, and is read again by the next; then what the stage
stored on the way, and the table it read, are deleted. A lost executor costs
the tasks it ran. A run that is repeated starts anew, in folders of its own.

All stages: a null text counts as empty, rows with a null id take part like
others, extra columns are carried along whatever their names, an empty table
gives an empty table with the stage's columns. Of equal ids and of ties each
stage says which row stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.byte_bpe import encode_rows
from eventlens.llm.common import discard, prepare, stored_alone, table
from eventlens.llm.decontaminate import drop_contaminated
from eventlens.llm.exact_dedup import drop_exact_copies
from eventlens.llm.langid import drop_unidentified, fit_language_model, score_floor, training_rows
from eventlens.llm.simhash import MAX_BITS, SHINGLE_WORDS, drop_near_copies

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model can name; texts without a letter go.

    So do those of which the model is less than half as sure as of any document
    it was held out of and named right (``score_floor``). Where no row has a
    label there is no model, and all texts with a letter stay. Repeated rows are
    judged alike.
    """
    prepare(spark)
    net = fit_language_model(training_rows(docs))
    return drop_unidentified(docs, net, min_score=score_floor(docs, net))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of texts that are equal up to white space: the smallest id, of repeated rows any one."""
    prepare(spark)
    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of SimHash links: the smallest id, of those with it the first stored."""
    prepare(spark)
    return drop_near_copies(docs, shingle_words=SHINGLE_WORDS, max_bits=MAX_BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate; texts without words stay, repeated rows are judged alike."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with the digests that show the round trip.

    The columns besides ``text``, then ``n_tokens, ids, ids_sha256,
    decoded_sha256``; a document's column of such a name (in any case) gets
    underscores until it clashes with no other. Empty texts have no ids.
    """
    prepare(spark)
    made = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    others = [c for c in docs.columns if c != "text"]
    taken, names = {c.lower() for c in others} | set(made), []
    for c in others:
        name = c
        while name.lower() in made or (name != c and name.lower() in taken):
            name += "_"
        taken.add(name.lower())
        names.append(name)
    doc = F.struct(*[F.col(f"`{c}`").alias(name) for c, name in zip(others, names, strict=True)])
    named = docs.select(doc.alias("doc"), "text")
    rows = encode_rows(named, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, "doc", with_ids=True)
    return rows.select("id.*", *made)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the network of the first stage; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stored_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
