"""From raw documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
result to the shared folder and reads it again as the next stage's documents, so a lost
executor never reaches behind a stage. All but the last return the columns of
``documents``. Stages handle nulls, empty tables and extra columns as their operators do.
"""

from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.exact import distinct_rows
from quire.llm.ngram_join import distinct_documents
from quire.llm.packing import pack_documents
from quire.llm.pii import masked
from quire.llm.toxicity import score_texts, train

#: No SQL: the stages learn, stream, iterate and tokenise. ``tests/llm`` has a plain version.
ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    """Documents that are not predicted toxic; the labels that are not held out train."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(docs, model, keep=docs.columns)
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_copies(spark, docs, sf_dir):
    """One row of each group of equal texts."""
    return distinct_rows(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each component of five-word shingles at a similarity of 0.75 or more."""
    return distinct_documents(docs)


def mask_personal_data(spark, docs, sf_dir):
    """Personal data replaced by ``[KIND]``; ``n_chars`` follows the text."""
    out = masked(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark, docs, sf_dir):
    """Token pieces of all documents, packed into sequences of 2,048."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]


def run(spark, sf_dir):
    """Apply every stage to the ``documents`` table; stages meet in written tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
