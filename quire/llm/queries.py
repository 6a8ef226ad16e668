"""The registered queries of this subpackage, with production parameters."""

from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op2_best_fit_packing(spark, sf_dir):
    """Documents as token pieces packed into sequences of 2,048."""
    from quire.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


@_query
def op7_byte_bpe_round_trip(spark, sf_dir):
    """Byte-level BPE ids of every document and the bytes they decode to, as digests."""
    import public_tokenizers

    from quire.llm.bpe import round_trip_digests

    return round_trip_digests(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@_query
def op8_exact_dedup(spark, sf_dir):
    """Which document of each group of equal texts stays."""
    from quire.llm.exact import deduplicate

    rows = deduplicate(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op8_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM r
"""


@_query
def op6_quality_rules(spark, sf_dir):
    """Line-first cleaning: base counts and the verdict on every document."""
    from quire.llm.quality import judge_documents

    return judge_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "n_kept_words"
    )


@_query
def op4_repeated_passages(spark, sf_dir):
    """Documents without the words of any 35-word window that starts twice."""
    from quire.llm.substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@_query
def op1_string_kernel_toxicity(spark, sf_dir):
    """Toxicity score of every document, learnt from labels that are not held out."""
    from quire.llm.toxicity import held_out, score_texts, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    return score_texts(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@_query
def op5_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose five-word shingles have a Jaccard similarity of 0.75 or more."""
    from quire.llm.ngram_join import link_documents

    return link_documents(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_equal")


@_query
def op9_wrapper_induction(spark, sf_dir):
    """Main text of every page."""
    from quire.llm.html import extract

    return extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@_query
def op10_bootstrapped_pii(spark, sf_dir):
    """Personal data of every document: counts and spans."""
    from quire.llm.pii import KINDS, find, written

    found = find(_table(spark, sf_dir, "documents"))
    # a lambda with a second argument would get the position there, so the kind is bound outside
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


@_query
def op3_license_scan(spark, sf_dir):
    """Licence notices in every document."""
    from quire.llm.licenses import scan

    found = scan(_table(spark, sf_dir, "documents"))
    names = F.array_join(F.transform("matches", lambda m: m["license"]), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), names.alias("licenses"))


@_query
def op11_fill_in_middle(spark, sf_dir):
    """Fill-in-middle form of every document, as digests, and the text rebuilt from it."""
    from quire.llm.fim import fill_in_middle, restore

    rows = fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLES["op11_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), v AS (
  SELECT *, substr(text, 1, least(c1, c2)) AS p, substr(text, least(c1, c2) + 1, abs(c1 - c2)) AS m, substr(text, greatest(c1, c2) + 1) AS s FROM u
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(c1 - c2) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM v
"""


@_query
def op12_importance_resampling(spark, sf_dir):
    """Documents drawn towards the word pairs of the benchmark texts."""
    from quire.llm.resample import resample

    rows = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of the distinct features, byte by byte; the table of 256 entries follows its rule.
ORACLES["op12_importance_resampling"] = r"""
WITH table_256 AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
  FROM range(256) AS t(i)
), texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM texts
), features AS (
  SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), codes AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), table_256
), placed AS (
  SELECT side, doc_id, bucket FROM features JOIN codes USING (f)
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS g FROM counts
), weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scores AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words w LEFT JOIN weights USING (doc_id) WHERE side = 'd'
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 25 // 100 AS k FROM scores WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM scores LEFT JOIN ranked USING (doc_id)
"""


@_query
def op13_secret_scan(spark, sf_dir):
    """Secrets of every document: counts and spans."""
    from quire.llm.secrets import KINDS, find, written

    found = find(_table(spark, sf_dir, "documents"))
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
