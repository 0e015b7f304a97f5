"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.byte_bpe import encode_rows
from eventlens.llm.chat import fold_events, read_back, render
from eventlens.llm.common import remainder, table
from eventlens.llm.decontaminate import contamination
from eventlens.llm.exact_dedup import exact_groups
from eventlens.llm.fill_middle import fill_middle
from eventlens.llm.importance import importance_sample
from eventlens.llm.kneser_ney import quality
from eventlens.llm.langid import fit_language_model, language_column, training_rows
from eventlens.llm.license_scan import license_scan
from eventlens.llm.pitman_yor import pitman_yor_scores
from eventlens.llm.simhash import simhash_components
from eventlens.llm.token_counts import token_counts
from eventlens.llm.weighted_fingerprint import edited_fingerprints


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a fifth of them is held out of training."""
    docs = table(spark, sf_dir, "documents")
    net = fit_language_model(training_rows(docs))
    found = docs.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        language_column(net, F.col("text")).alias("found"),
    )
    return found.select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), "found.shares"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of six of seven of them."""
    docs = table(spark, sf_dir, "documents")
    rows = pitman_yor_scores(docs, docs.filter(remainder("doc_id", 7) != 2))
    held_out = F.coalesce(remainder("id", 7) == 2, F.lit(False)).alias("held_out")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return rows.select(F.col("id").alias("doc_id"), held_out, *rows.columns[1:], perplexity)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents by progressively finer hashes."""
    rows = exact_groups(table(spark, sf_dir, "documents"), digests=True)
    return rows.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, rendered and read back."""
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], log.schema
    )
    events = log.unionByName(extra).select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("seq"), F.lit(None).cast("string").alias("msg"),
        F.lit("message").alias("kind"), "role", "text",
    )
    back = read_back(render(fold_events(events)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    rows = simhash_components(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a digest cache."""
    rows = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark contamination of every document by winnowing."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with byte-level BPE and decoded again."""
    rows = encode_rows(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return rows.withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under trusted text, and whether its language's threshold keeps it."""
    rows = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumnRenamed("id", "doc_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents towards the benchmark's texts, and a tenth drawn by them."""
    rows = importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fingerprints of all documents, of edited copies, and their likeness."""
    return edited_fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at line ranks and rearranged, and restored again."""
    rows = fill_middle(table(spark, sf_dir, "documents"), with_digests=True)
    return rows.withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH n AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""

#: Every column but ``formatted_chars`` restated; that one is the template's own length, so it is spelled out here.
OP5_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
           CAST(sum(length(role) + length(text) + 16
               + (length(text) - length(replace(text, '\', '')))
               + (length(text) - length(replace(text, '[INST]', '12345')))
               + (length(text) - length(replace(text, '[/INST]', '123456')))
               + (length(text) - length(replace(text, '<s>', '12')))
               + (length(text) - length(replace(text, '</s>', '123')))) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM g
"""

OP8_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), sized AS (
    SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram
    FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM sized)
), sizes AS (SELECT DISTINCT n FROM sized
), grams AS (
    SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram
    FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM docs, sizes WHERE len(w) >= n)
), met AS (
    SELECT r, item_id, p, n FROM grams JOIN windows USING (n, gram)
), words AS (
    SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS place FROM met) GROUP BY r
), found AS (
    SELECT r, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
    FROM met GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

OP11_SQL = r"""
WITH table_of AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc
    FROM range(256) AS t(i)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), source_words AS (SELECT r, unnest(w) AS word FROM docs
), target_words AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM benchmark
), spelled AS (
    SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM source_words UNION SELECT word FROM target_words)
), bucket_of AS (
    SELECT word, xor(list_reduce(
        list_transform(range(len(digits) // 2), lambda i: ('0x' || substr(digits, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT),
        lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM spelled, table_of
), counts AS (
    SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
    FROM (SELECT 0 AS side, word FROM source_words UNION ALL SELECT 1, word FROM target_words) JOIN bucket_of USING (word)
    GROUP BY bucket
), gain_of AS (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
                                        / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM counts
), weights AS (
    SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
    FROM source_words JOIN bucket_of USING (word) JOIN gain_of USING (bucket) GROUP BY r
), scored AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
               (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM docs LEFT JOIN weights USING (r)
), drawn AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
           10 * count(*) OVER () // 100 AS draw
    FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""

OP13_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
           sha256('7:' || doc_id) AS h
    FROM documents
), g AS (
    SELECT *, CAST(len(units) AS BIGINT) AS n, [('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(h, 9, 8))::BIGINT,
           ('0x' || substr(h, 17, 8))::BIGINT, ('0x' || substr(h, 25, 8))::BIGINT] AS x
    FROM d
), c AS (
    SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 100
                THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM g
), p AS (
    SELECT *, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle,
           array_to_string(units[b + 1 :], '') AS suffix
    FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_lm_score": op3_lm_score,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_decontaminate": op8_decontaminate,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality": op10_quality,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_fingerprints": op12_fingerprints,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_fill_middle": OP13_SQL,
}
