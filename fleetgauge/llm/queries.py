"""The operators' queries over whole tables, and their SQL twins where SQL can state the result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, decontamination, extraction, filter_audit, jaccard, languages, packing, periodic_runs, private_data, quality, sharding,
    token_files, toxicity,
)
from .common import SPACE, held_out, table

SHARDS = 8


def vocabulary(name: str) -> str:
    """The path of a public vocabulary: in TOKENIZERS_DIR if set, else where the `public_tokenizers` package has it."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = languages.train(documents.filter(~held_out(F.col("doc_id"))))
    return languages.predict(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_languages"))


def op2_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "coverage", "kind")


def op3_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digest(sharding.assign_shards(table(spark, folder, "documents"), SHARDS))


def op4_arrow_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), 1, lower=True)
    return token_files.read_back(manifest)


def op5_compression_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    learn = lambda rows: rows.filter(~held_out(F.col("doc_id")))
    model = toxicity.train(learn(documents), learn(table(spark, folder, "labels")))
    return toxicity.classify(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op6_nnls_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), 0)
    return packed.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids"), F.col("width")).alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """conv_id and record: each conversation as JSON, in the layout that its roles allow.

    One user and one assistant turn make a prompt record, with a system turn first an instruction record; others are lists
    of turns, under the names of two layouts by turns. Turns are in order of turn, role and text; null texts are empty.
    """
    rows = conversations.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    said = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).withColumn(
        "roles", F.transform("t", lambda t: t.role))
    text = lambda i: F.get("t", F.lit(i))["text"]
    same = lambda *roles: F.col("roles") == F.array(*map(F.lit, roles))
    known = F.forall("roles", lambda r: r.isin("user", "assistant", "system"))
    names = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    listed = F.to_json(F.struct(F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("content"))).alias("messages")))
    shared = F.to_json(F.struct(F.transform("t", lambda t: F.struct(names(t.role).alias("from"), t.text.alias("value"))).alias("conversations")))
    return said.select("conv_id", F.when(
        same("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))).when(
        same("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output")))).when(
        known & (F.col("conv_id") % 2 == 0), shared).otherwise(listed).alias("record"))


def op7_fingerprint_chat(spark: SparkSession, folder: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_chats(conversation_records(rows)).select(
        "conv_id", "layout", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout")


def op8_tokenizer_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "byte_share", "entropy")


def op9_size_aware_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = private_data.find(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(
        private_data.count_of(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in private_data.BASE),
        F.sha2(private_data.spelled(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        private_data.spelled(F.col("spans")).alias("spans"))


def op11_ratio_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages"))


def with_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and text, where the text of one in ten documents, by the checksum of its id, ends in a passage said again
    and again: with h the checksum (a null id counts as ''), g = h // 10 and n words, word i from a = g % n on becomes
    word a + (i - a) % (1 + (n - a) // (3 + g % 8))."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chosen = F.when(h % 10 == 0, F.array_remove(F.split("text", SPACE), ""))
    rows = documents.select("doc_id", "text", F.expr("crc32(coalesce(cast(doc_id AS string), '')) div 10").alias("_g"), chosen.alias("_words"))
    sized = rows.withColumn("_n", F.size("_words")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn(
        "_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    again = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return sized.select("doc_id", F.when(F.col("_n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find(with_repeats(table(spark, folder, "documents")))
    longest = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.concat(said, F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_mixture, op2_template_decontamination, op3_feistel_shards, op4_arrow_token_files, op5_compression_toxicity,
    op6_nnls_packing, op7_fingerprint_chat, op8_tokenizer_fertility, op9_size_aware_jaccard, op10_bootstrapped_pii,
    op11_ratio_extraction, op12_periodic_runs, op13_filter_interactions)}

# Escaping is undone before the hashes, so SQL can state them from the rows; the length is that of the escaped texts and
# three marks a turn.
_ESCAPED = r"""regexp_replace(regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(\||s>|/s>|<SYS>>|</SYS>>)', '\\l\1', 'g'),
    '\[(INST\]|/INST\])', '\\b\1', 'g'), '\|>', '\\p>', 'g')"""

ORACLE: dict[str, str] = {
    "op7_fingerprint_chat": """
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, """ + f"length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})" + """ + 23 AS chars FROM said),
joined AS (
    SELECT conv_id, count(*) AS n_turns, sum(chars) AS formatted_chars, string_agg(role, ',' ORDER BY turn, role, text) AS roles,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        bool_and(role IN ('user', 'assistant', 'system')) AS known
    FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars,
    CASE WHEN n_turns = 2 AND roles = 'user,assistant' THEN 'prompt' WHEN n_turns = 3 AND roles = 'system,user,assistant' THEN 'instruction'
        WHEN known AND conv_id % 2 = 0 THEN 'shared' ELSE 'messages' END AS layout
FROM joined""",
    "op9_size_aware_jaccard": """
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM cut),
same AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM shingled GROUP BY ALL),
each AS (SELECT rep, n, unnest(s) AS shingle FROM same),
shared AS (SELECT shingle FROM each GROUP BY shingle HAVING count(*) > 1),
few AS (SELECT each.* FROM each SEMI JOIN shared USING (shingle)),
met AS (
    SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m
    FROM few a JOIN few b ON a.shingle = b.shingle AND a.rep < b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM met WHERE 100 * k >= 75 * (n + m - k) UNION ALL SELECT b, a FROM met WHERE 100 * k >= 75 * (n + m - k)),
reached(node, root) AS (
    SELECT rep, rep FROM same UNION SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.node),
least AS (SELECT node, min(root) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE l.component_id END AS component_id
FROM shingled d JOIN same ON list_sort(d.s) = same.s JOIN least l ON l.node = same.rep""",
    # Shapley values here are sums over all orders, step by step.
    "op13_filter_interactions": """
WITH base AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM base GROUP BY t),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
    SELECT part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
        + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS INT)
        + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(base.doc_id > least, false) AS INT) AS mask,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM base JOIN first USING (t) LEFT JOIN known ON known.doc_id = base.doc_id),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT substr('ABCDE', i, 1) AS letter, 1 << (i - 1) AS bit FROM (SELECT unnest(range(1, 6))::INT AS i)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
    SELECT filter_order, step, l.bit AS own,
        coalesce((SELECT sum(p.bit) FROM letters p WHERE instr(substr(filter_order, 1, step - 1), p.letter) > 0), 0)::INT AS before
    FROM orders, (SELECT unnest(range(1, 6))::INT AS step) JOIN letters l ON l.letter = substr(filter_order, step, 1)),
each AS (
    SELECT part, filter_order, step, own, sum(CASE WHEN (mask & (before | own)) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN (mask & before) = 0 AND (mask & own) <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN (mask & before) <> 0 AND (mask & own) <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN (mask & before) = 0 AND (mask & own) <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN (mask & before) = 0 AND (mask & own) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM each""",
}

__all__ = ["ORACLE", "QUERIES", "conversation_records", "vocabulary"]
