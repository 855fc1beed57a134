"""The operators as queries over the given tables, with production parameters, and their SQL where SQL can express them."""

from pyspark.sql import functions as F

from barwise.llm import bands, binary, decontaminate, exactdup, extract, langid, licenses, mixing, neardup, repair, tokencount, trie, urls

WEIGHTS, LIMIT = (5, 2, 1), 3.0
END_ID, TOKEN_LIMIT = 2, 4096


#: verdict, then host and path
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def vocabulary_file(name):
    """Place of a public tokenizer file; the package with the files is only needed here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    counts = tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_near_dedup(spark, sf_dir):
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op3_exact_dedup(spark, sf_dir):
    groups = exactdup.exact_groups(spark, f"{sf_dir}/documents.parquet")
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
        F.col("digest").alias("text_sha256"),
    )


def op4_mix_sources(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, LIMIT)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_binary_output(spark, sf_dir):
    written = binary.encode(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), END_ID)
    return written.withColumnRenamed("id", "doc_id")


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.languages(docs, langid.fit(docs)).withColumnRenamed("id", "doc_id")


def op7_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base, every = F.col("base.label"), F.concat("base.label", "matches.label")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        # a whole template was found, or only the opening of a license, or only a phrase, or nothing
        F.when(F.exists("matches.label", lambda l: ~l.endswith("-notice")), 1.0).when(F.size("matches") > 0, 0.75).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op8_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_html_extract(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "confidence"
    )


def op11_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    found = repair.repair_digests(repair.damaged(conversations)).withColumnRenamed("digest", "repaired_sha256")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in repair.STATS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_prefix_trie(spark, sf_dir):
    rows, members = trie.with_shared_heads(trie.turns(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(rows, members).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_words").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def op13_quality_rules(spark, sf_dir):
    judged = bands.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "verdict", "n_chunks", "n_bad_chunks",
    )


BUILDERS = {
    "op1_token_counts": op1_token_counts,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_binary_output": op5_binary_output,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_extract": op9_html_extract,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_rules": op13_quality_rules,
}

SQL = {
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
    "op4_mix_sources": mixing.oracle(WEIGHTS, LIMIT),
    "op8_decontaminate": decontaminate.ORACLE,
    "op11_conversation_repair": repair.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
}
