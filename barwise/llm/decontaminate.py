"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

A window is ``width`` consecutive words of an item; a shorter item is one window. Words are ordered by rarity in the
corpus (document counts over all of it). A window can only occur where its rarest word does, so that word is its join
prefix: document positions are matched on prefix words alone, with the length bound (the text is long enough for the
window) and the positional bound (the window fits around the position) applied at once. The whole window is then
compared. Hits are merged as intervals.

Everything is DataFrame code. The prefix table follows the benchmark, not the corpus. It is stored and counted, then
broadcast in blocks of at most ``BLOCK`` rows, so a benchmark of any size is matched without shuffling the corpus' words.

Cases: null or empty texts and items have no words; items with equal windows are each reported; items without an
identifier hit words but are not listed; repeated documents get the same result each; empty tables give no hits.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from barwise.llm.common import packed, row_key, stored, word_array

WIDTH = 10
#: Rows (a word and two small numbers each) broadcast at once.
BLOCK = 200_000


def windows(items, width=WIDTH, item_col="item_id", text_col="text"):
    """Distinct windows: item, words (array)."""
    words = items.select(F.col(item_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(width - 1), F.lit(1)))
    return words.select("item", "w", F.explode(starts).alias("s")).select(
        "item", F.slice("w", F.col("s"), F.lit(width)).alias("words")
    ).distinct()


def document_words(docs, id_col, text_col):
    return docs.select(
        F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), word_array(F.col(text_col)).alias("words")
    )


def prefixes(wins, doc_words):
    """Distinct (word, at, length): the rarest word of each window and its place. Rarity counts rows of the corpus that
    hold the word; ties go to the smaller word."""
    vocabulary = stored(wins.select(F.explode("words").alias("word")).distinct())
    seen = doc_words.select(F.explode("words").alias("word"))
    blocks = max(-(-vocabulary.count() // BLOCK), 1)
    of_block = F.pmod(F.xxhash64("word"), F.lit(blocks))
    parts = [seen.join(F.broadcast(vocabulary.filter(of_block == b)), "word", "left_semi") for b in range(blocks)]
    found = reduce(DataFrame.unionAll, parts).groupBy("word").count()
    texts = wins.select("words").distinct().select("words", F.concat_ws(" ", "words").alias("window"))
    places = texts.select("window", F.size("words").alias("length"), F.posexplode("words").alias("at", "word"))
    ranked = places.join(found, "word", "left").groupBy("window", "length").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "at")).alias("p")
    )
    return ranked.select(F.col("p.word").alias("word"), F.col("p.at").alias("at"), "length").distinct()


def occurrences(docs, items, width=WIDTH, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", block=BLOCK):
    """Every place where a window of an item occurs: id, key, start (from 0), length, item."""
    wins = stored(windows(items, width, item_col, item_text_col))
    words = document_words(docs, id_col, text_col)
    prefix = stored(prefixes(wins, words))
    spots = words.select("id", "key", "words", F.posexplode("words").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    blocks = max(-(-prefix.count() // block), 1)
    of_block = F.pmod(F.xxhash64("word", "at", "length"), F.lit(blocks))
    matched = [spots.join(F.broadcast(prefix.filter(of_block == b)), "word") for b in range(blocks)]
    candidates = reduce(DataFrame.unionAll, matched).filter((start >= 0) & (start + F.col("length") <= F.size("words"))).select(
        "id", "key", start.alias("start"), "length",
        F.concat_ws(" ", F.slice("words", start + 1, F.col("length"))).alias("window"),
    )
    wanted = wins.select(F.concat_ws(" ", "words").alias("window"), "item").groupBy("window").agg(F.collect_set("item").alias("items"))
    return candidates.join(stored(wanted), "window").select("id", "key", "start", "length", "items")


def contamination(docs, items, width=WIDTH, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"):
    """One row per document: id, n_words, n_hit (words inside an occurrence), items (sorted distinct identifiers)."""
    found = occurrences(docs, items, width, id_col, text_col, item_col, item_text_col)
    end = F.col("start") + F.col("length")
    earlier = Window.partitionBy("id", "key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(end).over(earlier), F.lit(0))
    fresh = F.greatest(end - F.greatest("start", covered), F.lit(0))
    per_doc = found.withColumn("fresh", fresh).groupBy("id", "key").agg(
        F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    rows = docs.select(
        F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
        F.size(word_array(F.col(text_col))).cast("long").alias("n_words"),
    )
    on = rows["id"].eqNullSafe(per_doc["id"]) & (rows["key"] == per_doc["key"])
    return rows.join(per_doc, on, "left").select(
        rows["id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean(docs, items, width=WIDTH, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"):
    """The documents in which no window of an item occurs, with their own columns."""
    hit = occurrences(docs, items, width, id_col, text_col, item_col, item_text_col).select(
        F.col("id").alias("_id"), F.col("key").alias("_key")
    ).distinct()
    hit = stored(hit)  # few rows, whose size the planner then knows
    rows = packed(docs, id_col, text_col).withColumn("own", row_key("id", "text")).drop("text")
    return rows.join(hit, F.col("id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_key")), "left_anti").select("row.*")


ORACLE = r"""
WITH i AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(w[s : s + 9], ' ') AS win, least(len(w), 10) AS l FROM n),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
lens AS (SELECT DISTINCT l FROM win),
p AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lens WHERE len(w) >= l),
hit AS (SELECT p.doc_id, p.s, p.l, win.item FROM p JOIN win ON win.l = p.l AND win.win = array_to_string(p.w[p.s : p.s + p.l - 1], ' ')),
cover AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item)::BIGINT AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
