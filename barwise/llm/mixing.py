"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its identifier. Sizes are summed by source and hash bucket; along the buckets the
running sum crosses a source's budget in exactly one of them, and only the documents of that boundary bucket are summed
again, on the next 12 bits, until a bucket is one hash value. A document is taken when its hash lies below its source's
threshold, so nothing is sorted, a larger budget takes a superset of a smaller one, and reruns agree.

Cases: a null text has size 0; sources order by code point with null last; documents with equal hashes (repeated rows)
go together; a source without any words has target 0; an empty table gives an empty result. Other columns are kept out.
"""

from pyspark.sql import Window, functions as F

from barwise.llm.common import BLANKS, packed, quoted, stored

LEVELS, BITS = 5, 12
SEED = "mix-1"


def word_count(text):
    """Number of runs without white space."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.size(F.array_remove(parts, "")).cast("long")


def hash60(column):
    """60 bits of md5 as a long, the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.coalesce(column.cast("string"), F.lit("")), F.lit(SEED)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes, weights, limit=3.0):
    """Target of each source: its share by weight of all sizes, at most ``limit`` times its own size; what a source
    cannot take is shared again by weight. ``sizes``: source, source_size; ``weights``: how to weigh the sources in
    code-point order, repeating. One row per source, so the windows over all of them stay small."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights))).withColumn(
        "most", F.col("source_size") * F.lit(float(limit))
    )
    # Sources fill up in the order of most / weight. With the first k full, the others share the rest by weight.
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    open_ = F.col("level") * F.col("weight") <= F.col("most")
    s = s.withColumn("level", F.min(F.when(open_, F.struct((F.col("most") / F.col("weight")).alias("at"), "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def thresholds(docs, budgets):
    """Per source the hash below which documents are taken. ``docs``: source, hash, size; ``budgets``: source, budget.
    The document (or documents of one hash) across which the budget falls is taken if that comes nearer."""
    by = Window.partitionBy("source").orderBy("bucket")
    # state: for each source the prefix of bits fixed so far and what lies below it
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        rows = docs.join(state, docs["source"].eqNullSafe(state["source"])).drop(state["source"])
        if level > 1:
            rows = rows.filter(F.shiftright("hash", shift + BITS) == F.shiftright("low", shift + BITS))
        sums = rows.groupBy("source", "budget", "low", "below", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("size")
        )
        upto = F.col("below") + F.sum("size").over(by)
        crossing = sums.withColumn("upto", upto).withColumn("last", F.max("bucket").over(Window.partitionBy("source")))
        # the first bucket whose running sum passes the budget, or the last one
        edge = crossing.filter((F.col("upto") > F.col("budget")) | (F.col("bucket") == F.col("last"))).groupBy("source").agg(
            F.min_by(F.struct("budget", (F.shiftleft("bucket", shift)).alias("low"), (F.col("upto") - F.col("size")).alias("below"), "upto"), "bucket").alias("s")
        )
        state = stored(edge.select("source", "s.*"))
    over, under = F.col("upto") - F.col("budget"), F.col("budget") - F.col("below")
    return state.select("source", F.when(over < under, F.col("low") + 1).otherwise(F.col("low")).alias("threshold"))


def _sized(docs, id_col, text_col, source_col):
    return docs.select(
        F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), word_count(F.col(quoted(text_col))).alias("size"),
        hash60(F.col(quoted(id_col))).alias("hash"),
    )


def source_plan(sized, weights, limit):
    """One row per source: source_size, target, whole passes over it, and the threshold for a part of a further pass."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stored(targets(totals, weights, limit))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    part = thresholds(sized, plan)
    return stored(plan.join(part, plan["source"].eqNullSafe(part["source"])).drop(part["source"]).drop("budget"))


def _times(limit):
    extra = F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return F.least(F.col("passes") + extra, F.lit(int(limit))).cast("int")


def mix(docs, weights, limit=3.0, id_col="doc_id", text_col="text", source_col="source"):
    """One row per document: id, source, size, source_size, target, taken (words, repeats counted)."""
    sized = stored(_sized(docs, id_col, text_col, source_col))
    plan = source_plan(sized, weights, limit)
    out = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    return out.select("id", "source", "size", "source_size", "target", (F.col("size") * _times(limit)).alias("taken"))


def take(docs, weights, limit=3.0, id_col="doc_id", text_col="text", source_col="source"):
    """The documents of the mix with their own columns; a document taken twice is there twice. Documents without a word
    follow their hash like any other."""
    plan = source_plan(stored(_sized(docs, id_col, text_col, source_col)), weights, limit)
    plan = plan.select(F.col("source").alias("of"), "passes", "threshold")
    hashed = packed(docs, id_col, text_col, source_col).select("row", "source", hash60(F.col("id")).alias("hash"))
    joined = hashed.join(plan, F.col("source").eqNullSafe(F.col("of")))
    copies = F.sequence(F.lit(1), _times(limit))
    return joined.filter(_times(limit) > 0).select("row", F.explode(copies)).select("row.*")


def oracle(weights, limit):
    """The same mix in plain SQL, by sorting each source by hash."""
    cycle = "CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END"
    assert (tuple(weights), limit) == ((5, 2, 1), 3.0)
    return f"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ({cycle})::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
f AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
  sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  (sum(source_size) OVER ())::DOUBLE AS total FROM w),
l AS (SELECT *, (total - full_) / rest AS level FROM f),
m AS (SELECT min_by(level, most / weight) AS level FROM l WHERE level * weight <= most),
t AS (SELECT source, source_size, least(most, weight * m.level) AS target FROM l, m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
r AS (SELECT d.doc_id, d.size, d.hash, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) - sum(d.size) OVER (PARTITION BY d.source, d.hash) AS below
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * least(passes + CASE WHEN upto <= budget OR (below <= budget AND upto - budget < budget - below) THEN 1 ELSE 0 END, 3))::BIGINT AS taken FROM r
"""
