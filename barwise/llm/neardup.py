"""Near-duplicate documents by DartMinHash sketches, banded joins and exact checks.

Two documents are linked when the similarity of their five-word shingles (words: A-Z lower-cased, runs of letters, digits
and characters beyond ASCII; a shorter text is one shingle) is at least 0.8; classes are the connected components. With
``weights="set"`` each distinct shingle weighs 1 and the similarity is the Jaccard similarity of sets; with
``weights="count"`` it weighs its multiplicity and the similarity is the weighted one.

1. Texts with the same words become one vertex, so copies are never compared.
2. Vertices are joined by band values. In a bucket the smallest vertex leads; each member is checked against it, exactly,
   on the texts. That is linear in the bucket, and settles it if all members are like the leader.
3. Members unlike their leader are checked against the smallest one among them. What then still lies in different
   components within a bucket is compared by what sets each member apart from the leader: with the shingles a member
   lacks and those it adds, the similarity of two members follows exactly. That is the condition of a join on the bucket,
   which puts out links alone, so no link that shares a bucket is lost and no pair is listed for being compared.

With 24 bands of 6 coordinates a pair at 0.8 shares a bucket with probability 0.9993, at 0.9 with all but 1e-8.

Cases: null texts and texts without words form no class with others; a class is named by its smallest identifier that is
not null, which stays (of repeated rows, one); an empty table gives an empty result; other columns are left alone.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from barwise.llm import darts
from barwise.llm.common import packed, row_key, stored
from barwise.llm.graph import components
from barwise.llm.shingles import distinct, mix, shingles, words

SIMILARITY, SIZE, BANDS, ROWS = 0.8, 5, 24, 6
_STEP = 500  # texts handled at a time


def _weighted(texts, size, weights):
    """(word hashes, their texts, distinct shingles, their texts, weights) of an Arrow array."""
    h, owner = words(texts)
    s, of, times = distinct(*shingles(h, owner, len(texts), size))
    return h, owner, s, of, times if weights == "count" else np.ones(len(s), np.int64)


def _sketches(size, n_bands, rows, weights):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), _STEP):
                some = batch.slice(at, _STEP)
                h, owner, s, of, w = _weighted(some.column("text"), size, weights)
                values = darts.bands(darts.sketch(s, of, w, len(some), n_bands * rows), rows).view(np.int64)
                edges = np.searchsorted(owner, np.arange(len(some) + 1))
                digests = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * n_bands), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("key"), pa.array(digests, pa.binary()), pa.array(np.diff(edges), pa.int64()), lists],
                    ["id", "key", "digest", "n_words", "bands"],
                )

    return run


def _compare(size, weights):
    """For pairs of texts a, b: their similarity, the size of a, what b lacks of a and what it adds."""
    longs = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                some = batch.slice(at, 200)
                a_ids = some.column("a").to_numpy()
                new = np.ones(len(some), bool)
                new[1:] = a_ids[1:] != a_ids[:-1]  # a leader's text comes many times in a row
                left = _sets(some.column("text_a").filter(pa.array(new)), size, weights)
                which = np.cumsum(new) - 1
                rows = [_apart(left[i], x) for i, x in zip(which, _sets(some.column("text_b"), size, weights))]
                yield pa.RecordBatch.from_arrays(
                    [some.column("a"), some.column("b"), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], longs), pa.array([r[3] for r in rows], longs)],
                    ["a", "b", "similarity", "n", "lacks", "adds"],
                )

    return run


def _sets(texts, size, weights):
    """Sorted elements of each text; a shingle that counts several times is as many elements."""
    _, _, s, of, w = _weighted(texts, size, weights)
    if weights == "count":
        at = np.repeat(np.arange(len(s)), w)
        copy = np.arange(len(at)) - np.repeat(np.cumsum(w) - w, w)
        s, of, _ = distinct(mix(s[at] + copy.astype(np.uint64)), of[at])
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    return [s[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _apart(a, b):
    lacks, adds = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
    both = len(a) - len(lacks)
    return both / (len(a) + len(adds)), len(a), lacks.view(np.int64), adds.view(np.int64)


def classes(docs, id_col="doc_id", text_col="text", similarity=SIMILARITY, size=SIZE, n_bands=BANDS, rows=ROWS, weights="set"):
    """One row per document: row (unique), id, key, class_id, class_size, kept."""
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    source = docs.select(F.col(id_col).alias("id"), row_key(text).alias("key"), text.alias("text"))
    sketched = source.mapInArrow(
        _sketches(size, n_bands, rows, weights), f"id {id_type}, key long, digest binary, n_words long, bands array<long>"
    )
    # The numbers are fixed once the table is written.
    sketched = stored(sketched.withColumn("row", F.monotonically_increasing_id()))
    reps = sketched.filter("n_words > 0").groupBy("digest").agg(
        F.min(F.struct("id", "key")).alias("at"), F.first("bands").alias("bands")
    )
    reps = stored(reps.withColumn("vertex", F.monotonically_increasing_id()))
    links = _links(source, reps, similarity, size, weights)
    labels = components(links)

    vertices = reps.select("digest", "vertex").join(labels, "vertex", "left").select("digest", F.coalesce("label", "vertex").alias("label"))
    members = sketched.select("row", "id", "key", "digest").join(vertices, "digest", "left")
    # Texts without words have no vertex and stand alone.
    members = members.withColumn("class", F.coalesce("label", -1 - F.col("row"))).select("row", "id", "key", "class")
    sizes = members.groupBy("class").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"), F.count("*").alias("class_size")
    )
    return members.join(sizes, "class").select(
        "row", "id", "key", F.col("first.id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept")
    )


def _links(source, reps, similarity, size, weights):
    """Verified edges a, b between vertices."""
    placed = reps.select("vertex", F.explode("bands").alias("value"))
    buckets = placed.groupBy("value").agg(F.min("vertex").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    placed = stored(placed.join(buckets.select("value", "leader"), "value"))
    # Each candidate's text once, under its vertex.
    wanted = placed.select("vertex").distinct().join(reps.select("vertex", "at"), "vertex").select(
        "vertex", F.col("at.id").alias("_id"), F.col("at.key").alias("_key")
    )
    found = source.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    texts = stored(found.groupBy("vertex").agg(F.first("text").alias("text")))

    def checked(pairs):
        """Distinct pairs (a, b) with their similarity and how b differs from a."""
        a = texts.select(F.col("vertex").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("vertex").alias("b"), F.col("text").alias("text_b"))
        full = pairs.distinct().join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
        return stored(full.mapInArrow(_compare(size, weights), "a long, b long, similarity double, n long, lacks array<long>, adds array<long>"))

    least = F.lit(float(similarity))
    like = F.col("similarity") >= least
    own = placed.filter("vertex <> leader")
    first = checked(own.select(F.col("leader").alias("a"), F.col("vertex").alias("b")))
    known = first.select(F.col("a").alias("leader"), F.col("b").alias("vertex"), "similarity")
    unlike = stored(own.join(known, ["leader", "vertex"]).filter(~like).select("value", "vertex"))
    seconds = unlike.groupBy("value").agg(F.min("vertex").alias("second"))
    second = checked(unlike.join(seconds, "value").filter("vertex <> second").select(F.col("second").alias("a"), F.col("vertex").alias("b")))
    edges = first.filter(like).union(second.filter(like)).select("a", "b")
    if unlike.isEmpty():
        return edges

    # Everything in the buckets that hold unlike members, seen from the leader.
    labels = components(edges)
    seen = first.select(F.col("a").alias("leader"), F.col("b").alias("vertex"), "n", "lacks", "adds")
    nothing = F.array().cast("array<long>")
    members = placed.join(unlike.select("value").distinct(), "value", "left_semi").join(seen, ["leader", "vertex"], "left").join(
        labels, "vertex", "left"
    ).select("value", "vertex", "n", F.coalesce("lacks", nothing).alias("lacks"), F.coalesce("adds", nothing).alias("adds"), F.coalesce("label", "vertex").alias("label"))
    members = stored(members)
    x = members.join(unlike, ["value", "vertex"], "left_semi").select("value", *[F.col(c).alias(f"x_{c}") for c in members.columns if c != "value"])
    both = F.col("x_n") - F.size(F.array_union("lacks", "x_lacks")) + F.size(F.array_intersect("adds", "x_adds"))
    sizes = 2 * F.col("x_n") - F.size("lacks") - F.size("x_lacks") + F.size("adds") + F.size("x_adds")
    # Sizes alone may already differ too much.
    able = F.abs(F.size("adds") - F.size("lacks") - F.size("x_adds") + F.size("x_lacks")) <= (1 - least) / (1 + least) * sizes
    apart = F.col("label") != F.col("x_label")
    rest = x.join(members.drop("n"), (members["value"] == x["value"]) & apart & able & (both / (sizes - both) >= least))
    return edges.union(rest.select(F.least("vertex", "x_vertex").alias("a"), F.greatest("vertex", "x_vertex").alias("b")).distinct())


def keep_one(docs, id_col="doc_id", text_col="text", **options):
    """The documents that stay, with their own columns."""
    found = classes(docs, id_col, text_col, **options)
    stay = stored(found.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(
        F.max("kept").alias("_kept"), F.count("*").alias("_copies")
    ).filter("_kept"))
    rows = packed(docs, id_col, text_col).select("row", "id", row_key("text").alias("of"))
    there = rows.join(stay, F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_key")))
    # Rows that share identifier and text are one document. The first of them in any order stays; rows of any type have one.
    repeated = there.filter("_copies > 1").groupBy("id", "of").agg(F.first("row").alias("row"))
    return there.filter("_copies = 1").select("row").unionAll(repeated.select("row")).select("row.*")
