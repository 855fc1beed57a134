"""Prefix trie of conversations: which sequences of turns they share, and what sharing them saves.

Turns become 16-byte ids (the first half of the SHA-256 of role and text), conversations become keys of such ids, and
tasks put the keys into adaptive radix trees. Byte depths that are no multiple of the id's width are mere structure; at the
others stands a node of the trie. A tree that has grown to ``budget`` turns is put out and a new one begun, and a
conversation of more than ``segment`` turns goes in piece by piece, each under the digest of what lies before, so memory is
bounded for any number of turns and members.

1. Every tree puts out its nodes (a digest of their path, members, smallest member, ends). Nodes of one path are summed
   over the trees: a path shared by any number of conversations leaves a task as one row.
2. Sums over subtrees need no round per level. A node belongs to its smallest member, whose path passes all nodes above, so
   a running sum along that path, from its end upwards, holds what each node gets through this member.
3. The members that end in a node are sorted and hashed as a stream.

A conversation is read by one task (its path digests follow from each other), as are the sorted ends of one node (their
hash is one sequence); both are streams. Joining a node with its parent may meet parents with very many children:
adaptive execution splits these, and the root, the largest, is a scalar.

Cases: null role or text is empty; null turns come first; turns of one number follow each other by their id; rows without a
conversation id belong to none and are left out; repeated rows are turns of their own; equal conversations are members of
the same nodes; very long texts are hashed by Spark and never cut; an empty table gives an empty result; other columns are
left alone whatever their names. Conversation ids are whole numbers.
"""

import hashlib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.llm.common import BLANKS, quoted, stored
from barwise.llm.radix import RadixTree
from barwise.llm.repair import CRC_TABLE, crc32_sql

WIDTH, SEGMENT, BUDGET = 16, 4096, 100_000
NODE, PATH, END = range(3)
ROOT = bytes(WIDTH)


def _below(parent, turn):
    return hashlib.blake2b(parent + turn, digest_size=WIDTH).digest()


def turns(conversations, id_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """id, place (from 1), turn (its 16-byte id), words of every turn."""
    role, text = (F.coalesce(F.col(quoted(c)), F.lit("")) for c in (role_col, text_col))
    # The length of the role keeps (role, text) apart from any other pair with the same characters.
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(
        F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(turn_col)).alias("number"), F.substring(digest, 1, WIDTH).alias("turn"),
        F.size(F.array_remove(F.split(text, BLANKS), "")).cast("long").alias("words"),
    ).filter("id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("id").orderBy("number", "turn")).cast("long")
    return rows.select("id", place.alias("place"), "turn", "words")


_ROWS = "kind int, key binary, parent binary, turn binary, depth long, words long, n_convs long, n_ends long, conv long"


class _Tree:
    """One radix tree and what it is to put out."""

    def __init__(self):
        self.tree, self.words, self.turns = RadixTree(), {}, 0

    def add(self, anchor, depth, ids, conv, ends, long):
        """``ids``: turns below ``anchor``, the digest of the ``depth`` turns before."""
        self.tree.insert(anchor + b"".join(ids), (conv, depth, ends, long))
        self.turns += len(ids) + 1

    def rows(self):
        """Rows of all kinds."""
        walk = self.tree.walk()
        n = len(walk)
        members = [len(node.values) for node, _, _ in walk]
        least = [min((v[0] for v in node.values), default=None) for node, _, _ in walk]
        base = [node.values[0][1] if node.values else None for node, _, _ in walk]
        for i in range(n - 1, 0, -1):
            up = walk[i][1]
            members[up] += members[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
            base[up] = base[i] if base[up] is None else base[up]
        # of each place: rest (bytes since the last whole id), digest, depth and the path above: (upper path, own keys)
        state = [None] * n
        for i, (node, up, path) in enumerate(walk):
            rest, digest, depth, above = state[up] if up >= 0 else (b"", None, 0, None)
            data, keys, at = rest + path, [], 0
            ending = sum(1 for v in node.values if v[2])
            while len(data) - at >= WIDTH:
                turn, at = data[at : at + WIDTH], at + WIDTH
                last = at == len(data)
                if digest is None:  # the anchor
                    digest, depth, parent, shown = turn, base[i], None, turn == ROOT and base[i] == 0
                    turn = None
                else:
                    parent, digest, depth, shown = digest, _below(digest, turn), depth + 1, True
                if shown:
                    keys.append((depth, digest))
                    yield (NODE, digest, parent, turn, depth, self.words.get(turn, 0), members[i], ending if last else 0, least[i])
            state[i] = (data[at:], digest, depth, (above, keys))
            for conv, _, ends, long in node.values:
                if ends:
                    yield (END, digest, None, None, depth, None, None, None, conv)
                if long or conv == least[i]:
                    step = state[i][3]
                    while step is not None:
                        for d, key in step[1]:
                            yield (PATH, key, None, None, d, None, None, None, conv)
                        step = step[0]


def _grow(budget, segment):
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def frames_of(rows):
        out = []
        for row in rows:
            out.append(row)
            if len(out) == 20_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(rows):
        f = pd.DataFrame(rows, columns=names, dtype=object)
        for c in ("depth", "words", "n_convs", "n_ends"):
            f[c] = f[c].astype("Int64")
        return f

    def run(frames):
        tree, conv, ids, anchor, depth = _Tree(), None, [], ROOT, 0
        for batch in frames:
            for c, turn, words in zip(batch["id"].tolist(), batch["turn"].tolist(), batch["words"].tolist()):
                if c != conv:
                    if conv is not None:
                        tree.add(anchor, depth, ids, conv, True, depth > 0)
                    conv, ids, anchor, depth = c, [], ROOT, 0
                    if tree.turns >= budget:
                        yield from frames_of(tree.rows())
                        tree = _Tree()
                if turn is None:  # names the conversation only
                    continue
                if len(ids) == segment:
                    tree.add(anchor, depth, ids, conv, False, True)
                    for each in ids:
                        anchor = _below(anchor, each)
                    depth, ids = depth + segment, []
                    if tree.turns >= budget:
                        yield from frames_of(tree.rows())
                        tree = _Tree()
                tree.words[turn] = words
                ids.append(turn)
        if conv is not None:
            tree.add(anchor, depth, ids, conv, True, depth > 0)
        yield from frames_of(tree.rows())

    return run


def _ends(frames):
    key, state = None, None
    for frame in frames:
        out = []
        for k, conv in zip(frame["key"].tolist(), frame["conv"].tolist()):
            if k == key:
                state.update(f",{conv}".encode())
                continue
            if key is not None:
                out.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(str(conv).encode())
        if out:
            yield pd.DataFrame(out, columns=["key", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends"])


def prefix_trie(rows, members=None, budget=BUDGET, segment=SEGMENT):
    """One row per node: key (digest of its path), parent (null: root), turn (id of its last turn), depth, words, conv_id
    (smallest member), parent_conv_id, n_convs, n_ends, n_children, n_leaves, saved_words (both over the subtree) and ends
    (SHA-256 of the ids that end here). ``rows``: id, place, turn, words, as from ``turns``; ``members``: ids (column id)
    that count even without a turn."""
    if members is not None:
        nothing = members.select("id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"))
        rows = rows.select("id", "place", "turn", "words").unionByName(nothing)
    sorted_ = rows.repartition("id").sortWithinPartitions("id", "place")
    grown = stored(sorted_.select("id", "turn", "words").mapInPandas(_grow(budget, segment), _ROWS))

    # What depends on the key alone is part of the grouping: the buffers then are numbers.
    nodes = grown.filter(F.col("kind") == NODE).groupBy("key", "parent", "turn", "depth", "words").agg(
        F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends"), F.min("conv").alias("conv_id")
    )
    nodes = stored(nodes)
    leaf = (F.col("n_convs") == F.col("n_ends")).cast("long")
    paths = grown.filter(F.col("kind") == PATH).select("conv", "depth", "key", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    own = nodes.select(
        F.col("conv_id").alias("conv"), "depth", F.lit(None).cast("binary").alias("key"), leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    )
    upwards = Window.partitionBy("conv").orderBy(F.desc("depth"), F.col("key").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    through = paths.unionByName(own).withColumns({"leaves": F.sum("leaves").over(upwards), "saved": F.sum("saved").over(upwards)})
    through = through.filter("key IS NOT NULL AND (leaves > 0 OR saved > 0)").select("key", "leaves", "saved", F.lit(0).alias("children"))
    children = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("key"), F.lit(0).alias("leaves"), F.lit(0).alias("saved"), F.lit(1).alias("children"))
    sums = through.unionByName(children).groupBy("key").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_words"), F.sum("children").alias("n_children")
    )
    ended = grown.filter(F.col("kind") == END).select("key", "conv").repartition("key").sortWithinPartitions("key", "conv")
    ends = ended.mapInPandas(_ends, "key binary, ends string")

    root_conv = nodes.filter("depth = 0").agg(F.min("conv_id")).scalar()
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("upper"))
    deep = nodes.filter("depth > 1").join(parents, "parent").withColumnRenamed("upper", "parent_conv_id")
    flat = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, root_conv))
    out = deep.unionByName(flat).join(sums, "key").join(ends, "key", "left")
    return out.withColumn("ends", F.coalesce("ends", F.sha2(F.lit(""), 256)))


def node_turns(nodes, conversations, role_col="role", text_col="text"):
    """key, role and text of the last turn of every node but the root."""
    role, text = (F.coalesce(F.col(quoted(c)), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    said = conversations.select(F.substring(digest, 1, WIDTH).alias("turn"), role.alias("role"), text.alias("text")).dropDuplicates(["turn"])
    return nodes.filter("turn IS NOT NULL").select("key", "turn").join(said, "turn").select("key", "role", "text")


def with_shared_heads(rows, group=20, longest=4):
    """(rows, members): conversations that begin like the first of their ``group``: for CRC-32 of the id modulo ``longest``
    turns, and go on with their own turns after as many. At most ``2 * group - 1`` conversations share a head."""
    head = F.crc32(F.col("id").cast("string")) % longest
    members = stored(rows.select("id").distinct())
    first = rows.filter((F.col("id") % group == 0) & (F.col("place") < longest)).withColumnRenamed("id", "base")
    wanted = members.select("id", (F.col("id") - F.col("id") % group).alias("base"), head.alias("head"))
    heads = wanted.join(first, "base").filter(F.col("place") <= F.col("head")).select("id", "place", "turn", "words")
    return heads.unionByName(rows.filter(F.col("place") > head)), members


ORACLE = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, h, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS place FROM t),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql('conv_id::VARCHAR')} % 4 AS head FROM (SELECT DISTINCT conv_id FROM t) x, crc),
r AS (SELECT i.conv_id, place, h, words FROM ids i JOIN o ON o.conv_id = i.base AND place <= head
  UNION ALL SELECT i.conv_id, place, h, words FROM ids i JOIN o ON o.conv_id = i.conv_id AND place > head),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path, words
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
every AS (SELECT conv_id, 0::BIGINT AS depth, '' AS path, 0::BIGINT AS words FROM ids UNION ALL SELECT * FROM p),
n AS (SELECT conv_id, max(depth) AS n FROM every GROUP BY conv_id),
nodes AS (SELECT path, depth, min(e.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
  sha256(coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id) FILTER (depth = n), '')) AS ends_sha256
  FROM every e JOIN n ON e.conv_id = n.conv_id GROUP BY path, depth),
kids AS (SELECT left(path, -64) AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path, depth)),
up AS (SELECT left(path, 64 * k) AS path, k AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_) u GROUP BY ALL)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN up USING (path, depth) LEFT JOIN nodes q ON f.depth > 0 AND q.depth = f.depth - 1 AND q.path = left(f.path, -64)
"""
