"""Repair of conversation structure: the cheapest edits after which the roles read ``(s?(ua)+)?`` by their first letters.

Edits of a turn: Keep (0), Rerole to user or assistant (3), Delete (4; blank and duplicate turns must go), Insert an empty
user or assistant turn before, between or after (3); a truncated turn that stays adds 3. Of equally cheap edits the ASCII-
least string of their initials counts.

A dynamic program runs over the turns of a conversation in order. What it carries is, for each of four ends (nothing yet,
system, user, assistant), the cost of the best edits that lead there and their rank in ASCII order. Costs count from the
cheapest and ends that can't win any more are dropped, so only a few hundred situations exist: they are numbered once, and
a turn is one step of that automaton. What is kept of a turn is two bytes, from which the edits are traced back.

1. Turns are dealt by conversation and sorted there by text (to flag repeats) and then by turn; texts stay behind, their
   SHA-256 goes along. ``mapInPandas`` reads the sorted stream and carries the situation across Arrow batches.
2. The two-byte steps leave as rows of at most ``block`` turns. These rows are the spill of a giant conversation: Spark
   keeps them, no task does. They are sorted backwards and traced back, again as a stream.
3. ``repaired_turns`` streams the turns once more beside their edits and puts out the repaired turns.

A conversation is read by one task, because its edits depend on all turns before them; the task holds no more than a batch,
a block and, in step 3, the string of edits. Small tasks are put together by adaptive execution.

Cases: null role or text is one space (blank, or no role); null turns come first; turns of one number follow each other by
the SHA-256 of role and text; a null conversation id is a conversation of its own; repeated rows are duplicates; a
conversation in which nothing stays has an empty audit; very long texts are hashed by Spark and never cut; an empty table
gives an empty result; other columns are left alone whatever their names.
"""

import functools
from array import array

import pandas as pd
from pyspark.sql import functions as F

from barwise.llm.common import quoted, stored

SOLID = r"[^\x20\x09-\x0D]"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BLOCK = 65536
RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

#: Where insertions lead: from each end, the end reached by each further one (back to the same end would only cost).
_INSERTED = {EMPTY: [USER, ASSISTANT], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: [USER]}


def _then(end, initial):
    """The end after a turn with this initial, or None where it may not stand."""
    if initial == "s":
        return SYSTEM if end == EMPTY else None
    if initial == "u":
        return None if end == USER else USER
    return ASSISTANT if initial == "a" and end == USER else None


def _other(end):
    """The only role that may follow."""
    return ASSISTANT if end == USER else USER


def _closed(costs):
    """Least cost of each end with insertions, to tell which ends can't win any more."""
    best = dict(costs)
    for end, cost in costs.items():
        for k, reached in enumerate(_INSERTED[end], 1):
            best[reached] = min(best.get(reached, cost + k * INSERT), cost + k * INSERT)
    return best


@functools.cache
def automaton():
    """(steps, finals). A situation is a number; ``steps[situation * 12 + kind]`` is (next situation, cost added, for each
    end the end before and the edits). ``finals[situation]`` is (end, edits, cost added). ``kind``: 3 times the place of the
    role in "sua-" plus 0 for a sound turn, 1 for a truncated one, 2 for one that must go."""
    start = ((EMPTY, 0, 0),)
    numbers, order, steps, finals = {start: 0}, [start], [], []
    at = 0
    while at < len(order):
        ends = order[at]
        for kind in range(12):
            initial, state = "sua-"[kind // 3], kind % 3
            extra = TRUNCATED if state == 1 else 0
            found = {}
            for end, cost, rank in ends:
                for k, mid in enumerate([end, *_INSERTED[end]]):
                    moves = [(mid, DELETE, "D")]
                    if state < 2:
                        moves += [(_then(mid, initial), extra, "K"), (_other(mid), RETITLE + extra, "R")]
                    for target, price, letter in moves:
                        if target is not None:
                            new = (cost + k * INSERT + price, rank, "I" * k + letter, end)
                            found[target] = min(found.get(target, new), new)
            costs = _closed({t: f[0] for t, f in found.items()})
            accepted = costs.get(ASSISTANT, float("inf"))
            # Whatever may follow an end may follow these others too, for at most as much more.
            hopeless = {
                t for t, f in found.items()
                if f[0] > costs[t] or (t == SYSTEM and f[0] > min(accepted, costs.get(EMPTY, accepted)))
                or (t == EMPTY and f[0] > accepted + DELETE)
            }
            live = {t: f for t, f in found.items() if t not in hopeless}
            least = min(f[0] for f in live.values())
            ranked = sorted(live, key=lambda t: live[t][1:3])
            after = tuple((t, live[t][0] - least, ranked.index(t)) for t in sorted(live))
            if after not in numbers:
                numbers[after] = len(order)
                order.append(after)
            steps.append((numbers[after], least, {t: (f[3], f[2]) for t, f in live.items()}))
        at += 1
    for ends in order:
        tails = {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        cost, _, tail, end = min((c + INSERT * len(tails[e]), rank, tails[e], e) for e, c, rank in ends)
        finals.append((end, tail, cost))
    return steps, finals


def traced(moves, end):
    """(edits, end before them) of the steps ``moves`` that lead to ``end``."""
    steps, _ = automaton()
    out = []
    for step in reversed(moves):
        end, edits = steps[step][2][end]
        out.append(edits)
    return "".join(reversed(out)), end


class _Conversation:
    """What the first pass carries of one conversation."""

    def __init__(self, key):
        self.key, self.block, self.moves, self.situation = key, 0, array("H"), 0
        self.first = self.last = self.role = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0

    def add(self, known, turn, role, fault):
        if known and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.role is not None and self.role + role not in LEGAL:
            self.illegal += 1
        self.role = role
        self.blank += fault == 3
        self.duplicate += fault == 2
        self.truncated += fault == 1
        at = 3 * (("sua".find(role) if role else -1) % 4) + min(fault, 2)
        step = self.situation * 12 + at
        self.situation, more, _ = automaton()[0][step]
        self.cost += more
        self.moves.append(step)

    def cut(self):
        row = (self.key, self.block, self.moves.tobytes(), None, None, *[None] * len(STATS))
        self.block, self.moves = self.block + 1, array("H")
        return row

    def end(self):
        end, tail, more = automaton()[1][self.situation]
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.key, self.block, self.moves.tobytes(), end, tail, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + more)


_STEPS = "key string, block int, moves binary, goal int, tail string, " + ", ".join(f"{c} long" for c in STATS)
_PIECES = "key string, block int, piece string, " + ", ".join(f"{c} long" for c in STATS)


def _frame(rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    for c in names:
        if c in STATS or c in ("goal", "position"):
            frame[c] = frame[c].astype("Int64")
    return frame


def _program(block):
    def run(frames):
        now, out = None, []
        for frame in frames:
            for key, known, turn, role, fault in zip(*[frame[c].tolist() for c in ("key", "known", "turn", "initial", "fault")]):
                if now is None or key != now.key:
                    if now is not None:
                        out.append(now.end())
                    now = _Conversation(key)
                elif len(now.moves) == block:
                    out.append(now.cut())
                now.add(known, turn, role, fault)
            if out:
                yield _frame(out, _STEPS)
                out = []
        if now is not None:
            yield _frame([now.end()], _STEPS)

    return run


def _trace(frames):
    end = None
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if not pd.isna(row.goal):  # the last block of a conversation comes first
                end = int(row.goal)
            moves = array("H")
            moves.frombytes(row.moves)
            piece, end = traced(moves, end)
            out.append((row.key, row.block, piece + (row.tail or ""), *[getattr(row, c) for c in STATS]))
        yield _frame(out, _PIECES)


def _named(conversations, id_col, turn_col, role_col, text_col):
    role, text = (F.coalesce(F.col(quoted(c)), F.lit(" ")) for c in (role_col, text_col))
    turn = F.col(quoted(turn_col))
    rows = conversations.select(F.col(quoted(id_col)).alias("id"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    # The length of the role keeps (role, text) apart from any other pair with the same characters.
    return rows.select(
        F.col("id").cast("string").alias("key"), "turn", "role", "text",
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
    )


def audits(conversations, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", block=BLOCK):
    """One row per conversation: id, gaps (missing turn numbers), blank, duplicate, truncated (turns by their first fault),
    illegal (neighbours whose roles may not follow each other), cost and audit (the edits' initials in order)."""
    rows = _named(conversations, id_col, turn_col, role_col, text_col)
    solid = F.rtrim("text", F.lit(BLANKS))
    rows = rows.select(
        "key", "turn", "digest", F.substring("role", 1, 1).alias("initial"),
        F.when(solid == "", 3).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0).alias("fault"),
    ).repartition("key")
    # Both orders below need no further shuffle: what is dealt by conversation is dealt by conversation and text as well.
    again = F.row_number().over(_window("key", "digest", order="turn")) > 1
    rows = rows.withColumn("fault", F.when((F.col("fault") < 2) & again, 2).otherwise(F.col("fault")))
    rows = rows.select(
        "key", F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "initial", "fault", "digest",
    ).sortWithinPartitions("key", "known", "turn", "digest")
    steps = rows.drop("digest").mapInPandas(_program(block), _STEPS)
    back = steps.repartition("key").sortWithinPartitions("key", F.desc("block"))
    pieces = back.mapInPandas(_trace, _PIECES).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("pieces"), *[F.max(c).alias(c) for c in STATS]
    )
    id_type = conversations.schema[id_col].dataType
    return pieces.select(F.col("key").cast(id_type).alias("id"), *STATS, F.array_join("pieces.piece", "").alias("audit"))


def _window(*by, order):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(order)


_TURNS = "key string, position long, edit string, role string, text string"


def _apply(frames):
    """Repaired turns of a stream in which the edits of a conversation stand before its turns."""
    key, edits, at, end, position, out = None, "", 0, EMPTY, 0, []

    def put(edit, role, text):
        nonlocal position
        out.append((key, position, edit, role, text))
        position += 1

    def insertions():
        nonlocal at, end
        while edits[at : at + 1] == "I":
            end, at = _other(end), at + 1
            put("I", "assistant" if end == ASSISTANT else "user", "")

    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.audit is not None:
                insertions()  # those at the end of the conversation before
                key, edits, at, end, position = row.key, row.audit, 0, EMPTY, 0
                continue
            insertions()
            edit, at = edits[at], at + 1
            if edit == "K":
                end = _then(end, row.role[:1])
                put(edit, row.role, row.text)
            elif edit == "R":
                end = _other(end)
                put(edit, "assistant" if end == ASSISTANT else "user", row.text)
        if out:
            yield _frame(out, _TURNS)
            out = []
    insertions()
    if out:
        yield _frame(out, _TURNS)


def repaired_turns(conversations, found, id_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """The repaired conversations: key (the id as text), position, edit, role, text. ``found``: what ``audits`` gave.
    Inside a partition a conversation's rows follow each other in order."""
    rows = _named(conversations, id_col, turn_col, role_col, text_col)
    nothing = lambda kind: F.lit(None).cast(kind)
    head = found.select(
        F.col("id").cast("string").alias("key"), "audit", nothing(rows.schema["turn"].dataType).alias("turn"),
        nothing("string").alias("role"), nothing("string").alias("text"), nothing("binary").alias("digest"),
    )
    both = head.unionByName(rows.withColumn("audit", nothing("string"))).repartition("key")
    both = both.sortWithinPartitions("key", F.col("audit").isNull(), "turn", "digest")
    return both.select("key", "audit", "role", "text").mapInPandas(_apply, _TURNS)


def _digests(frames):
    import hashlib

    key, state, known = None, None, False
    for frame in frames:
        out = []
        for k, role, text in zip(frame["key"].tolist(), frame["role"].tolist(), frame["text"].tolist()):
            line = f"{role}:{text}".encode()
            if known and k == key:
                state.update(b"\n" + line)
                continue
            if known:
                out.append((key, state.hexdigest()))
            key, known, state = k, True, hashlib.sha256(line)
        if out:
            yield pd.DataFrame(out, columns=["key", "digest"], dtype=object)
    if known:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "digest"], dtype=object)


def repair_digests(conversations, **columns):
    """``audits`` with ``digest``: the SHA-256 of the repaired conversation, ``role:text`` joined by newlines."""
    found = stored(audits(conversations, **columns))
    read = repaired_turns(conversations, found, **{k: v for k, v in columns.items() if k != "block"})
    digests = read.mapInPandas(_digests, "key string, digest string")
    joined = found.join(digests, F.col("id").cast("string").eqNullSafe(F.col("key")), "left")
    return joined.select(*found.columns, F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"))


def damaged(conversations):
    """Conversations with planted faults, chosen by the CRC-32 of ``conv_id:turn``: a turn in twenty is lost, another is
    empty, without full stops, repeated, or given to the user. Nulls read as one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    role, text = text_of("role"), text_of("text")
    return conversations.filter(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


#: One row per byte value for the CRC-32, as a list.
CRC_TABLE = "SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t"


def crc32_sql(text):
    """CRC-32 of an ASCII text in DuckDB, with ``CRC_TABLE`` in scope as ``crc``."""
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda x, b: xor(x >> 8, crc.t[(xor(x, b) & 255) + 1])), 4294967295)"


def _least(*candidates):
    return "list_min([" + ", ".join(candidates) + "])"


def _oracle():
    """The plain dynamic program over whole strings of edits, by recursion over the turns."""
    add = lambda s, cost, letter, text="''": f"{{'c': {s}.c + {cost}, 'w': {s}.w || '{letter}', 't': {s}.t || {text}}}"
    new = lambda s, role: f"(CASE WHEN {s}.t = '' THEN '' ELSE chr(10) END) || '{role}:'"
    own = lambda s: f"(CASE WHEN {s}.t = '' THEN '' ELSE chr(10) END) || role || ':' || text"
    # where nothing stands yet, nothing is put before
    to_user = lambda s, n=1: add(s, 3, "I", new(s, "user"))
    to_assistant = lambda s: add(s, 3, "I", new(s, "assistant"))
    if_ = lambda condition, s: f"(CASE WHEN {condition} THEN {s} ELSE never END)"
    keep = lambda s, initial: if_(f"fault < 2 AND starts_with(role, '{initial}')", add(s, "fault * 3", "K", own(s)))
    rerole = lambda s, role: if_("fault < 2", add(s, "3 + fault * 3", "R", f"{new(s, role)} || text"))
    drop = lambda s: add(s, 4, "D")
    return f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
d AS (SELECT conv_id, turn, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate,
  coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE fate <> 0),
f AS (SELECT *, sha256(length(role) || ':' || role || text) AS h, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS solid FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, h ORDER BY turn NULLS FIRST, copy) AS nth FROM f),
r AS (SELECT conv_id, turn, i, role, text, CASE WHEN solid = '' THEN 3 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(solid, '[.!?]$') THEN 1 ELSE 0 END AS fault,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM g),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'w': '', 't': ''}} AS e, {{'c': 1000000000, 'w': '', 't': ''}} AS s,
    {{'c': 1000000000, 'w': '', 't': ''}} AS u, {{'c': 1000000000, 'w': '', 't': ''}} AS a FROM conversations
  UNION ALL
  SELECT conv_id, i, {drop('ve')}, {_least(drop('vs'), keep('ve', 's'))},
    {_least(drop('vu'), *[keep(v, 'u') for v in ('ve', 'vs', 'va')], *[rerole(v, 'user') for v in ('ve', 'vs', 'va')])},
    {_least(drop('va'), keep('vu', 'a'), rerole('vu', 'assistant'))}
  FROM (SELECT *, e AS ve, s AS vs, {_least('u', to_user('e'), to_user('s'), to_user('a'))} AS vu,
      {_least('a', to_assistant('u'), to_assistant('eu'), to_assistant('su'))} AS va
    FROM (SELECT dp.conv_id, r.i, e, s, u, a, role, text, fault, {to_user('e')} AS eu, {to_user('s')} AS su,
        {{'c': 1000000000, 'w': '', 't': ''}} AS never
      FROM dp JOIN r ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = dp.i + 1) x) y),
n AS (SELECT conv_id, max(i) AS n FROM dp GROUP BY conv_id),
z AS (SELECT dp.conv_id, {_least('e', 'a', to_assistant('u'), to_assistant('su'))} AS best
  FROM (SELECT *, {to_user('s')} AS su FROM dp) dp JOIN n ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.i = n.n),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 3) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c::BIGINT AS cost, best.w AS audit, sha256(best.t) AS repaired_sha256
FROM z LEFT JOIN c ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE = _oracle()
