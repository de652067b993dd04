"""Repair of conversation structure at the least cost of edits.

A conversation is right if its roles read `(s?(ua)+)?` by their initials. States are what has been read: nothing (or a
whole exchange), the system turn, a user turn, an answer. A node is (rows done, state), an edit is an arc with a cost
of 0 to 3, and the cheapest repair is a shortest path. Costs are small integers, so Dial's bucket queue finds the
distances to the end without comparisons: four buckets in a ring, each node in the bucket of its distance. Then the
path is walked from the start over tight arcs (those whose cost is just the difference of distances), each time over
the one whose edit has the least initial, which gives the first audit of all cheapest ones.

On Spark: turns are dealt by ranges of their whole order, so that a long conversation spans tasks; every row becomes
one character (its role and fault), pieces of which are joined in two steps; a conversation is solved from that
string alone, which is no longer than the audit it returns. Edits travel back to the rows in pieces, and repaired
texts are digested in order as they stream by, so that no task holds a conversation's texts. (A SHA-256 of a whole
repaired conversation is one chain: its texts pass through one task, one after the other.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import Scratch

#: Row ids (by powers of two) whose characters make one piece.
PIECE_LOG2 = 12
#: White space, ends of sentences, and what the repairs cost.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: One character a row: initials of its role (o for any other) if sound, capitals if truncated, digits if it has to go.
SOUND, CUT, GONE = "suao", "SUAO", "0123"
#: State after a turn of each role: (state, initial) -> state. From the start a system or a user turn, and so on.
START, SYSTEM, USER, ANSWER = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ANSWER, (ANSWER, "u"): USER}
#: The one turn that a user or assistant row can be in each state.
WANTED = {START: "u", SYSTEM: "u", USER: "a", ANSWER: "u"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped, 2: repeated): the rows with faults made by crc32(`conv_id:turn`) % 20.

    Nulls in the key, in roles and in texts count as one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), fault.alias("fault"))
    new = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), new.alias("text"), F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


def distances(codes: str) -> tuple[np.ndarray, int]:
    """(distance to the end of each node 4 * row + state, that of the start), by Dial's buckets from the end backwards.

    Nodes farther than the start keep a large number: no cheapest path meets them.
    """
    n = len(codes)
    far = 1 << 30
    dist = np.full(4 * n + 4, far, np.int32)
    before: dict[int, list[tuple[int, int]]] = {s: [(a, INSERT) for (a, c), z in NEXT.items() if z == s and WANTED[a] == c] for s in range(4)}
    ring: list[list[int]] = [[4 * n + START, 4 * n + ANSWER], [], [], []]
    dist[4 * n + START] = dist[4 * n + ANSWER] = 0
    at, waiting = 0, 2
    while waiting:
        bucket = ring[at & 3]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != at:
                continue
            i, s = node >> 2, node & 3
            arcs = [((i << 2) + a, INSERT) for a, _ in before[s]]
            if i:
                c, row = codes[i - 1], (i - 1) << 2
                arcs.append((row + s, DELETE))
                if c not in GONE:
                    extra, c = (TRUNCATED, c.lower()) if c in CUT else (0, c)
                    for (a, initial), z in NEXT.items():
                        if z == s:
                            if initial == c:
                                arcs.append((row + a, extra))
                            if initial == WANTED[a]:
                                arcs.append((row + a, REROLE + extra))
            for other, cost in arcs:
                if at + cost < dist[other]:
                    dist[other] = at + cost
                    ring[(at + cost) & 3].append(other)
                    waiting += 1
        if dist[START] == at:
            break
        at += 1
    return dist, int(dist[START])


def edits(codes: str) -> tuple[int, str]:
    """(cost, edits): `K` keep, `D` delete, `u` or `a` the role a row gets, `U` or `A` a turn put in before it.

    Of all cheapest repairs the one whose audit (`audit`) is first in ASCII order.
    """
    dist, cost = distances(codes)
    n, node, out = len(codes), START, []
    while not (node >> 2 == n and dist[node] == 0):
        i, s = node >> 2, node & 3
        left = dist[node]
        role = WANTED[s]
        goes, sound = i < n and codes[i] in GONE, i < n and codes[i] not in GONE
        c = codes[i].lower() if sound else ""
        extra = TRUNCATED if sound and codes[i] in CUT else 0
        down = (i + 1) << 2
        # The order of the initials: Delete, Insert, Keep, Rerole.
        if (goes or sound) and dist[down + s] + DELETE == left:
            node, step = down + s, "D"
        elif dist[(i << 2) + NEXT[s, role]] + INSERT == left:
            node, step = (i << 2) + NEXT[s, role], role.upper()
        elif sound and (s, c) in NEXT and dist[down + NEXT[s, c]] + extra == left:
            node, step = down + NEXT[s, c], "K"
        else:
            node, step = down + NEXT[s, role], role
        out.append(step)
    return cost, "".join(out)


AUDIT = str.maketrans("uaUA", "RRII")


def illegal(codes: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    roles = codes.translate(str.maketrans(CUT + GONE, SOUND + SOUND))
    return max(0, len(roles) - 1) - sum(roles[i : i + 2] in ("su", "ua", "au") for i in range(len(roles) - 1))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From key, codes, pieces (piece, rows): cost, audit, illegal, and the edits of each piece."""
    for batch in batches:
        rows = []
        for key, codes, pieces in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            cost, steps = edits(codes)
            own, at, done = [], 0, 0
            # Where in `steps` the edits of each row begin; turns put in belong to the row after them, the last ones to the last piece.
            ends = [k + 1 for k, x in enumerate(steps) if x not in "UA"]
            for p in pieces:
                done += p["rows"]
                end = len(steps) if done == len(codes) else ends[done - 1]
                own.append({"piece": p["piece"], "steps": steps[at:end]})
                at = end
            rows.append((key, illegal(codes), cost, steps.translate(AUDIT), own))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("piece", pa.int64()), ("steps", pa.string())]))]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["key", "illegal", "cost", "audit", "own"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each repaired conversation, from rows in order: the edits of a piece (`steps`), then the turns of the piece."""
    roles = {"u": "user", "a": "assistant"}
    key0, state, steps, at, joint = None, None, "", 0, ""

    def write(role: str, text: str) -> None:
        nonlocal joint
        state.update(f"{joint}{role}:{text}".encode())
        joint = "\n"

    def put_in() -> None:
        """The turns that stand before the next row, or at the end."""
        nonlocal at
        while at < len(steps) and steps[at] in "UA":
            write(roles[steps[at].lower()], "")
            at += 1

    def out(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["key", "repaired_sha256"])

    for batch in batches:
        done = []
        for key, own, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key != key0:
                if state:
                    put_in()
                    done.append((key0, state.hexdigest()))
                key0, state, steps, at, joint = key, hashlib.sha256(), "", 0, ""
            if own is not None:
                steps, at = own, 0
                continue
            put_in()
            step, at = steps[at], at + 1
            if step != "D":
                write(roles.get(step, role), text)
        yield out(done)
    if state:
        put_in()
        yield out([(key0, state.hexdigest())])


def _spaced(text: Column) -> Column:
    """The text without white space at its end: empty where it is blank."""
    return F.rtrim(text, F.lit(BLANKS))


def repairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, applied): per conversation its faults, cost and audit, and the digest of its repaired turns.

    `turns`: conv_id, turn, role, text, and copies (how often a row stands there; 0 makes the conversation known
    without the row). Rows stand by turn (nulls first), then role, then text.

    Defined cases: a conversation none of whose rows stand has no faults, cost 0 and an empty audit; a null conv_id is
    a conversation of its own; roles count by their first character, which must be s, u or a to be kept; a row that is
    equal to an earlier one and blank counts as blank; gaps ignore null turns; an empty table gives empty frames;
    further columns are not read.
    """
    scratch = Scratch(turns.sparkSession, "repair")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    # `key` is the id as text, so that a null one can be joined and grouped too.
    kept = turns.where("copies > 0").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", "copies")
    kept = kept.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    rows = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    rows = scratch.put("rows", rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "conv_id", "turn", "role", "text", "id"))
    # Flags from here on; a digest of role and text stands for both, so that texts stay where they are.
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    bare = _spaced(F.col("text"))
    flags = rows.select("key", "conv_id", "turn", "id", F.substring("role", 1, 1).alias("r"), (bare == "").alias("blank"), F.unhex(content).alias("content"), (~F.right(bare, F.lit(1)).isin(*STOPS)).alias("cut"))
    seen = F.row_number().over(W.partitionBy("key", "content").orderBy("id")) > 1
    fault = F.when(F.col("blank"), "b").when(F.col("seen"), "d").when(F.col("cut"), "t").otherwise("")
    letter = F.when(F.col("r").isin(*SOUND[:3]), F.col("r")).otherwise("o")
    code = F.when(F.col("fault").isin("b", "d"), F.translate(letter, SOUND, GONE)).when(F.col("fault") == "t", F.upper(letter)).otherwise(letter)
    coded = flags.withColumn("seen", seen).withColumn("fault", fault).select("key", "conv_id", "turn", "id", F.shiftright("id", PIECE_LOG2).alias("piece"), "fault", code.alias("code"))
    n = lambda x: F.sum(F.when(F.col("fault") == x, 1).otherwise(0)).cast("long")
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "code"))), lambda x: x["code"]), "")
    pieces = coded.groupBy("key", "piece").agg(F.first("conv_id").alias("conv_id"), in_order.alias("codes"), F.count(F.lit(1)).alias("rows"), n("b").alias("blank"), n("d").alias("duplicate"), n("t").alias("truncated"))
    listed = F.array_sort(F.collect_list(F.struct("piece", "rows", "codes")))
    whole = pieces.groupBy("key").agg(F.first("conv_id").alias("conv_id"), listed.alias("p"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    whole = scratch.put("coded", whole.select("key", "conv_id", F.array_join(F.transform("p", lambda x: x["codes"]), "").alias("codes"), F.transform("p", lambda x: F.struct(x["piece"].alias("piece"), x["rows"].alias("rows"))).alias("pieces"), "blank", "duplicate", "truncated"))
    kind = "key string, illegal long, cost long, audit string, own array<struct<piece:long,steps:string>>"
    solved = scratch.put("solved", whole.select("key", "codes", "pieces").mapInArrow(_solve, kind))
    # Distinct turns of a conversation, combined in two steps.
    turn = rows.where("turn is not null").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key")
    gaps = turn.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    known = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").cast("long").alias("conv_id")).distinct()
    facts = known.join(whole.select("key", "blank", "duplicate", "truncated"), "key", "left").join(solved.drop("own"), "key", "left").join(gaps, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    facts = facts.select("key", "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"))
    steps = solved.select("key", F.inline("own")).select("key", "piece", F.lit(-1).cast("long").alias("id"), "steps", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    stream = steps.unionByName(rows.select("key", F.shiftright("id", PIECE_LOG2).alias("piece"), "id", F.lit(None).cast("string").alias("steps"), "role", "text"))
    stream = stream.repartition("key").sortWithinPartitions("key", "piece", "id").select("key", "steps", "role", "text")
    applied = stream.mapInArrow(_applied, "key string, repaired_sha256 string")
    return facts, applied


def digest(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation."""
    facts, applied = parts
    none = F.lit(hashlib.sha256().hexdigest())
    return facts.join(applied, "key", "left").drop("key").withColumn("repaired_sha256", F.coalesce("repaired_sha256", none))


ORACLE = """
WITH RECURSIVE keys AS (
  SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations
), bits AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS b)
), crc(s, i, x) AS (
  SELECT s, 1, 4294967295 FROM keys
  UNION ALL
  SELECT s, i + 1, xor(x // 256, v) FROM crc JOIN bits ON b = xor(x % 256, ascii(s[i])) WHERE i <= length(s)
), fault AS (
  SELECT s, xor(x, 4294967295) % 20 AS f FROM crc WHERE i = length(s) + 1
), dam AS (
  SELECT conv_id AS c, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM conversations JOIN fault ON s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')
), num AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) - 1 AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST) > 1 AS seen,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, role[1] AS r
  FROM dam
), rows_ AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(r) OVER (PARTITION BY c ORDER BY i) AS r0 FROM num
), nxt(st, r, st2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
want(st, st2, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
ins AS (
  SELECT st, st AS st2, 0 AS cost, '' AS a, CAST([] AS VARCHAR[]) AS t FROM want
  UNION ALL SELECT st, st2, 2, 'I', [role || ':'] FROM want
  UNION ALL SELECT x.st, y.st2, 4, 'II', [x.role || ':', y.role || ':'] FROM want x JOIN want y ON y.st = x.st2
), ops AS (
  SELECT c, i, fault, 'D' AS op, s.st, s.st AS st2, 3 AS cost, CAST([] AS VARCHAR[]) AS t FROM rows_, want s
  UNION ALL SELECT c, i, fault, 'K', st, st2, CAST(fault = 't' AS INT), [role || ':' || text] FROM rows_ JOIN nxt USING (r) WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT c, i, fault, 'R', st, st2, 2 + CAST(fault = 't' AS INT), [want.role || ':' || text] FROM rows_, want WHERE fault NOT IN ('b', 'd')
), dp(c, i, st, m) AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT), 0, {'cost': 0, 'audit': '', 't': CAST([] AS VARCHAR[])} FROM rows_
  UNION ALL
  SELECT dp.c, dp.i + 1, ops.st2, min({'cost': m.cost + ins.cost + ops.cost, 'audit': m.audit || ins.a || ops.op, 't': list_concat(list_concat(m.t, ins.t), ops.t)})
  FROM dp JOIN ins ON ins.st = dp.st JOIN ops ON ops.c = dp.c AND ops.i = dp.i AND ops.st = ins.st2 GROUP BY dp.c, dp.i, ops.st2
), best AS (
  SELECT dp.c, min({'cost': m.cost + ins.cost, 'audit': m.audit || ins.a, 't': list_concat(m.t, ins.t)}) AS m
  FROM dp JOIN ins ON ins.st = dp.st JOIN (SELECT c, count(*) AS n FROM rows_ GROUP BY c) USING (c) WHERE i = n AND ins.st2 IN (0, 3) GROUP BY dp.c
), facts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE i > 0 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY c
)
SELECT k.c AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(m.cost, 0) AS BIGINT) AS cost, coalesce(m.audit, '') AS audit,
       sha256(coalesce(array_to_string(m.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS c FROM conversations) k LEFT JOIN facts f ON f.c IS NOT DISTINCT FROM k.c LEFT JOIN best b ON b.c IS NOT DISTINCT FROM k.c
"""
