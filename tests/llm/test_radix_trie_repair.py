"""Exact dedup, prefix trie and structure repair against plain versions, and on odd rows."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from helpers import SCHEMA, corpus, odd_columns, table

from segspan.llm import prefixtrie, radix, structrepair
from segspan.llm.store import Scratch

TURNS = "conv_id long, turn long, role string, text string"
NONE = hashlib.sha256().hexdigest()


def equal_classes(rows):
    same = defaultdict(list)
    for k, t, *_ in rows:
        same[t or ""].append(k)
    return same


@pytest.mark.parametrize(("digit", "growth", "most"), [(radix.DIGIT, radix.GROWTH, radix.BROADCAST_BYTES), (3, 2, -1), (1, 4, 1 << 30)])
def test_radix(spark, digit, growth, most):
    rows = corpus(5, 40)
    # A long text, its copies, one that goes on, one that ends where others go on, and one that differs at its end.
    long = "prefix of all " * 90
    texts = [long, long, long + "x", long[:-1], long[:-1] + "y", long[:64], long[:64], "é", "e", long]
    rows += [(1000 + k, t, None, None, None) for k, t in enumerate(texts)]
    got = radix.classes(odd_columns(table(spark, rows)), digit=digit, growth=growth, broadcast_bytes=most).collect()
    same = equal_classes(rows)
    of = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        own, r = same[t or ""], of[k]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), k == max(own), hashlib.sha256((t or "").encode()).hexdigest())


def test_radix_edges(spark):
    assert radix.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (2, None), (3, ""), (4, "z" * 3_000_000), (5, "z" * 3_000_000), (6, "z" * 2_999_999)]
    got = radix.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = sorted((r.text_sha256[:4], -1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    want = [(sha("a"), -1, 1, 3, False), (sha("a"), 1, 1, 3, False), (sha("a"), 1, 1, 3, True), (sha("b"), 1, 1, 1, True), (sha("c"), -1, None, 2, False), (sha("c"), -1, None, 2, True)]
    want += [(sha(""), 2, 3, 2, False), (sha(""), 3, 3, 2, True), (sha("z" * 3_000_000), 4, 5, 2, False), (sha("z" * 3_000_000), 5, 5, 2, True), (sha("z" * 2_999_999), 6, 6, 1, True)]
    assert sorted(of, key=str) == sorted(want, key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h, host = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(host, [])[:h] + v[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for x in members:
        if x:
            kids[x[:-1]].append(x)
    sums, out = {}, set()
    for x in sorted(members, key=len, reverse=True):
        below = [sums[y] for y in kids[x]]
        leaves, saved = sum(b[0] for b in below) or 1, sum(b[1] for b in below)
        sums[x] = (leaves, saved + (len(members[x]) - 1) * (len(x[-1][1]) if x else 0))
        ends = ",".join(str(c) for c in sorted(members[x]) if len(convs[c]) == len(x))
        parent = min(members[x[:-1]]) if x else None
        out.add((min(members[x]), len(x), parent, len(members[x]), len(kids[x]), *sums[x], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def dialogues(seed, n=160):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), 200, 201, 299, -5, -100, 305]:
        for t in range(r.choice([0, 1, 2, 3, 5, 7, 9])):
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None, ""]), r.choice(["hi", "hi", "Ünï", "", None, "ok ok"])))
    rows += [(c, t, "user", f"long {t}") for c in (40, 41) for t in range(70)] + [(41, 99, "user", "more"), (None, 0, "user", "nobody's")]
    return rows


@pytest.mark.parametrize(("bits", "block"), [(64, prefixtrie.BLOCK_LOG2), (3, 3), (64, 2)])
def test_trie(spark, bits, block):
    rows = dialogues(bits + block)
    got = prefixtrie.trie(prefixtrie.rebuilt(odd_columns(spark.createDataFrame(rows, TURNS).repartition(5))), bits, block).collect()
    assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == plain_trie(rebuilt(rows))


def test_trie_edges(spark):
    of = lambda rows: {tuple(x) for x in prefixtrie.trie(prefixtrie.rebuilt(spark.createDataFrame(rows, TURNS))).collect()}
    assert of([]) == set()
    for rows in ([(None, 1, "a", "b")], [(7, 0, None, None)], [(k, 0, "user", "x") for k in range(9)], [(5, None, "user", "y" * 200_000)] * 9):
        assert of(rows) == (plain_trie(rebuilt(rows)) if rows[0][0] is not None else set())


def test_long_conversation_spans_ranges(spark):
    """Places are right where a conversation is cut by range borders."""
    rows = [(3, t, "user", f"turn {t:04}") for t in range(900)] + [(c, 0, "user", "x") for c in range(20)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = prefixtrie.numbered(spark.createDataFrame(rows, TURNS).repartition(6), Scratch(spark, "t")).where("conv_id = 3").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = sorted([(t, "user", f"turn {t:04}") for t in range(900)] + [(0, "user", "x")])
    assert [(x.k, x.text) for x in sorted(got, key=lambda x: x.k)] == [(k, x[2]) for k, x in enumerate(want)]


def cheapest(codes):
    """(cost, audit) by a heap over all edits, cheapest and then first."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    want = {0: "u", 1: "u", 2: "a", 3: "u"}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if i == len(codes) and s in (0, 3):
            return cost, audit
        if (i, s) in seen:
            continue
        seen.add((i, s))
        heapq.heappush(heap, (cost + 2, audit + "I", i, step[s, want[s]]))
        if i < len(codes):
            c = codes[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s))
            if c not in "0123":
                more, c = int(c.isupper()), c.lower()
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, step[s, want[s]]))
                if (s, c) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, step[s, c]))


def test_dial():
    r = random.Random(3)
    for _ in range(3000):
        codes = "".join(r.choice("suaoSUAO0123uauauaua") for _ in range(r.randrange(14)))
        cost, steps = structrepair.edits(codes)
        assert (cost, steps.translate(structrepair.AUDIT)) == cheapest(codes), codes
    cost, steps = structrepair.edits("ua" * 20_000 + "u")
    assert cost == 2 and len(steps) == 40_002


def plain_repair(rows):
    convs = defaultdict(list)
    sp = lambda x: " " if x is None else str(x)
    for c, turn, role, text in rows:
        own, f = convs[c], zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if f == 1 else "".join(x for x in text if x not in ".!?") if f == 2 else text
        own += [(turn is not None, turn or 0, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    out = set()
    for c, own in convs.items():
        own.sort()
        seen, codes, faults = set(), "", {"b": 0, "d": 0, "t": 0, "": 0}
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            k = "sua".find(role[:1]) if role else -1
            codes += ("0123" if fault in "bd" and fault else "SUAO" if fault == "t" else "suao")[k]
        turns = [x[1] for x in own if x[0]]
        roles = [x[2][:1] for x in own]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        cost, audit = cheapest(codes)
        text, i, state = [], 0, 0
        for e in audit:
            wanted = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
            role = own[i][2] if e == "K" else wanted
            if e != "D":
                text.append(f"{role}:{'' if e == 'I' else own[i][3]}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            i += e != "I"
        out.add((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["b"], faults["d"], faults["t"], bad, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("piece", [structrepair.PIECE_LOG2, 1])
def test_repair(spark, piece, monkeypatch):
    monkeypatch.setattr(structrepair, "PIECE_LOG2", piece)
    r = random.Random(piece)
    texts = ["Fine.", "Fine.", "Open end", "What? \n", "", " \t\x0b", None, "Stop!  ", "no. ", "Ünï!"]
    rows = [(c, r.choice([t, t, t, t + 2, None]), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), r.choice([*texts, f"Own {t}.", f"Own {c} {t}."])) for c in [*range(150), None] for t in range(r.randrange(1, 9))]
    rows += [(7, None, "user", "x"), (7, None, "user", "x")]
    got = structrepair.digest(structrepair.repairs(structrepair.damaged(odd_columns(spark.createDataFrame(rows, TURNS).repartition(4))))).collect()
    assert len(got) == len({r[0] for r in rows}) and {tuple(x) for x in got} == plain_repair(rows)


def test_repair_edges(spark):
    of = lambda rows: structrepair.digest(structrepair.repairs(structrepair.damaged(spark.createDataFrame(rows, TURNS)))).collect()
    assert of([]) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert [tuple(x) for x in of([(gone, 0, "user", "x.")])] == [(gone, 0, 0, 0, 0, 0, 0, "", NONE)]
    long = [(1, t, ("user", "assistant")[t % 2], f"Turn {t} " + "word " * 500 + ".") for t in range(400)]
    assert {tuple(x) for x in of(long)} == plain_repair(long)
