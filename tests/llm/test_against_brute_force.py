"""Each operator against a plain version on a small corpus."""

import hashlib
import math
from collections import Counter

import pytest
from helpers import corpus, plain, prose, spaced, table

from segspan.llm import chaining, decontam, jaccard, lengths, mixing, search, suffix


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.mark.parametrize(("hot", "small", "block", "at_once", "bundle"), [(jaccard.HOT, jaccard.SMALL, jaccard.BLOCK, jaccard.AT_ONCE, jaccard.BUNDLE_BYTES), (3, 2, 4096, 0, 2000), (jaccard.HOT, 2, 6, 1, 2000)])
def test_jaccard(docs, rows, hot, small, block, at_once, bundle, monkeypatch):
    for name, value in (("SMALL", small), ("BLOCK", block), ("AT_ONCE", at_once), ("BUNDLE_BYTES", bundle)):
        monkeypatch.setattr(jaccard, name, value)
    sets = {}
    for k, t, *_ in rows:
        w = spaced(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, hot=hot).collect()}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("meet", [suffix.MEET, 2])
def test_suffix(docs, rows, meet):
    seen, want = {}, {}
    for k, t, *_ in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - 49):
            if seen.setdefault(b[q : q + 50], k) < k:
                gone[q : q + 50] = b"\x01" * 50
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        want[k] = (len(b), sum(gone), sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in suffix.substring_dedup(docs, meet=meet).collect()}
    assert got == want


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_decontam(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    texts = {k: t for k, t, *_ in rows}
    items = [(1, " ".join(texts[6].split()[-40:])), (2, "w1 w2"), (3, " ".join(texts[4].split()[:5])), (10, texts[20].upper()), (4, ""), (5, None), (2, texts[30])]
    windows = {}
    for i, t in items:
        w = plain(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = {}
    for k, t in texts.items():
        w, hit, found = plain(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if own := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= own
        want[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in decontam.digest(decontam.contamination(docs, bench)).collect()} == want
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {k for k, x in want.items() if not x[-1]}


def test_search(docs, rows):
    tf = {k: Counter(plain(t)) for k, t, *_ in rows}
    n, mean = len(rows), sum(sum(c.values()) for c in tf.values()) / len(rows)
    df = Counter(w for c in tf.values() for w in c)
    want = set()
    for q in (k for k in tf if k % 20 == 0):
        scores = []
        for d, c in tf.items():
            own = [w for w in tf[q] if w in c]
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in own)
            if own:
                scores.append((-round(s, 6), d))
        want |= {(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:10])}
    got = {(r.query_id, r.rank, r.doc_id, r.score) for r in search.top_k(docs, docs.where("doc_id % 20 = 0")).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in want}
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_lengths(docs, rows):
    from pathlib import Path

    encode = lengths.encoder(Path(lengths.VOCABULARY).read_bytes()).encode_ordinary
    n = [len(encode(t)) if t else 0 for _, t, *_ in rows]
    got = {r.n_tokens: r for r in lengths.token_counts(docs).collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(n)
    for k, r in got.items():
        assert r.docs_at_least == sum(x >= k for x in n) and r.tokens_at_least == sum(x for x in n if x >= k)
        assert r.truncated_total == sum(min(x, k) for x in n) and r.tokens_total == sum(n)
        assert abs(r.share_at_most - sum(x <= k for x in n) / len(n)) < 1e-12
    h = lengths.length_histogram(lengths.token_lengths(docs))
    assert {r.limit: (r.kept_tokens, r.cut_docs) for r in lengths.truncated_totals(h, [0, 17, 10**6]).collect()} == {k: (sum(min(x, k) for x in n), sum(x > k for x in n)) for k in (0, 17, 10**6)}
    q = {r.share: r.n_tokens for r in lengths.quantiles(lengths.suffix_sums(h), [0.5, 1.0]).collect()}
    assert q == {0.5: sorted(n)[-(-len(n) // 2) - 1], 1.0: max(n)}


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert {(r.doc_id, r.taken) for r in got} == again and len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    per = {}
    for r in got:
        p = per.setdefault(r.source, [0, r.source_size, r.target, 0])
        p[0] += r.taken
        p[3] += r.size
    total = sum(p[3] for p in per.values())
    assert all(p[3] == p[1] and p[0] == math.floor(p[2]) for p in per.values())
    assert abs(sum(p[2] for p in per.values()) - total) < 1e-6
    assert {k: len(spaced(t)) for k, t, *_ in rows} == {r.doc_id: r.size for r in got}


def test_chaining(spark):
    import random

    r = random.Random(8)
    passage = prose(r, 90).split()
    fuzzy = list(passage)
    for k in range(7, 90, 13):
        fuzzy[k] = f"edit{k}"
    del fuzzy[40]
    texts = [prose(r, 200), prose(r, 50) + " " + " ".join(passage) + " " + prose(r, 40), prose(r, 300), prose(r, 30) + " " + " ".join(passage) + " " + prose(r, 60), prose(r, 20) + " " + " ".join(fuzzy), " ".join(passage[:45]) + " " + prose(r, 90)]
    texts += [texts[2]]
    docs = table(spark, [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)])
    got = {x.doc_id: [(s.start, s.end) for s in x.spans or []] for x in chaining.fuzzy_dedup(docs).collect()}
    assert got[0] == got[1] == got[2] == got[5] == []
    assert got[3] == [(30, 120)] and got[6] == [(0, 300)]
    assert len(got[4]) == 1 and got[4][0][0] == 20 and abs(got[4][0][1] - 109) <= 2
    left = {x.doc_id: x for x in chaining.without_passages(docs).collect()}
    assert set(left) == {0, 1, 2, 3, 4, 5} and left[3].n_chars == len(left[3].text) and len(left[3].text.split()) == 90


def test_chain_prefers_few_gaps():
    import numpy as np

    f = np.zeros(4, chaining.FRAGMENT)
    for k, (x, y, n) in enumerate([(0, 0, 20), (22, 23, 20), (44, 400, 9), (60, 61, 15)]):
        f[k] = (x, x + n, y, y + n)
    best = chaining.chain(f)[0]
    assert best["x0"].tolist() == [0, 22, 60]
