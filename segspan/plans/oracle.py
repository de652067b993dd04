"""DuckDB SQL for the registered queries, written per position or per row, independently of the operators."""

from __future__ import annotations

BASE = """
slots AS (
  SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS k, min(l_partkey) AS a, min(l_suppkey) AS b, min(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2
), ps(predictor, shift) AS (VALUES ('p1', 0), ('p2', 3)),
sl AS (
  SELECT predictor, o, k, a, b, 40 * k + a % 10 AS s, 40 * k + a % 10 + 3 * (2 + b % 7) - 1 AS e, (q + shift) % 10 AS r FROM slots, ps
), gsec AS (
  SELECT predictor, o, s, e, row_number() OVER (PARTITION BY predictor, o ORDER BY s) - 1 AS idx FROM sl
), praw AS (
  SELECT predictor, o, s, e FROM sl WHERE r <= 3
  UNION ALL SELECT predictor, o, s + 1 + a % 3, e FROM sl WHERE r = 4
  UNION ALL SELECT predictor, o, s - 1 - a % 3, e FROM sl WHERE r = 5
  UNION ALL SELECT predictor, o, s, e + 1 + b % 4 FROM sl WHERE r = 6
  UNION ALL SELECT predictor, o, s, s + 1 FROM sl WHERE r = 8
  UNION ALL SELECT predictor, o, s + 4, e FROM sl WHERE r = 8
  UNION ALL SELECT predictor, o, s, 40 * (k + 1) + 9 FROM sl WHERE r = 9
  UNION ALL SELECT DISTINCT predictor, o, 5, 10 FROM sl WHERE o % 5 = 0
), pmark AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY predictor, o ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM praw
), pisl AS (
  SELECT *, sum(n) OVER (PARTITION BY predictor, o ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM pmark
), psec AS (
  SELECT predictor, o, min(s) AS s, max(e) AS e, row_number() OVER (PARTITION BY predictor, o ORDER BY min(s)) - 1 AS idx FROM pisl GROUP BY predictor, o, g
), seqs AS (SELECT DISTINCT predictor, o FROM sl)
"""

#: One row per position: g and h say whether reference and prediction are coding; gl and pl are the labels.
POS = """
, gpos AS (SELECT predictor, o, unnest(range(s, e + 1)) AS p FROM gsec)
, ppos AS (SELECT predictor, o, unnest(range(s, e + 1)) AS p FROM psec)
, ext AS (SELECT * FROM seqs
    LEFT JOIN (SELECT predictor, o, min(s) AS g0, max(e) AS g1 FROM gsec GROUP BY 1, 2) USING (predictor, o)
    LEFT JOIN (SELECT predictor, o, min(s) AS p0, max(e) AS p1 FROM psec GROUP BY 1, 2) USING (predictor, o))
, axis AS (SELECT *, unnest(range(0, 330)) AS p FROM ext)
, pos AS (
  SELECT x.predictor, x.o, x.p, CASE WHEN g.p IS NULL THEN 0 ELSE 1 END AS g, CASE WHEN h.p IS NULL THEN 0 ELSE 1 END AS h,
         CASE WHEN g.p IS NOT NULL THEN 0 WHEN x.p BETWEEN g0 AND g1 THEN 2 ELSE 8 END AS gl,
         CASE WHEN h.p IS NOT NULL THEN 0 WHEN x.p BETWEEN p0 AND p1 THEN 2 ELSE 8 END AS pl
  FROM axis x LEFT JOIN gpos g ON g.predictor = x.predictor AND g.o = x.o AND g.p = x.p LEFT JOIN ppos h ON h.predictor = x.predictor AND h.o = x.o AND h.p = x.p
)
"""

PAIRS = """
, pr AS (
  SELECT g.predictor, g.o, g.idx AS gi, p.idx AS pi, g.s AS gs, g.e AS ge, p.s AS ps, p.e AS pe, least(g.e, p.e) - greatest(g.s, p.s) + 1 AS bases, p.s - g.s AS r5, p.e - g.e AS r3,
         (least(g.e, p.e) - greatest(g.s, p.s) + 1) / (greatest(g.e, p.e) - least(g.s, p.s) + 1) AS iou
  FROM gsec g JOIN psec p ON g.predictor = p.predictor AND g.o = p.o AND p.s <= g.e AND p.e >= g.s
)
"""

INDEL = """
, grp AS (SELECT *, sum(d) OVER (PARTITION BY predictor, o ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM (
    SELECT *, CASE WHEN lag(g) OVER w = g AND lag(h) OVER w = h THEN 0 ELSE 1 END AS d FROM pos WINDOW w AS (PARTITION BY predictor, o ORDER BY p)))
, pieces AS (SELECT predictor, o, i, min(p) AS lo, max(p) AS hi, min(g) AS g, min(h) AS h FROM grp GROUP BY predictor, o, i)
, sides AS (SELECT *, coalesce(lag(g * h) OVER w, 0) AS l, coalesce(lead(g * h) OVER w, 0) AS r FROM pieces WINDOW w AS (PARTITION BY predictor, o ORDER BY lo))
, indel AS (SELECT predictor, o, lo, hi, hi - lo + 1 AS len, CASE h * 4 + l * 2 + r WHEN 7 THEN 'joined' WHEN 5 THEN '5_prime_extensions' WHEN 6 THEN '3_prime_extensions' WHEN 4 THEN 'whole_insertions'
    WHEN 3 THEN 'split' WHEN 1 THEN '5_prime_deletions' WHEN 2 THEN '3_prime_deletions' ELSE 'whole_deletions' END AS kind FROM sides WHERE g <> h)
"""

CHAINS = """
, gi AS (SELECT predictor, o, s, e FROM (SELECT predictor, o, e + 1 AS s, lead(s) OVER (PARTITION BY predictor, o ORDER BY s) - 1 AS e FROM gsec) WHERE e >= s)
, pin AS (SELECT predictor, o, s, e FROM (SELECT predictor, o, e + 1 AS s, lead(s) OVER (PARTITION BY predictor, o ORDER BY s) - 1 AS e FROM psec) WHERE e >= s)
, ef AS (SELECT predictor, o, count(*) FILTER (x.p = 1 AND x.g = 1) AS both_n, count(*) FILTER (x.g = 1 AND x.p = 0) AS gt_only, count(*) FILTER (x.g = 0 AND x.p = 1) AS pred_only,
           min(s) FILTER (x.g = 1) AS g0, max(e) FILTER (x.g = 1) AS g1, min(s) FILTER (x.p = 1) AS p0, max(e) FILTER (x.p = 1) AS p1
    FROM (SELECT predictor, o, s, e, max(g) AS g, max(p) AS p FROM (SELECT predictor, o, s, e, 1 AS g, 0 AS p FROM gsec UNION ALL SELECT predictor, o, s, e, 0, 1 FROM psec) GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2)
, nf AS (SELECT predictor, o, count(*) FILTER (x.p = 1 AND x.g = 1) AS both_n, count(*) FILTER (x.g = 1 AND x.p = 0) AS gt_only, count(*) FILTER (x.g = 0 AND x.p = 1) AS pred_only
    FROM (SELECT predictor, o, s, e, max(g) AS g, max(p) AS p FROM (SELECT predictor, o, s, e, 1 AS g, 0 AS p FROM gi UNION ALL SELECT predictor, o, s, e, 0, 1 FROM pin) GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2)
"""

FEATURES = """
, fraw AS (
  SELECT 'gt' AS source, o, s AS lo, e AS hi, 0 AS miss FROM gsec WHERE predictor = 'p1'
  UNION ALL SELECT predictor, o, s, e, CASE WHEN o % 13 = 5 THEN 500 ELSE 0 END FROM praw WHERE o % 11 <> 3
), fx AS (
  SELECT *, ((o // 14) // 3) * 1000 + ((o // 14) % 3) * 50 + 1 + miss AS off, (CASE WHEN source = 'gt' THEN 'gt' ELSE 'pr' END) || o AS id, 'chr' || (o % 7) AS seqid, CASE WHEN (o // 7) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM fraw
), exon AS (SELECT source, seqid, strand, id AS parent, lo + off AS s, hi + off AS e, o * 1000 + 1 + lo AS ord FROM fx)
, tr AS (SELECT source, seqid, strand, id, o, min(lo) + off AS s, max(hi) + off AS e, o * 1000 AS ord FROM fx GROUP BY source, seqid, strand, id, o, off)
, intr AS (SELECT DISTINCT source, seqid, parent, e AS d, nxt AS a FROM (SELECT *, lead(s) OVER (PARTITION BY source, seqid, parent ORDER BY s, e) AS nxt FROM exon) WHERE nxt IS NOT NULL)
, nint AS (SELECT source, seqid, parent, count(*) AS n FROM intr GROUP BY 1, 2, 3)
, tl AS (SELECT *, sum(n) OVER (PARTITION BY source, seqid, strand ORDER BY s, e, ord ROWS UNBOUNDED PRECEDING) AS locus FROM (
    SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY source, seqid, strand ORDER BY s, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM tr))
, lo AS (SELECT source, seqid, strand, locus, min(s) AS l0, max(e) AS l1, count(*) AS n FROM tl GROUP BY 1, 2, 3, 4)
, cand AS (
  SELECT g.seqid, g.strand, g.locus, p.source AS predictor, g.id AS gt_id, g.s AS gs, g.e AS ge, g.ord AS go, p.id AS pred_id, p.s AS ps, p.e AS pe, p.ord AS po
  FROM tl g JOIN lo l ON l.source = 'gt' AND l.seqid = g.seqid AND l.strand = g.strand AND l.locus = g.locus
  JOIN tr p ON p.source <> 'gt' AND p.seqid = g.seqid AND p.strand = g.strand AND p.s <= l.l1 AND p.e >= l.l0 WHERE g.source = 'gt'
), sh AS (
  SELECT c.*, coalesce(ng.n, 0) AS ng, coalesce(np.n, 0) AS np, (SELECT count(*) FROM intr x JOIN intr y ON x.d = y.d AND x.a = y.a AND y.source = c.predictor AND y.seqid = c.seqid AND y.parent = c.pred_id WHERE x.source = 'gt' AND x.seqid = c.seqid AND x.parent = c.gt_id) AS ns
  FROM cand c LEFT JOIN nint ng ON ng.source = 'gt' AND ng.seqid = c.seqid AND ng.parent = c.gt_id LEFT JOIN nint np ON np.source = c.predictor AND np.seqid = c.seqid AND np.parent = c.pred_id
), sc AS (
  SELECT *, greatest(0, least(ge, pe) - greatest(gs, ps) + 1) AS ov,
    CASE WHEN ng > 0 AND np > 0 AND ns > 0 THEN 2 * (ns / np) * (ns / ng) / (ns / np + ns / ng) ELSE 0 END AS f1,
    CASE WHEN ng = 0 OR np = 0 THEN CASE WHEN gs = ps AND ge = pe THEN 'exact' WHEN ps >= gs AND pe <= ge THEN 'contained' WHEN gs >= ps AND ge <= pe THEN 'contains' ELSE 'overlapping' END
      ELSE CASE WHEN ns = ng AND ns = np THEN 'exact' WHEN ns = np AND ps >= gs AND pe <= ge THEN 'contained' WHEN ns = ng AND gs >= ps AND ge <= pe THEN 'contains' WHEN ns > 0 THEN 'shared_junction' ELSE 'overlapping' END END AS mc
  FROM sh
), pairs AS (SELECT *, CASE WHEN ov = 0 THEN 0 WHEN ng > 0 AND np > 0 THEN f1 ELSE ov / greatest(ge - gs + 1, pe - ps + 1) END AS score FROM sc)
, bpl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seqid, strand, locus, predictor ORDER BY score DESC, gs, ge, go, po) AS r FROM pairs WHERE score > 0) WHERE r = 1)
"""

#: All one-to-one assignments of a locus, reference by reference; the best total wins, of equal ones that with the earlier pairs.
FULL = """
, fp AS (SELECT *, CAST(round(score * 1000000000) AS BIGINT) AS pts, row_number() OVER w AS k, count(*) OVER (PARTITION BY seqid, strand, locus, predictor) AS n, dense_rank() OVER (PARTITION BY seqid, strand, locus, predictor ORDER BY gs, ge, go) AS gr
    FROM pairs WHERE score > 0 WINDOW w AS (PARTITION BY seqid, strand, locus, predictor ORDER BY gs, ge, go, po))
, fl AS (SELECT seqid, strand, locus, predictor, max(gr) AS m FROM fp GROUP BY 1, 2, 3, 4)
, fw AS (
  SELECT seqid, strand, locus, predictor, m, CAST(0 AS BIGINT) AS gr, CAST([] AS VARCHAR[]) AS used, CAST([] AS BIGINT[]) AS ks, CAST(0 AS BIGINT) AS pts, CAST(0 AS DOUBLE) AS early FROM fl
  UNION ALL
  SELECT w.seqid, w.strand, w.locus, w.predictor, w.m, w.gr + 1, CASE WHEN x.k IS NULL THEN w.used ELSE list_append(w.used, x.pred_id) END, CASE WHEN x.k IS NULL THEN w.ks ELSE list_append(w.ks, x.k) END,
         w.pts + coalesce(x.pts, 0), w.early + coalesce(pow(0.5, x.k), 0)
  FROM fw w JOIN (SELECT seqid, strand, locus, predictor, gr, k, pred_id, pts FROM fp UNION ALL SELECT DISTINCT seqid, strand, locus, predictor, gr, NULL, NULL, NULL FROM fp) x
    ON x.seqid = w.seqid AND x.strand = w.strand AND x.locus = w.locus AND x.predictor = w.predictor AND x.gr = w.gr + 1
  WHERE x.k IS NULL OR NOT list_contains(w.used, x.pred_id)
), fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seqid, strand, locus, predictor ORDER BY pts DESC, early DESC) AS r FROM fw WHERE gr = m) WHERE r = 1)
, fd AS (SELECT p.* FROM fp p JOIN fb b ON b.seqid = p.seqid AND b.strand = p.strand AND b.locus = p.locus AND b.predictor = p.predictor AND list_contains(b.ks, p.k))
, fu AS (SELECT t.* FROM tr t WHERE t.source <> 'gt' AND NOT EXISTS (SELECT 1 FROM fd WHERE fd.predictor = t.source AND fd.seqid = t.seqid AND fd.strand = t.strand AND fd.pred_id = t.id))
, fm AS (SELECT t.* FROM tr t WHERE t.source = 'gt' AND NOT EXISTS (SELECT 1 FROM fd WHERE fd.seqid = t.seqid AND fd.strand = t.strand AND fd.gt_id = t.id))
"""


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p, r = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
    return f"round({p}, 9) AS precision, round({r}, 9) AS recall, round(CASE WHEN {tp} > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END, 9) AS f1"


def stats(x: str) -> str:
    return f"count({x}) AS count, round(coalesce(avg({x}), 0), 9) AS mean, round(coalesce(avg({x}), 0), 9) AS mae, round(coalesce(sqrt(avg({x} * {x})), 0), 9) AS rmse, round(coalesce(stddev_pop({x}), 0), 9) AS std, coalesce(CAST(min({x}) AS DOUBLE), 0) AS min, coalesce(CAST(max({x}) AS DOUBLE), 0) AS max"


def chain(facts: str, name: str) -> str:
    def hit(suffix: str, cond: str) -> str:
        return f"SELECT predictor, '{name}{suffix}' AS chain, count(*) FILTER (n_gt > 0 AND ({cond})) AS tp, count(*) FILTER (n_gt > 0 AND NOT ({cond})) AS fp, count(*) FILTER (n_gt > 0 AND NOT ({cond})) AS fn FROM f GROUP BY 1"

    inner = " UNION ALL ".join([hit("", "gt_only = 0 AND pred_only = 0"), hit("_subset", "n_pred > 0 AND pred_only = 0"), hit("_superset", "n_pred > 0 AND gt_only = 0")])
    return f"WITH {BASE}{CHAINS}, f AS (SELECT q.predictor, q.o, coalesce(gt_only, 0) AS gt_only, coalesce(pred_only, 0) AS pred_only, coalesce(both_n, 0) + coalesce(gt_only, 0) AS n_gt, coalesce(both_n, 0) + coalesce(pred_only, 0) AS n_pred FROM seqs q LEFT JOIN {facts} USING (predictor, o)), c AS ({inner}) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall FROM c"


def keyed(keys: str) -> str:
    return f"""WITH {BASE}{FEATURES}, k AS ({keys}), s AS (
  SELECT p.predictor, k.seqid, k.strand, k5, k3, max(CASE WHEN source = 'gt' THEN 1 ELSE 0 END) AS g, max(CASE WHEN source = p.predictor THEN 1 ELSE 0 END) AS h
  FROM k, ps p WHERE source IN ('gt', p.predictor) GROUP BY ALL
), c AS (SELECT predictor, count(*) FILTER (g = 1 AND h = 1) AS tp, count(*) FILTER (g = 0 AND h = 1) AS fp, count(*) FILTER (g = 1 AND h = 0) AS fn FROM s GROUP BY 1) SELECT *, {prf()} FROM c"""


CONF = "count(*) FILTER (g = 0 AND h = 0) AS tn, count(*) FILTER (g = 0 AND h = 1) AS fp, count(*) FILTER (g = 1 AND h = 0) AS fn, count(*) FILTER (g = 1 AND h = 1) AS tp FROM pos"

#: Windows (p, p + 1) with the last reference change at or before p and the next one after it.
EVENTS = """
, ch AS (SELECT *, lead(gl) OVER w AS g2, lead(pl) OVER w AS p2, lag(gl) OVER w AS gb FROM pos WINDOW w AS (PARTITION BY predictor, o ORDER BY p))
, near AS (SELECT *, CASE WHEN gl <> g2 THEN gl END AS x,
    last_value(CASE WHEN gb <> gl THEN gb END IGNORE NULLS) OVER (PARTITION BY predictor, o ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev,
    first_value(CASE WHEN gl <> g2 THEN g2 END IGNORE NULLS) OVER (PARTITION BY predictor, o ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM ch)
, ev AS (SELECT predictor, CASE WHEN gl <> g2 AND pl = gl THEN 'gt' WHEN pl = p2 THEN NULL WHEN gl = g2 AND pl = coalesce(prev, gl) AND p2 = gl THEN 'late' WHEN gl = g2 AND pl = gl AND p2 = coalesce(next, gl) THEN 'premature' ELSE 'spurious' END AS kind,
    gl AS ctx, CASE WHEN gl <> g2 AND pl = gl THEN g2 ELSE pl END AS row, p2 AS col FROM near WHERE g2 IS NOT NULL)
"""

#: Segments of both sides with their mismatch flag.
SEGMENTS = """
, sl2 AS (SELECT predictor, o, 'gt' AS side, p, gl AS label, gl <> pl AS x FROM pos UNION ALL SELECT predictor, o, 'pred', p, pl, gl <> pl FROM pos)
, sd AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS n FROM sl2 WINDOW w AS (PARTITION BY predictor, o, side ORDER BY p))
, si AS (SELECT *, sum(n) OVER (PARTITION BY predictor, o, side ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM sd)
, seg AS (SELECT predictor, o, side, label, min(p) AS lo, max(p) AS hi, bool_or(x) AS mismatch FROM si GROUP BY predictor, o, side, label, i)
"""

SQL: dict[str, str] = {
    "segment_flags": f"WITH {BASE}{POS}{SEGMENTS} SELECT predictor, side, label, mismatch, count(*) AS n, CAST(sum(hi - lo + 1) AS BIGINT) AS bases FROM seg GROUP BY 1, 2, 3, 4",
    "track_tiles": f"""WITH {BASE}{POS}{SEGMENTS}, m AS (SELECT predictor, side, label, mismatch, o * 330 + lo AS lo, o * 330 + hi AS hi FROM seg),
t AS (SELECT *, unnest(range(lo // 16384, hi // 16384 + 1)) AS t FROM m), b AS (SELECT *, least(hi, t * 16384 + 16383) - greatest(lo, t * 16384) + 1 AS n, CASE WHEN lo // 16384 = t THEN 1 ELSE 0 END AS s FROM t),
k AS (SELECT *, unnest(range(4)) AS level FROM (SELECT predictor, side, label, t, sum(n) AS n, sum(CASE WHEN mismatch THEN n ELSE 0 END) AS f, sum(s) AS s FROM b GROUP BY 1, 2, 3, 4))
SELECT predictor, side, CAST(level AS INTEGER) AS level, t >> CAST(level AS INTEGER) AS tile, label, CAST(sum(n) AS BIGINT) AS bases, CAST(sum(f) AS BIGINT) AS flagged, CAST(sum(s) AS BIGINT) AS segments FROM k GROUP BY 1, 2, 3, 4, 5""",
    "coding_sections": f"WITH {BASE} SELECT predictor, CAST(o AS VARCHAR) AS seq_id, 'gt' AS side, idx, CAST(s AS INTEGER) AS lo, CAST(e AS INTEGER) AS hi FROM gsec UNION ALL SELECT predictor, CAST(o AS VARCHAR), 'pred', idx, CAST(s AS INTEGER), CAST(e AS INTEGER) FROM psec",
    "rle_runs": f"""WITH {BASE}{POS}, l AS (SELECT predictor, o, 'gt' AS side, p, gl AS label FROM pos UNION ALL SELECT predictor, o, 'pred', p, pl FROM pos),
d AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS n FROM l WINDOW w AS (PARTITION BY predictor, o, side ORDER BY p)),
i AS (SELECT *, sum(n) OVER (PARTITION BY predictor, o, side ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM d),
r AS (SELECT predictor, o, side, label, min(p) AS lo, max(p) AS hi FROM i GROUP BY predictor, o, side, label, g)
SELECT predictor, side, label, count(*) AS n_runs, CAST(sum(hi - lo + 1) AS BIGINT) AS bases, CAST(sum(lo * 7 + hi) AS BIGINT) AS checksum FROM r GROUP BY 1, 2, 3""",
    "overlay_confusion": f"WITH {BASE}{POS} SELECT predictor, gl AS gt, pl AS pred, count(*) AS n FROM pos GROUP BY 1, 2, 3",
    "nucleotide_prf": f"WITH {BASE}{POS}, c AS (SELECT predictor, {CONF} GROUP BY 1) SELECT *, {prf()} FROM c",
    "mask_chunks": f"WITH {BASE}{POS}, c AS (SELECT predictor, CASE WHEN o % 4 = 0 AND p >= 140 THEN 1 ELSE 0 END AS chunk_id, {CONF} WHERE NOT (o % 4 = 0 AND p BETWEEN 120 AND 139) GROUP BY 1, 2) SELECT *, {prf()} FROM c",
    "intron_gaps": f"WITH {BASE}{CHAINS} SELECT predictor, 'gt' AS side, CAST(o AS VARCHAR) AS seq_id, count(*) AS n, CAST(min(e - s + 1) AS INTEGER) AS shortest, CAST(max(e - s + 1) AS INTEGER) AS longest FROM gi GROUP BY predictor, o UNION ALL SELECT predictor, 'pred', CAST(o AS VARCHAR), count(*), CAST(min(e - s + 1) AS INTEGER), CAST(max(e - s + 1) AS INTEGER) FROM pin GROUP BY predictor, o",
    "inferred_introns": f"WITH {BASE}{POS} SELECT predictor, side, label, count(*) AS bases FROM (SELECT predictor, 'gt' AS side, gl AS label FROM pos UNION ALL SELECT predictor, 'pred', pl FROM pos) GROUP BY 1, 2, 3",
    "intron_cutoffs": f"""WITH {BASE}{CHAINS}, g AS (SELECT predictor, o, 'gt' AS side, s, e - s + 1 AS len FROM gi UNION ALL SELECT predictor, o, 'pred', s, e - s + 1 FROM pin),
r AS (SELECT *, row_number() OVER w - 1 AS i, lead(len) OVER w AS nxt, count(*) OVER (PARTITION BY predictor, o, side) AS n FROM g WINDOW w AS (PARTITION BY predictor, o, side ORDER BY len, s)),
b AS (SELECT *, nxt / greatest(len, 1) AS j, row_number() OVER (PARTITION BY predictor, o, side ORDER BY nxt / greatest(len, 1) DESC NULLS LAST, i) AS best FROM r),
m AS (SELECT predictor, o, side, median(len) FILTER (i < greatest(1, n // 2)) AS med FROM r GROUP BY 1, 2, 3)
SELECT predictor, side, CAST(o AS VARCHAR) AS seq_id, CAST(CASE WHEN j >= 5 THEN floor(sqrt(CAST(len AS DOUBLE) * nxt)) ELSE floor(med * 20) END AS BIGINT) AS cutoff FROM b JOIN m USING (predictor, o, side) WHERE best = 1 AND n >= 2""",
    "indel_groups": f"WITH {BASE}{POS}{INDEL} SELECT predictor, CAST(o AS VARCHAR) AS seq_id, kind, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM indel",
    "indel_counts": f"WITH {BASE}{POS}{INDEL} SELECT predictor, kind, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases, median(len) AS median_length FROM indel GROUP BY 1, 2",
    "indel_length_hist": f"WITH {BASE}{POS}{INDEL}, s AS (SELECT predictor, min(log10(len)) AS a, max(log10(len)) AS z FROM indel GROUP BY 1) SELECT predictor, kind, CAST(least(floor((log10(len) - a) / (z - a) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM indel JOIN s USING (predictor) GROUP BY 1, 2, 3",
    "section_pairs": f"WITH {BASE}{PAIRS} SELECT predictor, CAST(o AS VARCHAR) AS seq_id, gi AS g_idx, pi AS p_idx, bases, r5, r3, round(iou, 9) AS iou FROM pr",
    "iou_stats": f"WITH {BASE}{PAIRS} SELECT predictor, {stats('iou')} FROM pr GROUP BY 1".replace("coalesce(CAST(min(iou) AS DOUBLE), 0) AS min", "round(min(iou), 9) AS min").replace("coalesce(CAST(max(iou) AS DOUBLE), 0) AS max", "round(max(iou), 9) AS max"),
    "iou_survival": f"WITH {BASE}{PAIRS}, n AS (SELECT predictor, iou, count(*) AS n FROM pr GROUP BY 1, 2) SELECT predictor, round(iou, 9) AS iou, n, round(sum(n) OVER (PARTITION BY predictor ORDER BY iou DESC) / sum(n) OVER (PARTITION BY predictor), 9) AS share_at_least FROM n",
    "boundary_residuals": f"WITH {BASE}{PAIRS} SELECT predictor, r5, r3, count(*) AS n FROM pr GROUP BY 1, 2, 3",
    "bias_matrix": f"WITH {BASE}{PAIRS}, a AS (SELECT unnest(range(-10, 11)) AS r), n AS (SELECT predictor, r5, r3, count(*) AS n FROM pr GROUP BY 1, 2, 3) SELECT p.predictor, CAST(x.r AS INTEGER) AS r5, CAST(y.r AS INTEGER) AS r3, coalesce(n, 0) AS n FROM ps p, a x, a y LEFT JOIN n ON n.predictor = p.predictor AND n.r5 = x.r AND n.r3 = y.r",
    "reliability_matrix": f"WITH {BASE}{PAIRS}, a AS (SELECT unnest(range(0, 11)) AS t), n AS (SELECT predictor, count(*) AS m FROM gsec GROUP BY 1), h AS (SELECT pr.predictor, x.t AS t5, y.t AS t3, count(*) AS hits FROM pr, a x, a y WHERE abs(r5) <= x.t AND abs(r3) <= y.t GROUP BY 1, 2, 3) SELECT n.predictor, CAST(x.t AS INTEGER) AS t5, CAST(y.t AS INTEGER) AS t3, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / m, 9) AS recall FROM n, a x, a y LEFT JOIN h ON h.predictor = n.predictor AND h.t5 = x.t AND h.t3 = y.t",
    "perfect_boundary": f"WITH {BASE} SELECT q.predictor, (SELECT count(*) FROM gsec g WHERE g.predictor = q.predictor AND EXISTS (SELECT 1 FROM psec p WHERE p.predictor = g.predictor AND p.o = g.o AND p.s = g.s AND p.e = g.e)) AS hits, (SELECT count(*) FROM gsec g WHERE g.predictor = q.predictor) AS n_gt, (SELECT count(*) FROM psec p WHERE p.predictor = q.predictor) AS n_pred FROM ps q",
    "terminal_flags": f"WITH {BASE}{PAIRS}, l AS (SELECT predictor, o, max(idx) AS m FROM gsec GROUP BY 1, 2), f AS (SELECT q.predictor, q.o, coalesce(max(CASE WHEN gi = 0 AND pe = ge THEN 1 ELSE 0 END), 0) AS a, coalesce(max(CASE WHEN gi = m AND ps = gs THEN 1 ELSE 0 END), 0) AS b FROM seqs q LEFT JOIN pr USING (predictor, o) LEFT JOIN l USING (predictor, o) GROUP BY 1, 2) SELECT predictor, a AS first_3_prime, b AS last_5_prime, count(*) AS n FROM f GROUP BY 1, 2, 3",
    "region_discovery": f"""WITH RECURSIVE {BASE}{PAIRS}, c AS (SELECT *, row_number() OVER (PARTITION BY predictor, o ORDER BY bases DESC, gi, pi) AS r FROM pr),
walk AS (
  SELECT predictor, o, CAST(1 AS BIGINT) AS r, [gi] AS gs_used, [pi] AS ps_used, 1 AS nb, CASE WHEN ps >= gs AND pe <= ge THEN 1 ELSE 0 END AS inn, CASE WHEN ps <= gs AND pe >= ge THEN 1 ELSE 0 END AS cov FROM c WHERE r = 1
  UNION ALL
  SELECT w.predictor, w.o, c.r, CASE WHEN t THEN list_append(gs_used, gi) ELSE gs_used END, CASE WHEN t THEN list_append(ps_used, pi) ELSE ps_used END, nb + CASE WHEN t THEN 1 ELSE 0 END, inn + CASE WHEN t AND ps >= gs AND pe <= ge THEN 1 ELSE 0 END, cov + CASE WHEN t AND ps <= gs AND pe >= ge THEN 1 ELSE 0 END
  FROM (SELECT w.*, c.r AS cr, c.gi, c.pi, c.gs, c.ge, c.ps, c.pe, NOT list_contains(gs_used, c.gi) AND NOT list_contains(ps_used, c.pi) AS t FROM walk w JOIN c ON c.predictor = w.predictor AND c.o = w.o AND c.r = w.r + 1) AS w(predictor, o, r, gs_used, ps_used, nb, inn, cov, cr, gi, pi, gs, ge, ps, pe, t), LATERAL (SELECT w.cr AS r) c
), m AS (SELECT predictor, o, max(nb) AS nb, max(inn) AS inn, max(cov) AS cov FROM walk GROUP BY 1, 2),
pf AS (SELECT g.predictor, g.o, count(*) AS perf FROM gsec g JOIN psec p ON p.predictor = g.predictor AND p.o = g.o AND p.s = g.s AND p.e = g.e GROUP BY 1, 2),
f AS (SELECT q.predictor, q.o, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np, coalesce(nb, 0) AS nb, coalesce(inn, 0) AS inn, coalesce(cov, 0) AS cov, coalesce(perf, 0) AS perf FROM seqs q LEFT JOIN (SELECT predictor, o, count(*) AS ng FROM gsec GROUP BY 1, 2) USING (predictor, o) LEFT JOIN (SELECT predictor, o, count(*) AS np FROM psec GROUP BY 1, 2) USING (predictor, o) LEFT JOIN m USING (predictor, o) LEFT JOIN pf USING (predictor, o)),
u AS (SELECT predictor, 'neighborhood' AS level, sum(nb) AS tp, sum(ng - nb) AS fn, sum(np - nb) AS fp FROM f GROUP BY 1 UNION ALL SELECT predictor, 'internal', sum(inn), sum(ng - inn), sum(np - nb) FROM f GROUP BY 1 UNION ALL SELECT predictor, 'full_coverage', sum(cov), sum(ng - cov), sum(np - nb) FROM f GROUP BY 1 UNION ALL SELECT predictor, 'perfect_boundary', sum(perf), sum(ng - perf), sum(np - perf) FROM f GROUP BY 1)
SELECT predictor, level, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall FROM u""",
    "intron_chain_prf": chain("nf", "intron_chain"),
    "exon_chain_prf": chain("ef", "exon_chain"),
    "match_class_dist": f"""WITH {BASE}{CHAINS}, f AS (SELECT *, both_n + gt_only AS n_gt, both_n + pred_only AS n_pred FROM ef), c AS (SELECT predictor, CASE WHEN n_pred = 0 THEN 'missed' WHEN gt_only = 0 AND pred_only = 0 THEN 'exact' WHEN n_gt = n_pred AND g0 = p0 AND g1 = p1 THEN 'boundary_shift_internal' WHEN n_gt = n_pred THEN 'boundary_shift_terminal' WHEN pred_only = 0 THEN 'missing_segments' WHEN gt_only = 0 THEN 'extra_segments' WHEN both_n > 0 THEN 'partial_overlap' ELSE 'no_overlap' END AS match_class FROM f WHERE n_gt > 0)
SELECT predictor, match_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY predictor), 9) AS share FROM c GROUP BY 1, 2""",
    "boundary_shift": f"WITH {BASE}{CHAINS}, z AS (SELECT predictor, o, sum(CASE WHEN g.s <> p.s THEN 1 ELSE 0 END + CASE WHEN g.e <> p.e THEN 1 ELSE 0 END) AS c, sum(abs(g.s - p.s) + abs(g.e - p.e)) AS t FROM gsec g JOIN psec p USING (predictor, o, idx) GROUP BY 1, 2), r AS (SELECT f.predictor, CASE WHEN gt_only = pred_only THEN coalesce(c, 0) ELSE 0 END AS c, CASE WHEN gt_only = pred_only THEN coalesce(t, 0) ELSE 0 END AS t FROM ef f LEFT JOIN z USING (predictor, o)) SELECT predictor, CAST(c AS BIGINT) AS shift_count, CAST(t AS BIGINT) AS shift_total, count(*) AS n FROM r GROUP BY 1, 2, 3",
    "soft_exon": f"WITH {BASE}{CHAINS} SELECT predictor, CAST(least(floor(both_n / (both_n + gt_only) * 20), 19) AS INTEGER) AS recall_bin, pred_only AS hallucinated, count(*) AS n FROM ef WHERE both_n + gt_only > 0 GROUP BY 1, 2, 3",
    "segment_delta_stats": f"WITH {BASE}{CHAINS}, d AS (SELECT predictor, pred_only - gt_only AS x FROM ef) SELECT predictor, {stats('x')} FROM d GROUP BY 1",
    "length_emd": f"""WITH {BASE}, v AS (SELECT predictor, o, e - s + 1 AS v, 1.0 / count(*) OVER (PARTITION BY predictor, o) AS w, 1 AS a FROM gsec UNION ALL SELECT predictor, o, e - s + 1, -1.0 / count(*) OVER (PARTITION BY predictor, o), -1 FROM psec),
u AS (SELECT predictor, o, v, CAST(sum(w) AS DOUBLE) AS w, max(a) AS a, min(a) AS z FROM v GROUP BY 1, 2, 3), r AS (SELECT *, abs(sum(w) OVER k) * (lead(v) OVER k - v) AS part FROM u WINDOW k AS (PARTITION BY predictor, o ORDER BY v)),
d AS (SELECT predictor, o, CASE WHEN max(a) > 0 AND min(z) < 0 THEN coalesce(sum(part), 0) ELSE 0 END AS x FROM r GROUP BY 1, 2) SELECT predictor, {stats('x').replace('coalesce(CAST(min(x) AS DOUBLE), 0) AS min', 'round(min(x), 6) AS min').replace('coalesce(CAST(max(x) AS DOUBLE), 0) AS max', 'round(max(x), 6) AS max').replace(', 9)', ', 6)')} FROM d GROUP BY 1""",
    "position_bias": f"""WITH {BASE}{POS}, m AS (SELECT predictor, p - g0 AS x, CAST(g1 - g0 + 1 AS DOUBLE) AS span FROM pos JOIN ext USING (predictor, o) WHERE g <> h AND p BETWEEN g0 AND g1),
i AS (SELECT *, least(CAST(trunc(x / span * 100.0) AS INTEGER), 99) AS i FROM m), j AS (SELECT *, CASE WHEN x < i * (span / 100.0) THEN i - 1 WHEN x >= (i + 1) * (span / 100.0) AND i <> 99 THEN i + 1 ELSE i END AS bin FROM i), a AS (SELECT CAST(unnest(range(0, 100)) AS INTEGER) AS bin), n AS (SELECT predictor, bin, count(*) AS n FROM j GROUP BY 1, 2) SELECT q.predictor, a.bin, coalesce(n, 0) AS n FROM ps q, a LEFT JOIN n ON n.predictor = q.predictor AND n.bin = a.bin""",
    "frame_percentages": f"""WITH {BASE}{POS}, c AS (SELECT *, sum(g) OVER w AS cg, sum(h) OVER w AS ch, sum(h) OVER (PARTITION BY predictor, o) AS th FROM pos WINDOW w AS (PARTITION BY predictor, o ORDER BY p)), f AS (SELECT predictor, CAST(abs(ch - cg) % 3 AS INTEGER) AS frame FROM c WHERE g = 1 AND h = 1 AND th >= 3)
SELECT predictor, frame, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY predictor), 9) AS share FROM f GROUP BY 1, 2""",
    "gt_transition_matrix": f"WITH {BASE}{POS}{EVENTS} SELECT predictor, ctx, row, col, count(*) AS n FROM ev WHERE kind = 'gt' GROUP BY 1, 2, 3, 4",
    "false_transitions": f"WITH {BASE}{POS}{EVENTS} SELECT predictor, kind, ctx, row, col, count(*) AS n FROM ev WHERE kind <> 'gt' GROUP BY 1, 2, 3, 4, 5",
    "stable_counts": f"WITH {BASE}{POS}{EVENTS} SELECT predictor, gl AS label, count(*) AS n FROM near WHERE gl = g2 GROUP BY 1, 2",
    "intron_chain_index": f"WITH {BASE}{FEATURES} SELECT t.source, t.seqid, t.id AS parent, coalesce(n, 0) AS n_introns, coalesce(string_agg(d || '-' || a, ',' ORDER BY d, a), '') AS chain FROM tr t LEFT JOIN nint x ON x.source = t.source AND x.seqid = t.seqid AND x.parent = t.id LEFT JOIN intr i ON i.source = t.source AND i.seqid = t.seqid AND i.parent = t.id GROUP BY 1, 2, 3, 4",
    "loci": f"WITH {BASE}{FEATURES} SELECT source, seqid, strand, l0 AS l_start, l1 AS l_stop, n FROM lo",
    "pair_scores": f"WITH {BASE}{FEATURES} SELECT seqid, strand, predictor, gt_id, pred_id, ov AS base_overlap, round(f1, 9) AS junction_f1, round(score, 9) AS score FROM pairs",
    "pair_classes": f"WITH {BASE}{FEATURES} SELECT predictor, mc AS match_class, count(*) AS n FROM pairs GROUP BY 1, 2",
    "mapping_best_per_locus": f"WITH {BASE}{FEATURES} SELECT seqid, strand, gt_id, predictor, pred_id, mc AS match_class, ov AS base_overlap, round(f1, 9) AS junction_f1 FROM bpl",
    "global_nucleotide": f"""WITH {BASE}{FEATURES}, e AS (SELECT DISTINCT source, seqid, strand, unnest(range(s, e + 1)) AS p FROM exon), r AS (SELECT DISTINCT q.predictor, seqid, strand, unnest(range(s, e + 1)) AS p FROM tr, ps q WHERE source IN ('gt', q.predictor)),
x AS (SELECT r.predictor, r.seqid, r.strand, r.p, max(CASE WHEN e.source = 'gt' THEN 1 ELSE 0 END) AS g, max(CASE WHEN e.source = r.predictor THEN 1 ELSE 0 END) AS h FROM r JOIN e ON e.seqid = r.seqid AND e.strand = r.strand AND e.p = r.p AND e.source IN ('gt', r.predictor) GROUP BY 1, 2, 3, 4),
c AS (SELECT predictor, count(*) FILTER (g = 1 AND h = 1) AS tp, count(*) FILTER (g = 0 AND h = 1) AS fp, count(*) FILTER (g = 1 AND h = 0) AS fn FROM x GROUP BY 1) SELECT *, {prf()} FROM c""",
    "global_exon": keyed("SELECT DISTINCT source, seqid, strand, s AS k5, e AS k3 FROM exon"),
    "global_exon_lenient": keyed("SELECT DISTINCT source, seqid, strand, CASE WHEN n > 1 AND k = 1 THEN NULL ELSE s END AS k5, CASE WHEN n > 1 AND k = n THEN NULL ELSE e END AS k3 FROM (SELECT *, row_number() OVER (PARTITION BY source, parent ORDER BY s, e, ord) AS k, count(*) OVER (PARTITION BY source, parent) AS n FROM exon)"),
    "global_transcript": f"WITH {BASE}{FEATURES}, n AS (SELECT count(DISTINCT (seqid, strand, gt_id)) AS m FROM bpl), c AS (SELECT q.predictor, count(b.gt_id) AS tp, CAST(0 AS BIGINT) AS fp, any_value(m) - count(b.gt_id) AS fn FROM ps q LEFT JOIN bpl b USING (predictor), n GROUP BY 1) SELECT predictor, tp, fp, fn, {prf()} FROM c",
    "global_gene": f"""WITH {BASE}{FEATURES}, c AS (SELECT q.predictor, (SELECT count(*) FROM lo WHERE source = 'gt') AS n_ref, (SELECT count(*) FROM lo WHERE source = q.predictor) AS n_pred,
 (SELECT count(DISTINCT (t.seqid, t.strand, t.locus)) FROM tl t JOIN bpl b ON b.predictor = q.predictor AND b.seqid = t.seqid AND b.strand = t.strand AND b.gt_id = t.id WHERE t.source = 'gt') AS matched_gt,
 (SELECT count(DISTINCT (t.seqid, t.strand, t.locus)) FROM tl t JOIN bpl b ON b.predictor = q.predictor AND b.seqid = t.seqid AND b.strand = t.strand AND b.pred_id = t.id WHERE t.source = q.predictor) AS matched_pred FROM ps q),
 d AS (SELECT *, matched_pred / n_pred AS p, matched_gt / n_ref AS r FROM c) SELECT predictor, n_ref, n_pred, matched_gt, matched_pred, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM d""",
    "painted_pairs": f"""WITH {BASE}{FEATURES}, k AS (
  SELECT b.predictor, b.seqid, b.strand, b.gt_id, 'gt' AS side, greatest(x.s, gs) - gs AS lo, least(x.e, ge) - gs AS hi FROM bpl b JOIN exon x ON x.source = 'gt' AND x.seqid = b.seqid AND x.parent = b.gt_id WHERE x.s <= ge AND x.e >= gs
  UNION ALL SELECT b.predictor, b.seqid, b.strand, b.gt_id, 'pred', greatest(x.s, gs) - gs, least(x.e, ge) - gs FROM bpl b JOIN exon x ON x.source = b.predictor AND x.seqid = b.seqid AND x.parent = b.pred_id WHERE x.s <= ge AND x.e >= gs
), p AS (SELECT DISTINCT predictor, seqid, strand, gt_id, side, unnest(range(lo, hi + 1)) AS p FROM k) SELECT predictor, side, count(*) AS bases, CAST(sum(p) AS BIGINT) AS checksum FROM p GROUP BY 1, 2""",
    "global_gene_full": f"""WITH RECURSIVE {BASE}{FEATURES}{FULL}, c AS (SELECT q.predictor, (SELECT count(*) FROM lo WHERE source = 'gt') AS n_ref, (SELECT count(*) FROM lo WHERE source = q.predictor) AS n_pred,
 (SELECT count(DISTINCT (t.seqid, t.strand, t.locus)) FROM tl t JOIN fd b ON b.predictor = q.predictor AND b.seqid = t.seqid AND b.strand = t.strand AND b.gt_id = t.id WHERE t.source = 'gt') AS matched_gt,
 (SELECT count(DISTINCT (t.seqid, t.strand, t.locus)) FROM tl t JOIN fd b ON b.predictor = q.predictor AND b.seqid = t.seqid AND b.strand = t.strand AND b.pred_id = t.id WHERE t.source = q.predictor) AS matched_pred FROM ps q),
 d AS (SELECT *, matched_pred / n_pred AS p, matched_gt / n_ref AS r FROM c) SELECT predictor, n_ref, n_pred, matched_gt, matched_pred, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM d""",
    "painted_pairs_full": f"""WITH RECURSIVE {BASE}{FEATURES}{FULL}, fa AS (SELECT predictor, seqid, strand, gt_id, gs, ge, pred_id FROM fd UNION ALL SELECT source, seqid, strand, '__unmatched_pred__' || id, s, e, id FROM fu UNION ALL SELECT q.predictor, t.seqid, t.strand, t.id, t.s, t.e, NULL FROM tr t, ps q WHERE t.source = 'gt' AND NOT EXISTS (SELECT 1 FROM fd WHERE fd.predictor = q.predictor AND fd.seqid = t.seqid AND fd.strand = t.strand AND fd.gt_id = t.id)), k AS (
  SELECT b.predictor, b.seqid, b.strand, b.gt_id, 'gt' AS side, greatest(x.s, gs) - gs AS lo, least(x.e, ge) - gs AS hi FROM fa b JOIN exon x ON x.source = 'gt' AND x.seqid = b.seqid AND x.parent = b.gt_id WHERE x.s <= ge AND x.e >= gs
  UNION ALL SELECT b.predictor, b.seqid, b.strand, b.gt_id, 'pred', greatest(x.s, gs) - gs, least(x.e, ge) - gs FROM fa b JOIN exon x ON x.source = b.predictor AND x.seqid = b.seqid AND x.parent = b.pred_id WHERE x.s <= ge AND x.e >= gs
), p AS (SELECT DISTINCT predictor, seqid, strand, gt_id, side, unnest(range(lo, hi + 1)) AS p FROM k) SELECT predictor, side, count(*) AS bases, CAST(sum(p) AS BIGINT) AS checksum FROM p GROUP BY 1, 2""",
    "mapping_full_discovery": f"""WITH RECURSIVE {BASE}{FEATURES}{FULL}
SELECT seqid, strand, gt_id, gs AS gt_start, ge AS gt_stop, false AS is_unmatched_prediction, predictor, pred_id, ps AS pred_start, pe AS pred_stop, mc AS match_class, ov AS base_overlap, round(f1, 9) AS junction_f1 FROM fd
UNION ALL SELECT seqid, strand, id, s, e, false, '', '', -1, -1, '', -1, -1.0 FROM fm
UNION ALL SELECT seqid, strand, '__unmatched_pred__' || id, s, e, true, source, id, s, e, 'overlapping', 0, 0.0 FROM fu""",
    "unmatched_predictions": f"WITH RECURSIVE {BASE}{FEATURES}{FULL} SELECT seqid, strand, source AS predictor, id AS pred_id, s AS gt_start, e AS gt_stop FROM fu",
    "global_transcript_full": f"WITH RECURSIVE {BASE}{FEATURES}{FULL}, c AS (SELECT q.predictor, (SELECT count(*) FROM fd WHERE fd.predictor = q.predictor) AS tp, (SELECT count(*) FROM fu WHERE fu.source = q.predictor) AS fp, (SELECT count(*) FROM tr WHERE source = 'gt') - (SELECT count(*) FROM fd WHERE fd.predictor = q.predictor) AS fn FROM ps q) SELECT predictor, tp, fp, fn, {prf()} FROM c",
    "late_transitions": f"WITH {BASE}{POS}{EVENTS} SELECT predictor, count(*) FILTER (kind = 'late') AS n FROM ev WHERE kind IS NOT NULL GROUP BY 1",
    "false_transition_targets": f"WITH {BASE}{POS}{EVENTS} SELECT predictor, kind, col AS target, count(*) AS n FROM ev WHERE kind IN ('premature', 'spurious') GROUP BY 1, 2, 3",
    "array_pair_confusion": f"WITH {BASE}{POS} SELECT predictor, gl AS gt, pl AS pred, count(*) AS n FROM pos GROUP BY 1, 2, 3",
    "individual_nucleotide": f"WITH {BASE}{POS}, c AS (SELECT predictor, CAST(o AS VARCHAR) AS seq_id, {CONF} GROUP BY 1, 2) SELECT *, {prf()} FROM c",
    "long_axis_confusion": f"""WITH {BASE}{POS}, nx AS (SELECT predictor, o, coalesce(lead(o) OVER (PARTITION BY predictor ORDER BY o) - o - 1, 0) * 330 AS gap FROM seqs)
SELECT predictor, gl AS gt, pl AS pred, CAST(sum(n) AS BIGINT) AS n FROM (SELECT predictor, gl, pl, count(*) AS n FROM pos GROUP BY 1, 2, 3 UNION ALL SELECT predictor, gl, pl, gap FROM pos JOIN nx USING (predictor, o) WHERE p = 329) GROUP BY 1, 2, 3""",
    "long_axis_union": f"""WITH {BASE}, a AS (SELECT predictor, o * 330 + s AS s, o * 330 + e AS e FROM (SELECT predictor, o, s, e FROM gsec UNION ALL SELECT predictor, o, s, e FROM psec)),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY predictor ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM a),
i AS (SELECT *, sum(n) OVER (PARTITION BY predictor ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT predictor, min(s) AS lo, max(e) AS hi FROM i GROUP BY predictor, g""",
    "long_axis_loci": f"""WITH {BASE}{FEATURES}, m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY source ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM tr),
i AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT source, min(s) AS l_start, max(e) AS l_stop, count(*) AS n FROM i GROUP BY source, g""",
    "exon_arrays": f"WITH {BASE}{FEATURES} SELECT t.id || '_' || t.strand AS seq_id, t.e - t.s + 1 AS n, x.s - t.s AS lo, x.e - t.s AS hi FROM tr t JOIN exon x ON x.source = 'gt' AND x.parent = t.id WHERE t.source = 'gt'",
    "gff3_parse": f"WITH {BASE}{FEATURES}, f AS (SELECT source, seqid, 'mRNA' AS type, s, e, strand, id AS gff_id, NULL AS parent FROM tr UNION ALL SELECT source, seqid, 'exon', s, e, strand, NULL, parent FROM exon) SELECT source, seqid, type, s AS start, e AS stop, strand, gff_id, parent FROM f",
    "gtf_parse": f"WITH {BASE}{FEATURES}, f AS (SELECT source, seqid, 'mRNA' AS type, s, e, strand, id AS gff_id FROM tr UNION ALL SELECT source, seqid, 'exon', s, e, strand, parent FROM exon) SELECT source, seqid, type, s AS start, e AS stop, strand, gff_id, gff_id AS parent FROM f",
}
