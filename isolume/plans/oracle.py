"""DuckDB twins of the lens queries. On a gene of the lens a junction has at most one partner within the threshold, so matching is a plain join there."""

from __future__ import annotations

from isolume.plans.lenses import CFG, GENES, SAMPLES, SIM
from isolume.sources.sinks import SHOWN

THR = CFG.junction_threshold

_LENS = f"""
lined AS (SELECT l_orderkey AS ord, l_orderkey % {GENES} AS gene, CASE WHEN l_partkey % 11 = 0 THEN l_partkey % 5 ELSE 0 END AS drift,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity) AS rn FROM lineitem),
placed AS (SELECT ord, gene, gene * 20000 + (rn + (ord // {GENES}) % 2) * 500 + drift AS start FROM lined),
exons AS (SELECT ord, gene, 'chr' || (gene % 5 + 1) AS chrom, CASE WHEN (gene // 5) % 2 = 0 THEN '+' ELSE '-' END AS strand, 's' || (ord % {SAMPLES}) AS sample_id,
                 start, start + 100 + 10 * (gene % 7) AS stop, row_number() OVER (PARTITION BY ord ORDER BY start) - 1 AS i FROM placed),
t AS (SELECT ord, any_value(gene) AS gene, any_value(chrom) AS chrom, any_value(strand) AS strand, any_value(sample_id) AS sample_id, min(start) AS start, max(stop) AS stop,
             count(*) AS n_exons, count(*) - 1 AS nj, sum(stop - start)::BIGINT AS length FROM exons GROUP BY ord),
j AS (SELECT ord, gene, chrom, strand, sample_id, i, stop AS donor, lead(start) OVER (PARTITION BY ord ORDER BY start) AS acceptor FROM exons QUALIFY acceptor IS NOT NULL),
chains AS (SELECT ord, any_value(chrom) || ':' || any_value(strand) || ':' || string_agg(donor || '-' || acceptor, ':' ORDER BY i) AS chain FROM j GROUP BY ord)
"""
_REF = f"""
rx AS (SELECT g.gene, c.letter || g.gene AS ref, g.gene * 20000 + k.k * 500 AS start, g.gene * 20000 + k.k * 500 + 100 + 10 * (g.gene % 7) AS stop,
              k.k - c.lo AS i, CASE WHEN c.letter = 'r' THEN g.gene ELSE g.gene + {GENES} END AS ref_ord
       FROM (SELECT unnest(range({GENES})) AS gene) g, (VALUES ('r', 1, 13), ('c', 2, 5)) c(letter, lo, hi), (SELECT unnest(range(1, 14)) AS k) k
       WHERE k.k BETWEEN c.lo AND c.hi AND (c.letter = 'r' OR g.gene % 3 = 0)),
r AS (SELECT ref, any_value(gene) AS gene, any_value(ref_ord) AS ref_ord, min(start) AS start, max(stop) AS stop, count(*) - 1 AS nj FROM rx GROUP BY ref),
rj AS (SELECT ref, gene, i, stop AS donor, lead(start) OVER (PARTITION BY ref ORDER BY start) AS acceptor FROM rx QUALIFY acceptor IS NOT NULL)
"""


def _pairs(t: str, p: str) -> str:
    return f"""
{p} AS (SELECT t.ord, r.ref, r.ref_ord, t.gene, t.start AS qs, t.stop AS qe, r.start AS rs, r.stop AS re, t.nj AS nq, r.nj AS nr
      FROM {t} t JOIN r ON t.gene = r.gene AND t.start < r.stop AND t.stop > r.start)
"""


def _codes(t: str, j: str, exons: str, p: str, pre: str = "") -> str:
    """Tables {pre}codes of pairs p and {pre}best of the transcripts t, with their junctions and exons."""
    return f"""
{pre}linked AS (SELECT p.ord, p.ref, count(*) AS m, max(rj.i) - min(rj.i) + 1 AS width, count(*) FILTER (WHERE rj.i = j.i) AS same
           FROM {p} p JOIN {j} j ON j.ord = p.ord JOIN rj ON rj.ref = p.ref AND abs(j.donor - rj.donor) <= {THR} AND abs(j.acceptor - rj.acceptor) <= {THR} GROUP BY p.ord, p.ref),
{pre}touching AS (SELECT DISTINCT p.ord, p.ref, bool_or(x.start >= rx.start AND x.stop <= rx.stop) OVER (PARTITION BY p.ord, p.ref) AS inside
             FROM {p} p JOIN {exons} x ON x.ord = p.ord JOIN rx ON rx.ref = p.ref AND x.start < rx.stop AND x.stop > rx.start),
{pre}codes AS (SELECT p.ord, p.ref, p.ref_ord, p.gene,
            CASE WHEN h.ord IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM rj WHERE rj.ref = p.ref AND p.qs >= rj.donor AND p.qe <= rj.acceptor) THEN 'i' END
                 WHEN nq = 0 THEN CASE WHEN h.inside THEN 'c' ELSE 'e' END
                 WHEN nq = nr AND same = nq THEN '='
                 WHEN m = nq AND nq < nr THEN 'c'
                 WHEN m = nr AND nr < nq THEN 'k'
                 WHEN rs >= qs AND re <= qe AND NOT (qs >= rs AND qe <= re) THEN 'y'
                 WHEN m > 0 AND nq < nr AND width > m THEN 'm'
                 WHEN m > 0 THEN 'j' ELSE 'o' END AS code
          FROM {p} p LEFT JOIN {pre}linked l ON l.ord = p.ord AND l.ref = p.ref LEFT JOIN {pre}touching h ON h.ord = p.ord AND h.ref = p.ref),
{pre}best AS (SELECT t.*, coalesce(b.code, 'u') AS class_code, b.ref AS ref_transcript_id, CASE WHEN b.ref IS NOT NULL THEN 'g' || t.gene END AS ref_gene_id
         FROM {t} t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY list_position(['=','c','k','m','n','j','e','o','s','x','i','y','p','u'], code), ref_ord) AS n
                           FROM {pre}codes WHERE code IS NOT NULL) b ON b.ord = t.ord AND b.n = 1)
"""


_PAIRS, _CODES = _pairs("t", "p"), _codes("t", "j", "exons", "p")
_NEIGHBOURS = f"""
n AS (SELECT lag(ord) OVER (PARTITION BY gene ORDER BY ord) AS a_ord, ord AS b_ord FROM t QUALIFY a_ord IS NOT NULL),
pairs AS (SELECT n.*, a.strand, a.nj AS na, b.nj AS nb, a.n_exons AS xa, b.n_exons AS xb, a.length AS la, b.length AS lb,
                 CASE WHEN a.strand = '-' THEN a.stop ELSE a.start END AS tss_a, CASE WHEN a.strand = '-' THEN b.stop ELSE b.start END AS tss_b,
                 CASE WHEN a.strand = '-' THEN a.start ELSE a.stop END AS tes_a, CASE WHEN a.strand = '-' THEN b.start ELSE b.stop END AS tes_b
          FROM n JOIN t a ON a.ord = n.a_ord JOIN t b ON b.ord = n.b_ord),
near AS (SELECT n.a_ord, n.b_ord, x.i AS i, y.i AS k, greatest(abs(x.donor - y.donor), abs(x.acceptor - y.acceptor)) AS err
         FROM n JOIN j x ON x.ord = n.a_ord JOIN j y ON y.ord = n.b_ord AND abs(x.donor - y.donor) <= 50 AND abs(x.acceptor - y.acceptor) <= 50),
links AS (SELECT a_ord, b_ord, count(*) AS m, min(i) AS i0, max(i) AS i1, min(k) AS k0, max(k) AS k1, count(*) FILTER (WHERE err > 0) AS moved, sum(err) AS err
          FROM near WHERE err <= {THR} GROUP BY a_ord, b_ord)
"""


def _with(*parts: str, then: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + then


_MODE = "arg_max({0}, struct_pack(n := n, early := -early))"
_W1, _W2, _W3 = SIM.weight_structural, SIM.weight_junction, SIM.weight_jaccard
_MONO, _ALL = _W1 + _W3, _W1 + _W2 + _W3

_SIMILARITY = f"""
, shared AS (SELECT n.a_ord, n.b_ord, sum(least(x.stop, y.stop) - greatest(x.start, y.start)) AS s FROM n JOIN exons x ON x.ord = n.a_ord JOIN exons y ON y.ord = n.b_ord AND x.start < y.stop AND x.stop > y.start GROUP BY n.a_ord, n.b_ord),
fits AS (SELECT a_ord, b_ord, count(*) FILTER (WHERE err <= {SIM.junction_threshold}) AS strict, count(*) FILTER (WHERE err > {SIM.junction_threshold} AND err <= {SIM.fuzzy_threshold}) AS fuzzy FROM near GROUP BY a_ord, b_ord),
parts AS (SELECT p.a_ord, p.b_ord, na, nb, (1.0::DOUBLE - abs(xa - xb)::DOUBLE / greatest(xa, xb)) * (1.0::DOUBLE - abs(la - lb)::DOUBLE / greatest(la, lb)) AS structural,
                 CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0
                      ELSE least((coalesce(strict, 0) + 0.5::DOUBLE * coalesce(fuzzy, 0)) / greatest(na + nb - coalesce(strict, 0), 1), 1.0::DOUBLE) END::DOUBLE AS junction,
                 coalesce(s, 0)::DOUBLE / (la + lb - coalesce(s, 0)) AS jaccard
          FROM pairs p LEFT JOIN fits USING (a_ord, b_ord) LEFT JOIN shared USING (a_ord, b_ord))
SELECT a_ord, b_ord, round(structural, 6) AS structural, round(junction, 6) AS junction, round(jaccard, 6) AS jaccard,
       round(CASE WHEN na = 0 AND nb = 0 THEN {_W1 / _MONO!r}::DOUBLE * structural + {_W3 / _MONO!r}::DOUBLE * jaccard
                  ELSE {_W1 / _ALL!r}::DOUBLE * structural + {_W2 / _ALL!r}::DOUBLE * junction + {_W3 / _ALL!r}::DOUBLE * jaccard END, 6) AS total FROM parts
"""

_PICKS = """
, votes AS (SELECT gene, start, NULL AS stop, count(*) AS n, min(ord) AS early FROM t GROUP BY gene, start),
ends AS (SELECT gene, stop, count(*) AS n, min(ord) AS early FROM t GROUP BY gene, stop),
ms AS (SELECT gene, arg_max(start, struct_pack(n := n, early := -early)) AS mode_start FROM votes GROUP BY gene),
me AS (SELECT gene, arg_max(stop, struct_pack(n := n, early := -early)) AS mode_stop FROM ends GROUP BY gene),
g AS (SELECT gene, any_value(strand) AS strand, min(start) AS lo, arg_min(sample_id, struct_pack(v := start, o := ord)) AS lo_source, max(stop) AS hi,
             arg_min(sample_id, struct_pack(v := -stop, o := ord)) AS hi_source, arg_min(sample_id, ord) AS first_source FROM t GROUP BY gene)
SELECT g.gene, CASE WHEN strand = '+' THEN lo ELSE hi END AS tss_longest, CASE WHEN strand = '+' THEN mode_start ELSE mode_stop END AS tss_freq,
       CASE WHEN strand = '+' THEN hi ELSE lo END AS tes_longest, CASE WHEN strand = '+' THEN mode_stop ELSE mode_start END AS tes_freq,
       CASE WHEN strand = '+' THEN lo_source ELSE hi_source END AS tss_longest_source, first_source AS tss_freq_source,
       CASE WHEN strand = '+' THEN hi_source ELSE lo_source END AS tes_longest_source, first_source AS tes_freq_source
FROM g JOIN ms USING (gene) JOIN me USING (gene)
"""

_TO_CHAIN = f"""
, matched AS (SELECT j.ord, j.gene, rj.i AS k, greatest(abs(j.donor - rj.donor), abs(j.acceptor - rj.acceptor)) AS err
              FROM j JOIN rj ON rj.ref = 'r' || j.gene AND abs(j.donor - rj.donor) <= {THR} AND abs(j.acceptor - rj.acceptor) <= {THR}),
spans AS (SELECT ord, any_value(gene) AS gene, count(*) AS matches, min(k) AS first, max(k) AS last, sum(err)::BIGINT AS error FROM matched GROUP BY ord)
"""

_GENES = """
, e AS (SELECT DISTINCT x.ord AS u, y.ord AS v FROM exons x JOIN exons y ON x.gene = y.gene AND x.ord <> y.ord AND x.start < y.stop AND x.stop > y.start),
reach(ord, seen) AS (SELECT ord, ord FROM t UNION SELECT reach.ord, e.v FROM reach JOIN e ON reach.seen = e.u),
comp AS (SELECT ord, min(seen) AS component FROM reach GROUP BY ord)
"""

# Greedy placement: of each transcript, in its turn, the first of the seeds that would take it (compat, the best first) that is one by then.
def _greedy(name: str) -> str:
    """Tables {name}_ranked (ord, gene, n) and {name}_compat (ord, c) give {name}_placed (ord, gene, n, seed)."""
    return f"""
    {name}_steps(gene, n, ord, seed, seeds) AS (
        SELECT gene, n, ord, ord, [ord] FROM {name}_ranked WHERE n = 1
        UNION ALL
        SELECT gene, n, ord, seed, CASE WHEN seed = ord THEN list_append(seeds, ord) ELSE seeds END
        FROM (SELECT r.gene, r.n, r.ord, s.seeds, coalesce(list_filter(c.c, lambda x: list_contains(s.seeds, x))[1], r.ord) AS seed
              FROM {name}_steps s JOIN {name}_ranked r ON r.gene = s.gene AND r.n = s.n + 1 LEFT JOIN {name}_compat c ON c.ord = r.ord)),
    {name}_placed AS (SELECT gene, n, ord, seed FROM {name}_steps)"""


# All ordered pairs of a gene's transcripts, and their junctions' matches.
_PAIRED = f"""
duo AS (SELECT a.ord AS a_ord, b.ord AS b_ord, a.gene, a.strand, a.nj AS na, b.nj AS nb, a.n_exons AS xa, b.n_exons AS xb, a.length AS la, b.length AS lb, a.start AS sa, a.stop AS ea, b.start AS sb, b.stop AS eb,
               CASE WHEN a.strand = '-' THEN a.stop ELSE a.start END AS tss_a, CASE WHEN a.strand = '-' THEN b.stop ELSE b.start END AS tss_b,
               CASE WHEN a.strand = '-' THEN a.start ELSE a.stop END AS tes_a, CASE WHEN a.strand = '-' THEN b.start ELSE b.stop END AS tes_b
        FROM t a JOIN t b ON a.gene = b.gene),
near AS (SELECT x.ord AS a_ord, y.ord AS b_ord, x.i AS i, y.i AS k, greatest(abs(x.donor - y.donor), abs(x.acceptor - y.acceptor)) AS err
         FROM j x JOIN j y ON x.gene = y.gene AND abs(x.donor - y.donor) <= 50 AND abs(x.acceptor - y.acceptor) <= 50),
links AS (SELECT a_ord, b_ord, count(*) AS m, min(i) AS i0, max(i) AS i1, min(k) AS k0, max(k) AS k1, count(*) FILTER (WHERE err > 0) AS moved, sum(err) AS err
          FROM near WHERE err <= {THR} GROUP BY a_ord, b_ord)
"""
_MULTI = (
    f"""
multi_ranked AS (SELECT ord, gene, row_number() OVER (PARTITION BY gene ORDER BY nj DESC, length DESC, ord) AS n FROM t WHERE n_exons > 1),
multi_ok AS (SELECT d.a_ord, d.b_ord, CASE WHEN greatest(i0, k0) = 0 AND greatest(na - 1 - i1, nb - 1 - k1) = 0 THEN CASE WHEN moved > 0 THEN 'fuzzy_match' ELSE 'exact_match' END
                    WHEN greatest(na - 1 - i1, nb - 1 - k1) = 0 THEN 'truncation_5' WHEN greatest(i0, k0) = 0 THEN 'truncation_3' ELSE 'truncation_both' END AS status
             FROM duo d JOIN links l USING (a_ord, b_ord) WHERE i1 - i0 + 1 = m AND k1 - k0 + 1 = m AND greatest(i0, k0) <= {CFG.max_5trunc} AND greatest(na - 1 - i1, nb - 1 - k1) <= {CFG.max_3trunc}
             AND abs(tss_a - tss_b) <= {CFG.tss_window} AND abs(tes_a - tes_b) <= {CFG.tes_window} AND moved::DOUBLE / m <= {CFG.max_diff_ratio}),
multi_compat AS (SELECT b.ord, list(a.ord ORDER BY a.n) AS c FROM multi_ok o JOIN multi_ranked a ON a.ord = o.a_ord JOIN multi_ranked b ON b.ord = o.b_ord AND a.n < b.n GROUP BY b.ord),"""
    + _greedy("multi")
)
_SINGLE = (
    f"""
mono_ranked AS (SELECT ord, gene, row_number() OVER (PARTITION BY gene ORDER BY start, ord) AS n FROM t WHERE n_exons = 1),
mono_ok AS (SELECT a_ord, b_ord, CASE WHEN sa = sb AND ea = eb THEN 'monoexon_exact' ELSE 'monoexon_overlap' END AS status FROM duo
            WHERE xa = 1 AND xb = 1 AND greatest(0, least(ea, eb) - greatest(sa, sb))::DOUBLE / least(ea - sa, eb - sb) >= {CFG.mono_overlap}
            AND CASE WHEN strand = '+' THEN abs(sa - sb) ELSE abs(ea - eb) END <= {CFG.mono_5end} AND CASE WHEN strand = '+' THEN abs(ea - eb) ELSE abs(sa - sb) END <= {CFG.mono_3end}),
mono_compat AS (SELECT b.ord, list(a.ord ORDER BY a.n) AS c FROM mono_ok o JOIN mono_ranked a ON a.ord = o.a_ord JOIN mono_ranked b ON b.ord = o.b_ord AND a.n < b.n GROUP BY b.ord),"""
    + _greedy("mono")
)
_MERGED_STATUS = """
seated AS (SELECT p.*, false AS mono, o.status FROM multi_placed p LEFT JOIN multi_ok o ON o.a_ord = p.seed AND o.b_ord = p.ord AND p.seed <> p.ord
           UNION ALL SELECT p.*, true, o.status FROM mono_placed p LEFT JOIN mono_ok o ON o.a_ord = p.seed AND o.b_ord = p.ord AND p.seed <> p.ord),
statuses AS (SELECT seed, mono, CASE WHEN count(*) = 1 THEN 'singleton' WHEN mono THEN CASE WHEN bool_or(status = 'monoexon_overlap') THEN 'monoexon_overlap' ELSE 'monoexon_exact' END
                    ELSE arg_min(status, struct_pack(p := CASE status WHEN 'exact_match' THEN 1 WHEN 'fuzzy_match' THEN 2 WHEN 'truncation_both' THEN 4 ELSE 3 END, n := n)) FILTER (WHERE status IS NOT NULL) END AS status
             FROM seated GROUP BY seed, mono)"""

# Transcripts and references as one table, and the similarity of a gene's pairs.
_UNITED = """
ux AS (SELECT 't' || ord AS id, gene, start, stop, i FROM exons UNION ALL SELECT ref, gene, start, stop, i FROM rx),
u AS (SELECT 't' || ord AS id, gene, ord::HUGEINT AS ord, start, stop, n_exons, nj, length, false AS is_ref, 1 AS n_occ FROM t
      UNION ALL SELECT ref, any_value(gene), (any_value(ref_ord)::HUGEINT + 1152921504606846976), min(start), max(stop), count(*), count(*) - 1, sum(stop - start)::BIGINT, true, 0 FROM rx GROUP BY ref),
uj AS (SELECT id, gene, i, stop AS donor, lead(start) OVER (PARTITION BY id ORDER BY start) AS acceptor FROM ux QUALIFY acceptor IS NOT NULL)"""


def _scores(members: str, exons: str, junctions: str, key: str, where: str) -> str:
    """Table scored: (a, b, structural, junction, jaccard, total) of the pairs of a gene that overlap."""
    return f"""
    shared AS (SELECT x.{key} AS a, y.{key} AS b, sum(least(x.stop, y.stop) - greatest(x.start, y.start)) AS s FROM {exons} x JOIN {exons} y ON x.gene = y.gene AND x.start < y.stop AND x.stop > y.start GROUP BY 1, 2),
    fits AS (SELECT x.{key} AS a, y.{key} AS b, count(*) FILTER (WHERE greatest(abs(x.donor - y.donor), abs(x.acceptor - y.acceptor)) <= {SIM.junction_threshold}) AS strict,
                    count(*) FILTER (WHERE greatest(abs(x.donor - y.donor), abs(x.acceptor - y.acceptor)) > {SIM.junction_threshold}) AS fuzzy
             FROM {junctions} x JOIN {junctions} y ON x.gene = y.gene AND abs(x.donor - y.donor) <= {SIM.fuzzy_threshold} AND abs(x.acceptor - y.acceptor) <= {SIM.fuzzy_threshold} GROUP BY 1, 2),
    parts AS (SELECT p.{key} AS a, q.{key} AS b, p.nj AS na, q.nj AS nb,
                     (1.0::DOUBLE - abs(p.n_exons - q.n_exons)::DOUBLE / greatest(p.n_exons, q.n_exons)) * (1.0::DOUBLE - abs(p.length - q.length)::DOUBLE / greatest(p.length, q.length)) AS structural,
                     CASE WHEN p.nj = 0 AND q.nj = 0 THEN 1.0 WHEN p.nj = 0 OR q.nj = 0 THEN 0.0
                          ELSE least((coalesce(strict, 0) + 0.5::DOUBLE * coalesce(fuzzy, 0)) / greatest(p.nj + q.nj - coalesce(strict, 0), 1), 1.0::DOUBLE) END::DOUBLE AS junction,
                     coalesce(s, 0)::DOUBLE / (p.length + q.length - coalesce(s, 0)) AS jaccard
              FROM {members} p JOIN {members} q ON p.gene = q.gene AND p.start < q.stop AND p.stop > q.start AND {where}
              LEFT JOIN fits f ON f.a = p.{key} AND f.b = q.{key} LEFT JOIN shared h ON h.a = p.{key} AND h.b = q.{key}),
    scored AS (SELECT a, b, structural, junction, jaccard, CASE WHEN na = 0 AND nb = 0 THEN {_W1 / _MONO!r}::DOUBLE * structural + {_W3 / _MONO!r}::DOUBLE * jaccard
                      ELSE {_W1 / _ALL!r}::DOUBLE * structural + {_W2 / _ALL!r}::DOUBLE * junction + {_W3 / _ALL!r}::DOUBLE * jaccard END AS total FROM parts)"""


_FOUR = "printf('%.4f', round({}, 4))"


def _mode(column: str, out: str) -> str:
    """The most frequent value by cluster and exon ordinal, of equal ones the first member's."""
    return f"""(SELECT seed, i, arg_max(v, struct_pack(n := c, early := -early)) AS {out} FROM (SELECT q.seed, x.i, x.{column} AS v, count(*) AS c, min(q.n) AS early
               FROM uq q JOIN exons x ON x.ord = q.ord GROUP BY q.seed, x.i, x.{column}) GROUP BY seed, i)"""


# Consensus of the greedy clusters: one member a sample (uq), ends, exons by vote, junctions, provenance; then labels, IDs and genes.
_CONSENSUS = f"""
uq AS (SELECT s.seed, s.mono, s.n, t.* FROM seated s JOIN t USING (ord) QUALIFY row_number() OVER (PARTITION BY s.seed, t.sample_id ORDER BY s.n) = 1),
late AS (SELECT seed, arg_max(v, struct_pack(c := c, early := -early)) AS tes FROM (SELECT seed, CASE WHEN strand = '+' THEN stop ELSE start END AS v, count(*) AS c, min(n) AS early FROM uq GROUP BY 1, 2) GROUP BY seed),
ends AS (SELECT seed, any_value(mono) AS mono, any_value(gene) AS gene, any_value(chrom) AS chrom, any_value(strand) AS strand, any_value(tes) AS tes, max(n_exons) AS top,
                CASE WHEN any_value(strand) = '+' THEN min(start) ELSE max(stop) END AS tss, arg_min(sample_id, struct_pack(v := CASE WHEN strand = '+' THEN start ELSE -stop END, n := n)) AS tss_source,
                arg_min(sample_id, n) AS tes_source, count(*) AS num_samples, string_agg(sample_id, ',' ORDER BY n) AS sample_ids, list(sample_id) AS samples,
                string_agg(sample_id || ':t' || ord, ',' ORDER BY n) AS source_transcript_ids, list(sample_id ORDER BY n) AS ordered FROM uq JOIN late USING (seed) GROUP BY seed),
voted AS (SELECT a.seed, a.i, e.strand, CASE WHEN e.strand = '+' AND a.i = 0 THEN tss WHEN e.strand <> '+' AND a.i = top - 1 THEN tes ELSE a.start END AS start,
                 CASE WHEN e.strand = '+' AND a.i = top - 1 THEN tes WHEN e.strand <> '+' AND a.i = 0 THEN tss ELSE b.stop END AS stop
          FROM {_mode("start", "start")} a JOIN {_mode("stop", "stop")} b USING (seed, i) JOIN ends e USING (seed)),
mx AS (SELECT seed AS ord, row_number() OVER (PARTITION BY seed ORDER BY i) - 1 AS i, start, stop, strand FROM voted WHERE start < stop),
mj AS (SELECT ord, i, stop AS donor, lead(start) OVER (PARTITION BY ord ORDER BY i) AS acceptor FROM mx QUALIFY acceptor IS NOT NULL),
held AS (SELECT mj.ord, mj.i, any_value(mj.donor) AS donor, any_value(mj.acceptor) AS acceptor, string_agg(uq.sample_id, ':' ORDER BY uq.n) AS samples, max(greatest(abs(mj.donor - j.donor), abs(mj.acceptor - j.acceptor))) AS drift
         FROM mj JOIN uq ON uq.seed = mj.ord JOIN j ON j.ord = uq.ord AND j.i = mj.i GROUP BY mj.ord, mj.i),
told AS (SELECT ord, count(*) AS nj, string_agg(donor || '-' || acceptor, ',' ORDER BY i) AS coords, string_agg('novel', ',') AS known, string_agg('j' || i || ':' || samples, ',' ORDER BY i) AS support,
                string_agg('j' || i || ':' || drift || 'bp', ',' ORDER BY i) AS drifts, count(*) FILTER (WHERE drift > 0) AS moved FROM held GROUP BY ord),
hit AS (SELECT mj.ord AS seed, uq.ord, uq.n, uq.sample_id, min(mj.i) AS miss_5, any_value(told.nj) - 1 - max(mj.i) AS miss_3 FROM mj JOIN told ON told.ord = mj.ord JOIN uq ON uq.seed = mj.ord AND uq.nj < told.nj
        JOIN j ON j.ord = uq.ord AND abs(j.donor - mj.donor) <= {THR} AND abs(j.acceptor - mj.acceptor) <= {THR} GROUP BY mj.ord, uq.ord, uq.n, uq.sample_id),
lost AS (SELECT seed, count(*) FILTER (WHERE miss_5 > 0) AS t5, count(*) FILTER (WHERE miss_3 > 0) AS t3, string_agg(sample_id || ':first_' || miss_5, ';' ORDER BY n) FILTER (WHERE miss_5 > 0) AS m5,
                string_agg(sample_id || ':last_' || miss_3, ';' ORDER BY n) FILTER (WHERE miss_3 > 0) AS m3 FROM hit GROUP BY seed),
away AS (SELECT seed, min(a) || '-' || max(a) || 'bp' AS tss_range, min(b) || '-' || max(b) || 'bp' AS tes_range
         FROM (SELECT seed, abs(CASE WHEN uq.strand = '-' THEN stop ELSE start END - tss) AS a, abs(CASE WHEN uq.strand = '-' THEN start ELSE stop END - tes) AS b FROM uq JOIN ends USING (seed)) GROUP BY seed),
founded AS (SELECT seed, min(ord) AS first_ord, arg_min(n, n) AS founder FROM seated GROUP BY seed),
mt AS (SELECT e.seed AS ord, e.gene, e.mono, e.chrom, e.strand, least(tss, tes) AS start, greatest(tss, tes) AS stop, coalesce(told.nj, 0) AS nj, s.status, e.samples,
              CASE WHEN e.mono THEN struct_pack(a := z.start::BIGINT, b := 0::BIGINT, c := z.ord::BIGINT) ELSE struct_pack(a := -z.nj::BIGINT, b := -z.length::BIGINT, c := z.ord::BIGINT) END AS place,
              min(f.first_ord) OVER (PARTITION BY e.chrom, e.mono, e.strand) AS met
       FROM ends e JOIN statuses s USING (seed) JOIN founded f USING (seed) JOIN t z ON z.ord = e.seed LEFT JOIN told ON told.ord = e.seed),
{_pairs("mt", "mp")},{_codes("mt", "mj", "mx", "mp", "m")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY mono, met, place) AS merge_ord, substr(chrom, 4)::INT - 1 AS chrom_ord FROM mbest),
named AS (SELECT *, CASE WHEN class_code = '=' THEN ref_transcript_id ELSE 'Novel.Tx' || printf('%06d', (sum(CASE WHEN class_code = '=' THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY merge_ord) + chrom_ord * 1000000)::BIGINT)
                 || '.' || chrom || '.' || class_code END AS transcript_id FROM ranked),
meets AS (SELECT DISTINCT a.ord AS u, b.ord AS v FROM named a JOIN named b ON a.gene = b.gene AND a.ord <> b.ord AND struct_pack(s := a.start, o := a.ord) < struct_pack(s := b.start, o := b.ord) AND b.start <= a.stop
          JOIN mx x ON x.ord = a.ord JOIN mx y ON y.ord = b.ord AND x.start < y.stop AND x.stop > y.start),
both_ways AS (SELECT u, v FROM meets UNION SELECT v, u FROM meets),
reach(ord, seen) AS (SELECT ord, ord FROM named UNION SELECT reach.ord, w.v FROM reach JOIN both_ways w ON reach.seen = w.u),
roots AS (SELECT ord, min(seen) AS component FROM reach GROUP BY ord),
strands AS (SELECT chrom, strand, min(merge_ord) AS strand_ord FROM named GROUP BY chrom, strand),
genes AS (SELECT n.chrom, n.strand, component, any_value(chrom_ord) AS chrom_ord, any_value(strand_ord) AS strand_ord, min(struct_pack(s := start, o := merge_ord)) AS first, min(start) AS gene_start, max(stop) AS gene_end, count(*) AS num_transcripts,
                 len(list_distinct(flatten(list(samples)))) AS gene_samples, count(DISTINCT ref_gene_id) AS refs, min(ref_gene_id) AS gene_ref FROM named n JOIN roots USING (ord) JOIN strands s ON s.chrom = n.chrom AND s.strand = n.strand GROUP BY n.chrom, n.strand, component),
numbered AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY strand_ord, first) AS gene_no FROM genes),
whole AS (SELECT n.*, g.gene_no, g.gene_start, CASE WHEN g.refs = 1 THEN g.gene_ref ELSE 'NovelG' || g.gene_no END AS gene_id FROM named n JOIN roots USING (ord) JOIN numbered g ON g.chrom = n.chrom AND g.strand = n.strand AND g.component = roots.component),
track AS (SELECT w.ord, w.chrom_ord, w.merge_ord, w.transcript_id, w.gene_id, w.status AS merge_status, w.class_code, coalesce(w.ref_transcript_id, 'NA') AS ref_transcript_id, coalesce(w.ref_gene_id, 'NA') AS ref_gene_id,
    num_samples::VARCHAR AS num_samples, sample_ids, source_transcript_ids, array_to_string(list_transform(ordered, lambda x: x || ':' || w.status), ',') AS per_sample_status, w.nj::VARCHAR AS num_junctions,
    coalesce(coords, 'NA') AS junction_coords, coalesce(known, 'NA') AS junction_known_status, coalesce(support, 'NA') AS per_junction_sample_support, coalesce(drifts, 'NA') AS per_junction_max_coord_diff,
    coalesce(moved, 0)::VARCHAR AS diff_junction_count, {_FOUR.format("CASE WHEN w.nj > 0 THEN moved::DOUBLE / w.nj ELSE 0.0::DOUBLE END")} AS diff_junction_ratio, tss::VARCHAR AS tss_coord, tes::VARCHAR AS tes_coord, tss_source, tes_source,
    tss_range AS tss_diff_range, tes_range AS tes_diff_range, coalesce(t5, 0)::VARCHAR AS truncation_5_count, coalesce(t3, 0)::VARCHAR AS truncation_3_count,
    {_FOUR.format("coalesce(t5, 0)::DOUBLE / num_samples")} AS truncation_5_ratio, {_FOUR.format("coalesce(t3, 0)::DOUBLE / num_samples")} AS truncation_3_ratio,
    coalesce(m5, 'NA') AS missing_junctions_5, coalesce(m3, 'NA') AS missing_junctions_3, {_FOUR.format(f"num_samples::DOUBLE / {SAMPLES}")} AS freq_score, 'known' AS strand_status
    FROM whole w JOIN ends e ON e.seed = w.ord JOIN away USING (seed) LEFT JOIN told ON told.ord = w.ord LEFT JOIN lost ON lost.seed = w.ord)
"""


def _attributes(*pairs: tuple[str, str]) -> str:
    return " || '; ' || ".join(f"""'{k} "' || {v} || '"'""" for k, v in pairs)


def _line(feature: str, chrom: str, start: str, stop: str, strand: str, told: str) -> str:
    return " || chr(9) || ".join([chrom, "'isolume'", f"'{feature}'", f"({start} + 1)", stop, "'.'", strand, "'.'", f"({told})"])


_IDS = (("gene_id", "w.gene_id"), ("transcript_id", "w.transcript_id"))
_GTF = f""" SELECT chrom_ord, gene_start, gene_no, {_line("gene", "chrom", "gene_start", "gene_end", "strand", _attributes(("gene_id", "CASE WHEN refs = 1 THEN gene_ref ELSE 'NovelG' || gene_no END"), ("gene_name", "'NA'"),
            ("ref_gene_id", "coalesce(gene_ref, 'NA')"), ("num_transcripts", "num_transcripts"), ("num_samples", "gene_samples")))} AS line FROM numbered
UNION ALL SELECT w.chrom_ord, gene_start, gene_no, {_line("transcript", "chrom", "start", "stop", "strand", _attributes(*[(k, f"k.{c or k}") for k, c in SHOWN]))} FROM whole w JOIN track k ON k.ord = w.ord
UNION ALL SELECT w.chrom_ord, gene_start, gene_no, {_line("exon", "chrom", "x.start", "x.stop", "x.strand", _attributes(*_IDS, ("exon_number", "(x.i + 1)")))} FROM whole w JOIN mx x ON x.ord = w.ord"""
_MERGE = (_LENS, _REF, _PAIRED, _MULTI, _SINGLE, _MERGED_STATUS, _CONSENSUS)

ORACLE_SQL: dict[str, str] = {
    "tracking": _with(*_MERGE, then=" SELECT * EXCLUDE (ord) FROM track"),
    "merged_gtf": _with(*_MERGE, then=_GTF),
    "greedy_merge": _with(_LENS, _PAIRED, _MULTI, _SINGLE, _MERGED_STATUS, then=" SELECT p.ord, p.seed, p.mono, s.status FROM seated p JOIN statuses s USING (seed, mono)"),
    "greedy_mono": _with(_LENS, _PAIRED, _SINGLE, then=" SELECT p.ord, p.seed, o.status FROM mono_placed p LEFT JOIN mono_ok o ON o.a_ord = p.seed AND o.b_ord = p.ord AND p.seed <> p.ord"),
    "greedy_mono_legacy": _with(_LENS, _PAIRED, _SINGLE, then=" SELECT p.ord, p.seed, o.status FROM mono_placed p LEFT JOIN mono_ok o ON o.a_ord = p.seed AND o.b_ord = p.ord AND p.seed <> p.ord"),
    "similarity_table": _with(
        _LENS,
        _scores("t", "exons", "j", "ord", "p.ord < q.ord"),
        then=f""" SELECT 't' || a AS transcript_a, 't' || b AS transcript_b, {_FOUR.format("total")} AS similarity, {_FOUR.format("structural")} AS structural, {_FOUR.format("junction")} AS junction,
        {_FOUR.format("jaccard")} AS jaccard FROM scored""",
    ),
    "similarity_clusters": _with(
        _LENS,
        _REF,
        _UNITED,
        _scores("u", "ux", "uj", "id", "p.id <> q.id"),
        f"""
        sim_ranked AS (SELECT id AS ord, gene, row_number() OVER (PARTITION BY gene ORDER BY is_ref DESC, n_occ DESC, length DESC, id, ord) AS n FROM u),
        rounded AS (SELECT a, b, round(total, 4) AS total, round(structural, 4) AS structural, round(junction, 4) AS junction, round(jaccard, 4) AS jaccard FROM scored),
        sim_compat AS (SELECT b.ord, list(a.ord ORDER BY s.total DESC, a.n) AS c FROM rounded s JOIN sim_ranked a ON a.ord = s.a JOIN sim_ranked b ON b.ord = s.b AND a.n < b.n
                       WHERE s.total >= {SIM.min_similarity} AND s.total > 0 GROUP BY b.ord)""",
        _greedy("sim"),
        """
        seated AS (SELECT p.ord AS id, p.seed, p.gene, u.is_ref, u.n_occ, u.length, u.ord, 'chr' || (p.gene % 5 + 1) AS chrom, CASE WHEN (p.gene // 5) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM sim_placed p JOIN u ON u.id = p.ord),
        met AS (SELECT chrom, strand, min(ord) AS met FROM seated GROUP BY chrom, strand),
        numbers AS (SELECT id AS seed, row_number() OVER (ORDER BY met, is_ref DESC, n_occ DESC, length DESC, id, ord) AS cluster_no FROM seated JOIN met USING (chrom, strand) WHERE id = seed)""",
        then=f""" SELECT cluster_no, row_number() OVER (PARTITION BY cluster_no ORDER BY is_ref DESC, n_occ DESC, length DESC, id, ord)::INT AS member_no, 'C' || printf('%06d', cluster_no) AS cluster_id, id AS transcript_id,
        CASE WHEN id = p.seed THEN 'yes' ELSE 'no' END AS is_representative, {", ".join(_FOUR.format(f"coalesce(s.{c}, 1.0::DOUBLE)") + f" AS {n}" for c, n in (("total", "similarity"), ("structural", "structural"), ("junction", "junction"), ("jaccard", "jaccard")))},
        'u' AS class_code, 'NA' AS ref_id, chrom, strand FROM seated p JOIN numbers USING (seed) LEFT JOIN rounded s ON s.a = p.seed AND s.b = p.id""",
    ),
    "penalty_consensus": _with(
        _LENS,
        _PAIRED,
        """
        judged AS (SELECT d.*, coalesce(m > 0 AND k1 - k0 + 1 = m AND i1 - i0 + 1 = m, false) AS mergeable,
            CASE WHEN m IS NULL OR k1 - k0 + 1 > m OR i1 - i0 + 1 > m THEN 'singleton' WHEN i0 = 0 AND na - 1 - i1 = 0 THEN CASE WHEN moved > 0 THEN 'fuzzy_intron' ELSE 'exact_match' END
            WHEN na - 1 - i1 = 0 THEN CASE WHEN moved > 0 THEN 'fuzzy_truncation_5' ELSE 'truncation_5' END WHEN i0 = 0 THEN CASE WHEN moved > 0 THEN 'fuzzy_truncation_3' ELSE 'truncation_3' END ELSE 'truncation_both' END AS kind,
            CASE WHEN m IS NULL OR k1 - k0 + 1 > m THEN 0.0 WHEN i1 - i0 + 1 > m THEN greatest(0.0, 100.0 - 50.0 * (i1 - i0 + 1 - m)) ELSE greatest(0.0, 100.0 - err - 5.0 * (na - 1 - i1)) END::DOUBLE AS score
            FROM duo d LEFT JOIN links USING (a_ord, b_ord)),
        e AS (SELECT a_ord AS u, b_ord AS v FROM judged WHERE a_ord < b_ord AND sa <= eb AND ea >= sb AND mergeable AND score >= 90.0),
        both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        reach(ord, seen) AS (SELECT ord, ord FROM t UNION SELECT reach.ord, x.v FROM reach JOIN both_ways x ON reach.seen = x.u),
        roots AS (SELECT ord, min(seen) AS root FROM reach GROUP BY ord),
        m AS (SELECT t.ord, t.sample_id, t.nj, root FROM t JOIN roots USING (ord)),
        reps AS (SELECT root, arg_min(ord, struct_pack(a := -nj, b := ord)) AS rep, count(*) AS members FROM m GROUP BY root),
        each AS (SELECT root, min(ord) AS ord FROM m GROUP BY root, sample_id),
        s AS (SELECT each.root, each.ord, rep, members, kind, score FROM each JOIN reps USING (root) JOIN judged ON a_ord = rep AND b_ord = each.ord),
        votes AS (SELECT root, kind, count(*) AS n, min(ord) AS early FROM s GROUP BY root, kind),
        kinds AS (SELECT root, arg_max(kind, struct_pack(n := n, early := -early)) AS kind FROM votes GROUP BY root)""",
        then=""" SELECT s.root, any_value(rep) AS representative, any_value(members) AS members, count(*) AS samples, CASE WHEN any_value(members) = 1 THEN 100.0::DOUBLE ELSE avg(score) END AS avg_score,
        CASE WHEN any_value(members) = 1 THEN 'singleton' ELSE any_value(kinds.kind) END AS kind FROM s JOIN kinds USING (root) GROUP BY s.root""",
    ),
    "assemble_transcripts": _with(
        _LENS,
        then="""SELECT 't' || ord AS transcript_id, 'g' || any_value(gene) AS gene_id, any_value(chrom) AS chrom, min(start) AS start, max(stop) AS "end", any_value(strand) AS strand,
        any_value(sample_id) AS sample_id, count(*) AS n_exons, sum(stop - start)::BIGINT AS length, string_agg(start || '-' || stop, ',' ORDER BY start) AS exons FROM exons GROUP BY ord""",
    ),
    "junction_chains": _with(_LENS, then="SELECT ord, chain FROM chains"),
    "chain_groupby": _with(
        _LENS,
        then="""SELECT chain, count(*) AS members, count(DISTINCT sample_id) AS samples, min(start) AS start, max(stop) AS "end", min(ord) AS first_ord FROM chains JOIN t USING (ord) GROUP BY chain""",
    ),
    "overlap_pairs": _with(_LENS, _REF, _PAIRS, then="SELECT ord, ref AS ref_transcript_id FROM p"),
    "exon_semi_overlap": _with(_LENS, _REF, then="SELECT DISTINCT x.ord FROM exons x JOIN rx ON x.gene = rx.gene AND rx.ref LIKE 'c%' AND x.start < rx.stop AND x.stop > rx.start"),
    "pair_codes": _with(_LENS, _REF, _PAIRS, _CODES, then="SELECT ord, ref AS ref_transcript_id, code FROM codes WHERE code IS NOT NULL"),
    "best_codes": _with(_LENS, _REF, _PAIRS, _CODES, then="SELECT ord, class_code, ref_transcript_id, ref_gene_id FROM best"),
    "merge_pair_status": _with(
        _LENS,
        _NEIGHBOURS,
        then=f""", s AS (SELECT p.a_ord, p.b_ord, CASE WHEN m IS NULL THEN 'no_match' WHEN i1 - i0 + 1 > m OR k1 - k0 + 1 > m THEN 'internal_gap'
        WHEN greatest(i0, k0) > {CFG.max_5trunc} THEN '5trunc_too_many' WHEN greatest(na - 1 - i1, nb - 1 - k1) > {CFG.max_3trunc} THEN '3trunc_too_many'
        WHEN abs(tss_a - tss_b) > {CFG.tss_window} THEN 'tss_too_far' WHEN abs(tes_a - tes_b) > {CFG.tes_window} THEN 'tes_too_far'
        WHEN moved::DOUBLE / m > {CFG.max_diff_ratio} THEN 'diff_ratio_exceeded' WHEN greatest(i0, k0) = 0 AND greatest(na - 1 - i1, nb - 1 - k1) = 0 THEN CASE WHEN moved > 0 THEN 'fuzzy_match' ELSE 'exact_match' END
        WHEN greatest(na - 1 - i1, nb - 1 - k1) = 0 THEN 'truncation_5' WHEN greatest(i0, k0) = 0 THEN 'truncation_3' ELSE 'truncation_both' END AS status
        FROM pairs p LEFT JOIN links USING (a_ord, b_ord) WHERE xa > 1 AND xb > 1)
        SELECT a_ord, b_ord, status IN ('exact_match', 'fuzzy_match', 'truncation_5', 'truncation_3', 'truncation_both') AS ok, status FROM s""",
    ),
    "mono_pair_status": _with(
        _LENS,
        then=f""", m AS (SELECT *, lag(ord) OVER w AS a_ord, lag(start) OVER w AS a_start, lag(stop) OVER w AS a_stop FROM t WHERE n_exons = 1 WINDOW w AS (PARTITION BY gene ORDER BY ord)),
        d AS (SELECT a_ord, ord AS b_ord, greatest(0, least(stop, a_stop) - greatest(start, a_start))::DOUBLE / least(stop - start, a_stop - a_start) AS share,
              CASE WHEN strand = '+' THEN abs(start - a_start) ELSE abs(stop - a_stop) END AS d5, CASE WHEN strand = '+' THEN abs(stop - a_stop) ELSE abs(start - a_start) END AS d3 FROM m WHERE a_ord IS NOT NULL),
        s AS (SELECT a_ord, b_ord, CASE WHEN share < {CFG.mono_overlap} THEN 'overlap_too_low' WHEN d5 > {CFG.mono_5end} THEN '5end_too_far' WHEN d3 > {CFG.mono_3end} THEN '3end_too_far'
              WHEN d5 = 0 AND d3 = 0 THEN 'monoexon_exact' ELSE 'monoexon_overlap' END AS status FROM d)
        SELECT a_ord, b_ord, status LIKE 'mono%' AS ok, status FROM s""",
    ),
    "similarity_pairs": _with(_LENS, _NEIGHBOURS, then=_SIMILARITY),
    "mode_consensus": _with(
        _LENS,
        then=f""", a AS (SELECT gene, i, start, count(*) AS n, min(ord) AS early FROM exons GROUP BY gene, i, start), b AS (SELECT gene, i, stop, count(*) AS n, min(ord) AS early FROM exons GROUP BY gene, i, stop),
        aa AS (SELECT gene, i, {_MODE.format("start")} AS start FROM a GROUP BY gene, i), bb AS (SELECT gene, i, {_MODE.format("stop")} AS "end" FROM b GROUP BY gene, i) SELECT gene, i, start, "end" FROM aa JOIN bb USING (gene, i)""",
    ),
    "first_per_sample": _with(_LENS, then="SELECT gene, sample_id, min(ord) AS ord FROM t GROUP BY gene, sample_id"),
    "tss_tes_pick": _with(_LENS, then=_PICKS),
    "scaffolds": _with(_LENS, then="SELECT gene, arg_min(ord, struct_pack(n := -n_exons, o := ord)) AS most_exons, arg_min(ord, struct_pack(n := start, o := ord)) AS leftmost FROM t GROUP BY gene"),
    "junction_support": _with(
        _LENS,
        _REF,
        then="""SELECT j.gene, j.i AS j, count(*) AS support, count(DISTINCT j.sample_id) AS samples, max(greatest(abs(j.donor - rj.donor), abs(j.acceptor - rj.acceptor))) AS drift
        FROM j JOIN rj ON rj.ref = 'r' || j.gene AND rj.i = j.i GROUP BY j.gene, j.i""",
    ),
    "truncation_counts": _with(
        _LENS,
        _REF,
        then=_TO_CHAIN
        + """SELECT s.gene, count(*) FILTER (WHERE first > 0) AS truncated_5, count(*) FILTER (WHERE 11 - last > 0) AS truncated_3, max(first) AS most_5, max(11 - last) AS most_3
        FROM spans s JOIN t USING (ord) WHERE t.nj < 12 GROUP BY s.gene""",
    ),
    "matched_junctions": _with(_LENS, _REF, then=_TO_CHAIN + "SELECT ord, matches, first, last, error FROM spans"),
    "gene_components": _with(_LENS, then=_GENES + "SELECT ord, component FROM comp"),
    "novel_ids": _with(
        _LENS,
        _REF,
        _PAIRS,
        _CODES,
        then="""SELECT ord, CASE WHEN class_code = '=' THEN ref_transcript_id ELSE 'Novel.Tx' || printf('%06d', (sum(CASE WHEN class_code = '=' THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY ord)
        + (substr(chrom, 4)::BIGINT - 1) * 1000000)::BIGINT) || '.' || chrom || '.' || class_code END AS transcript_id FROM best""",
    ),
    "gene_spans": _with(
        _LENS,
        _REF,
        _PAIRS,
        _CODES,
        then=_GENES
        + """, met AS (SELECT chrom, strand, min(ord) AS met FROM t GROUP BY chrom, strand),
        g AS (SELECT b.chrom, b.strand, component, min(struct_pack(s := b.start, o := b.ord)) AS first, min(b.start) AS gene_start, max(b.stop) AS gene_end, count(*) AS num_transcripts, count(DISTINCT sample_id) AS gene_samples,
              count(DISTINCT ref_gene_id) AS refs, min(ref_gene_id) AS ref FROM best b JOIN comp USING (ord) GROUP BY b.chrom, b.strand, component)
        SELECT chrom, strand, CASE WHEN refs = 1 THEN ref ELSE 'NovelG' || row_number() OVER (PARTITION BY chrom ORDER BY met, first) END AS gene_id, gene_start, gene_end, num_transcripts, gene_samples FROM g JOIN met USING (chrom, strand)""",
    ),
    "ref_only": _with(_LENS, _REF, _PAIRS, _CODES, then="SELECT ref AS transcript_id, 'g' || gene AS gene_id FROM r WHERE ref NOT IN (SELECT ref_transcript_id FROM best WHERE class_code = '=')"),
    "manifest_dupes": "SELECT 'n' || c_nationkey AS sample_id, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1",
    "attr_parse": "SELECT p_partkey, 'g' || p_size AS gene_id, p_type AS transcript_id, 'two words' AS note, NULL::VARCHAR AS bad, 3::BIGINT AS n FROM part",
    "sample_freq": _with(_LENS, then=f"SELECT gene, count(DISTINCT sample_id) AS samples, count(*) AS transcripts, round(count(DISTINCT sample_id)::DOUBLE / {SAMPLES}, 4) AS freq FROM t GROUP BY gene"),
    "chain_stats": _with(
        _LENS,
        then=", g AS (SELECT chain, count(*) AS n FROM chains GROUP BY chain) SELECT sum(n)::BIGINT AS members, count(*) AS groups, sum(n)::DOUBLE / count(*) AS avg_size, count(*) FILTER (WHERE n = 1) AS singletons FROM g",
    ),
    "occurrence_counts": _with(_LENS, then="SELECT 'x' || (ord % 997) AS transcript_id, count(*) AS n FROM t GROUP BY 1"),
    "reference_members": _with(_LENS, then=f"SELECT chrom, count(*) FILTER (WHERE ord < {GENES}) AS refs, count(*) FILTER (WHERE ord >= {GENES}) AS others FROM t GROUP BY chrom"),
    "reference_dedup": _with(_LENS, then='SELECT \'x\' || (ord % 997) AS id, max(ord) AS ord, arg_max(start, ord) AS start, arg_max(stop, ord) AS "end" FROM t GROUP BY 1'),
    "chrom_order": """WITH c AS (SELECT DISTINCT o_custkey % 23 AS n FROM orders)
        SELECT CASE n WHEN 0 THEN 'chrX' WHEN 22 THEN 'chrM' ELSE 'chr' || n END AS chrom, row_number() OVER (ORDER BY CASE n WHEN 0 THEN 1001 WHEN 22 THEN 1000 ELSE n END) - 1 AS chrom_ord FROM c""",
    "strand_groups": _with(_LENS, then="SELECT chrom, strand, count(*) AS n, count(*) FILTER (WHERE n_exons = 1) AS mono, sum(length)::BIGINT AS bases, min(ord) AS first_ord FROM t GROUP BY chrom, strand"),
    "exon_lines": _with(
        _LENS,
        then="""SELECT chrom || chr(9) || 'lens' || chr(9) || 'exon' || chr(9) || (start + 1) || chr(9) || stop || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9)
        || 'gene_id "g' || gene || '"; transcript_id "t' || ord || '"; exon_number "' || (i + 1) || '"' AS line FROM exons""",
    ),
    "event_islands": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS start, epoch_us(ts) + 7200000000 AS stop FROM events),
        b AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS begins FROM e),
        i AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY start, event_id)::BIGINT AS run FROM b)
        SELECT user_id, min(start) AS island, count(*) AS n, min(start) AS start, max(stop) AS "end" FROM i GROUP BY user_id, run""",
    "event_overlaps": """SELECT a.event_id AS a_event_id, b.event_id AS b_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
        AND epoch_us(a.ts) < epoch_us(b.ts) + 7200000000 AND epoch_us(b.ts) < epoch_us(a.ts) + 7200000000""",
    "penalty_pairs": _with(
        _LENS,
        _NEIGHBOURS,
        then="""SELECT p.a_ord, p.b_ord, coalesce(m > 0 AND k1 - k0 + 1 = m AND i1 - i0 + 1 = m, false) AS mergeable,
        CASE WHEN m IS NULL OR k1 - k0 + 1 > m OR i1 - i0 + 1 > m THEN 'singleton' WHEN i0 = 0 AND na - 1 - i1 = 0 THEN CASE WHEN moved > 0 THEN 'fuzzy_intron' ELSE 'exact_match' END
        WHEN na - 1 - i1 = 0 THEN CASE WHEN moved > 0 THEN 'fuzzy_truncation_5' ELSE 'truncation_5' END WHEN i0 = 0 THEN CASE WHEN moved > 0 THEN 'fuzzy_truncation_3' ELSE 'truncation_3' END ELSE 'truncation_both' END AS kind,
        CASE WHEN m IS NULL OR k1 - k0 + 1 > m THEN 0.0 WHEN i1 - i0 + 1 > m THEN greatest(0.0, 100.0 - 50.0 * (i1 - i0 + 1 - m)) ELSE greatest(0.0, 100.0 - err - 5.0 * (na - 1 - i1)) END::DOUBLE AS score
        FROM pairs p LEFT JOIN links USING (a_ord, b_ord)""",
    ),
    "reference_ladder": _with(
        _LENS,
        _REF,
        then=""", q AS (SELECT t.ord, r.ref, r.ref_ord, t.gene, t.nj, r.nj AS rn FROM t JOIN r ON t.gene = r.gene AND t.start <= r.stop AND t.stop >= r.start),
        s AS (SELECT q.ord, q.ref, count(*) AS m, count(*) FILTER (WHERE j.i = rj.i) AS same FROM q JOIN j ON j.ord = q.ord JOIN rj ON rj.ref = q.ref AND j.donor = rj.donor AND j.acceptor = rj.acceptor GROUP BY q.ord, q.ref),
        k AS (SELECT q.*, CASE WHEN q.nj = 0 THEN 'gene_match' WHEN same = q.nj AND q.nj = rn THEN 'full_match' WHEN m = q.nj THEN 'junction_match' WHEN m > 0 THEN 'partial_match' ELSE 'gene_match' END AS match
              FROM q LEFT JOIN s USING (ord, ref)),
        b AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY CASE match WHEN 'full_match' THEN 1 WHEN 'junction_match' THEN 2 WHEN 'partial_match' THEN 3 ELSE 4 END,
              CASE WHEN match IN ('junction_match', 'partial_match') THEN -ref_ord ELSE ref_ord END) AS n FROM k)
        SELECT t.ord, coalesce(match, 'novel') AS match, CASE WHEN ref IS NOT NULL THEN 'g' || t.gene END AS ref_gene_id, CASE WHEN match <> 'gene_match' THEN ref END AS ref_transcript_id FROM t LEFT JOIN b ON b.ord = t.ord AND b.n = 1""",
    ),
}
