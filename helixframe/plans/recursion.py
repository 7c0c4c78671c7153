"""SQL for queries that take recursion or long window chains to say."""

from __future__ import annotations

from .analytics import _HIST, _SITES, _TOT, _q
from .catalog import compare
from .counting import _UMI_GENES
from .roles import MOLECULES

_NEAR = "mol b ON b.cb = a.cb AND b.gene = a.gene AND hamming(b.umi, a.umi) = 1"
for _name, _add in (("a11_umi_directional", 0), ("a11_umi_directional_tools", -1)):
    compare(_name, f"WITH {MOLECULES}, child AS (SELECT DISTINCT a.cb, a.gene, a.umi FROM mol a JOIN {_NEAR} WHERE b.n >= 2 * a.n + ({_add}) AND (b.n > a.n OR (b.n = a.n AND b.umi < a.umi))) SELECT cb, gene, count(*) AS n_umi FROM mol ANTI JOIN child USING (cb, gene, umi) GROUP BY ALL")
compare(
    "a16_umi_clique",
    f"""WITH RECURSIVE {MOLECULES}, walk AS (SELECT cb, gene, umi, umi AS root FROM mol UNION SELECT b.cb, b.gene, b.umi, a.root FROM walk a JOIN {_NEAR}),
      lab AS (SELECT cb, gene, umi, min(root) AS root FROM walk GROUP BY ALL), part AS (SELECT cb, gene, root, count(*) AS size, list_sort(list(n), 'DESC') AS ns FROM lab JOIN mol USING (cb, gene, umi) GROUP BY ALL)
      SELECT cb, gene, CAST(sum(CASE WHEN size BETWEEN 2 AND 4 AND ns[1] >= 2 * ns[2] THEN 1 ELSE size END) AS BIGINT) AS n_umi FROM part GROUP BY ALL""",
)
compare(
    "a17_clique_counts",
    f"""WITH RECURSIVE {MOLECULES}, tags AS (SELECT DISTINCT cb, umi FROM mol), walk AS (SELECT cb, umi, umi AS root FROM tags UNION SELECT b.cb, b.umi, a.root FROM walk a JOIN tags b ON b.cb = a.cb AND hamming(b.umi, a.umi) = 1),
      lab AS (SELECT cb, umi, min(root) AS root FROM walk GROUP BY ALL), per AS (SELECT cb, root, gene AS feature, sum(n) AS n FROM lab JOIN mol USING (cb, umi) GROUP BY ALL),
      top AS (SELECT *, sum(n) OVER w AS total, rank() OVER (w ORDER BY n DESC) AS r, count(*) OVER (PARTITION BY cb, root, n) AS ties FROM per WINDOW w AS (PARTITION BY cb, root))
      SELECT cb, feature, count(*) AS n FROM top WHERE r = 1 AND ties = 1 AND n > total * 0.5 GROUP BY ALL""",
)
compare(
    "p4_quality_trim",
    """WITH l AS (SELECT l_orderkey AS read, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS b FROM lineitem),
      r AS (SELECT read, f, b, sum(25 - q) OVER (PARTITION BY read ORDER BY b) AS s3, sum(25 - q) OVER (PARTITION BY read ORDER BY f) AS s5 FROM l),
      k AS (SELECT *, min(s3) OVER (PARTITION BY read ORDER BY b) >= 0 AS on3, min(s5) OVER (PARTITION BY read ORDER BY f) >= 0 AS on5 FROM r),
      m AS (SELECT read, count(*) AS size, coalesce(max(s3) FILTER (on3 AND s3 > 0), 0) AS m3, coalesce(max(s5) FILTER (on5 AND s5 > 0), 0) AS m5 FROM k GROUP BY read)
      SELECT m.read, CAST(any_value(size) - coalesce(min(b) FILTER (on3 AND s3 = m3 AND m3 > 0), 0) AS INT) AS kept3, CAST(any_value(size) - coalesce(min(f) FILTER (on5 AND s5 = m5 AND m5 > 0), 0) AS INT) AS kept5 FROM m JOIN k USING (read) GROUP BY m.read""",
)
compare("x10_hash31", "SELECT n_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 115) AS h FROM nation")
compare(
    "p13_mismatch_tags",
    """WITH x AS (SELECT n_name, rpad(n_name, 12, 'x') AS a, rpad('ARGENTINA', 12, 'x') AS b FROM nation), e AS (SELECT n_name, i, b[i] AS ref FROM x, range(1, 13) t(i) WHERE a[i] <> b[i]),
      g AS (SELECT n_name, i, ref, i - coalesce(lag(i) OVER (PARTITION BY n_name ORDER BY i), 0) - 1 AS run FROM e)
      SELECT x.n_name, CAST(count(i) AS INT) AS nm, coalesce(string_agg(run || ref, '' ORDER BY i), '') || (12 - coalesce(max(i), 0)) AS md FROM x LEFT JOIN g USING (n_name) GROUP BY x.n_name""",
)
compare(
    "m10_error_model",
    """WITH l AS (SELECT l_orderkey, l_linenumber, x.p AS l_partkey, x.s AS l_suppkey FROM (SELECT l_orderkey, l_linenumber, min(struct_pack(p := l_partkey, s := l_suppkey)) AS x FROM lineitem GROUP BY ALL)), b AS (SELECT l_orderkey AS read, l_linenumber AS place, least(1, l_linenumber * 2 // 8) AS bin, (l_partkey % 4) * 9 + CASE WHEN l_suppkey % 10 > 0 THEN l_partkey % 4 ELSE (l_partkey + 1) % 4 END AS state FROM l),
      t AS (SELECT bin, lag(state) OVER (PARTITION BY read ORDER BY place) AS prior, state FROM b), n AS (SELECT bin, prior, state, count(*) AS n FROM t WHERE prior IS NOT NULL GROUP BY ALL)
      SELECT CAST(bin AS INT) AS bin, prior AS before, state, floor(ln((n + 1.0::DOUBLE) / sum(n + 1.0::DOUBLE) OVER (PARTITION BY bin, prior)) * 1e6 + 0.5) / 1e6 AS logp FROM n""",
)
compare(
    "m16_order_of_magnitude",
    f"""WITH {_TOT}, g AS (SELECT DISTINCT CAST(round(pow(2::DOUBLE, 1 + i * (log2(2000::DOUBLE) - 1) / 199)) AS INT) AS r FROM range(200) t(i)), b AS (SELECT r, n AS baseline, greatest(1, CAST(floor(n * 0.1::DOUBLE + 0.5) AS BIGINT)) AS cutoff FROM g JOIN rk ON rank = greatest(1, round(r * (1 - 0.99::DOUBLE)))),
      f AS (SELECT b.r, baseline, cutoff, count(tot.cb) AS f FROM b LEFT JOIN tot ON tot.n >= cutoff GROUP BY ALL) SELECT f AS recovered, baseline, cutoff FROM f ORDER BY pow(f - r, 2) / r::DOUBLE, r LIMIT 1""",
)
compare(
    "m1_new_to_total",
    f"""WITH RECURSIVE {_HIST}, c AS (SELECT gene, w, exp(k * ln(0.001::DOUBLE) + (n_t - k) * ln(0.999::DOUBLE)) AS old, exp(k * ln(0.05::DOUBLE) + (n_t - k) * ln(0.95::DOUBLE)) AS new, lgamma(n_t + 1) - lgamma(k + 1) - lgamma(n_t - k + 1) AS choose FROM h),
      s AS (SELECT 0 AS r, gene, 0.1::DOUBLE AS pi, -1e308::DOUBLE AS last, false AS done FROM h GROUP BY gene
        UNION ALL SELECT r + 1, gene, nxt, ll, abs(nxt - pi) < 1e-6 AND abs(ll - last) < 1e-6 FROM (SELECT r, s.gene, pi, last, sum(w * pi * new / ((1 - pi) * old + pi * new)) / sum(w) AS nxt, sum(w * (ln((1 - pi) * old + pi * new) + choose)) AS ll FROM s JOIN c USING (gene) WHERE NOT done AND r < 1000 GROUP BY ALL))
      SELECT s.gene, any_value(t.reads) AS reads, {_q("arg_max(pi, r)", 4)} AS ntr FROM s JOIN (SELECT gene, sum(w) AS reads FROM h GROUP BY gene) t USING (gene) GROUP BY s.gene""",
)
compare(
    "m3_snp_em",
    f"""WITH RECURSIVE {_SITES}, h AS (SELECT n::DOUBLE AS n, k::DOUBLE AS k, count(*)::DOUBLE AS m FROM st GROUP BY ALL), z AS (SELECT least(greatest(coalesce(sum(k * m) FILTER (k / n <= 0.01), 0) / greatest(coalesce(sum(n * m) FILTER (k / n <= 0.01), 0), 1), 1e-6), 0.1) AS err FROM h),
      s AS (SELECT 0 AS r, 0.999::DOUBLE AS a, 0.0009::DOUBLE AS b, 0.0001::DOUBLE AS c, err::DOUBLE AS p, 0.0::DOUBLE AS last, false AS done FROM z
        UNION ALL SELECT r + 1, greatest(sa / m, 1e-12), greatest(sb / m, 1e-12), greatest(sc / m, 1e-12), least(greatest(sk / greatest(sn, 1e-12), 1e-6), 0.1), total, r > 0 AND abs(total - last) <= 1e-7 * abs(last) FROM (
          SELECT r, last, sum(m) AS m, sum(m * x / (x + y + v)) AS sa, sum(m * y / (x + y + v)) AS sb, sum(m * v / (x + y + v)) AS sc, sum(k * m * x / (x + y + v)) AS sk, sum(n * m * x / (x + y + v)) AS sn, sum(m * (top + ln(x + y + v))) AS total FROM (
            SELECT *, exp(l1 - top) AS x, exp(l2 - top) AS y, exp(l3 - top) AS v FROM (SELECT *, greatest(l1, l2, l3) AS top FROM (
              SELECT s.*, h.*, ln(a) + k * ln(p) + (n - k) * ln(1 - p) AS l1, ln(b) + n * ln(0.5::DOUBLE) AS l2, ln(c) + k * ln(0.95::DOUBLE) + (n - k) * ln(0.05::DOUBLE) AS l3 FROM s, h WHERE NOT done AND r < 50))) GROUP BY r, last)),
      e AS (SELECT * FROM s ORDER BY r DESC LIMIT 1), q AS (SELECT chr, pos, ln(a) + k * ln(p) + (n - k) * ln(1 - p) AS l1, ln(b) + n * ln(0.5::DOUBLE) AS l2, ln(c) + k * ln(0.95::DOUBLE) + (n - k) * ln(0.05::DOUBLE) AS l3 FROM st, e)
      SELECT chr, pos FROM q WHERE 1 - exp(l1 - greatest(l1, l2, l3)) / (exp(l1 - greatest(l1, l2, l3)) + exp(l2 - greatest(l1, l2, l3)) + exp(l3 - greatest(l1, l2, l3))) >= 0.99::DOUBLE""",
)

# transcripts: a class for each set of suppliers of an order, of weight 1 a member
_CLASSES = """cl AS (SELECT ts, count(*) AS n FROM (SELECT list_sort(list(DISTINCT l_suppkey)) AS ts FROM lineitem GROUP BY l_orderkey) GROUP BY ts), num AS (SELECT row_number() OVER () AS c, ts, n::DOUBLE AS n FROM cl),
  el AS (SELECT c, n, unnest(ts) AS tid FROM num), x AS (SELECT c, el.n, el.tid, el.n / (s_suppkey * 13 % 400 + 100)::DOUBLE AS aux FROM el JOIN supplier ON s_suppkey = tid),
  tot AS (SELECT sum(n) AS total, least(0.999::DOUBLE, sum(n) / 5e6) AS share FROM num), size AS (SELECT count(*) AS k FROM supplier),
  first AS (SELECT tid, sum(n * aux / a) AS e FROM (SELECT *, sum(aux) OVER (PARTITION BY c) AS a FROM x) GROUP BY tid),
  init AS (SELECT s_suppkey AS tid, share * coalesce(e, 0) + (1 - share) * total / k AS now FROM supplier LEFT JOIN first ON tid = s_suppkey, tot, size)"""


def _rounds(theta: str) -> str:
    """theta: of the working table's rows w, which carry now of every transcript and the sum of all as alls."""
    return f"""WITH RECURSIVE {_CLASSES}, s AS (SELECT 0 AS r, tid, now, false AS done FROM init
        UNION ALL SELECT r + 1, tid, new, r + 1 >= 100 AND max(CASE WHEN new > 0.01 THEN abs(new - now) / new ELSE 0 END) OVER () < 0.01 FROM (
          SELECT w.r, w.tid, any_value(w.now) AS now, coalesce(sum(CASE WHEN tv > 0 THEN cn * v / tv END), 0) AS new FROM (
            SELECT w.r, w.tid, w.now, x.c, x.n AS cn, th * x.aux AS v, sum(th * x.aux) OVER (PARTITION BY x.c) AS tv FROM (SELECT *, {theta} AS th FROM (SELECT *, sum(now) OVER () AS alls, count(*) OVER () AS many FROM s WHERE NOT done AND r < 10000)) w LEFT JOIN x USING (tid)) w GROUP BY w.r, w.tid))
      SELECT tid, {_q("CASE WHEN now <= 1e-8 THEN 0 ELSE now END", 2)} AS count FROM s WHERE r = (SELECT max(r) FROM s)"""


def _digamma(x: str) -> str:
    shift = " + ".join(f"1.0::DOUBLE / ({x} + {i})" for i in range(6))
    f = f"(1.0::DOUBLE / (({x} + 6) * ({x} + 6)))"
    return f"(ln({x} + 6) - 0.5::DOUBLE / ({x} + 6) - {f} * (1 / 12.0::DOUBLE - {f} * (1 / 120.0::DOUBLE - {f} * (1 / 252.0::DOUBLE - {f} * (1 / 240.0::DOUBLE - {f} / 132.0::DOUBLE)))) - ({shift}))"


compare("m6_em", _rounds("now"))
compare("m7_vb", _rounds(f"exp({_digamma('(now + 0.01::DOUBLE)')} - {_digamma('(alls + 0.01::DOUBLE * many)')})"))

# a multi-gene tag's shares, in each cell
compare(
    "m5_multi_gene_em",
    f"""WITH RECURSIVE {_UMI_GENES}, u AS (SELECT cb, gene, count(*) FILTER (genes = 1)::DOUBLE AS uq, coalesce(sum(1.0::DOUBLE / genes) FILTER (genes > 1), 0) AS even FROM com GROUP BY ALL), multi AS (SELECT cb, umi, gene FROM com WHERE genes > 1),
      s AS (SELECT 0 AS r, cb, gene, uq, uq + even AS now, false AS done FROM u
        UNION ALL SELECT r + 1, cb, gene, uq, new, max(abs(new - th)) OVER (PARTITION BY cb) < 0.01 FROM (
          SELECT r, cb, gene, any_value(uq) AS uq, any_value(th) AS th, any_value(uq) + coalesce(sum(CASE WHEN tot > 0 THEN th / tot ELSE 0 END) FILTER (umi IS NOT NULL), 0) AS new FROM (
            SELECT w.r, w.cb, w.gene, uq, th, m.umi, sum(th) OVER (PARTITION BY w.cb, m.umi) AS tot FROM (SELECT *, CASE WHEN now < 0.01 THEN 0 ELSE now END AS th FROM s WHERE NOT done AND r < 100) w LEFT JOIN multi m ON m.cb = w.cb AND m.gene = w.gene) GROUP BY r, cb, gene))
      SELECT cb, gene, {_q("now - uq")} AS em FROM s QUALIFY r = max(r) OVER (PARTITION BY cb)""",
)
# the normal prior of mean 250 and deviation 25 by Simpson's rule, 32 steps a length
compare(
    "a36_fragment_lengths",
    f"""WITH g AS (SELECT f, sum((CASE WHEN k IN (0, 32) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5::DOUBLE * pow((f - 0.5::DOUBLE + k / 32.0::DOUBLE - 250) / 25.0::DOUBLE, 2))) AS w FROM range(0, 1001) a(f), range(0, 33) b(k) GROUP BY f),
      kern(d, c) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)), o AS (SELECT least(p_size * 10, 1000) AS f, count(*) AS n FROM part GROUP BY ALL),
      every AS (SELECT f, w / sum(w) OVER () AS w FROM g UNION ALL SELECT greatest(0, least(1000, f + d)), n * c / 16.0::DOUBLE FROM o, kern), t AS (SELECT f, sum(w) AS w FROM every GROUP BY f)
      SELECT CAST(f AS INT) AS f, {_q("w / sum(w) OVER ()")} AS p FROM t""",
)
