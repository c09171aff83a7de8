"""Queries on tests, correlations and networks."""
from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions.ranking import bh
from lamella.operators import correlation as CO, differential as DI, filters as FI, mapping as MP, network as NE, normalize as NO
from lamella.plans import fixtures as X
from lamella.plans.catalog_tables import _TAX, _PL, _lineage, _part_layer
from lamella.plans.fixtures import f_p, t_p, with_
from lamella.plans.registry import register

# ---- H: differential -----------------------------------------------------------------------

_G = with_("la", "samples") + """, gs AS (SELECT layer, feature, count(*) FILTER (acct_high='high') AS n0, count(*) FILTER (acct_high='low') AS n1,
  avg(value) FILTER (acct_high='high') AS m0, avg(value) FILTER (acct_high='low') AS m1,
  var_samp(value) FILTER (acct_high='high') AS v0, var_samp(value) FILTER (acct_high='low') AS v1 FROM la JOIN samples USING (sample) GROUP BY 1,2)
"""
_T = """, tt AS (SELECT layer, feature, m0-m1 AS diff, cast(n0+n1-2 as double) AS df,
  (m0-m1)/sqrt(((n0-1)*v0+(n1-1)*v1)/(n0+n1-2)*(1.0/n0+1.0/n1)) AS stat FROM gs)
"""
register("t_test", "H1", _G + _T + f"SELECT *, {t_p('stat', 'df')} AS pval FROM tt", "diff df stat pval")(
    lambda s, d: DI.t_test(X.log_a(s, d), X.samples(s, d), "acct_high", adjust=False))
register("t_test_one_sample", "H1", with_("la") + f"""SELECT *, {t_p('stat', 'df')} AS pval FROM (SELECT layer, feature, avg(value) AS diff, cast(count(*)-1 as double) AS df,
  avg(value)/sqrt(var_samp(value)/count(*)) AS stat FROM la GROUP BY 1,2) t""", "diff df stat pval")(
    lambda s, d: DI.t_test(X.log_a(s, d), adjust=False))
_FG = with_("la", "samples") + """, s AS (SELECT layer, feature, region, count(*) AS n, avg(value) AS mn, var_samp(value) AS v FROM la JOIN samples USING (sample) GROUP BY 1,2,3)
"""
register("f_test", "H2", _FG + f"""SELECT *, {f_p('stat', 'df1', 'df2')} AS pval FROM (SELECT layer, feature, cast(k-1 as double) AS df1, cast(nn-k as double) AS df2, (s2-s1*s1/nn)/(k-1)/(ssw/(nn-k)) AS stat FROM (
  SELECT layer, feature, count(*) AS k, sum(n) AS nn, sum((n-1)*v) AS ssw, sum(n*mn) AS s1, sum(n*mn*mn) AS s2 FROM s GROUP BY 1,2) t) u""", "df1 df2 stat pval")(
    lambda s, d: DI.f_test(X.log_a(s, d), X.samples(s, d), "region").select("layer", "feature", "df1", "df2", "stat", "pval"))
register("f_test_welch", "H2", _FG + """, c AS (SELECT *, n/v AS w, sum(n/v) OVER p AS ww, sum(n/v*mn) OVER p AS wm, count(*) OVER p AS k FROM s WINDOW p AS (PARTITION BY layer, feature)),
 t AS (SELECT layer, feature, any_value(k) AS k, sum(w*(mn-wm/ww)*(mn-wm/ww)) AS a, sum((1-w/ww)*(1-w/ww)/(n-1)) AS b FROM c GROUP BY 1,2)
SELECT *, """ + f_p("stat", "df1", "df2") + """ AS pval FROM (SELECT layer, feature, cast(k-1 as double) AS df1, (k*k-1)/(3*b) AS df2, (a/(k-1))/(1+2*(k-2)/(k*k-1)*b) AS stat FROM t) u""", "df1 df2 stat pval")(
    lambda s, d: DI.f_test(X.log_a(s, d), X.samples(s, d), "region", False).select("layer", "feature", "df1", "df2", "stat", "pval"))
_lm = ["layer", "feature", "term", "coef", "sigma", "df", "ave"]
register("lm_contrast", "H3", _G + """SELECT layer, feature, 'low-high' AS term, m1-m0 AS coef, sqrt(((n0-1)*v0+(n1-1)*v1)/(n0+n1-2)) AS sigma,
  cast(n0+n1-2 as double) AS df, (n0*m0+n1*m1)/(n0+n1) AS ave FROM gs""", "coef sigma df ave")(
    lambda s, d: DI.lm_test(X.log_a(s, d), X.samples(s, d), "acct_high", ref="high").select(*_lm))
_LMR = """SELECT x.layer, x.feature, x.region || '-' || y.region AS term, x.mn-y.mn AS coef, sqrt(e.ssw/(e.nn-e.k)) AS sigma, cast(e.nn-e.k as double) AS df, e.sm/e.nn AS ave
 FROM s x JOIN s y ON x.feature=y.feature AND {cond} JOIN (SELECT feature, sum(n) AS nn, count(*) AS k, sum((n-1)*v) AS ssw, sum(n*mn) AS sm FROM s GROUP BY 1) e ON e.feature=x.feature"""
register("lm_reference", "H3", _FG + _LMR.format(cond="y.region='ASIA' AND x.region<>'ASIA'"), "coef sigma df ave")(
    lambda s, d: DI.lm_test(X.log_a(s, d), X.samples(s, d), "region", ref="ASIA").select(*_lm))
register("lm_continuous", "H4", with_("la", "samples") + """SELECT layer, feature, 's_acctbal' AS term, regr_slope(value, s_acctbal) AS coef,
  sqrt((regr_syy(value,s_acctbal)-regr_sxy(value,s_acctbal)*regr_sxy(value,s_acctbal)/regr_sxx(value,s_acctbal))/(count(*)-2)) AS sigma,
  cast(count(*)-2 as double) AS df, avg(value) AS ave FROM la JOIN samples USING (sample) GROUP BY 1,2""", "coef sigma df ave")(
    lambda s, d: DI.lm_test(X.log_a(s, d), X.samples(s, d), "s_acctbal", kind="cont").select(*_lm))
register("lm_block", "H5")(lambda s, d: DI.lm_test(X.log_a(s, d), X.samples(s, d), "acct_high", block="region"))
register("lm_nested_contrast", "H6")(lambda s, d: DI.lm_test(
    X.log_a(s, d), X.samples(s, d), "region", contrasts={"kind": "nested", "pairs": [("ASIA", "EUROPE"), ("AFRICA", "AMERICA")], "nested_only": False}))
register("lm_nested_coefficients", "H6", _FG + """, w AS (SELECT layer, feature, max(mn) FILTER (region='ASIA')-max(mn) FILTER (region='EUROPE') AS ae,
  max(mn) FILTER (region='AFRICA')-max(mn) FILTER (region='AMERICA') AS aa, sqrt(sum((n-1)*v)/(sum(n)-count(*))) AS sigma, cast(sum(n)-count(*) as double) AS df, sum(n*mn)/sum(n) AS ave FROM s GROUP BY 1,2)
SELECT layer, feature, 'ASIA-EUROPE' AS term, ae AS coef, sigma, df, ave FROM w UNION ALL SELECT layer, feature, 'AFRICA-AMERICA', aa, sigma, df, ave FROM w
UNION ALL SELECT layer, feature, '(ASIA-EUROPE)-(AFRICA-AMERICA)', ae-aa, sigma, df, ave FROM w""", "coef sigma df ave")(lambda s, d: DI.lm_test(
    X.log_a(s, d), X.samples(s, d), "region", contrasts={"kind": "nested", "pairs": [("ASIA", "EUROPE"), ("AFRICA", "AMERICA")], "nested_only": False}).select(*_lm))
# one covariate factor: the coefficient is the slope within its levels
register("adjustment_coefficients", "H7", with_("la", "samples") + """, j AS (SELECT layer, feature, value, CASE WHEN acct_high='low' THEN 1.0 ELSE 0.0 END AS x, region FROM la JOIN samples USING (sample)),
 c AS (SELECT layer, feature, x-avg(x) OVER p AS xc, value-avg(value) OVER p AS yc, x, value FROM j WINDOW p AS (PARTITION BY layer, feature, region))
SELECT layer, feature, 'low-high' AS term, sum(xc*yc)/sum(xc*xc) AS coef_adjusted, regr_slope(value, x) AS coef_raw FROM c GROUP BY 1,2""", "coef_adjusted coef_raw")(
    lambda s, d: DI.adjustment_effect(X.log_a(s, d), X.samples(s, d), "acct_high", ["region"]).select("layer", "feature", "term", "coef_adjusted", "coef_raw"))
register("adjustment_effect", "H7")(lambda s, d: DI.adjustment_effect(X.log_a(s, d), X.samples(s, d), "acct_high", ["region"]))


def _pvals(s, d):
    """p-values with many ties: rounded price ranks of the parts."""
    p = X.table(s, d, "part")
    return p.select(F.col("p_type").alias("layer"), F.col("p_partkey").cast("string").alias("feature"), (F.pmod(F.col("p_partkey") * 37, F.lit(997)) / 1000.0 + 0.0001).alias("pval"))


register("bh_adjust", "H8", """WITH p AS (SELECT p_type AS layer, cast(p_partkey as string) AS feature, (p_partkey*37)%997/1000.0+0.0001 AS pval FROM part),
 r AS (SELECT *, pval*count(*) OVER (PARTITION BY layer)/row_number() OVER (PARTITION BY layer ORDER BY pval, feature) AS q FROM p)
SELECT layer, feature, pval, least(1.0, min(q) OVER (PARTITION BY layer ORDER BY pval DESC, feature DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM r""", "pval padj")(
    lambda s, d: bh(_pvals(s, d), "pval", ["layer"]))
register("significant_features", "H9", """WITH p AS (SELECT p_type AS layer, p_brand AS feature, (p_partkey*37)%997/1000.0+0.0001 AS padj, p_size/10.0-2 AS coef FROM part)
SELECT layer, feature, min(padj) AS padj, max(abs(coef)) AS max_coef FROM p GROUP BY 1,2 HAVING min(padj)<=0.02 AND max(abs(coef))>=2.95""", "padj max_coef")(
    lambda s, d: DI.significant(X.table(s, d, "part").select(
        F.col("p_type").alias("layer"), F.col("p_brand").alias("feature"), (F.pmod(F.col("p_partkey") * 37, F.lit(997)) / 1000.0 + 0.0001).alias("padj"),
        (F.col("p_size") / 10.0 - 2).alias("coef")), 0.02, 2.95))
register("pairwise_lm", "H10", _FG + _LMR.format(cond="x.region>y.region"), "coef sigma df ave")(
    lambda s, d: DI.pairwise_lm(X.log_a(s, d), X.samples(s, d), "region").select(*_lm))
register("overall_f", "H10", with_("la", "samples") + """, x AS (SELECT layer, feature, region, value FROM la JOIN samples USING (sample)),
  g AS (SELECT layer, feature, region, count(*) AS n, avg(value) AS m, sum(value) AS s, var_pop(value)*count(*) AS ss FROM x GROUP BY 1,2,3),
  t AS (SELECT layer, feature, cast(count(*)-1 as double) AS f_df, cast(sum(n)-count(*) as double) AS df_total, sum(ss) AS within, sum(n*m*m)-sum(s)*sum(s)/sum(n) AS between FROM g GROUP BY 1,2),
  f AS (SELECT layer, feature, (between/f_df)/(within/df_total) AS f_stat, f_df, df_total FROM t),
  p AS (SELECT *, """ + f_p("f_stat", "f_df", "df_total") + """ AS f_pval FROM f),
  q AS (SELECT *, f_pval*count(*) OVER (PARTITION BY layer)/row_number() OVER (PARTITION BY layer ORDER BY f_pval, feature) AS q FROM p)
SELECT layer, feature, f_stat, f_df, df_total, f_pval, least(1.0, min(q) OVER (PARTITION BY layer ORDER BY f_pval DESC, feature DESC ROWS UNBOUNDED PRECEDING)) AS f_padj FROM q""",
         "f_stat f_pval f_padj")(lambda s, d: DI.overall_f(X.log_a(s, d), X.samples(s, d), "region", prior=False))
register("membership", "H11")(lambda s, d: DI.membership(X.log_a(s, d), X.samples(s, d), "region", 0.9))


def _log2(m):
    return m.withColumn("value", F.log2(F.col("value") + 1))


register("lm_taxa", "H12", _PL.rstrip() + ", " + _TAX + with_("samples").replace("WITH", ",") + """, r AS (SELECT rank AS layer, taxon AS feature, sample, log2(sum(value)+1) AS value
  FROM pl JOIN tax USING (feature) GROUP BY 1,2,3),
 g AS (SELECT layer, feature, avg(value) FILTER (acct_high='low')-avg(value) FILTER (acct_high='high') AS coef, avg(value) AS ave FROM r JOIN samples USING (sample) GROUP BY 1,2)
SELECT layer, feature, coef, ave FROM g""", "coef ave")(
    lambda s, d: DI.lm_test_taxa(_part_layer(s, d), MP.parse_taxa(_lineage(s, d)), X.samples(s, d), "acct_high", _log2)
    .select("layer", "feature", "coef", "ave"))


def flagship(spark, d):
    """Which brands differ between the two supplier groups: log2, autoscale, t-test, BH."""
    m = NO.scale(NO.normalize(X.layer_a(spark, d), "log2"), "auto")
    return DI.t_test(m, X.samples(spark, d), "acct_high").orderBy("pval", "feature")


register("flagship", "E4 E19 H1 H8", with_("la", "samples") + """, z AS (SELECT layer, feature, sample, (value-avg(value) OVER p)/stddev_samp(value) OVER p AS value FROM la WINDOW p AS (PARTITION BY layer, feature)),
 gs AS (SELECT layer, feature, count(*) FILTER (acct_high='high') AS n0, count(*) FILTER (acct_high='low') AS n1, avg(value) FILTER (acct_high='high') AS m0, avg(value) FILTER (acct_high='low') AS m1,
  var_samp(value) FILTER (acct_high='high') AS v0, var_samp(value) FILTER (acct_high='low') AS v1 FROM z JOIN samples USING (sample) GROUP BY 1,2)""" + _T.rstrip() + f""",
 pv AS (SELECT *, {t_p('stat', 'df')} AS pval FROM tt),
 q AS (SELECT *, pval*count(*) OVER (PARTITION BY layer)/row_number() OVER (PARTITION BY layer ORDER BY pval, feature) AS raw FROM pv)
SELECT layer, feature, diff, df, stat, pval, least(1.0, min(raw) OVER (PARTITION BY layer ORDER BY pval DESC, feature DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM q""", "diff df stat pval padj")(flagship)

# ---- I: correlation ------------------------------------------------------------------------

_CO = """SELECT x.layer AS layer1, x.feature AS feature1, y.layer AS layer2, y.feature AS feature2, corr(x.value,y.value) AS r, cast(count(*) as double) AS n
  FROM {t} x JOIN {t} y ON x.sample=y.sample AND (x.layer, x.feature)<(y.layer, y.feature) {w} GROUP BY 1,2,3,4"""
_K = CO.PAIR_KEYS


def _with_p(sql: str) -> str:
    """The pairs with the t p-value of their correlation."""
    head, _, body = sql.rpartition(_CO[:40])
    return f"{head}SELECT *, {t_p('r*sqrt((n-2)/(1-r*r))', '(n-2)')} AS pval FROM ({_CO[:40]}{body}) c"


register("correlate_pearson", "I3", _with_p(with_("ab") + _CO.format(t="ab", w="")), "r n pval")(lambda s, d: CO.correlate(X.log_ab(s, d)).select(*_K, "r", "n", "pval"))
register("correlate_pairwise_complete", "I3", with_("dirty") + _CO.format(t="dirty", w="WHERE x.value IS NOT NULL AND y.value IS NOT NULL"), "r n")(
    lambda s, d: CO.correlate(X.dirty(s, d)).select(*_K, "r", "n"))
_RANK = """, rk AS (SELECT layer, feature, sample, rank() OVER (PARTITION BY layer, feature ORDER BY value)
  +(count(*) OVER (PARTITION BY layer, feature, value)-1)/2.0 AS value FROM ab)
"""
register("correlate_spearman", "I4", with_("ab").replace("ln(value)/ln(2)", "value") + _RANK + _CO.format(t="rk", w=""), "r n")(
    lambda s, d: CO.correlate(X.stack_layers([X.layer_a(s, d), X.layer_b(s, d)]), "spearman").select(*_K, "r", "n"))
register("correlate_kendall", "I5", with_("e") + """, ps AS (SELECT x.feature, x.sample AS s1, y.sample AS s2, sign(x.value-y.value) AS g FROM e x JOIN e y
  ON x.feature=y.feature AND x.sample<y.sample)
SELECT 'ptype' AS layer1, p.feature AS feature1, 'ptype' AS layer2, q.feature AS feature2, sum(p.g*q.g)/sqrt(sum(abs(p.g))*sum(abs(q.g))) AS r
  FROM ps p JOIN ps q ON p.s1=q.s1 AND p.s2=q.s2 AND p.feature<q.feature GROUP BY 2,4""", "r")(
    lambda s, d: CO.correlate(X.layer_e(s, d), "kendall").select(*_K, "r"))
register("partial_correlation", "I6")(lambda s, d: CO.partial_corr(X.log_a(s, d)))
# whole-number digammas are harmonic numbers; the nearest-neighbour counts come from all distances of a pair's samples
register("mutual_information", "I7", with_("la") + """, dd AS (SELECT x.feature, x.sample AS s1, y.sample AS s2, abs(x.value-y.value) AS g FROM la x JOIN la y ON x.feature=y.feature AND x.sample<>y.sample),
 hh AS (SELECT k, sum(1.0/greatest(k,1)) OVER (ORDER BY k) - 1 AS h FROM range(0, 1000) t(k)),
 zz AS (SELECT p.feature AS f1, q.feature AS f2, p.s1, p.g AS gx, q.g AS gy, greatest(p.g,q.g) AS z FROM dd p JOIN dd q ON p.s1=q.s1 AND p.s2=q.s2 AND p.feature<q.feature),
 ee AS (SELECT f1, f2, s1, list_extract(list_sort(list(z)), 5) AS eps, count(*)+1 AS n FROM zz GROUP BY 1,2,3),
 cc AS (SELECT f1, f2, s1, any_value(n) AS n, count(*) FILTER (gx<eps) AS nx, count(*) FILTER (gy<eps) AS ny FROM zz JOIN ee USING (f1,f2,s1) GROUP BY 1,2,3),
 mm AS (SELECT f1, f2, greatest(0, any_value(k4.h)+any_value(kn.h)-avg(hx.h+hy.h)) AS mi FROM cc JOIN hh hx ON hx.k=nx JOIN hh hy ON hy.k=ny JOIN hh kn ON kn.k=n-1 JOIN hh k4 ON k4.k=4 GROUP BY 1,2)
SELECT 'revenue' AS layer1, f1 AS feature1, 'revenue' AS layer2, f2 AS feature2, mi, mi/max(mi) OVER () AS scaled FROM mm""", "mi scaled")(
    lambda s, d: CO.mutual_info(X.log_a(s, d)).select(*_K, "mi", "scaled"))
for _how in ("aracne", "clr", "mrnet"):
    register(f"infer_network_{_how}", "I8")(lambda s, d, h=_how: CO.infer_network(
        CO.correlate(X.log_ab(s, d)).withColumn("mi", F.abs("r")), h))
register("select_significant", "I1", with_("la", "samples") + """, st AS (SELECT layer, feature, abs(avg(value) FILTER (acct_high='high')-avg(value) FILTER (acct_high='low')) AS s
  FROM la JOIN samples USING (sample) GROUP BY 1,2), k AS (SELECT layer, feature FROM st ORDER BY s LIMIT 7)
SELECT layer, feature, sample, value FROM la WHERE (layer, feature) IN (SELECT (layer, feature) FROM k)""", "value")(
    lambda s, d: CO.select_features(X.log_a(s, d), DI.t_test(X.log_a(s, d), X.samples(s, d), "acct_high", adjust=False).withColumn("a", F.abs("diff")), by="a", limit=7))
register("select_by_loading", "I2", with_("b") + """, l AS (SELECT layer, feature, cast(sample as int)%5+1 AS factor, sum(value)-480 AS v FROM b GROUP BY 1,2,3),
  k AS (SELECT layer, feature FROM l WHERE factor<=2 QUALIFY row_number() OVER (PARTITION BY layer, factor ORDER BY abs(v) DESC, md5(feature), feature)<=4)
SELECT layer, feature, sample, value FROM b WHERE (layer, feature) IN (SELECT (layer, feature) FROM k)""", "value")(
    lambda s, d: CO.select_by_loading(X.layer_b(s, d), X.layer_b(s, d).groupBy("layer", "feature", (F.col("sample").cast("int") % 5 + 1).alias("factor"))
                                      .agg((F.sum("value") - 480).alias("value")), 4, 2))
_E = with_("ab") + ", e0 AS (" + _CO.format(t="ab", w="") + ")\n"
_edges = lambda s, d, t=0.0: CO.correlate(X.log_ab(s, d), "pearson", t)
register("filter_edges", "I9", _E + """, f AS (SELECT * FROM e0 WHERE abs(r)>CASE WHEN layer1<>layer2 THEN 0.1 ELSE 0.3 END)
SELECT layer1, feature1, layer2, feature2, r FROM f QUALIFY dense_rank() OVER (ORDER BY round(abs(r),10) DESC)<=200""", "r")(
    lambda s, d: CO.filter_edges(_edges(s, d), 0.1, 0.3, keep=200).select(*_K, "r"))
register("filter_edges_cross", "I9", _E + "SELECT layer1, feature1, layer2, feature2, r FROM e0 WHERE layer1<>layer2 AND -r>0.2", "r")(
    lambda s, d: CO.need_edges(CO.filter_edges(_edges(s, d), 0.2, 0.2, "negative", True)).select(*_K, "r"))
register("correlate_in_group", "I10", with_("ab", "samples") + _CO.format(t="ab", w="WHERE x.sample IN (SELECT sample FROM samples WHERE region='ASIA')"), "r n")(
    lambda s, d: CO.correlate(X.log_ab(s, d).join(X.samples(s, d).where("region = 'ASIA'"), "sample", "left_semi")).select(*_K, "r", "n"))
_DC = with_("la", "samples") + """, dc AS (SELECT region AS "group", x.layer AS layer1, x.feature AS feature1, y.layer AS layer2, y.feature AS feature2, corr(x.value,y.value) AS r,
  cast(count(*) as double) AS n FROM la x JOIN la y ON x.sample=y.sample AND x.feature<y.feature JOIN samples s ON s.sample=x.sample GROUP BY 1,2,3,4,5)
"""
register("diff_correlate", "I11", _DC + "SELECT * FROM dc", "r n")(
    lambda s, d: CO.diff_correlate(X.log_a(s, d), X.samples(s, d), "region").drop("pval"))
register("diff_network", "I12", _DC + """, ok AS (SELECT DISTINCT feature1, feature2 FROM dc WHERE abs(r)>=0.5),
  k AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(abs(r),10) DESC, feature1, feature2) AS rank FROM dc JOIN ok USING (feature1, feature2))
SELECT "group", layer1, feature1, layer2, feature2, r, n, rank FROM k WHERE rank<=25""", "r n")(
    lambda s, d: CO.diff_network(CO.diff_correlate(X.log_a(s, d), X.samples(s, d), "region"), 0.5, 1.0, 25).drop("pval"))
register("chord", "I13", _E + """SELECT layer1, feature1, layer2, feature2, r FROM e0 WHERE layer1<>layer2 AND abs(r)>0.1
  ORDER BY round(abs(r),10) DESC, layer1, feature1, layer2, feature2 LIMIT 50""", "r")(
    lambda s, d: CO.chord(_edges(s, d), 0.1, 1.0, 50).select(*_K, "r"))
register("cross_block", "I14", _E + """SELECT layer1, feature1, layer2, feature2, round(r,4) AS r FROM e0 WHERE layer1<>layer2 AND abs(r)>=0.1
  ORDER BY round(abs(r),10) DESC, layer1, feature1, layer2, feature2 LIMIT 100""", "r")(lambda s, d: CO.cross_block(X.log_ab(s, d), 0.1, 100))
register("corr_distribution", "I15", _E + """SELECT CASE WHEN layer1<>layer2 THEN 'inter' ELSE 'intra' END AS class, count(*) FILTER (r>0.1) AS positive,
  count(*) FILTER (r< -0.1) AS negative, count(*) AS n FROM e0 GROUP BY 1""")(lambda s, d: CO.corr_distribution(_edges(s, d), 0.1)[0])
register("corr_histogram", "I15", _E + """SELECT CASE WHEN layer1<>layer2 THEN 'inter' ELSE 'intra' END AS class,
  least(20, cast(floor((r+1)/2*20) as bigint)+1) AS bin, count(*) AS n FROM e0 GROUP BY 1,2""")(lambda s, d: CO.corr_distribution(_edges(s, d), 0.1)[1])
register("pair_values", "I16", with_("a", "b", "samples") + """SELECT a.sample, a.value AS x, b.value AS y, region AS "group" FROM a JOIN b USING (sample)
  JOIN samples USING (sample) WHERE a.feature='Brand#1' AND b.feature='7'""", "x y")(
    lambda s, d: CO.pair_values(X.stack_layers([X.layer_a(s, d), X.layer_b(s, d)]), X.samples(s, d), "region", ("revenue", "Brand#1"), ("quantity", "7")))

# ---- J: network ----------------------------------------------------------------------------

_N = _E + """, ge AS (SELECT layer1 || ':' || feature1 AS src, layer2 || ':' || feature2 AS dst, r AS weight FROM e0 WHERE abs(r)>0.21),
  sym AS (SELECT src, dst FROM ge UNION SELECT dst, src FROM ge), deg AS (SELECT src AS node, count(*) AS degree FROM sym GROUP BY 1)
"""
_REC = _N.replace("WITH ", "WITH RECURSIVE ", 1)


def _graph(s, d):
    return CO.network_edges(CO.filter_edges(_edges(s, d, 0.2), 0.21, 0.21))


register("simplify", "J1", """WITH e AS (SELECT p_brand AS src, substr(p_brand,1,6) || p_size AS dst, p_retailprice AS weight FROM part)
SELECT least(src,dst) AS src, greatest(src,dst) AS dst, avg(weight) AS weight FROM e WHERE src<>dst GROUP BY 1,2""", "weight")(
    lambda s, d: NE.simplify(X.table(s, d, "part").select(F.col("p_brand").alias("src"), F.concat(F.substring("p_brand", 1, 6), F.col("p_size").cast("string")).alias("dst"),
                                                         F.col("p_retailprice").alias("weight"))))
_CC = _REC + """, walk AS (SELECT node, node AS root FROM deg UNION SELECT s.dst, w.root FROM walk w JOIN sym s ON s.src=w.node),
  lab AS (SELECT node, min(root) AS root FROM walk GROUP BY 1), sz AS (SELECT root, count(*) AS size FROM lab GROUP BY 1 HAVING count(*)>=2),
  cc AS (SELECT node, root, size, 'subnetwork' || row_number_ AS component FROM lab JOIN (SELECT *, row_number() OVER (ORDER BY size DESC, root) AS row_number_ FROM sz) z USING (root, size))
""".replace("FROM lab JOIN (SELECT *, row_number() OVER (ORDER BY size DESC, root) AS row_number_ FROM sz) z USING (root, size)",
            "FROM lab JOIN (SELECT *, row_number() OVER (ORDER BY size DESC, root) AS row_number_ FROM sz) z USING (root)")
register("components", "J2", _CC + "SELECT root, node, size, component FROM cc")(lambda s, d: NE.components(_graph(s, d), 2))
register("component_stats", "J3", _CC + """, nl AS (SELECT component, split_part(node,':',1) AS l, count(*) AS c FROM cc GROUP BY 1,2)
SELECT n.component, n.n_nodes, n.layers, e.n_edges FROM (SELECT component, cast(sum(c) as bigint) AS n_nodes, string_agg(l || '=' || c, ';' ORDER BY l) AS layers FROM nl GROUP BY 1) n
 JOIN (SELECT component, count(*) AS n_edges FROM ge JOIN cc ON src=node GROUP BY 1) e USING (component)""")(
    lambda s, d: NE.component_stats(_graph(s, d), NE.components(_graph(s, d), 2)))
register("degree", "J4", _N + "SELECT node, degree FROM deg")(lambda s, d: NE.degree(_graph(s, d)))
register("degree_distribution", "J4", _N + "SELECT degree, count(*) AS n FROM deg GROUP BY 1")(lambda s, d: NE.degree_distribution(_graph(s, d)))
register("betweenness", "J5")(lambda s, d: NE.betweenness(_graph(s, d)))
register("filter_nodes", "J6", _N + """SELECT src, dst, weight FROM ge WHERE src NOT IN (SELECT node FROM deg WHERE degree<=1) AND dst NOT IN (SELECT node FROM deg WHERE degree<=1)""", "weight")(
    lambda s, d: NE.filter_nodes(_graph(s, d), 1))
register("topology", "J7")(lambda s, d: NE.topology(_graph(s, d)))
register("transitivity", "J7", _N + """, t AS (SELECT count(*) AS triangles FROM sym x JOIN sym y ON x.dst=y.src JOIN sym z ON z.src=y.dst AND z.dst=x.src WHERE x.src<x.dst AND x.dst<y.dst),
  w AS (SELECT sum(degree*(degree-1)/2) AS triples FROM deg) SELECT triangles, triples, 3*triangles/triples AS clustering FROM t, w""", "triples clustering")(
    lambda s, d: NE.transitivity(_graph(s, d)))
register("communities", "J8")(lambda s, d: NE.communities(_graph(s, d), min_size=3))
_lab = lambda s, d: X.log_ab(s, d).select(F.concat_ws(":", "layer", "feature").alias("node"), F.substring("feature", -1, 1).alias("label")).distinct()
register("community_test", "J9")(lambda s, d: NE.community_test(_graph(s, d), _lab(s, d)))
register("modularity", "J10", _N + """, l AS (SELECT src, dst, right(src,1) AS a, right(dst,1) AS b FROM ge), m AS (SELECT count(*) AS m FROM ge),
  i AS (SELECT a AS c, count(*) AS k FROM l WHERE a=b GROUP BY 1), g AS (SELECT right(node,1) AS c, sum(degree) AS d FROM deg GROUP BY 1)
SELECT sum(coalesce(k,0)/m - (d/(2*m))*(d/(2*m))) AS modularity FROM g LEFT JOIN i USING (c), m""".replace("g LEFT JOIN i USING (c), m", "g LEFT JOIN i USING (c) CROSS JOIN m"), "modularity")(
    lambda s, d: NE.modularity(_graph(s, d), _lab(s, d)))
_DENSE = lambda s, d: CO.network_edges(CO.filter_edges(_edges(s, d, 0.1), 0.14, 0.14))
_ND = _REC.replace("abs(r)>0.21", "abs(r)>0.14")
register("shortest_paths", "J11", _ND + """, p AS (SELECT 'quantity:1' AS head, ['quantity:1'] AS path, 1 AS n UNION ALL
  SELECT dst, list_append(path, dst), n+1 FROM p JOIN sym ON src=head WHERE n<6 AND NOT list_contains(path, dst) AND NOT list_contains(path, 'revenue:Brand#9'))
SELECT path FROM p WHERE head='revenue:Brand#9' AND n=(SELECT min(n) FROM p WHERE head='revenue:Brand#9') ORDER BY path LIMIT 50""")(
    lambda s, d: NE.shortest_paths(_DENSE(s, d), "quantity:1", "revenue:Brand#9"))
_SEEDS = ["quantity:1", "quantity:2", "revenue:Brand#9", "revenue:Brand#3"]
register("module", "J12")(lambda s, d: NE.module(_DENSE(s, d), _SEEDS))
register("min_network", "J13")(lambda s, d: NE.min_network(_DENSE(s, d), s.createDataFrame([(x,) for x in _SEEDS], "node string")))
register("exclude_nodes", "J14", _N + """SELECT src, dst, weight FROM ge WHERE NOT regexp_matches(src,'[13]$') AND NOT regexp_matches(dst,'[13]$')""", "weight")(
    lambda s, d: NE.exclude_nodes(_graph(s, d), NE.nodes_of(_graph(s, d)).where(F.col("node").rlike("[13]$"))))
register("node_table", "J15")(lambda s, d: NE.node_table(_graph(s, d)))
