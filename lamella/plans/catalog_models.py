"""Queries on sources, reduction, clustering, enrichment, biomarkers and models."""
from __future__ import annotations

from pyspark.sql import functions as F

from lamella.core import checkpointed, scratch_folder, stack_layers
from lamella.operators import biomarker as BI, clustering as CL, correlation as CO, differential as DI, enrichment as EN, models as MO, quality as QU, reduction as RE, wide as WI
from lamella.plans import fixtures as X
from lamella.plans.catalog_relations import _E, _edges, _graph, _N
from lamella.plans.fixtures import t_p, with_
from lamella.plans.registry import register
from lamella.sources import tables as TB

# ---- A: sources and sinks ------------------------------------------------------------------


def _folder(spark) -> str:
    return scratch_folder(spark)


def _wide(m, rows="feature", cols="sample"):
    if m.select(cols).distinct().limit(TB.MAX_COLUMNS + 1).count() > TB.MAX_COLUMNS:
        return TB.wide(checkpointed(m), rows, cols)
    return m.groupBy(F.col(rows).alias("#NAME")).pivot(cols).agg(F.first("value"))


def _round_trip(s, d, turned):
    p = _folder(s) + "/layer.csv"
    m = X.layer_e(s, d)
    w = _wide(m, "sample", "feature") if turned else _wide(m)
    TB.write_wide(w, p) if isinstance(w, TB.Wide) else w.write.csv(p, header=True)
    return TB.read_layer(s, p, "ptype", X.samples(s, d))


for _turned in (False, True):
    register("read_layer" + ("_samples_in_rows" if _turned else ""), "A2 A5" if _turned else "A1 A5", with_("e") + "SELECT layer, feature, sample, value FROM e", "value")(
        lambda s, d, t=_turned: _round_trip(s, d, t))


def _meta_trip(s, d):
    p = _folder(s) + "/meta.csv"
    X.samples(s, d).select(F.col("sample").alias("#NAME"), F.when(F.col("s_acctbal") < 0, "NA").otherwise(F.col("region")).alias("home region"),
                           "s_acctbal", F.lit(None).cast("string").alias("nothing")).write.csv(p, header=True)
    return TB.read_metadata(s, p)


register("read_metadata", "A3 A5", with_("samples") + """SELECT sample, CASE WHEN s_acctbal<0 THEN NULL ELSE region END AS home_region, s_acctbal FROM samples""", "s_acctbal")(
    lambda s, d: _meta_trip(s, d).withColumn("s_acctbal", F.col("s_acctbal").cast("double")))


def _embedded(s, d):
    w = _wide(X.layer_e(s, d).withColumn("value", F.col("value").cast("string")).unionByName(X.samples(s, d).select(
        F.lit("x").alias("layer"), F.lit("#CLASS_region").alias("feature"), "sample", F.col("region").alias("value"))))
    return TB.split_embedded_meta(w)[1]


register("split_embedded_meta", "A4", with_("samples") + "SELECT sample, 'region' AS var, region AS value FROM samples WHERE sample IN (SELECT cast(l_suppkey as string) FROM lineitem)")(_embedded)


def _id_map_trip(s, d):
    p = _folder(s) + "/map"
    X.table(s, d, "part").select(F.lit("part").alias("source"), F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("target")).write.parquet(p)
    return TB.load_id_map(s, p)


register("load_id_map", "A6", "SELECT 'part' AS source, cast(p_partkey as string) AS id, p_brand AS target FROM part WHERE p_size>5")(_id_map_trip)


def sets(s, d, col="p_brand"):
    return X.table(s, d, "part").select(F.col(col).alias("set_id"), F.concat(F.lit("set "), F.col(col)).alias("set_name"), F.col("p_partkey").cast("string").alias("member"))


def _sets_trip(s, d):
    p = _folder(s)
    sets(s, d).groupBy("set_id", "set_name").agg(F.collect_list("member").alias("members")).write.json(p + "/go_brand")
    return TB.load_sets_named(s, p, "brand", "json")


register("load_sets", "A7", "SELECT p_brand AS set_id, 'set ' || p_brand AS set_name, cast(p_partkey as string) AS member FROM part")(_sets_trip)


def _csv_trip(s, d):
    p = _folder(s) + "/out"
    TB.write_csv(X.layer_a(s, d), p)
    return s.read.csv(p, header=True, schema="layer string, feature string, sample string, value double")


register("write_csv", "A8", with_("a") + "SELECT layer, feature, sample, round(value/pow(10,floor(log10(value))-5))*pow(10,floor(log10(value))-5) AS value FROM a", "value")(_csv_trip)


def _table_trip(s, d):
    p = _folder(s) + "/out"
    TB.write_table(X.layer_e(s, d), p, key=["layer", "feature", "sample"])
    return s.read.parquet(p)


register("write_table", "A9", with_("e") + "SELECT layer, feature, sample, value, layer || ':' || feature || ':' || sample AS row_id FROM e", "value")(_table_trip)


def _json_trip(s, d):
    p = _folder(s) + "/out"
    TB.write_json(X.layer_e(s, d).select("feature", "sample", "value"), p, ["feature"])
    return s.read.json(p).select("feature", F.explode("rows").alias("r")).select("feature", "r.sample", "r.value")


register("write_json", "A10", with_("e") + "SELECT feature, sample, value FROM e", "value")(_json_trip)


def _sif_trip(s, d):
    p = _folder(s)
    g = checkpointed(_graph(s, d))
    TB.write_sif(g, g.select(F.col("src").alias("node")).distinct(), p)
    return s.read.text(p + "/edges.sif")


register("write_sif", "A11", _N + "SELECT src || chr(9) || 'pp' || chr(9) || dst AS value FROM ge")(_sif_trip)


def _pairs_trip(s, d):
    p = _folder(s) + "/pairs"
    TB.write_pairs(_edges(s, d, 0.2), p, "inter")
    return s.read.csv(p, header=True).select("layer1", "feature1", "layer2", "feature2")


register("write_pairs", "A12", _E + "SELECT layer1, feature1, layer2, feature2 FROM e0 WHERE layer1<>layer2 AND abs(r)>=0.2")(_pairs_trip)

# ---- K: reduction --------------------------------------------------------------------------

_pca = lambda s, d: RE.pca(X.log_ab(s, d), 5, True)
_abs = lambda df: df.withColumn("value", F.abs("value"))
register("pca_variance", "K1")(lambda s, d: _pca(s, d).var_exp)
register("pca_scores", "K1")(lambda s, d: _abs(_pca(s, d).scores))
register("pca_loadings", "K1")(lambda s, d: _abs(_pca(s, d).loadings))
register("combined_pca", "K2")(lambda s, d: RE.combined_pca(X.log_ab(s, d)).var_exp)
register("mcia", "K3")(lambda s, d: RE.mcia(X.abe(s, d), 3).var_exp)
register("factor_model", "K4")(lambda s, d: RE.factor_model(X.log_ab(s, d)).var_exp)
register("block_pls", "K5")(lambda s, d: RE.block_pls(X.log_ab(s, d), X.samples(s, d), "acct_high", 2).loadings)
register("block_pls_cv", "K6")(lambda s, d: RE.block_pls_cv(X.log_ab(s, d), X.samples(s, d), "acct_high", 3))
register("consensus_pca", "K7")(lambda s, d: _abs(RE.consensus_pca(X.log_ab(s, d), 3).scores))


def _two_scores(s, d):
    r = checkpointed(_pca(s, d).scores.where("factor <= 3"))
    return RE.procrustes(r.where("layer = 'revenue'"), r.where("layer = 'quantity'"))[0]


register("procrustes", "K8")(lambda s, d: _abs(_two_scores(s, d)))
register("sparse_cca", "K9")(lambda s, d: RE.sparse_cca(X.log_ab(s, d), "revenue", "quantity", 1, 0.4, 0.4).loadings)


def _by_customer(s, d, layer, feature, agg):
    """A layer with a sample for each customer, which grows with the orders."""
    c = X.table(s, d, "lineitem").join(X.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(X.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return c.groupBy(F.lit(layer).alias("layer"), F.col(feature).cast("string").alias("feature"), F.col("o_custkey").cast("string").alias("sample")).agg(agg.cast("double").alias("value"))


_brands = lambda s, d: _by_customer(s, d, "brands", "p_brand", F.sum("l_quantity"))
_sizes = lambda s, d: _by_customer(s, d, "sizes", "p_size", F.count("*"))
register("pca_wide", "K1")(lambda s, d: WI.wide_pca(_brands(s, d), 5, True, extra=35).var_exp)
register("combined_pca_wide", "K2")(lambda s, d: WI.wide_pca(stack_layers([_brands(s, d), _sizes(s, d)]), 5, True, stacked=True, extra=35).var_exp)


def _rebuilt(m):
    """The centred cells as sums of scores times loadings over all factors."""
    r = WI.wide_pca(m, 25, extra=5)
    in_order = lambda d, keys, name: d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("factor", "value"))).alias(name))
    c = m.join(in_order(r.loadings, ["layer", "feature"], "w"), ["layer", "feature"]).join(in_order(r.scores, ["layer", "sample"], "z"), ["layer", "sample"])
    terms = F.zip_with("w", "z", lambda w, z: w["value"] * z["value"])
    return c.select("layer", "feature", "sample", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("value"))


register("pca_wide_rebuilt", "K1", """WITH b AS (SELECT 'brands' AS layer, p_brand AS feature, cast(o_custkey as string) AS sample, cast(sum(l_quantity) as double) AS value
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey GROUP BY 2,3)
SELECT layer, feature, sample, value-avg(value) OVER (PARTITION BY feature) AS value FROM b""", "value")(lambda s, d: _rebuilt(_brands(s, d)))
register("cca_penalty", "K10")(lambda s, d: RE.cca_penalty(X.log_ab(s, d), "revenue", "quantity", [0.3, 0.5]))
register("multi_cca", "K11")(lambda s, d: RE.multi_cca(X.log_ab(s, d), 1, p1=0.4, p2=0.4).scores)
for _how in ("concat", "joint"):
    register(f"nmf_{_how}", "K12" if _how == "concat" else "K13")(lambda s, d, h=_how: RE.nmf(X.log_ab(s, d), 4, h).loadings)
    register(f"semi_nmf_{_how}", "K14" if _how == "concat" else "K15")(lambda s, d, h=_how: RE.semi_nmf(X.log_ab(s, d), 4, h).loadings)


def _loads(s, d):
    """A loading table derived from the data: centred brand and size totals by supplier digit."""
    g = stack_layers([X.layer_a(s, d), X.layer_b(s, d)]).withColumn("factor", (F.col("sample").cast("int") % 4 + 1))
    g = g.groupBy("layer", "feature", "factor").agg(F.sum("value").alias("v"))
    mu = g.groupBy("layer", "factor").agg(F.avg("v").alias("m"))
    return g.join(mu, ["layer", "factor"]).select("layer", "feature", "factor", (F.col("v") / F.col("m") - 1).alias("value"))


_LD = with_("a", "b") + """, g AS (SELECT layer, feature, cast(sample as int)%4+1 AS factor, sum(value) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) t GROUP BY 1,2,3),
  ld AS (SELECT layer, feature, factor, v/avg(v) OVER (PARTITION BY layer, factor)-1 AS value FROM g)
"""
register("top_features", "K16", _LD + """SELECT *, row_number() OVER (PARTITION BY layer, factor ORDER BY abs(value) DESC, md5(feature), feature) AS rank FROM ld
  QUALIFY row_number() OVER (PARTITION BY layer, factor ORDER BY abs(value) DESC, md5(feature), feature)<=8""", "value")(lambda s, d: RE.top_features(_loads(s, d), 8))
register("contributions", "K17", _LD + """SELECT layer, factor, 100*s/sum(s) OVER (PARTITION BY factor) AS share FROM (SELECT layer, factor, sum(abs(value)) AS s FROM ld GROUP BY 1,2) t""", "share")(
    lambda s, d: RE.contributions(_abs(_loads(s, d))))
register("variance_report", "K18", _LD + """SELECT layer, factor, value, sum(value) OVER (PARTITION BY layer ORDER BY factor) AS cumulative FROM (
  SELECT layer, factor, sum(value*value) AS value FROM ld GROUP BY 1,2) t""", "value cumulative")(
    lambda s, d: RE.variance_report(_loads(s, d).groupBy("layer", "factor").agg(F.sum(F.col("value") ** 2).alias("value"))))
register("loading_table", "K19", _LD + """SELECT layer, feature, value, feature AS label FROM ld WHERE factor<=3
  QUALIFY row_number() OVER (PARTITION BY layer, feature ORDER BY abs(value) DESC, factor)=1""", "value")(lambda s, d: RE.loading_table(_loads(s, d)))
register("rv_coefficient", "K20", with_("ab") + """, c AS (SELECT layer, feature, sample, value-avg(value) OVER (PARTITION BY layer, feature) AS v FROM ab),
  g AS (SELECT x.layer, x.sample AS i, y.sample AS j, sum(x.v*y.v) AS g FROM c x JOIN c y USING (layer, feature) GROUP BY 1,2,3)
SELECT x.layer AS layer1, y.layer AS layer2, sum(x.g*y.g)/sqrt(sum(x.g*x.g)*sum(y.g*y.g)) AS rv FROM g x JOIN g y USING (i, j) WHERE x.layer<y.layer GROUP BY 1,2""", "rv")(
    lambda s, d: RE.rv(X.log_ab(s, d)))
register("factor_select", "K21", _LD + "SELECT layer, feature, factor, abs(value/max(abs(value)) OVER (PARTITION BY layer, factor)) AS value FROM ld WHERE factor IN (1,2) AND layer='revenue'", "value")(
    lambda s, d: RE.select_factors(_loads(s, d), [1, 2], ["revenue"], True, True))


def _scores(s, d):
    """Scores of all samples on the factors of the loading table, from every feature."""
    return RE.project(X.log_a(s, d), _loads(s, d))


_LDS = _LD.replace(with_("a", "b"), with_("a", "b", "la", "samples")) + """, yc AS (SELECT layer, feature, sample, value-avg(value) OVER (PARTITION BY layer, feature) AS y FROM la),
  sc AS (SELECT sample, factor, sum(y*value)/sum(value*value) AS value FROM yc JOIN ld USING (layer, feature) GROUP BY 1,2)"""
register("factor_scores", "K21", _LDS + "SELECT * FROM sc", "value")(_scores)
register("correlated_factors", "K21", _LDS + """SELECT x.factor AS factor1, y.factor AS factor2, corr(x.value, y.value) AS r FROM sc x JOIN sc y USING (sample)
  WHERE x.factor<y.factor GROUP BY 1,2 HAVING abs(corr(x.value, y.value))>0.1""", "r")(lambda s, d: RE.correlated_factors(_scores(s, d), 0.1))
register("factor_r2", "K21", _LDS + """, t AS (SELECT layer, sum(y*y) AS tot FROM yc GROUP BY 1)
SELECT c.layer, ld.factor, 1-sum((y-sc.value*ld.value)*(y-sc.value*ld.value))/any_value(tot) AS r2 FROM yc c JOIN sc USING (sample)
  JOIN ld ON ld.layer=c.layer AND ld.feature=c.feature AND ld.factor=sc.factor JOIN t ON t.layer=c.layer GROUP BY 1,2""", "r2")(
    lambda s, d: RE.r2(X.log_a(s, d), _scores(s, d), _loads(s, d)))
register("ellipsoid", "K22", _LDS + """, p AS (SELECT sample, max(value) FILTER (factor=1) AS x1, max(value) FILTER (factor=2) AS x2, max(value) FILTER (factor=3) AS x3 FROM sc GROUP BY 1)
SELECT region AS "group", count(*) AS n, avg(x1) AS c1, avg(x2) AS c2, avg(x3) AS c3, covar_samp(x1,x1) AS s11, covar_samp(x1,x2) AS s12, covar_samp(x1,x3) AS s13,
  covar_samp(x2,x2) AS s22, covar_samp(x2,x3) AS s23, covar_samp(x3,x3) AS s33, sqrt(7.814727903251179) AS radius FROM p JOIN samples USING (sample) GROUP BY 1 HAVING count(*)>=4""",
         "c1 c2 c3 s11 s12 s13 s22 s23 s33 radius")(lambda s, d: RE.ellipsoid(_scores(s, d), X.samples(s, d).select("sample", F.col("region").alias("group"))))

# ---- L: clustering -------------------------------------------------------------------------

register("kmeans", "L1")(lambda s, d: CL.kmeans(X.layer_d(s, d), 10)[0])
register("kmeans_plus", "L3")(lambda s, d: CL.kmeans(X.layer_d(s, d), 10, 10, "++")[0])
register("auto_k", "L2")(lambda s, d: CL.auto_k(X.layer_a(s, d), 5)[0])
_DIST = with_("e") + """, z AS (SELECT feature, sample, (value-avg(value) OVER (PARTITION BY feature)){scale} AS v FROM e),
  dist AS (SELECT x.sample AS sample1, y.sample AS sample2, sqrt(sum((x.v-y.v)*(x.v-y.v))) AS dist FROM z x JOIN z y USING (feature) WHERE x.sample<>y.sample GROUP BY 1,2)
"""
register("affinity", "L4", _DIST.format(scale="/stddev_samp(value) OVER (PARTITION BY feature)") + """, nn AS (SELECT sample1, avg(dist) AS mu FROM (
  SELECT *, row_number() OVER (PARTITION BY sample1 ORDER BY dist, sample2) AS r FROM dist) t WHERE r<=20 GROUP BY 1),
  k AS (SELECT d.sample1, d.sample2, dist, 0.5*(p.mu+q.mu+dist)/3 AS s FROM dist d JOIN nn p ON p.sample1=d.sample1 JOIN nn q ON q.sample1=d.sample2)
SELECT 'ptype' AS layer, sample1, sample2, exp(-dist*dist/(2*s*s))/(s*sqrt(2*pi())) AS weight FROM k""", "weight")(lambda s, d: CL.affinity(X.layer_e(s, d)))
register("similarity_fusion", "L5")(lambda s, d: CL.snf(X.log_ab(s, d)))
register("fused_clusters", "L6 L7")(lambda s, d: CL.snf_clusters(X.log_ab(s, d))[0])
register("spectral_multiview", "L8")(lambda s, d: CL.spectral_multiview(X.log_ab(s, d))[0])
register("perturbation_clusters", "L9")(lambda s, d: CL.perturbation(X.log_a(s, d))[0])
_lab = lambda s, d: X.samples(s, d).select("sample", F.col("region").alias("cluster"))
register("silhouette", "L10", _DIST.format(scale="").replace(with_("e"), with_("e", "samples")) + """, g AS (SELECT sample1, p.region AS c1, q.region AS c2, avg(dist) AS a FROM dist
  JOIN samples p ON p.sample=sample1 JOIN samples q ON q.sample=sample2 GROUP BY 1,2,3),
  t AS (SELECT sample1, c1, max(a) FILTER (c1=c2) AS a, min(a) FILTER (c1<>c2) AS b FROM g GROUP BY 1,2)
SELECT 'ptype' AS layer, sample1 AS sample, c1 AS cluster, CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b-a)/greatest(a,b) END AS silhouette FROM t""", "silhouette")(
    lambda s, d: CL.silhouette(X.layer_e(s, d), _lab(s, d)))
register("nmi", "L11", with_("samples") + """, c AS (SELECT region, acct_high, count(*) AS n FROM samples GROUP BY 1,2), t AS (SELECT count(*) AS t FROM samples),
  a AS (SELECT region, sum(n) AS na FROM c GROUP BY 1), b AS (SELECT acct_high, sum(n) AS nb FROM c GROUP BY 1)
SELECT (SELECT sum(n/t*log2(n*t/(na*nb))) FROM c JOIN a USING (region) JOIN b USING (acct_high), t)
  /sqrt((SELECT sum(-na/t*log2(na/t)) FROM a, t)*(SELECT sum(-nb/t*log2(nb/t)) FROM b, t)) AS nmi""", "nmi")(lambda s, d: CL.nmi(X.samples(s, d), "region", "acct_high"))
register("cluster_members", "L12", with_("samples") + "SELECT region AS cluster, count(*) AS n, list(sample ORDER BY sample) AS samples FROM samples GROUP BY 1")(
    lambda s, d: CL.cluster_members(CL.cluster_table(_lab(s, d), X.samples(s, d).drop("region"))))
register("density", "L13", _LDS + """, dd AS (SELECT x.sample AS i, y.sample AS j, sqrt(sum((x.value-y.value)*(x.value-y.value))) AS d FROM sc x JOIN sc y USING (factor) GROUP BY 1,2),
  r AS (SELECT i, count(*) FILTER (d<0.5)-1 AS rho FROM dd GROUP BY 1)
SELECT r.i AS sample, r.rho, coalesce((SELECT min(d) FROM dd JOIN r q ON q.i=dd.j WHERE dd.i=r.i AND (q.rho>r.rho OR (q.rho=r.rho AND q.i<r.i))), (SELECT max(d) FROM dd WHERE dd.i=r.i)) AS delta FROM r""", "delta")(
    lambda s, d: CL.density(_scores(s, d), 0.5).drop("denser"))
register("density_peaks", "L13")(lambda s, d: CL.density_peaks(_scores(s, d), 3, 0.5))
register("mean_shift", "L14")(lambda s, d: CL.mean_shift(_scores(s, d), 0.3))
register("cluster_by_group", "L15")(lambda s, d: CL.cluster_by(_scores(s, d), X.samples(s, d), "acct_high"))
register("cluster_chosen", "L15")(lambda s, d: CL.cluster_chosen(_scores(s, d), X.samples(s, d).where("s_acctbal < 0")))
register("heatmap", "L16", with_("la") + """, v AS (SELECT layer, feature, row_number() OVER (PARTITION BY layer ORDER BY var_samp(value) DESC, md5(feature), feature) AS rank FROM la GROUP BY 1,2),
  z AS (SELECT layer, feature, sample, rank, (value-avg(value) OVER p)/stddev_samp(value) OVER p AS z FROM la JOIN v USING (layer, feature) WHERE rank<=10 WINDOW p AS (PARTITION BY layer, feature))
SELECT *, least(30, cast(floor((z-min(z) OVER ())/(max(z) OVER ()-min(z) OVER ())*30) as bigint)+1) AS bin FROM z""", "z")(lambda s, d: CL.heatmap(X.log_a(s, d), top=10))
register("bisecting_order", "L17")(lambda s, d: CL.bisecting(X.layer_a(s, d), 4))

# ---- M: enrichment -------------------------------------------------------------------------


def _query(s, d):
    """Parts whose revenue is in the top tenth."""
    r = X.table(s, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("rev"))
    return r.where("rev > 1400000").select(F.col("l_partkey").cast("string").alias("id"))


_QS = """WITH q AS (SELECT cast(l_partkey as string) AS id FROM lineitem GROUP BY l_partkey HAVING round(sum(l_extendedprice*(1-l_discount)),4)>1400000),
  st AS (SELECT p_brand AS set_id, 'set ' || p_brand AS set_name, cast(p_partkey as string) AS member FROM part),
  u AS (SELECT count(DISTINCT member) AS universe, count(DISTINCT member) FILTER (member IN (SELECT id FROM q)) AS drawn FROM st),
  h AS (SELECT set_id, set_name, count(*) AS total, count(*) FILTER (member IN (SELECT id FROM q)) AS hits FROM st GROUP BY 1,2),
  lf AS (SELECT range AS x, lgamma(range+1) AS f FROM range(0, 300000)),
  o AS (SELECT set_id, set_name, total, hits, universe, drawn, total*drawn/universe AS expected FROM h, u)
"""
register("ora", "M1", _QS + "SELECT * FROM o WHERE hits>0", "expected")(lambda s, d: EN.ora(_query(s, d), sets(s, d)).drop("pval", "padj"))
register("ora_pvalue", "M1", _QS + """, k AS (SELECT set_id, total, hits, universe, drawn, unnest(range(cast(hits as bigint), cast(least(total,drawn) as bigint)+1)) AS x FROM o WHERE hits>0)
SELECT set_id, sum(exp(lgamma(total+1)-lgamma(x+1)-lgamma(total-x+1)+lgamma(universe-total+1)-lgamma(drawn-x+1)-lgamma(universe-total-drawn+x+1)
  -lgamma(universe+1)+lgamma(drawn+1)+lgamma(universe-drawn+1))) AS pval FROM k WHERE universe-total-drawn+x>=0 GROUP BY 1""".replace("SELECT set_id, sum(", "SELECT set_id, round(sum(").replace(")) AS pval", ")),6) AS pval"), "pval")(
    lambda s, d: EN.ora(_query(s, d), sets(s, d)).select("set_id", F.round("pval", 6).alias("pval")))
register("ora_min_size", "M2", _QS.replace("AS member FROM part)", "AS member FROM part WHERE p_brand<>'Brand#7')") + "SELECT * FROM o WHERE hits>0 AND total>2", "expected")(
    lambda s, d: EN.ora(_query(s, d), sets(s, d), 3, ["Brand#7"]).drop("pval", "padj"))
register("ora_joint", "M3")(lambda s, d: EN.ora_joint(EN.ora(_query(s, d), sets(s, d)), EN.ora(X.table(s, d, "part").where("p_size > 45").select(
    F.col("p_partkey").cast("string").alias("id")), sets(s, d))))


def _ranked(s, d):
    r = X.table(s, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("id")).agg((F.round(F.sum(F.col("l_quantity") - 25.5), 4)).alias("stat"))
    return EN.ranking(r, "id", "stat")


register("enrichment_score", "M4", """WITH r AS (SELECT cast(l_partkey as string) AS id, round(sum(l_quantity-25.5),4) AS stat FROM lineitem GROUP BY l_partkey),
  p AS (SELECT id, stat, row_number() OVER (ORDER BY stat DESC, md5(id), id) AS pos, count(*) OVER () AS n FROM r),
  h AS (SELECT p_brand AS set_id, pos, abs(stat) AS w, n, row_number() OVER s AS i, count(*) OVER (PARTITION BY p_brand) AS size, sum(abs(stat)) OVER (PARTITION BY p_brand) AS nr,
    sum(abs(stat)) OVER s AS cum FROM p JOIN part ON cast(p_partkey as string)=id WINDOW s AS (PARTITION BY p_brand ORDER BY pos)),
  g AS (SELECT set_id, any_value(size) AS size, max(cum/nr-(pos-i)/(n-size)) AS u, min((cum-w)/nr-(pos-i)/(n-size)) AS d FROM h GROUP BY 1)
SELECT set_id, size, CASE WHEN u>=-d THEN u ELSE d END AS es FROM g""", "es")(lambda s, d: EN.enrichment_scores(_ranked(s, d), sets(s, d), 15, 5000))
register("gsea", "M4")(lambda s, d: EN.select_gsea(EN.gsea(_ranked(s, d), sets(s, d), max_size=100000)))
register("normalize_ids", "M5", """SELECT 'cpd:C' || lpad(cast(p_partkey as string),5,'0') AS id, 'C' || lpad(cast(p_partkey as string),5,'0') AS mapped FROM part
  UNION ALL SELECT 'x' || p_partkey, CASE WHEN p_size>10 THEN p_brand ELSE 'x' || p_partkey END FROM part""")(
    lambda s, d: EN.normalize_ids(X.table(s, d, "part").select(F.explode(F.array(F.concat(F.lit("cpd:C"), F.lpad(F.col("p_partkey").cast("string"), 5, "0")),
                                                                               F.concat(F.lit("x"), F.col("p_partkey").cast("string")))).alias("id")),
                                  [X.table(s, d, "part").where("p_size > 10").select(F.concat(F.lit("X"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("target"))]))


def _names_sets(s, d):
    p = X.table(s, d, "part")
    return p.select(F.col("p_brand").alias("set_id"), F.col("p_brand").alias("set_name"), F.col("p_name").alias("member")).distinct()


for _how, _w in (("mixed", "(sh/a.n+sh/b.n)/2"), ("overlap", "sh/least(a.n,b.n)"), ("jaccard", "sh/(a.n+b.n-sh)")):
    register(f"set_network_{_how}", "M6", f"""WITH m AS (SELECT DISTINCT p_brand AS set_id, p_name AS member FROM part), n AS (SELECT set_id, count(*) AS n FROM m GROUP BY 1),
  s AS (SELECT x.set_id AS set1, y.set_id AS set2, count(*) AS sh FROM m x JOIN m y ON x.member=y.member AND x.set_id<y.set_id GROUP BY 1,2)
SELECT set1, set2, sh AS shared, {_w} AS weight FROM s JOIN n a ON a.set_id=set1 JOIN n b ON b.set_id=set2 WHERE {_w}>=0.3""", "weight")(
        lambda s, d, h=_how: EN.set_network(_names_sets(s, d), _names_sets(s, d), h))
register("bipartite", "M6", _QS + "SELECT DISTINCT st.set_id, st.member FROM st JOIN q ON q.id=st.member JOIN o ON o.set_id=st.set_id WHERE o.hits>0")(
    lambda s, d: EN.bipartite(sets(s, d), EN.ora(_query(s, d), sets(s, d)), _query(s, d)))
register("query_list_significant", "M7", """SELECT DISTINCT p_type AS layer, p_brand AS id FROM part WHERE p_type IN (SELECT min(p_type) FROM part UNION ALL SELECT max(p_type) FROM part) AND p_size>40""")(
    lambda s, d: EN.query_list(sig=X.table(s, d, "part").where("p_size > 40").select(F.col("p_type").alias("layer"), F.col("p_brand").alias("feature")),
                               layers=list(X.table(s, d, "part").agg(F.min("p_type"), F.max("p_type")).first())))
register("query_list_loading", "M7", _LD + """SELECT layer, feature AS id FROM ld WHERE factor=2 QUALIFY row_number() OVER (PARTITION BY layer ORDER BY abs(value) DESC, md5(feature), feature)
  <= ceil(count(*) OVER (PARTITION BY layer)*30/100)""")(lambda s, d: EN.query_list(load=_loads(s, d), factor=2, percent=30.0))
register("hit_table", "M8", """SELECT p_type AS set_id, 'parts' AS layer, count(*) AS hits, count(*) FILTER (c>0) AS up, count(*) FILTER (c<0) AS down FROM (
  SELECT l_partkey, sum(l_quantity-25) AS c FROM lineitem GROUP BY 1) t JOIN part ON p_partkey=l_partkey GROUP BY 1""")(
    lambda s, d: EN.hit_table(X.table(s, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("feature")).agg(F.sum(F.col("l_quantity") - 25).alias("coef"))
                              .withColumn("layer", F.lit("parts")), sets(s, d, "p_type")))

# ---- N: biomarkers -------------------------------------------------------------------------

_y = lambda s, d: X.samples(s, d).select("sample", F.col("acct_high").alias("label"))
register("prepare_groups", "N1", with_("samples") + """SELECT CASE WHEN region='ASIA' THEN 'ASIA' ELSE 'others' END AS label, count(*) AS n,
  CASE WHEN count(*)<10 THEN 'error' WHEN count(*)<20 THEN 'warning' ELSE 'ok' END AS status FROM samples GROUP BY 1""")(
    lambda s, d: BI.prepare_groups(X.layer_a(s, d), X.samples(s, d), "region", "ASIA")[2])
_AUC = with_("a", "samples") + """, r AS (SELECT layer, feature, acct_high, rank() OVER (PARTITION BY feature ORDER BY value)+(count(*) OVER (PARTITION BY feature, value)-1)/2.0 AS r FROM a JOIN samples USING (sample)),
  u AS (SELECT layer, feature, (sum(r) FILTER (acct_high='low')-count(*) FILTER (acct_high='low')*(count(*) FILTER (acct_high='low')+1)/2)/(count(*) FILTER (acct_high='low')*count(*) FILTER (acct_high='high')) AS u FROM r GROUP BY 1,2)
"""
register("auc", "N2", _AUC + "SELECT layer, feature, greatest(u,1-u) AS auc FROM u", "auc")(lambda s, d: BI.auc(X.layer_a(s, d), _y(s, d)))
register("auc_multi", "N3", with_("a", "samples") + """, x AS (SELECT feature, region, value FROM a JOIN samples USING (sample)),
  p AS (SELECT x.feature, x.region AS c0, y.region AS c1, avg(CASE WHEN y.value>x.value THEN 1.0 WHEN y.value=x.value THEN 0.5 ELSE 0 END) AS u FROM x JOIN x y ON x.feature=y.feature AND x.region<y.region GROUP BY 1,2,3)
SELECT 'revenue' AS layer, feature, avg(greatest(u,1-u)) AS auc FROM p GROUP BY 2""", "auc")(
    lambda s, d: BI.auc_multi(X.layer_a(s, d), X.samples(s, d).select("sample", F.col("region").alias("label"))))
register("fold_change", "N4", with_("a", "samples") + """SELECT layer, feature, log2(avg(value) FILTER (acct_high='low')/avg(value) FILTER (acct_high='high')) AS fc
  FROM a JOIN samples USING (sample) GROUP BY 1,2""", "fc")(lambda s, d: BI.fold_change(X.layer_a(s, d), _y(s, d)))
register("rank_table_statistics", "N5", with_("a", "samples") + f""", j AS (SELECT layer, feature, value, acct_high AS label FROM a JOIN samples USING (sample)),
 k AS (SELECT *, rank() OVER (PARTITION BY layer, feature ORDER BY value) + (count(*) OVER (PARTITION BY layer, feature, value) - 1) / 2.0 AS rk FROM j),
 g AS (SELECT layer, feature, sum(rk) FILTER (label='low') AS s, cast(count(*) FILTER (label='high') as double) AS n0, cast(count(*) FILTER (label='low') as double) AS n1, avg(value) FILTER (label='high') AS m0,
   avg(value) FILTER (label='low') AS m1, var_samp(value) FILTER (label='high') AS v0, var_samp(value) FILTER (label='low') AS v1 FROM k GROUP BY 1,2),
 t AS (SELECT *, n0+n1-2 AS df, (m0-m1)/sqrt(((n0-1)*v0+(n1-1)*v1)/(n0+n1-2)*(1/n0+1/n1)) AS stat FROM g)
SELECT layer, feature, greatest((s-n1*(n1+1)/2)/(n1*n0), 1-(s-n1*(n1+1)/2)/(n1*n0)) AS auc, stat, {t_p('stat', 'df')} AS pval, log2(m1/m0) AS fc FROM t""", "auc stat pval fc")(
    lambda s, d: BI.rank_table(X.layer_a(s, d), _y(s, d)).select("layer", "feature", "auc", "stat", "pval", "fc"))
register("rank_table", "N5")(lambda s, d: BI.rank_table(X.layer_a(s, d), _y(s, d)))
_ROC = with_("e", "samples") + """, v AS (SELECT feature, value, count(*) FILTER (acct_high='low') AS a, count(*) FILTER (acct_high='high') AS b FROM e JOIN samples USING (sample) GROUP BY 1,2),
  md AS (SELECT feature, quantile_cont(value,0.5) FILTER (acct_high='low') AS m1, quantile_cont(value,0.5) FILTER (acct_high='high') AS m0, count(*) FILTER (acct_high='low') AS n1, count(*) FILTER (acct_high='high') AS n0
    FROM e JOIN samples USING (sample) GROUP BY 1),
  c AS (SELECT feature, CASE WHEN lead(value) OVER w IS NULL THEN 'inf'::double ELSE (value+lead(value) OVER w)/2 END AS threshold, sum(a) OVER w AS b1, sum(b) OVER w AS b0 FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)),
  t AS (SELECT * FROM c UNION ALL SELECT feature, '-inf'::double, 0, 0 FROM md),
  rc AS (SELECT 'ptype' AS layer, feature, 'low' AS class, threshold, CASE WHEN m0<=m1 THEN 1-b1/n1 ELSE b1/n1 END AS sens, CASE WHEN m0<=m1 THEN b0/n0 ELSE 1-b0/n0 END AS spec FROM t JOIN md USING (feature))
"""
_curve = lambda s, d: BI.roc(X.layer_e(s, d), _y(s, d))
register("roc", "N6", _ROC + """SELECT layer, feature, class, CASE WHEN threshold='inf'::double THEN 999999.0 WHEN threshold='-inf'::double THEN -999999.0 ELSE threshold END AS threshold,
  sens, spec, sens+spec AS total, sens/nullif(1-spec,0) AS lr_pos, (1-sens)/nullif(spec,0) AS lr_neg FROM rc""", "threshold sens spec total lr_pos lr_neg")(
    lambda s, d: QU.clean_inf(_curve(s, d), "threshold"))
register("roc_best", "N7", _ROC + """SELECT layer, feature, class, threshold, sens, spec FROM rc QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(sens+spec,12) DESC, threshold)=1""",
         "threshold sens spec")(lambda s, d: BI.best_threshold(_curve(s, d)))
register("roc_topleft", "N7", _ROC + """SELECT layer, feature, class, threshold, sens, spec FROM rc QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round((1-sens)*(1-sens)+(1-spec)*(1-spec),12), threshold)=1""",
         "threshold sens spec")(lambda s, d: BI.best_threshold(_curve(s, d), "topleft"))
register("roc_at_threshold", "N7", _ROC + """SELECT layer, feature, class, threshold, sens, spec FROM rc WHERE threshold<=100 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY threshold DESC)=1""",
         "threshold sens spec")(lambda s, d: BI.roc_at(_curve(s, d), "threshold", 100.0))
register("partial_auc", "N7", _ROC + """, w AS (SELECT feature, 1-spec AS x, sens AS y, lag(1-spec) OVER q AS x0, lag(sens) OVER q AS y0 FROM rc WINDOW q AS (PARTITION BY feature ORDER BY 1-spec, sens))
SELECT 'ptype' AS layer, feature, 'low' AS class, sum(CASE WHEN least(x,1.0)>greatest(x0,0.0) THEN (x-x0)*(y+y0)/2 ELSE 0 END) AS area FROM w WHERE x0 IS NOT NULL GROUP BY 2""", "area")(
    lambda s, d: BI.partial_auc(_curve(s, d)))
register("roc_bootstrap", "N8")(lambda s, d: BI.roc_boot(X.layer_a(s, d), _y(s, d)))
_WEIGHT = " + ".join(f"cast(u > {c!r} AS int)" for c in BI.POISSON.tolist())
register("roc_intervals", "N8", with_("e", "samples") + f""", r AS (SELECT feature, value, acct_high = 'low' AS hit, rep, ({_WEIGHT}) AS w
    FROM (SELECT *, cast('0x' || left(md5(sample || '|' || rep || '|1'), 8) AS bigint) / 4294967296.0 AS u FROM e JOIN samples USING (sample), range(1, 201) AS t(rep)) z),
  md AS (SELECT feature, quantile_cont(value, 0.5) FILTER (acct_high = 'low') >= quantile_cont(value, 0.5) FILTER (acct_high = 'high') AS up FROM e JOIN samples USING (sample) GROUP BY 1),
  v AS (SELECT feature, rep, value, sum(CASE WHEN hit THEN w ELSE 0 END) AS a, sum(CASE WHEN hit THEN 0 ELSE w END) AS b FROM r GROUP BY ALL),
  n AS (SELECT feature, rep, sum(a) AS n1, sum(b) AS n0 FROM v GROUP BY ALL HAVING sum(a) > 0 AND sum(b) > 0),
  k AS (SELECT feature, rep, value, sum(a) OVER o AS b1, sum(b) OVER o AS b0 FROM v WINDOW o AS (PARTITION BY feature, rep ORDER BY value) UNION ALL SELECT feature, rep, '-inf'::double, 0, 0 FROM n),
  c AS (SELECT feature, rep, value, CASE WHEN up THEN 1-b1/n1 ELSE b1/n1 END AS sens, CASE WHEN up THEN b0/n0 ELSE 1-b0/n0 END AS spec FROM k JOIN n USING (feature, rep) JOIN md USING (feature)),
  x AS (SELECT feature, rep, 'sens_at_spec' AS kind, s AS "at", max(sens) AS y FROM c, (VALUES (0.5::double), (0.9::double)) q(s) WHERE spec >= s - 1e-12 GROUP BY ALL
    UNION ALL SELECT feature, rep, 'sens_at_threshold', 100::double, arg_max(sens, value) FROM c WHERE value <= 100 GROUP BY ALL
    UNION ALL SELECT feature, rep, 'spec_at_threshold', 100::double, arg_max(spec, value) FROM c WHERE value <= 100 GROUP BY ALL)
SELECT 'ptype' AS layer, feature, kind, "at", quantile_cont(y, 0.025) AS low, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.975) AS high FROM x GROUP BY ALL""",
         "low median high")(lambda s, d: BI.roc_intervals(X.layer_e(s, d), _y(s, d), [0.5, 0.9], [100.0]).withColumn("at", F.round("at", 6)))
_SPLITS = """, y AS (SELECT sample, acct_high AS label FROM samples), n AS (SELECT round(min(c) * 2 / 3.0) AS n_train FROM (SELECT count(*) AS c FROM y GROUP BY label) t),
 r AS (SELECT cast(run AS bigint) AS run, sample, label, row_number() OVER (PARTITION BY run, label ORDER BY md5(sample || '|' || run || '|1'), sample) AS rn FROM y, range(1, {runs} + 1) AS t(run)),
 splits AS (SELECT run, sample, label, CASE WHEN rn <= n_train THEN 'train' ELSE 'test' END AS role FROM r, n)
"""
register("mc_splits", "N9", with_("samples") + _SPLITS.format(runs=10) + "SELECT * FROM splits")(lambda s, d: BI.mc_splits(_y(s, d)))
_TR = with_("a", "samples") + _SPLITS.format(runs=10) + """, tr AS (SELECT run, layer, feature, value, label FROM a JOIN splits USING (sample) WHERE role = 'train')
"""
_RANK = {
    "auroc": _TR + """, k AS (SELECT *, rank() OVER (PARTITION BY run, layer, feature ORDER BY value) + (count(*) OVER (PARTITION BY run, layer, feature, value) - 1) / 2.0 AS rk FROM tr),
 u AS (SELECT run, layer, feature, sum(rk) FILTER (label = 'low') AS s, count(*) FILTER (label = 'low') AS n1, count(*) FILTER (label <> 'low') AS n0 FROM k GROUP BY ALL)
SELECT run, layer, feature, greatest((s - n1 * (n1 + 1) / 2.0) / (n1 * n0), 1 - (s - n1 * (n1 + 1) / 2.0) / (n1 * n0)) AS score FROM u""",
    "fisher": _TR + """, q AS (SELECT *, median(value) OVER (PARTITION BY run, layer, feature) AS md FROM tr),
 t AS (SELECT run, layer, feature, count(*) FILTER (value > md AND label = 'low') AS x, count(*) FILTER (value > md) AS k, count(*) FILTER (label = 'low') AS d, count(*) AS n FROM q GROUP BY ALL),
 g AS (SELECT *, unnest(range(greatest(0, k + d - n), least(k, d) + 1)) AS z FROM t),
 l AS (SELECT *, lgamma(k + 1) - lgamma(z + 1) - lgamma(k - z + 1) + lgamma(n - k + 1) - lgamma(d - z + 1) - lgamma(n - k - d + z + 1) AS lp FROM g),
 e AS (SELECT *, exp(lp - max(lp) OVER p) AS pr FROM l WINDOW p AS (PARTITION BY run, layer, feature)),
 o AS (SELECT *, max(pr) FILTER (z = x) OVER (PARTITION BY run, layer, feature) AS own FROM e)
SELECT run, layer, feature, -log10(least(1.0, sum(pr) FILTER (pr <= own * (1 + 1e-7)) / sum(pr))) AS score FROM o GROUP BY ALL""",
    "f": _TR + """, s AS (SELECT run, layer, feature, label, count(*) AS n, avg(value) AS mn, var_samp(value) AS v FROM tr GROUP BY ALL)
SELECT run, layer, feature, (sum(n*mn*mn) - sum(n*mn)*sum(n*mn)/sum(n)) / (count(*) - 1) / (sum((n-1)*v) / (sum(n) - count(*))) AS score FROM s GROUP BY ALL""",
}
_RANK["pls"] = with_("a", "samples") + _SPLITS.format(runs=10) + """, tr AS (SELECT run, layer, feature, sample, value, cast(label = 'low' AS int) AS one FROM a JOIN splits USING (sample) WHERE role = 'train'),
 x AS (SELECT run, layer, feature, sample, value - avg(value) OVER (PARTITION BY run, layer, feature) AS x, one - avg(one) OVER (PARTITION BY run) AS y FROM tr),
 w1 AS (SELECT run, layer, feature, sum(x*y) AS w FROM x GROUP BY ALL),
 t1 AS (SELECT run, sample, sum(x*w) AS t, any_value(y) AS y FROM x JOIN w1 USING (run, layer, feature) GROUP BY ALL),
 c1 AS (SELECT run, sum(t*t) AS tt, sum(t*y) AS ty FROM t1 GROUP BY ALL),
 y2 AS (SELECT run, sample, t, tt, y - t*ty/tt AS y2 FROM t1 JOIN c1 USING (run)),
 w2 AS (SELECT run, layer, feature, sum(x*y2) AS w FROM x JOIN y2 USING (run, sample) GROUP BY ALL),
 r2 AS (SELECT run, sample, sum(x*w) AS r FROM x JOIN w2 USING (run, layer, feature) GROUP BY ALL),
 t2 AS (SELECT run, sample, y2, r - t*(sum(r*t) OVER (PARTITION BY run))/tt AS t FROM r2 JOIN y2 USING (run, sample)),
 c2 AS (SELECT run, sum(t*y2)*sum(t*y2)/sum(t*t) AS s2 FROM t2 GROUP BY ALL),
 u AS (SELECT run, layer, feature, w1.w*w1.w/sum(w1.w*w1.w) OVER r AS a, w2.w*w2.w/sum(w2.w*w2.w) OVER r AS b, count(*) OVER r AS p
   FROM w1 JOIN w2 USING (run, layer, feature) WINDOW r AS (PARTITION BY run))
SELECT run, layer, feature, (sqrt(p*a) + sqrt(p*(a*ty*ty/tt + b*s2)/(ty*ty/tt + s2)))/2 AS score FROM u JOIN c1 USING (run) JOIN c2 USING (run)"""
for _how in ("auroc", "fisher", "f", "pls", "forest", "svm"):
    register(f"rank_features_{_how}", "N10", _RANK.get(_how), "score")(lambda s, d, h=_how: BI.rank_features(X.layer_a(s, d), BI.mc_splits(_y(s, d)), h))


def _wide_x(s, d):
    """Revenue of the brands per supplier as one array, label 1 for the richer half."""
    w = X.log_a(s, d).groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda r: r["value"]).alias("x"))
    return w.join(_y(s, d), "sample").select("sample", (F.col("label") == "high").cast("int").alias("label"), "x")


def _classified(s, d, how):
    w = checkpointed(_wide_x(s, d))
    cut = F.pmod(F.xxhash64("sample"), F.lit(3)) == 0
    return BI.classify(w.where(~cut), w.where(cut), how)


for _how in ("rf", "elastic", "logistic", "svm"):
    register(f"classify_{_how}", "N11")(lambda s, d, h=_how: _classified(s, d, h))
_cv = lambda s, d: BI.mccv(X.log_a(s, d), _y(s, d))
register("mccv", "N12")(lambda s, d: BI.mccv_performance(_cv(s, d)[0])[1])
for _how in ("elastic", "svm", "forest"):
    register(f"mccv_{_how}", "N12")(lambda s, d, h=_how: BI.mccv_performance(BI.mccv(X.log_a(s, d), _y(s, d), how=h)[0])[1])
register("mccv_features", "N13")(lambda s, d: BI.mccv_test(X.log_a(s, d), _y(s, d), X.log_a(s, d).select("layer", "feature").distinct(), how="logistic", hold_out=["1", "2", "3"])[1])
register("average_roc", "N14")(lambda s, d: BI.average_roc(_cv(s, d)[0].where("size = 5")))
register("importance", "N15")(lambda s, d: BI.importance(_cv(s, d)[1].where("size = 10"), 5))
register("high_low", "N15", with_("a", "samples") + """SELECT layer, feature, CASE WHEN h>l THEN 'high' ELSE 'low' END AS high, CASE WHEN h>l THEN 'low' ELSE 'high' END AS low FROM (
  SELECT layer, feature, quantile_cont(value,0.5) FILTER (acct_high='high') AS h, quantile_cont(value,0.5) FILTER (acct_high='low') AS l FROM a JOIN samples USING (sample) GROUP BY 1,2) t""")(
    lambda s, d: BI.high_low(X.layer_a(s, d), _y(s, d)))
register("confusion", "N16", with_("a", "samples") + """, p AS (SELECT sample, CASE WHEN acct_high='high' THEN 1 ELSE 0 END AS label, CASE WHEN avg(CASE WHEN value>1250000 THEN 1.0 ELSE 0 END)>=0.5 THEN 1 ELSE 0 END AS predicted
  FROM a JOIN samples USING (sample) GROUP BY 1,2) SELECT label, predicted, count(*) AS n FROM p GROUP BY 1,2""")(
    lambda s, d: BI.confusion(X.layer_a(s, d).join(_y(s, d), "sample").select("sample", (F.col("label") == "high").cast("int").alias("label"), (F.col("value") > 1250000).cast("double").alias("prob")))[1])
register("permutation_test", "N17")(lambda s, d: BI.permutation_test(X.log_a(s, d), _y(s, d), 5))
register("logistic_report", "N18")(lambda s, d: BI.logistic_report(X.log_a(s, d), _y(s, d), [("revenue", "Brand#1"), ("revenue", "Brand#2")])[0])
register("logistic_performance", "N18")(lambda s, d: BI.logistic_model(X.log_a(s, d), _y(s, d), [("revenue", "Brand#1"), ("revenue", "Brand#2")])[2])
register("logistic_predictions", "N18")(lambda s, d: BI.logistic_report(X.log_a(s, d), _y(s, d), [("revenue", "Brand#1"), ("revenue", "Brand#2")])[1])

# ---- O: models -----------------------------------------------------------------------------

_im = lambda s, d: MO.interaction_models(X.log_ab(s, d), X.samples(s, d), "revenue", "quantity", "acct_high")
_IM = with_("la", "lb", "samples") + """, g AS (SELECT la.feature AS feature1, lb.feature AS feature2, acct_high, regr_slope(lb.value, la.value) AS b, regr_sxx(lb.value, la.value) AS sxx,
    regr_syy(lb.value, la.value) AS syy, regr_sxy(lb.value, la.value) AS sxy, count(*) AS n, avg(lb.value) AS my FROM la JOIN lb USING (sample) JOIN samples USING (sample) GROUP BY 1,2,3),
  p AS (SELECT feature1, feature2, max(b) FILTER (acct_high='low')-max(b) FILTER (acct_high='high') AS coef, sum(syy-sxy*sxy/sxx) AS ss, sum(n) AS n, sum(1/sxx) AS v,
    sum(syy)+sum(n*my*my)-sum(n*my)*sum(n*my)/sum(n) AS tot FROM g GROUP BY 1,2),
  im AS (SELECT 'revenue' AS layer1, feature1, 'quantity' AS layer2, feature2, coef, coef/sqrt(ss/(n-4)*v) AS stat, cast(n-4 as double) AS df, 1-ss/tot AS r2 FROM p)
"""
register("interaction_models", "O1", _IM + "SELECT layer1, feature1, layer2, feature2, round(coef,6) AS coef, round(stat,6) AS stat, df, round(r2,6) AS r2 FROM im", "coef stat df r2")(
    lambda s, d: _im(s, d).select(*CO.PAIR_KEYS, F.round("coef", 6).alias("coef"), F.round("stat", 6).alias("stat"), "df", F.round("r2", 6).alias("r2")))
register("interaction_select", "O2", _IM + """SELECT layer1, feature1, layer2, feature2, coef, r2, row_number() OVER (ORDER BY round(abs(coef),12) DESC) AS rank,
  CASE WHEN r2<0.05 THEN 'none' WHEN coef>0 THEN 'up' ELSE 'down' END AS class FROM im QUALIFY row_number() OVER (ORDER BY round(abs(coef),12) DESC)<=200""", "coef r2")(
    lambda s, d: MO.interaction_select(_im(s, d), 200, 1.0, r2=0.05).select("layer1", "feature1", "layer2", "feature2", "coef", "r2", "rank", "class"))
register("interaction_network", "O3", _IM + """, t AS (SELECT * FROM im QUALIFY row_number() OVER (ORDER BY round(abs(coef),12) DESC)<=200)
SELECT layer1 || ':' || feature1 AS src, layer2 || ':' || feature2 AS dst, coef AS weight FROM t WHERE coef>0 QUALIFY dense_rank() OVER (ORDER BY round(abs(coef),10) DESC)<=50""", "weight")(
    lambda s, d: MO.interaction_network(MO.interaction_select(_im(s, d), 200, 1.0), "positive", 50))
register("mediation", "O4")(lambda s, d: MO.mediation(X.log_a(s, d), X.samples(s, d), "acct_high", "s_acctbal", 1000))
register("variance_partition", "O5")(lambda s, d: MO.variance_partition(X.log_a(s, d), X.samples(s, d), ["region"], ["acct_high"]))
register("variation_partitioning", "O6")(lambda s, d: MO.vpa(X.log_ab(s, d), X.samples(s, d), "revenue", "quantity", ["s_acctbal"], 5, 999))
register("redundancy_analysis", "O7")(lambda s, d: MO.rda(X.log_a(s, d), X.samples(s, d), ["region", "s_acctbal"], perms=999)[2])
register("permanova", "O8", with_("la", "samples") + """, c AS (SELECT feature, region, value, avg(value) OVER (PARTITION BY feature) AS mu, avg(value) OVER (PARTITION BY feature, region) AS mg FROM la JOIN samples USING (sample)),
  t AS (SELECT sum((value-mu)*(value-mu)) AS tot, sum((value-mg)*(value-mg)) AS res FROM c), k AS (SELECT count(*) AS n, count(DISTINCT region) AS k FROM samples)
SELECT 'region' AS term, cast(k-1 as double) AS df, ((tot-res)/(k-1))/(res/(n-k)) AS f, (tot-res)/tot AS r2 FROM t, k""", "df f r2")(
    lambda s, d: MO.permanova(X.log_a(s, d), X.samples(s, d), ["region"], 999).drop("pval"))
register("biplot", "O9")(lambda s, d: _abs(MO.biplot(X.log_a(s, d))[1]))
