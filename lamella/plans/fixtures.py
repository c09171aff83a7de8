"""Layers, metadata and reference tables derived from the shared star-schema tables.

Each fixture has a DataFrame builder and a SQL twin of the same name in ``CTE``,
so a query and its check start from identical rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamella.core import stack_layers

_BRAND = "cast(substr(p_brand, 7) as int)"

CTE = {
    "a": """a AS (SELECT 'revenue' AS layer, p_brand AS feature, cast(l_suppkey as string) AS sample,
      round(sum(l_extendedprice*(1-l_discount)),4) AS value
      FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY p_brand, l_suppkey)""",
    "b": """b AS (SELECT 'quantity' AS layer, cast(p_size as string) AS feature, cast(l_suppkey as string) AS sample,
      sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY p_size, l_suppkey)""",
    "c": """c AS (SELECT 'lines' AS layer, cast(l_partkey as string) AS feature, strftime(l_shipdate,'%Y-%m') AS sample,
      cast(count(*) as double) AS value FROM lineitem GROUP BY l_partkey, strftime(l_shipdate,'%Y-%m'))""",
    "d": """d AS (SELECT 'embedding' AS layer, cast(generate_subscripts(embedding,1)-1 as string) AS feature,
      cast(vec_id as string) AS sample, cast(unnest(embedding) as double) AS value FROM embeddings)""",
    "e": """e AS (SELECT 'ptype' AS layer, p_type AS feature, cast(l_suppkey as string) AS sample,
      cast(count(*) as double) AS value FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY p_type, l_suppkey)""",
    "g": """g AS (SELECT 'events' AS layer, event_type AS feature, cast(user_id as string) AS sample,
      round(sum(value),4) AS value FROM events GROUP BY event_type, user_id)""",
    "samples": """samples AS (SELECT cast(s_suppkey as string) AS sample, r_name AS region,
      CASE WHEN s_acctbal >= (SELECT median(s_acctbal) FROM supplier) THEN 'high' ELSE 'low' END AS acct_high, s_acctbal
      FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)""",
    # a with injected nulls and zeros
    "dirty": """dirty AS (SELECT layer, feature, sample,
      CASE WHEN (cast(sample as int)*7 + cast(substr(feature,7) as int)*3) % 10 = 0 THEN NULL
           WHEN (cast(sample as int)*3 + cast(substr(feature,7) as int)*11) % 17 = 0 THEN 0.0 ELSE value END AS value FROM a)""",
    # log2 of a, the usual input of tests and correlations
    "la": "la AS (SELECT layer, feature, sample, ln(value)/ln(2) AS value FROM a)",
    "lb": "lb AS (SELECT layer, feature, sample, ln(value)/ln(2) AS value FROM b)",
    "ab": "ab AS (SELECT * FROM la UNION ALL SELECT * FROM lb)",
    "abe": "abe AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e)",
}
_NEEDS = {"dirty": ["a"], "la": ["a"], "lb": ["b"], "ab": ["a", "b", "la", "lb"], "abe": ["a", "b", "e"]}


def t_p(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole ``df``, as the finite sums of the two cases."""
    c2, n = f"({df}/({df}+({t})*({t})))", f"cast({df} AS bigint)"
    even = f"1-abs({t})/sqrt({df}+({t})*({t}))*list_sum([exp(lgamma(2*j+1)-2*lgamma(j+1)-j*ln(4))*pow({c2},j) for j in range({n}//2)])"
    odd = (f"1-2/pi()*(atan(abs({t})/sqrt({df}))+abs({t})*sqrt({df})/({df}+({t})*({t}))"
           f"*coalesce(list_sum([exp(j*ln(4)+2*lgamma(j+1)-lgamma(2*j+2))*pow({c2},j) for j in range(({n}-1)//2)]),0))")
    return f"CASE WHEN {n}%2=0 THEN {even} ELSE {odd} END"


def f_p(f: str, d1: str, d2: str) -> str:
    """Upper p of F for even ``d1``, a finite sum."""
    x = f"({d2}/({d2}+{d1}*({f})))"
    return f"pow({x},{d2}/2)*list_sum([exp(lgamma({d2}/2+j)-lgamma({d2}/2)-lgamma(j+1))*pow(1-{x},j) for j in range(cast({d1} AS bigint)//2)])"


def with_(*names: str) -> str:
    """``WITH`` clause holding the named fixtures and what they need."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(CTE[x] for x in order) + "\n"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark, d, *cols):
    """lineitem with part attributes; the engine picks the join side from file sizes."""
    return table(spark, d, "lineitem").join(
        table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), *cols), "l_partkey")


def _long(df, layer, feature, sample, agg):
    return (df.groupBy(F.col(feature).cast("string").alias("feature"), F.col(sample).cast("string").alias("sample"))
            .agg(agg.cast("double").alias("value"))
            .select(F.lit(layer).alias("layer"), "feature", "sample", "value"))


def layer_a(spark, d):
    return _long(_lines(spark, d, "p_brand"), "revenue", "p_brand", "l_suppkey",
                 F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4))


def layer_b(spark, d):
    return _long(_lines(spark, d, "p_size"), "quantity", "p_size", "l_suppkey", F.sum("l_quantity"))


def layer_c(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return _long(li, "lines", "l_partkey", "month", F.count("*"))


def layer_d(spark, d):
    return (table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
            .select(F.lit("embedding").alias("layer"), F.col("pos").cast("string").alias("feature"),
                    F.col("vec_id").cast("string").alias("sample"), F.col("x").cast("double").alias("value")))


def layer_e(spark, d):
    return _long(_lines(spark, d, "p_type"), "ptype", "p_type", "l_suppkey", F.count("*"))


def layer_g(spark, d):
    return _long(table(spark, d, "events"), "events", "event_type", "user_id", F.round(F.sum("value"), 4))


def samples(spark, d):
    s = table(spark, d, "supplier")
    med = s.agg(F.median("s_acctbal").alias("_med")).withColumn("_one", F.lit(1))
    return (s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumn("_one", F.lit(1)).join(med, "_one")
            .select(F.col("s_suppkey").cast("string").alias("sample"), F.col("r_name").alias("region"),
                    F.when(F.col("s_acctbal") >= F.col("_med"), "high").otherwise("low").alias("acct_high"),
                    "s_acctbal"))


def dirty(spark, d):
    s, b = F.col("sample").cast("int"), F.substring("feature", 7, 9).cast("int")
    return layer_a(spark, d).withColumn(
        "value", F.when((s * 7 + b * 3) % 10 == 0, F.lit(None).cast("double"))
        .when((s * 3 + b * 11) % 17 == 0, F.lit(0.0)).otherwise(F.col("value")))


def log_a(spark, d):
    return layer_a(spark, d).withColumn("value", F.log("value") / F.log(F.lit(2.0)))


def log_b(spark, d):
    return layer_b(spark, d).withColumn("value", F.log("value") / F.log(F.lit(2.0)))


def log_ab(spark, d):
    return stack_layers([log_a(spark, d), log_b(spark, d)])


def abe(spark, d):
    return stack_layers([layer_a(spark, d), layer_b(spark, d), layer_e(spark, d)])
