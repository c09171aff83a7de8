"""The long table, and the few helpers every operator shares.

Shape the design relies on: features are many (distributed), samples are few
(``MAX_SAMPLES``, checked).  A ``(layer, feature)`` group therefore has a
bounded number of rows; a ``(layer, sample)`` or ``layer`` group has not, and is
only ever reduced by mergeable aggregates or by :mod:`lamella.functions.ranking`.
An absent cell and a null cell mean the same thing: missing.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

LONG = T.StructType([
    T.StructField("layer", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("sample", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
FEATURE = ["layer", "feature"]
SAMPLE = ["layer", "sample"]
CELL = ["layer", "feature", "sample"]
MAX_SAMPLES = 5000


def session(app: str = "lamella", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def from_frame(df: DataFrame, layer: str, feature: str, sample: str, value: str) -> DataFrame:
    """Long table from any frame: ``layer`` is a literal label, the rest are column names."""
    return df.select(F.lit(layer).alias("layer"), F.col(feature).cast("string").alias("feature"),
                     F.col(sample).cast("string").alias("sample"), F.col(value).cast("double").alias("value"))


def with_stats(m: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Attach per-group aggregates to every row.

    Group-then-join, not a window: the aggregate combines map-side, so a hot
    group costs one partial row per task, and the join is broadcast or
    skew-split by AQE from its measured size.
    """
    return m.join(m.groupBy(*keys).agg(*aggs), keys, "left")


def layer_sizes(m: DataFrame) -> DataFrame:
    """Samples and features per layer (``layer, n_samples, n_features``)."""
    s = m.select("layer", "sample").distinct().groupBy("layer").agg(F.count("*").alias("n_samples"))
    f = m.select("layer", "feature").distinct().groupBy("layer").agg(F.count("*").alias("n_features"))
    return s.join(f, "layer")


def layer_sample_counts(m: DataFrame) -> DataFrame:
    return m.select("layer", "sample").distinct().groupBy("layer").agg(F.count("*").alias("n_samples"))


def keep_features(m: DataFrame, kept: DataFrame) -> DataFrame:
    return m.join(kept.select(*FEATURE), FEATURE, "left_semi")


def stack_layers(layers: list[DataFrame]) -> DataFrame:
    """Union of layers; the key is (layer, feature)."""
    out = layers[0].select(*CELL, "value")
    for x in layers[1:]:
        out = out.unionByName(x.select(*CELL, "value"))
    return out


def sample_ids(m: DataFrame, limit: int = MAX_SAMPLES) -> list[str]:
    """Sorted sample ids on the driver; refuses more than ``limit``."""
    rows = m.select("sample").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} samples: sample-space matrices would not fit the driver")
    return sorted(r[0] for r in rows)


def shared_samples(m: DataFrame, meta: DataFrame) -> list[str]:
    """Sorted ids of the samples present in both."""
    return sample_ids(m.join(meta.select("sample"), "sample", "left_semi"))


def bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that must be small; refuses more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared place the cluster names; under /tmp only in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint()


def densify(m: DataFrame) -> DataFrame:
    """One row per (feature, sample of the layer): absent cells become null rows.

    One shuffle by feature, cells and gaps merged by a sort, if the sample list of every layer is small; beyond, the grid of a
    layer's features and samples is joined with its cells.
    """
    if not m.select("layer", "sample").distinct().groupBy("layer").count().where(F.col("count") > MAX_SAMPLES).isEmpty():
        grid = m.select("layer", "sample").distinct().join(F.broadcast(m.select(*FEATURE).distinct()), "layer")
        return grid.join(m.select(*CELL, "value"), CELL, "left").select(*CELL, "value")
    samples = (m.select("layer", "sample").distinct().groupBy("layer")
               .agg(F.collect_list("sample").alias("_samples"))
               .select("layer", F.when(F.size("_samples") <= MAX_SAMPLES, F.col("_samples"))
                       .otherwise(F.raise_error(F.lit("too many samples in a layer"))).alias("_samples")))
    cells = m.groupBy(*FEATURE).agg(F.collect_list(F.struct("sample", F.lit(0).alias("gap"), "value")).alias("_cells"))
    gaps = F.transform("_samples", lambda x: F.struct(x.alias("sample"), F.lit(1).alias("gap"), F.lit(None).cast("double").alias("value")))
    return (_fill_gaps(cells.join(samples, "layer"), gaps, "sample")
            # explode would infer a size filter and push the whole gap expression below, inside its own lambda
            .select(*FEATURE, F.explode_outer("_cells").alias("_c")).select(*FEATURE, "_c.sample", "_c.value"))


def _fill_gaps(df: DataFrame, gaps: Column, key: str) -> DataFrame:
    """``_cells`` sorted by key, with the gap entries of keys that have no real one (linear after the sort)."""
    d = df.withColumn("_cells", F.sort_array(F.concat("_cells", gaps)))
    before = lambda i: F.get(F.col("_cells"), i - 1)[key]
    return d.withColumn("_cells", F.filter("_cells", lambda x, i: (x["gap"] == 0) | (i == 0) | (before(i) != x[key])))


def vectors(m: DataFrame, order: list[str]) -> DataFrame:
    """``layer, feature, vec``: the feature's values in the given sample order, NaN where missing."""
    idx = {s: i for i, s in enumerate(order)}
    spark = m.sparkSession
    lookup = spark.createDataFrame([(s, i) for s, i in idx.items()], "sample string, _i int")
    n = len(order)
    cells = (m.join(F.broadcast(lookup), "sample").groupBy(*FEATURE)
             .agg(F.collect_list(F.struct("_i", F.lit(0).alias("gap"), "value")).alias("_cells")))
    gaps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.struct(i.alias("_i"), F.lit(1).alias("gap"), F.lit(None).cast("double").alias("value")))
    return _fill_gaps(cells, gaps, "_i").select(
        *FEATURE, F.transform("_cells", lambda x: F.coalesce(x["value"], F.lit(float("nan")))).alias("vec"))


def signif(x: Column | str, digits: int = 6) -> Column:
    """``x`` rounded to significant digits."""
    x = F.col(x) if isinstance(x, str) else x
    e = F.floor(F.log10(F.abs(x)))
    s = (digits - 1) - e
    up, down = F.pow(F.lit(10.0), s), F.pow(F.lit(10.0), -s)
    return (F.when(x.isNull() | F.isnan(x) | (x == 0), x)
            .when(s >= 0, F.round(x * up) / up)
            .otherwise(F.round(x / down) * down))
