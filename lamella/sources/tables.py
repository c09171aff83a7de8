"""Readers and writers (inventory section A).  Files go through Spark's own CSV, parquet, JSON and text sources."""
from __future__ import annotations

import csv
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamella.core import CELL, signif

META_ROW = r"^#CLASS"
#: Columns that a table may have as a DataFrame; with more it is a ``Wide``.
MAX_COLUMNS = 10_000


@dataclass
class Wide:
    """A table of any number of columns: the name of its first one, the others as ``_i, name``, and rows ``key, cells array<string>``."""
    first: str
    names: DataFrame
    rows: DataFrame

    def cells(self) -> DataFrame:
        """``_k, _c, value``: row key, column name and text of every cell."""
        return self.rows.select(F.col("key").alias("_k"), F.posexplode("cells").alias("_i", "value")).join(self.names, "_i").select("_k", F.col("name").alias("_c"), "value")


def wide(m: DataFrame, rows: str = "feature", cols: str = "sample") -> Wide:
    """Long table to a wide one, columns in the order of their names; ``value`` as text, a cell given twice once."""
    names = (m.where(F.col(cols).isNotNull()).select(cols).distinct().agg(F.array_sort(F.collect_list(cols)).alias("_n"))
             .select(F.posexplode("_n").alias("_i", "name")))
    own = m.join(names.select("_i", F.col("name").alias(cols)), cols).groupBy(rows, "_i").agg(F.first("value").cast("string").alias("value"))
    own = own.groupBy(rows).agg(F.array_sort(F.collect_list(F.struct("_i", "value"))).alias("_c"))
    n = names.agg(F.count("*").cast("int").alias("_n"))
    own = m.select(rows).distinct().join(own, rows, "left").crossJoin(F.broadcast(n))
    # gaps: from the cell before to the next, each cell brings the nulls that stand before it
    held = F.concat(F.coalesce("_c", F.array().cast("array<struct<_i:int,value:string>>")), F.array(F.struct(F.col("_n").alias("_i"), F.lit(None).cast("string").alias("value"))))
    own = own.select(F.col(rows).alias("key"), held.alias("_c"))
    before = lambda i: F.coalesce(F.get(F.col("_c"), i - 1)["_i"], F.lit(-1))
    filled = F.flatten(F.transform("_c", lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("string"), x["_i"] - before(i) - 1), F.array(x["value"]))))
    return Wide("#NAME", names, own.select("key", F.slice(filled, 1, F.size(filled) - 1).alias("cells")))


def _quoted(c: Column) -> Column:
    safe = F.regexp_replace(c, r'(["\\\\])', r"\\$1")
    return F.when(c.isNull(), "").when(c == "", '""').when(c.rlike(r'[",\\\\\r\n]|^\s|\s$'), F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(c)


def write_wide(w: Wide, path: str) -> None:
    """Comma-separated files, each with the header, as Spark's own writer leaves them."""
    head = w.names.agg(F.array_sort(F.collect_list(F.struct("_i", "name"))).alias("_n")).select(
        F.concat_ws(",", F.lit(w.first), F.transform("_n", lambda x: _quoted(x["name"])))).first()[0]

    def lines(it):
        started = False
        for pdf in it:
            if len(pdf) and not started:
                started = True
                yield pd.DataFrame({"value": [head]})
            yield pdf

    w.rows.select(F.concat_ws(",", _quoted(F.col("key")), F.transform("cells", _quoted)).alias("value")).mapInPandas(lines, "value string").write.text(path)


def _parsed(lines, sep: str):
    return csv.reader(lines, delimiter=sep, quotechar='"', escapechar="\\", doublequote=False)


def header(spark: SparkSession, path: str, sep: str = ",") -> tuple[str, list[str]]:
    """The header line and its names: a nameless column is called by its place, repeated names have it appended."""
    line = spark.read.text(path).where(F.trim("value") != "").select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    line = line.groupBy("f").agg(F.min_by("value", "i").alias("value")).orderBy("f").first()["value"]
    names = [n.strip() for n in next(_parsed([line], sep))]
    low = [n.lower() for n in names]
    twice = {n for n in low if low.count(n) > 1} if len(set(low)) < len(low) else set()
    return line, [f"_c{i}" if not n else f"{n}{i}" if n.lower() in twice else n for i, n in enumerate(names)]


def _read_wide(spark: SparkSession, path: str, line: str, names: list[str], sep: str) -> Wide:
    """Lines as arrays of cells; short lines end with nulls. Lines equal to the header are headers of other files."""
    n = len(names) - 1

    def rows(it):
        for pdf in it:
            for r in _parsed(pdf["value"], sep):
                r = [c.strip() or None for c in r[:n + 1]]
                yield pd.DataFrame({"key": r[:1], "cells": [r[1:] + [None] * (n + 1 - len(r))]})

    lines = spark.read.text(path).where((F.col("value") != line) & (F.trim("value") != ""))
    cols = spark.createDataFrame(list(enumerate(names[1:])), "_i int, name string")
    return Wide(names[0], cols, lines.mapInPandas(rows, "key string, cells array<string>"))


def _raw(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, nullValue="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def _tick(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c).isin("", "NA"), None).otherwise(F.trim(c))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold nothing; one aggregate over the file."""
    n = df.agg(*[F.count(blank_to_null(_tick(c).cast("string"))).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[_tick(c) for i, c in enumerate(df.columns) if n[i] > 0])


def split_embedded_meta(df: DataFrame | Wide) -> tuple[DataFrame | Wide, DataFrame]:
    """Rows of the value table, and metadata rows (``#CLASS...`` or ``Label``) as ``sample, var, value``."""
    key = F.col("key") if isinstance(df, Wide) else _tick(df.columns[0])
    is_meta = key.rlike(META_ROW) | (key == "Label")
    others = ~F.coalesce(is_meta, F.lit(False))
    if isinstance(df, Wide):
        rest = Wide(df.first, df.names, df.rows.where(others))
        meta = Wide(df.first, df.names, df.rows.where(is_meta)).cells().select(F.col("_k").alias("var"), F.col("_c").alias("sample"), "value")
    else:
        rest = df.where(others)
        meta = df.where(is_meta).select(key.alias("var"), *[_tick(c) for c in df.columns[1:]])
        meta = meta.unpivot(["var"], [_tick(c) for c in df.columns[1:]], "sample", "value")
    name = F.when(F.col("var") == "Label", "Label").otherwise(F.regexp_replace("var", r"^#CLASS[:_.]?", ""))
    return rest, meta.select(
        "sample", F.when(name == "", "CLASS").otherwise(name).alias("var"), blank_to_null(F.col("value")).alias("value"))


def samples_in_rows(df: DataFrame, sample_ids: DataFrame) -> bool:
    """More metadata ids in the first column than in the header."""
    spark = df.sparkSession
    first = df.select(_tick(df.columns[0]).alias("sample")).distinct().join(sample_ids.select("sample"), "sample", "left_semi").count()
    head = spark.createDataFrame([(c,) for c in df.columns[1:]], "sample string").join(sample_ids.select("sample"), "sample", "left_semi").count()
    return first > head


def melt(df: DataFrame, layer: str, transposed: bool = False) -> DataFrame:
    """Long text table of a wide one; with samples in rows only the column roles differ."""
    first = df.columns[0]
    d = df.select(_tick(first).alias("_k"), *[_tick(c) for c in df.columns[1:]]).unpivot(["_k"], [_tick(c) for c in df.columns[1:]], "_c", "value")
    f, s = ("_c", "_k") if transposed else ("_k", "_c")
    return d.select(F.lit(layer).alias("layer"), F.col(f).alias("feature"), F.col(s).alias("sample"), blank_to_null(F.col("value")).alias("value"))


def read_layer(spark: SparkSession, path: str, layer: str, sample_ids: DataFrame | None = None, sep: str = ",") -> DataFrame:
    """Delimited features x samples table to the long table; turned when the samples stand in rows."""
    from lamella.operators.quality import to_numeric
    line, names = header(spark, path, sep)
    if len(names) > MAX_COLUMNS:
        return to_numeric(_long_cells(_read_wide(spark, path, line, names, sep), layer, sample_ids)).select(*CELL, "value")
    df, _ = split_embedded_meta(drop_empty_columns(_raw(spark, path, sep)))
    if sample_ids is not None and samples_in_rows(df, sample_ids):
        cols = df.columns[1:]
        r = df.agg(*[(F.count(F.regexp_replace(_tick(c), ",", "").try_cast("double")) / F.count(_tick(c))).alias(f"c{i}") for i, c in enumerate(cols)]).first()
        df = df.select(_tick(df.columns[0]), *[_tick(c) for i, c in enumerate(cols) if (r[i] or 0) > 0.8])
        return to_numeric(melt(df, layer, True)).select(*CELL, "value")
    return to_numeric(melt(df, layer)).select(*CELL, "value")


def _long_cells(w: Wide, layer: str, sample_ids: DataFrame | None) -> DataFrame:
    """The cells of a wide table as ``read_layer`` keeps them, as text: columns that hold nothing are left out, as are, with samples
    in rows, those of which at most 80% are numbers."""
    held = w.cells().where(blank_to_null(F.col("value")).isNotNull()).select("_c").distinct()
    w, _ = split_embedded_meta(w)
    c = w.cells().join(held, "_c", "left_semi")
    count = lambda d, col: d.select(F.col(col).alias("sample")).distinct().join(sample_ids.select("sample"), "sample", "left_semi").count()
    f, s = "_k", "_c"
    if sample_ids is not None and count(w.rows, "key") > count(held, "_c"):
        f, s = s, f
        number = F.regexp_replace("value", ",", "").try_cast("double")
        c = c.join(c.groupBy("_c").agg((F.count(number) / F.nullif(F.count("value"), F.lit(0))).alias("_r")).where(F.col("_r") > 0.8), "_c", "left_semi")
    return c.select(F.lit(layer).alias("layer"), F.col(f).alias("feature"), F.col(s).alias("sample"), blank_to_null(F.col("value")).alias("value"))


def read_metadata(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Sample metadata: the first header must start with #NAME; NA to null; blanks in names to underscores."""
    df = drop_empty_columns(_raw(spark, path, sep))
    if not df.columns[0].upper().startswith("#NAME"):
        raise ValueError("the first column of the metadata must be #NAME")
    return df.select(_tick(df.columns[0]).alias("sample"), *[blank_to_null(_tick(c)).alias(c.strip().replace(" ", "_")) for c in df.columns[1:]])


def load_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``source, id, target`` dimension table (parquet)."""
    return spark.read.parquet(path).select("source", "id", "target").where(F.col("id").isNotNull() & F.col("target").isNotNull())


def load_sets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Library with ``set_id, set_name, members array`` to ``set_id, set_name, member``; empty sets vanish."""
    return spark.read.format(fmt).load(path).select("set_id", "set_name", F.explode("members").alias("member")).where(F.trim("member") != "")


def load_sets_named(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A library by name, or its ``go_`` form where only that exists."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return load_sets(spark, f"{folder}/{name if there else 'go_' + name}", fmt)


# ---- sinks ---------------------------------------------------------------------------------

def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[signif(_tick(c), digits).alias(c) if t == "double" else _tick(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Doubles at significant digits; one file per task."""
    rounded(df, digits).write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, row_id: str = "row_id", key: list[str] | None = None) -> None:
    """Parquet with a row id column built from the key columns."""
    d = df.withColumn(row_id, F.concat_ws(":", *(key or [c for c in ("layer", "feature") if c in df.columns] or df.columns[:1])))
    d.write.mode("overwrite").parquet(path)


def nested(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with the other columns as an array of structs (keys with bounded groups)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))


def write_json(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    (nested(df, keys) if keys else df).write.mode("overwrite").json(path)


def sif(edges: DataFrame, relation: str = "pp") -> DataFrame:
    return edges.select(F.concat_ws("\t", "src", F.lit(relation), "dst").alias("value"))


def write_sif(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """``edges.sif`` plus attribute tables of edges and nodes."""
    sif(edges).write.mode("overwrite").text(f"{path}/edges.sif")
    write_csv(edges, f"{path}/edge_attributes")
    write_csv(nodes, f"{path}/node_attributes")


def write_pairs(edges: DataFrame, path: str, kind: str = "all") -> None:
    from lamella.operators.correlation import pairs
    write_csv(pairs(edges, kind), path)
