"""Sources and sinks (S1-S7, F19) with explicit schemas."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATHS = (
    "src_fine_file coarse_path fine_path zs_coarse_path zs_fine_path elev_fine_path elev_coarse_path rough_path mask_fine_path "
    "mask_coarse_path slope_path twi_path aspect_sin_path aspect_cos_path"
).split()
PATCH_INDEX = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("scenario", "var", "t")]
    + [T.StructField(c, T.IntegerType()) for c in "time_index patch_row patch_col downscale patch_size_coarse patch_size_fine".split()]
    + [T.StructField(c, T.DoubleType()) for c in "x0_fine y0_fine x1_fine y1_fine".split()]
    + [T.StructField(c, T.StringType()) for c in PATHS]
    + [T.StructField("aoi_ratio", T.DoubleType()), T.StructField("filtered_out", T.IntegerType())]
)
PATCHES = "scenario string, var string, t string, time_index int, patch_row int, patch_col int, downscale int, grid string, h int, w int, values array<float>, mask array<tinyint>"


def read_patch_index(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, typed, blanks as NULL, with ``row_id``: its own column, or else the row's place.

    Without ``row_id`` rows are numbered from 0 in the order of the scan's partitions, which is that of
    the files where their sizes allow. Write the result to keep the numbers.
    """
    head = spark.read.option("header", True).csv(path).columns
    fields = {f.name: f for f in PATCH_INDEX}
    old = {"elev_path": "elev_fine_path"}
    schema = T.StructType([T.StructField(c, T.LongType()) if c == "row_id" else fields.get(old.get(c, c), T.StructField(c, T.StringType())) for c in head])
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(head, schema, strict=True)])
    out = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path).withColumnsRenamed({o: n for o, n in old.items() if o in head})
    if "row_id" in head:
        return out
    # partition number and place in it, then the places before each partition: one row for each
    numbered = out.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = numbered.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn("row_id", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).select(*out.columns, "row_id")


def write_patch_index(index: DataFrame, path: str, form: str = "parquet", mode: str = "append") -> None:
    writer = index.write.mode(mode).partitionBy("scenario", "var")
    writer.parquet(path) if form == "parquet" else writer.option("header", True).csv(path)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PATCHES).parquet(path)


def write_patches(patches: DataFrame, path: str, mode: str = "append") -> None:
    """Rows of a scenario and variable lie together, so that both prune a scan."""
    patches.repartition("scenario", "var", "t").write.mode(mode).partitionBy("scenario", "var").parquet(path)


def decode_npy(data: bytes) -> tuple[tuple[int, ...], np.ndarray]:
    """Shape and values of a .npy file; only plain numbers (no pickles), C or Fortran order."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    n, at = (struct.unpack_from("<H", data, 8)[0], 10) if data[6] == 1 else (struct.unpack_from("<I", data, 8)[0], 12)
    head = ast.literal_eval(data[at : at + n].decode("latin1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject:
        raise ValueError("a .npy file of objects")
    values = np.frombuffer(data, kind, offset=at + n).reshape(head["shape"], order="F" if head["fortran_order"] else "C")
    return values.shape, values


def read_npy(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """(path, h, w, values) of .npy files under a folder; 1-D arrays have h = 1, others must be 2-D."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, c in zip(frame["path"], frame["content"], strict=True):
                _, v = decode_npy(c)
                v = np.atleast_2d(v)
                rows.append((p, *v.shape, v.astype(np.float32).ravel()))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "values"])

    return files.mapInPandas(run, "path string, h int, w int, values array<float>")


def read_point_series(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Numbers separated by white space, ``#`` lines left out; missing trailing columns are NULL."""
    lines = spark.read.text(path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    return lines.select(*[F.get(parts, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(cols)])


def write_stats_json(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    stats.write.mode(mode).json(path)


ONE = "struct<n:bigint,min:double,max:double,mean:double,std:double>"
SPLIT_STATS = (
    f"split struct<train:array<bigint>,val:array<bigint>>, seed int, val_ratio double, stats map<string,{ONE}>, "
    f"stats_var struct<mode:string,coarse:{ONE},fine:{ONE},shared:{ONE},asinh_by_q:map<string,struct<s:double,coarse:{ONE},fine:{ONE},shared:{ONE}>>,"
    f"wet_ratio:double,pos_weight:double>, aux_stats map<string,struct<coarse:{ONE},fine:{ONE},shared:{ONE}>>"
)


def read_stats_json(spark: SparkSession, path: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """The nested stats document; ValueError if one of the ``needed`` keys of ``stats`` is absent."""
    out = spark.read.schema(SPLIT_STATS).option("multiLine", True).json(path)
    for k in needed:
        if not out.where(F.col("stats")[k].isNull()).isEmpty():
            raise ValueError(f"stats has no {k}")
    return out


def write_metric_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One CSV folder per level."""
    for name, table in tables.items():
        table.write.mode(mode).option("header", True).csv(f"{path}/{name}")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")
