"""Text logs: flows, packets, probe results; which log files belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqdrift.schema import FLOW_LOG, PACKET_LOG, PROBE_LOG

FLOW_LOG_NAME = r"^flows.*\.log"
PACKET_LOG_NAME = r"^packets.*\.log"


def _tsv(spark: SparkSession, paths: str | list[str], schema: T.StructType, mode: str, recursive: bool) -> DataFrame:
    """Tab-separated, one header line, no quoting; plain, .gz or .zst by suffix. Columns go by position.

    FAILFAST stops at a bad number. PERMISSIVE keeps the line in `_bad` instead.
    """
    if mode == "PERMISSIVE":
        schema = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(schema).options(
        sep="\t", header=True, quote="", enforceSchema=True, mode=mode, columnNameOfCorruptRecord="_bad",
        recursiveFileLookup=recursive,
    )
    return reader.csv(paths)


def flow_log(spark: SparkSession, paths: str | list[str], mode: str = "FAILFAST", recursive: bool = False) -> DataFrame:
    return _tsv(spark, paths, FLOW_LOG, mode, recursive)


def packet_log(spark: SparkSession, paths: str | list[str], mode: str = "FAILFAST", recursive: bool = False) -> DataFrame:
    return _tsv(spark, paths, PACKET_LOG, mode, recursive)


def write_tsv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.options(sep="\t", header=True, quote="", compression=compression).csv(path)


def probe_log(spark: SparkSession, arrays: str | list[str] | None = None, lines: str | list[str] | None = None) -> DataFrame:
    """Probe results under one schema: files holding a JSON array, and files with one object per line.

    A JSON array cannot be split, so such a file is one task; line files split as usual.
    """
    parts = []
    if arrays is not None:
        parts.append(spark.read.schema(PROBE_LOG).json(arrays, multiLine=True))
    if lines is not None:
        parts.append(spark.read.schema(PROBE_LOG).json(lines))
    if not parts:
        raise ValueError("no input")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(dir, name) of every file below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return found.select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name")
    )


def leaf_folders(files: DataFrame) -> DataFrame:
    """Files of folders that have no folder with files below them."""
    dirs = files.select("dir").distinct()
    depth = F.size(F.split("dir", "/"))
    # each folder names its ancestors; a folder that is named is not a leaf
    ancestors = dirs.select(F.explode(F.transform(
        F.sequence(F.lit(1), depth - 1), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/")
    )).alias("dir")).distinct()
    return files.join(dirs.join(ancestors, "dir", "left_anti"), "dir", "left_semi")


def paired_logs(files: DataFrame, flow_name: str = FLOW_LOG_NAME, packet_name: str = PACKET_LOG_NAME) -> DataFrame:
    """(dir, flow_log, packet_log) of leaf folders holding exactly one log of each kind.

    Takes a listing such as `files_below` makes, and patterns of the two names; the two logs of a folder are what `flow_log` and
    `packet_log` read.
    """
    is_flow, is_packet = F.col("name").rlike(flow_name), F.col("name").rlike(packet_name)
    grouped = leaf_folders(files).groupBy("dir").agg(
        F.count_if(is_flow).alias("_f"), F.count_if(is_packet).alias("_p"),
        F.max(F.when(is_flow, F.col("name"))).alias("flow_log"), F.max(F.when(is_packet, F.col("name"))).alias("packet_log"),
    )
    return grouped.where((F.col("_f") == 1) & (F.col("_p") == 1)).select("dir", "flow_log", "packet_log")


def shards(files: DataFrame) -> DataFrame:
    """(dir, name) of flow shards (`flows*`, a file or a written table) in leaf folders.

    One scan of all of them replaces a loop over shards.
    """
    path = F.concat_ws("/", "dir", "name")
    # a table is a folder of part files: cut its path at the table
    table = r"^(.*?)/(flows[^/]*)(?:/.*)?$"
    inside = path.rlike(table)
    entries = files.select(
        F.when(inside, F.regexp_extract(path, table, 1)).otherwise(F.col("dir")).alias("dir"),
        F.when(inside, F.regexp_extract(path, table, 2)).otherwise(F.col("name")).alias("name"),
    ).distinct()
    return leaf_folders(entries).where(F.col("name").startswith("flows"))
