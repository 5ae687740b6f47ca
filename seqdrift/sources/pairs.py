"""Paired logs of a whole tree as one table or one stream: a Python data source.

    pairs.register(spark)
    spark.read.format("paired_logs").option("table", "packets").load("/captures")
    spark.readStream.format("paired_logs").option("table", "flows").load("/captures")

A pair is a folder without folders below it that holds exactly one flow log and exactly one packet log, as in
`logs.paired_logs`. Each pair is one partition; rows carry the folder as `dir`. Files are plain, .gz or .zst text, columns go
by position, a bad number stops the job. Filters on `dir` choose partitions before anything is read.

A stream takes pairs by the time their later file was finished. It stays `settle` seconds behind, so that files are complete
and none appears with a time that has passed; a log that is written anew is read anew. Folders are listed with Arrow's file
systems, so a tree may lie on any storage these open; the driver lists, the executors read.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.csv as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from seqdrift.schema import FLOW_LOG, PACKET_LOG
from seqdrift.session import settled, shipped
from seqdrift.sources.logs import FLOW_LOG_NAME, PACKET_LOG_NAME

NAME = "paired_logs"
SCHEMAS = {"flows": FLOW_LOG, "packets": PACKET_LOG}
_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}
BLOCK_BYTES = 8 << 20
#: packets of a folder that `write_pairs` holds in a task
PAIR_ROWS = 250_000


@dataclass(frozen=True)
class Pair:
    """Two logs of one folder; paths as the file system names them, `done` in microseconds."""

    dir: str
    flows: str
    packets: str
    done: int


class PairPartition(InputPartition):
    def __init__(self, root: str, dir: str, path: str) -> None:
        super().__init__(dir)
        self.root, self.dir, self.path = root, dir, path


def opened(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.rstrip("/") or "/"


def pairs_below(root: str, flow_name: str = FLOW_LOG_NAME, packet_name: str = PACKET_LOG_NAME) -> list[Pair]:
    """All pairs of a tree, by folder. Names of files are read, not their contents."""
    system, path = opened(root)
    folders: dict[str, list[fs.FileInfo]] = {}
    for info in system.get_file_info(fs.FileSelector(path, recursive=True)):
        if info.type == fs.FileType.File:
            folders.setdefault(info.path.rsplit("/", 1)[0], []).append(info)
    above = {folder[: m.start()] for folder in folders for m in re.finditer("/", folder)}
    found = []
    for folder, files in sorted(folders.items()):
        own = [[f for f in files if re.search(name, f.base_name)] for name in (flow_name, packet_name)]
        if folder not in above and len(own[0]) == len(own[1]) == 1:
            (flow,), (packet,) = own
            done = max((_micros(f.mtime) for f in (flow, packet)), default=0)
            found.append(Pair(folder, flow.path, packet.path, done))
    return found


def _micros(at: datetime | None) -> int:
    # some storage keeps no time: such files count as finished long ago
    return 0 if at is None else int(at.replace(tzinfo=at.tzinfo or UTC).timestamp() * 1_000_000)


def rows_of(partition: PairPartition, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """One log in batches of bounded size."""
    names = [f.name for f in schema.fields]
    kinds = {f.name: _ARROW[f.dataType.simpleString()] for f in schema.fields}
    system, _ = opened(partition.root)
    with system.open_input_stream(partition.path, compression="detect") as raw:
        head = raw.read(1)
        if not head:
            return
    with system.open_input_stream(partition.path, compression="detect") as raw:
        reader = pc.open_csv(
            raw,
            read_options=pc.ReadOptions(column_names=names, skip_rows=1, block_size=BLOCK_BYTES),
            parse_options=pc.ParseOptions(delimiter="\t", quote_char=False, double_quote=False),
            convert_options=pc.ConvertOptions(column_types=kinds, null_values=[""], strings_can_be_null=True),
        )
        for batch in reader:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([partition.dir] * len(batch), pa.string())], names=[*names, "dir"])


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options.get("path", "")
        if not self.root:
            raise ValueError("load() needs a path")
        self.table = options.get("table", "flows")
        if self.table not in SCHEMAS:
            raise ValueError(f"table is one of {sorted(SCHEMAS)}")
        self.flow_name = options.get("flowname", options.get("flowName", FLOW_LOG_NAME))
        self.packet_name = options.get("packetname", options.get("packetName", PACKET_LOG_NAME))
        self.settle = float(options.get("settle", "5"))

    def pairs(self) -> list[Pair]:
        return pairs_below(self.root, self.flow_name, self.packet_name)

    def partition(self, pair: Pair) -> PairPartition:
        return PairPartition(self.root, pair.dir, pair.flows if self.table == "flows" else pair.packets)


class PairReader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options, self.chosen = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - name of the interface
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and tuple(f.attribute) == ("dir",):
                self.chosen.append(f)
            else:
                yield f

    def _wanted(self, folder: str) -> bool:
        def one(f: Filter) -> bool:
            if isinstance(f, In):
                return folder in f.value
            return folder == f.value if isinstance(f, EqualTo) else folder.startswith(f.value)

        return all(one(f) for f in self.chosen)

    def partitions(self) -> list[PairPartition]:
        return [self.options.partition(p) for p in self.options.pairs() if self._wanted(p.dir)]

    def read(self, partition: PairPartition) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.path:
            yield from rows_of(partition, SCHEMAS[self.options.table])


class PairStreamReader(DataSourceStreamReader):
    """Offsets are times: pairs finished after the one and not after the other are a micro-batch."""

    def __init__(self, options: _Options) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"done": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        limit = int((time.time() - self.options.settle) * 1_000_000)
        return {"done": max((p.done for p in self.options.pairs() if p.done <= limit), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[PairPartition]:
        return [self.options.partition(p) for p in self.options.pairs() if start["done"] < p.done <= end["done"]]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: PairPartition) -> Iterator[pa.RecordBatch]:
        yield from rows_of(partition, SCHEMAS[self.options.table])


class PairedLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return T.StructType([*SCHEMAS[_Options(self.options).table].fields, T.StructField("dir", T.StringType())])

    def reader(self, schema: T.StructType) -> PairReader:
        return PairReader(_Options(self.options))

    def streamReader(self, schema: T.StructType) -> PairStreamReader:  # noqa: N802
        return PairStreamReader(_Options(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters handed to the source."""
    shipped(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PairedLogs)


def _log_text(table: pa.Table, schema: T.StructType) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "gzip") as out:
        out.write(("\t".join(f.name for f in schema.fields) + "\n").encode())
        pc.write_csv(table, out, pc.WriteOptions(include_header=False, delimiter="\t", quoting_style="none"))
    return sink.getvalue()


def pairs_for(packets: int, least: int = 8) -> int:
    """Folders for a number of packets, so that their size stays the same however many there are."""
    return max(least, -(-packets // PAIR_ROWS))


def write_pairs(flows: DataFrame, packets: DataFrame, root: str, pairs: int) -> DataFrame:
    """Writes logs as a tree of pairs that `paired_logs` reads: flows are dealt by id to `pairs` folders, each written by one task.

    The flows and packets of a folder must fit a task, so `pairs` follows the size of the table (`pairs_for`). Returns (dir, flows, packets)
    with the rows written. A file appears under its name only when it is whole: a task that runs again replaces it.
    """
    spark = flows.sparkSession
    shipped(spark)

    def write(key: tuple, own: pa.Table, theirs: pa.Table) -> pa.Table:
        folder = f"pair-{key[0].as_py():06d}"
        system, path = opened(root)
        system.create_dir(f"{path}/{folder}", recursive=True)
        for name, table in (("flows", own), ("packets", theirs)):
            schema = SCHEMAS[name]
            # a folder without one of the two is no pair
            text = _log_text(table.select([f.name for f in schema.fields]), schema)
            part = f"{path}/{folder}/.{name}.{os.getpid()}"
            with system.open_output_stream(part) as out:
                out.write(text)
            system.move(part, f"{path}/{folder}/{name}.log.gz")
        return pa.table({"dir": [folder], "flows": [len(own)], "packets": [len(theirs)]})

    def dealt(df: DataFrame, schema: T.StructType) -> DataFrame:
        columns = [F.col(f.name).cast(f.dataType) for f in schema.fields]
        return df.select(F.pmod(F.xxhash64("conn_id"), F.lit(pairs)).alias("_pair"), *columns).groupBy("_pair")

    written = dealt(flows, FLOW_LOG).cogroup(dealt(packets, PACKET_LOG)).applyInArrow(write, "dir string, flows long, packets long")
    return settled(written, "pairs")
