"""Archives of pipe-separated files as a Spark data source: member ranges are partitions.

The driver reads an archive's directory (names, places and sizes, no data). A partition is a run
of members in name order, some partition_bytes of packed data; its task opens the archive, goes to each
member's place and unpacks it as a stream, checks its checksum, and maps the member's own header to the
wanted columns. So a large archive is read by many tasks, and no file is held whole.

Archives are opened with pyarrow's file systems, as executors have no other way to read a file by
offset; any store they know will do.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewell.sources.panel import canonical_names, identity_of

NAME = "psv_archive"
PARTITION_BYTES = 32 << 20
PIECE = 1 << 20  # bytes unpacked at once
BATCH = 20_000  # rows
STORED, DEFLATED = 0, 8
SUFFIX = ".psv"


@dataclass(frozen=True)
class Member:
    name: str
    place: int  # of its local header
    packed: int
    size: int
    crc: int
    method: int


@dataclass
class Members(InputPartition):
    archive: str
    members: list[Member]


@dataclass
class Written(WriterCommitMessage):
    made: str | None
    final: str | None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a plain path or a URI."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def archives_at(path: str) -> list[str]:
    """The archive at path, or those right in the folder."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    inside = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in inside if x.type == fs.FileType.File and x.base_name.lower().endswith(".zip"))


def directory(path: str) -> list[Member]:
    """An archive's members in name order, without folders."""
    store, at = opened(path)
    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
    if odd := [i.filename for i in infos if i.flag_bits & 1 or i.compress_type not in (STORED, DEFLATED)]:
        raise ValueError(f"members that cannot be unpacked: {odd[:3]}")
    return sorted((Member(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type) for i in infos), key=lambda m: m.name)


def lines_of(f, m: Member) -> Iterator[str]:
    """A member's lines; ends are \\n or \\r\\n. Fails unless length and checksum are right."""
    f.seek(m.place)
    head = f.read(30)
    f.seek(m.place + 30 + sum(struct.unpack("<HH", head[26:30])))
    unzip = zlib.decompressobj(-15) if m.method == DEFLATED else None
    left, size, crc, rest = m.packed, 0, 0, b""
    while left or (unzip and unzip.unconsumed_tail):
        if unzip and unzip.unconsumed_tail:
            data = unzip.decompress(unzip.unconsumed_tail, PIECE)
        else:
            data = f.read(min(left, PIECE))
            if not data:
                raise ValueError(f"{m.name}: the archive ends inside it")
            left -= len(data)
            data = unzip.decompress(data, PIECE) if unzip else data
        size, crc = size + len(data), zlib.crc32(data, crc)
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            yield line.removesuffix(b"\r").decode()
    if (size, crc) != (m.size, m.crc):
        raise ValueError(f"{m.name}: length or checksum differ from the archive's directory")
    if rest:
        yield rest.removesuffix(b"\r").decode()


def rows_of(lines: Iterator[str], name: str, columns: list[str], aliases: dict[str, str]) -> Iterator[list[str | None]]:
    """[row number, *cells in the order of columns] below the member's own header; blank lines are skipped, cells that a short line lacks are null."""
    header = next(lines, "").removeprefix("﻿").split("|")
    try:
        named = canonical_names(header, columns, aliases)
    except ValueError as e:
        raise ValueError(f"{name}: {e}") from None
    place = {canonical: i for i, canonical in enumerate(named.values())}
    order = [place[c] for c in columns]
    number = 0
    for line in lines:
        if not line.strip():
            continue
        cells: list[str | None] = line.split("|")
        if len(cells) > len(header):
            raise ValueError(f"{name}: a line has {len(cells)} cells below {len(header)} headers")
        cells += [None] * (len(header) - len(cells))
        number += 1
        yield [number, *(cells[k] for k in order)]
    if not number:
        raise ValueError(f"{name}: no rows")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.columns = json.loads(options["columns"]) if "columns" in options else None
        self.aliases = json.loads(options.get("aliases", "{}"))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.names = schema.names

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        seen: set[str] = set()
        for archive in archives_at(self.path):
            held: list[Member] = []
            for m in directory(archive):
                if self.columns is not None:
                    if not m.name.lower().endswith(SUFFIX):
                        continue
                    entity = identity_of(m.name)[1]
                    if entity in seen:
                        raise ValueError(f"two files of entity {entity}")
                    seen.add(entity)
                held.append(m)
                if sum(x.packed for x in held) >= self.partition_bytes:
                    out.append(Members(archive, held))
                    held = []
            if held:
                out.append(Members(archive, held))
        if self.columns is not None and not seen:
            raise ValueError(f"no {SUFFIX} files in the archives at {self.path}")
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.members:
            return
        if self.columns is None:
            of = partition.members
            cols = [[partition.archive] * len(of), [m.name for m in of], [m.size for m in of], [m.crc for m in of]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], self.names)
            return
        store, at = opened(partition.archive)
        with store.open_input_file(at) as f:
            for m in partition.members:
                source, entity = identity_of(m.name)
                held: list[list] = []
                for row in rows_of(lines_of(f, m), m.name, self.columns, self.aliases):
                    held.append(row)
                    if len(held) == BATCH:
                        yield self.batch(source, entity, held)
                        held = []
                if held:
                    yield self.batch(source, entity, held)

    def batch(self, source: str, entity: str, rows: list[list]) -> pa.RecordBatch:
        number, *cells = zip(*rows)
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([source] * n), pa.array([entity] * n), pa.array(number, pa.int64()), *(pa.array(c, pa.string()) for c in cells)], self.names)


class ArchiveWriter(DataSourceWriter):
    """One archive for each task, under a name of its own until all tasks have ended."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("archives are added, never overwritten")
        self.path, self.names = options["path"].rstrip("/"), schema.names

    def write(self, rows: Iterator) -> Written:
        store, at = opened(self.path)
        store.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        made, entity, lines = f"{at}/_{name}.tmp", None, []
        done: set[str] = set()
        columns = [c for c in self.names if c not in ("source", "entity")]
        with store.open_output_stream(made) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:

            def close() -> None:
                if entity is None:
                    return
                member = f"{entity[0]}/{entity[1].split(':', 1)[-1]}{SUFFIX}"
                if member in done:
                    raise ValueError(f"{member} is written twice: rows must be sorted by entity")
                done.add(member)
                z.writestr(member, "\n".join(["|".join(columns), *lines]) + "\n")

            for r in rows:
                if (r["source"], r["entity"]) != entity:
                    close()
                    entity, lines = (r["source"], r["entity"]), []
                lines.append("|".join("" if r[c] is None else str(r[c]) for c in columns))
            close()
        if not done:
            store.delete_file(made)
            return Written(None, None)
        return Written(made, f"{at}/{name}.zip")

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m and m.made:
                store.move(m.made, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m and m.made:
                store.delete_file(m.made)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        if "columns" not in self.options:
            return "archive string, name string, size long, crc long"
        return ", ".join(["source string", "entity string", "row long", *(f"`{c}` string" for c in json.loads(self.options["columns"]))])

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, schema, overwrite)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, size and checksum of all members of the archives at path, without folders."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(NAME).option("partition_bytes", 1 << 60).load(path)


def read_archive(spark: SparkSession, path: str, columns: list[str], aliases: dict[str, str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """source, entity, row (from 1 in each file) and the columns as text, from the .psv members of the archives at path.

    Each member's header is held against columns (after aliases) and may have another order; duplicate,
    unknown or missing names fail the job with the member's name, as do two members of one entity.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(NAME).option("columns", json.dumps(columns)).option("aliases", json.dumps(aliases or {})).option("partition_bytes", partition_bytes).load(path)


def write_archive(rows: DataFrame, path: str, order: str = "t") -> None:
    """rows (source, entity and columns) as .psv members of new archives below path, one archive for each task; an entity's rows in `order`."""
    rows.sparkSession.dataSource.register(ArchiveSource)
    rows.repartition("source", "entity").sortWithinPartitions("source", "entity", order).write.format(NAME).mode("append").save(path)
