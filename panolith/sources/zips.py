"""Members of zip archives, read by byte ranges: of an archive only what is wanted is fetched.

The driver reads the central directory alone and plans partitions over the wanted members, in
the order of their bytes and about ``partition_bytes`` each; a task fetches the ranges of its
members, one at a time. Archives lie under a path that driver and executors can open, or at an
http address that answers ranges.
"""

from __future__ import annotations

import io
import os
import struct
import urllib.request
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOCAL_HEADER = struct.Struct("<4s5H3I2H")  # fixed values of the zip format: 30 bytes in front of each member
SCHEMA = "archive string, name string, size long, content binary"


def fetch(path: str, start: int, length: int) -> bytes:
    """``length`` bytes from ``start`` (fewer at the end) of a file or of what an http address serves."""
    if path.startswith(("http://", "https://")):
        asked = urllib.request.Request(path, headers={"Range": f"bytes={start}-{start + length - 1}"})
        with urllib.request.urlopen(asked) as answer:
            if answer.status != 206:
                raise OSError(f"{path} does not answer ranges")
            return answer.read()
    with open(path.removeprefix("file://"), "rb") as f:
        f.seek(start)
        return f.read(length)


def size_of(path: str) -> int:
    if path.startswith(("http://", "https://")):
        with urllib.request.urlopen(urllib.request.Request(path, method="HEAD")) as answer:
            return int(answer.headers["Content-Length"])
    return os.path.getsize(path.removeprefix("file://"))


class _Ranges(io.RawIOBase):
    """A file of which each read is a range; counts what it fetched."""

    def __init__(self, path: str):
        self.path, self.size, self.at, self.fetched = path, size_of(path), 0, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def readinto(self, buffer) -> int:
        data = fetch(self.path, self.at, min(len(buffer), self.size - self.at)) if self.at < self.size and len(buffer) else b""
        buffer[: len(data)] = data
        self.at += len(data)
        self.fetched += len(data)
        return len(data)


@dataclass(frozen=True)
class Member:
    archive: str
    name: str
    method: int
    at: int
    packed: int
    size: int
    crc: int


def directory(path: str) -> list[Member]:
    """All members of an archive but folders, from its central directory."""
    with zipfile.ZipFile(io.BufferedReader(_Ranges(path), 1 << 16)) as z:
        return [Member(path, i.filename, i.compress_type, i.header_offset, i.compress_size, i.file_size, i.CRC) for i in z.infolist() if not i.is_dir()]


def content(m: Member) -> bytes:
    """The bytes of a member, from its two ranges; raises where its checksum differs."""
    head = LOCAL_HEADER.unpack(fetch(m.archive, m.at, LOCAL_HEADER.size))
    packed = fetch(m.archive, m.at + LOCAL_HEADER.size + head[-2] + head[-1], m.packed) if m.packed else b""
    if m.method == zipfile.ZIP_STORED:
        out = packed
    elif m.method == zipfile.ZIP_DEFLATED:
        out = zlib.decompress(packed, -15)
    else:
        raise ValueError(f"{m.name}: packing method {m.method}")
    if zlib.crc32(out) != m.crc:
        raise OSError(f"{m.archive}: {m.name} is damaged")
    return out


@dataclass
class Portion(InputPartition):
    members: list[Member]


def portions(members: list[Member], most: int) -> list[Portion]:
    """Members in the order of their bytes, about ``most`` packed bytes at a time."""
    out: list[Portion] = []
    held, size = [], 0
    for m in sorted(members, key=lambda m: (m.archive, m.at)):
        if held and (size + m.packed > most or m.archive != held[-1].archive):
            out.append(Portion(held))
            held, size = [], 0
        held.append(m)
        size += m.packed
    return [*out, Portion(held)] if held else out


class _Reader(DataSourceReader):
    def __init__(self, members: list[Member], most: int):
        self.planned = portions(members, most)

    def partitions(self) -> list[Portion]:
        return self.planned or [Portion([])]

    def read(self, partition: Portion) -> Iterator[pa.RecordBatch]:
        for m in partition.members:
            yield pa.RecordBatch.from_arrays([pa.array([m.archive]), pa.array([m.name]), pa.array([m.size], pa.int64()), pa.array([content(m)], pa.binary())], names=["archive", "name", "size", "content"])


class ZipMembers(DataSource):
    """Format ``zip_members``; options: ``paths`` (one a line), ``names`` (wanted ones, one a line; all if unset), ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        wanted = set(self.options["names"].split("\n")) if "names" in self.options else None
        found = [m for p in self.options["paths"].split("\n") if p for m in directory(p) if wanted is None or m.name in wanted]
        return _Reader(found, int(self.options.get("partition_bytes", 1 << 26)))


def members(spark: SparkSession, paths: list[str], names: list[str] | None = None, done: DataFrame | None = None, partition_bytes: int = 1 << 26) -> DataFrame:
    """archive, name, size, content of the wanted members; those in ``done`` (name) are left out, as a resumed run needs it.

    Names and what is done reach the driver, which plans with the central directory in hand.
    """
    spark.dataSource.register(ZipMembers)
    reader = spark.read.format("zip_members").option("paths", "\n".join(paths)).option("partition_bytes", partition_bytes)
    if done is not None:
        have = {r[0] for r in done.select("name").distinct().collect()}
        names = [n for n in (names if names is not None else [m.name for p in paths for m in directory(p)]) if n not in have]
    return reader.option("names", "\n".join(names)).load() if names is not None else reader.load()


def write_archives(rows: DataFrame, folder: str, archives: int = 8) -> list[str]:
    """Writes rows (name, content) into zip archives of a folder that the driver and all executors can
    open, and returns their paths. A task streams one archive under a name of its own, so that a
    repeated task leaves no half of one behind."""
    place = folder.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(place, exist_ok=True)
        path, wrote = f"{place}/{uuid.uuid4().hex}.zip", 0
        with zipfile.ZipFile(f"{path}.part", "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    z.writestr(name, data or b"")
                    wrote += 1
        if wrote:
            os.replace(f"{path}.part", path)
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])
        else:
            os.remove(f"{path}.part")

    return [r[0] for r in rows.select("name", "content").repartition(archives, "name").mapInArrow(run, "path string").collect()]
