"""Follower lists as packed big-endian unsigned 64-bit integers: a Spark data source for reading and writing.

``<first two digits>/<user id>.fws`` holds the followers of one user in order, eight bytes each; ``.fws.gz`` the same
through gzip, of one member or several; ``<user id>.<number>.fws`` what was appended later. Reading plans partitions of bounded
size and yields Arrow batches; paths are those of pyarrow's file systems, local ones must be shared by all executors.
"""

from __future__ import annotations

import gzip
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from larkspur.operators.graph import numbered
from larkspur.sources.files import opened
from larkspur.sources.schemas import FOLLOWER

NAME = re.compile(r"([0-9]+)(?:\.([0-9]+))?\.fws(\.gz)?$")
#: Bytes that a partition reads, and that are read at a time.
SPLIT = 64 << 20
CHUNK = 1 << 20
ID = pa.decimal128(20, 0)


class Piece(InputPartition):
    """Some bytes of a file, all behind ``start`` if ``size`` is none; first: the place of their first follower in the user's list."""

    def __init__(self, folder: str, file: str, user: str, first: int, start: int, size: int | None):
        super().__init__(file)
        self.folder, self.file, self.user, self.first, self.start, self.size = folder, file, user, first, start, size


@dataclass
class Written(WriterCommitMessage):
    """(temporary file, the user's path without its ending, place of the file's first follower)."""

    paths: list[tuple[str, str, int]]


def stream_of(system: pyarrow.fs.FileSystem, file: str):
    """The list's bytes; those of a gzip file to the end of its last member."""
    data = system.open_input_stream(file, compression=None)
    return gzip.GzipFile(fileobj=data) if file.endswith(".gz") else data


def unpacked_size(system: pyarrow.fs.FileSystem, file: str) -> int:
    """Bytes of a gzip file's list, by reading it: what the file says of its size is that of its last member, modulo 2^32."""
    with stream_of(system, file) as data:
        return sum(len(raw) for raw in iter(lambda: data.read(CHUNK), b""))


def lists_of(folder: str) -> dict[str, list[pyarrow.fs.FileInfo]]:
    """Each user's files in the order in which they were written."""
    system, inside = opened(folder)
    users: dict[str, list[tuple[int, pyarrow.fs.FileInfo]]] = {}
    for info in system.get_file_info(pyarrow.fs.FileSelector(inside, recursive=True, allow_not_found=True)):
        if info.type == pyarrow.fs.FileType.File and (found := NAME.search(info.base_name)):
            users.setdefault(found[1], []).append((int(found[2] or 0), info))
    return {user: [info for _, info in sorted(files, key=lambda x: x[0])] for user, files in sorted(users.items())}


def ids_of(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as decimals of 20 digits."""
    both = np.zeros((len(values), 2), "<u8")
    both[:, 0] = values
    return pa.Decimal128Array.from_buffers(ID, len(values), [None, pa.py_buffer(both.tobytes())])


class PackedReader(DataSourceReader):
    """Plans partitions of bounded size; gzip files can't be cut, and are read in planning only if more files of their user follow."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Piece]:
        system, _ = opened(self.folder)
        out = []
        for user, files in lists_of(self.folder).items():
            first = 0
            for k, info in enumerate(files):
                if info.path.endswith(".gz"):
                    out.append(Piece(self.folder, info.path, user, first, 0, None))
                    first += unpacked_size(system, info.path) // 8 if k + 1 < len(files) else 0
                    continue
                whole = info.size // 8 * 8
                out += [Piece(self.folder, info.path, user, first + at // 8, at, min(SPLIT, whole - at)) for at in range(0, whole, SPLIT)]
                first += whole // 8
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not getattr(partition, "file", None):
            return
        system, _ = opened(partition.folder)
        pos, left, rest = partition.first, partition.size, b""
        user = np.array([int(partition.user)], np.uint64)
        whole = partition.file.endswith(".gz")
        with stream_of(system, partition.file) if whole else system.open_input_file(partition.file) as data:
            if partition.start:
                data.seek(partition.start)
            while left is None or left > 0:
                raw = data.read(CHUNK if left is None else min(CHUNK, left))
                if not raw:
                    return
                left = None if left is None else left - len(raw)
                raw, rest = rest + raw, b""
                if cut := len(raw) % 8:
                    raw, rest = raw[:-cut], raw[-cut:]
                values = np.frombuffer(raw, ">u8")
                n = len(values)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [ids_of(np.repeat(user, n)), ids_of(values), pa.array(np.arange(pos, pos + n))], names=["user_id", "follower_id", "pos"]
                    )
                pos += n


class PackedWriter(DataSourceWriter):
    """Writes rows of a user, which must be together and in order in a task, to temporary files that the commit renames, one by one.

    A user's rows may be several tasks': their files follow one another by their first places. An append is a further file of the user,
    numbered from the greatest that is there, so nothing that is stored is written again; a crash inside the commit leaves
    some users with their rows and others without, never half a file.
    """

    def __init__(self, folder: str, append: bool):
        self.folder, self.append = folder, append

    def write(self, rows) -> Written:
        system, inside = opened(self.folder)
        paths: list[tuple[str, str, int]] = []
        out, user = None, None
        for row in rows:
            if row["user_id"] != user:
                if out:
                    out.close()
                user = row["user_id"]
                shard = f"{inside}/{str(int(user))[:2]}"
                system.create_dir(shard, recursive=True)
                base = f"{shard}/{int(user)}"
                temporary = f"{base}.{uuid.uuid4().hex}.tmp"
                out = system.open_output_stream(temporary)
                paths.append((temporary, base, int(row["pos"])))
            out.write(struct.pack("!Q", int(row["follower_id"])))
        if out:
            out.close()
        return Written(paths)

    def commit(self, messages) -> None:
        system, _ = opened(self.folder)
        stored = lists_of(self.folder)
        written: dict[str, list[tuple[int, str]]] = {}
        for message in messages:
            for temporary, base, first in message.paths if message else []:
                written.setdefault(base, []).append((first, temporary))
        for base, parts in written.items():
            files = stored.get(base.rsplit("/", 1)[1], [])
            number = max([int(NAME.search(x.base_name)[2] or 0) for x in files], default=-1) + 1 if self.append else 0
            names = [f"{base}.{k:06d}.fws" if k else f"{base}.fws" for k in range(number, number + len(parts))]
            for name, (_, temporary) in zip(names, sorted(parts)):
                system.move(temporary, name)
            for info in [] if self.append else files:
                if info.path not in names:
                    system.delete_file(info.path)

    def abort(self, messages) -> None:
        system, _ = opened(self.folder)
        for message in messages:
            for temporary, *_ in message.paths if message else []:
                if system.get_file_info(temporary).type != pyarrow.fs.FileType.NotFound:
                    system.delete_file(temporary)


class PackedFollowers(DataSource):
    """``spark.read.format("packed_followers").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "packed_followers"

    def schema(self) -> str:
        return FOLLOWER

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], not overwrite)


def read_followers(spark: SparkSession, folder: str, cursor: int = 0) -> DataFrame:
    """(user_id, follower_id, pos) of packed lists, from a cursor on."""
    spark.dataSource.register(PackedFollowers)
    return spark.read.format("packed_followers").load(folder).where(F.col("pos") >= cursor)


def write_followers(rows: DataFrame, folder: str, append: bool = True) -> None:
    """Appends (or rewrites) followers of each user in the order of pos; rows are dealt by ranges of user and pos, so a user may be several tasks' and files'."""
    rows.sparkSession.dataSource.register(PackedFollowers)
    ordered = rows.select(F.col("user_id").cast("decimal(20,0)"), F.col("follower_id").cast("decimal(20,0)"), F.col("pos").cast("bigint"))
    ordered = ordered.repartitionByRange("user_id", "pos").sortWithinPartitions("user_id", "pos")
    ordered.write.format("packed_followers").mode("append" if append else "overwrite").save(folder)


def followers_from_text(spark: SparkSession, path: str, user_id: int) -> DataFrame:
    """Followers of decimal lists, one a line, file after file; other lines are skipped, order is kept.

    Files are read in splits, in the order of their names and places, and numbered part by part.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    ids = lines.selectExpr("file", "block", "line", "try_cast(trim(value) as decimal(20,0)) as follower_id").where("follower_id is not null")
    rows = numbered(ids, "file", "block", "line", base=-1, name="pos")
    return rows.select(F.lit(user_id).cast("decimal(20,0)").alias("user_id"), "follower_id", F.col("pos").cast("bigint").alias("pos"))
