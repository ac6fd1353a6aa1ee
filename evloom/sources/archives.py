"""Uncompressed tar archives as Spark sources: an index of members without their contents, and members in parts
with receipts. Both also as streams, whose offsets (the next header of each archive) Spark keeps in the
checkpoint: a stopped scan goes on at the header where it ended.

Paths are those of pyarrow's file systems (local, hdfs://, s3://, gs://); only headers and what is extracted
are read. Links, sparse files and extension headers, unsafe or repeated names, and sizes beyond the archive
are errors, as is an archive without its end mark.
"""

from __future__ import annotations

import hashlib
import json
import re
import tarfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK = 512
INDEX = "archive string, name string, header long, offset long, size long"
PARTS = f"{INDEX}, part int, data binary, sha256 string"


def opened(path: str):
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def members(file, archive: str, size: int, start: int, pattern: str) -> Iterator[tuple[tarfile.TarInfo | None, int, int]]:
    """(member, its header, the next header) from a header on; (None, end mark, end mark) at the end."""
    at = start
    if at < 0 or at % BLOCK or at > size:
        raise ValueError(f"{archive}: no header can begin at {at}")
    while True:
        if at + BLOCK > size:
            raise ValueError(f"{archive}: no end mark")
        file.seek(at)
        raw = file.read(BLOCK)
        if raw == bytes(BLOCK):
            yield None, at, at
            return
        try:
            member = tarfile.TarInfo.frombuf(raw, "utf-8", "strict")
        except (tarfile.HeaderError, UnicodeError) as e:
            raise ValueError(f"{archive}: no header at {at}") from e
        if member.type not in (tarfile.REGTYPE, tarfile.AREGTYPE, tarfile.DIRTYPE):
            raise ValueError(f"{archive}: {member.name} is of type {member.type!r}")
        behind = at + BLOCK + (member.size + BLOCK - 1) // BLOCK * BLOCK
        if member.isfile():
            if not re.fullmatch(pattern, member.name) or ".." in member.name.split("/"):
                raise ValueError(f"{archive}: unsafe name {member.name}")
            if member.size < 0 or at + BLOCK + member.size > size:
                raise ValueError(f"{archive}: {member.name} goes beyond the end")
        yield member, at, behind
        at = behind


class Range(InputPartition):
    """Headers from `start` to before `end` (None: to the end mark) of an archive."""

    def __init__(self, archive: str, start: int, end: int | None):
        self.archive, self.start, self.end = archive, start, end


class _Tar:
    def __init__(self, options: dict):
        self.archives = [p.strip() for p in options["path"].split(",")]
        self.most = int(options.get("members", "1000"))
        self.chunk = int(options.get("chunk", str(4 << 20)))
        self.content = options.get("content", "false") == "true"
        self.pattern = options.get("names", r"[A-Za-z0-9_./-]+")

    def read(self, partition: Range) -> Iterator[tuple]:
        seen: set[str] = set()
        with opened(partition.archive) as file:
            for member, at, _ in members(file, partition.archive, file.size(), partition.start, self.pattern):
                if member is None or (partition.end is not None and at >= partition.end):
                    return
                if not member.isfile():
                    continue
                if member.name in seen:
                    raise ValueError(f"{partition.archive}: repeated name {member.name}")
                seen.add(member.name)
                row = (partition.archive, member.name, at, at + BLOCK, member.size)
                if self.content:
                    yield from self.parts(file, row)
                else:
                    yield row

    def parts(self, file, row: tuple) -> Iterator[tuple]:
        """The member's content in parts; the last one (an empty one, if there are none) has its hash."""
        h, left, k = hashlib.sha256(), row[4], 0
        file.seek(row[3])
        while True:
            data = file.read(min(self.chunk, left))
            if len(data) < min(self.chunk, left):
                raise ValueError(f"{row[0]}: {row[1]} is cut short")
            h.update(data)
            left -= len(data)
            yield (*row, k, data, None if left else h.hexdigest())
            if not left:
                return
            k += 1


class TarReader(_Tar, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [Range(a, 0, None) for a in self.archives]


class TarStream(_Tar, DataSourceStreamReader):
    """Up to `members` members of each archive a micro-batch; a partition is a range of headers."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.told: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": json.dumps(dict.fromkeys(self.archives, 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        """One step behind what was told last: headers alone are read."""
        now = self.told or dict.fromkeys(self.archives, 0)
        self.told = {a: self.step(a, now[a]) for a in self.archives}
        return {"next": json.dumps(self.told)}

    def step(self, archive: str, start: int) -> int:
        with opened(archive) as file:
            n = 0
            for _, _, behind in members(file, archive, file.size(), start, self.pattern):
                n += 1
                if n == self.most:
                    return behind
            return behind

    def partitions(self, start: dict, end: dict) -> list[Range]:
        a, b = json.loads(start["next"]), json.loads(end["next"])
        self.told = b if self.told is None else self.told
        return [Range(x, a.get(x, 0), b[x]) for x in self.archives if b[x] > a.get(x, 0)]

    def commit(self, end: dict) -> None:
        pass


class TarSource(DataSource):
    """Format "tar". Options: path (archives, comma-separated), names (a pattern that member names match),
    content (true: PARTS instead of INDEX), chunk (bytes a part), members (a micro-batch)."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return PARTS if self.options.get("content", "false") == "true" else INDEX

    def reader(self, schema) -> TarReader:
        return TarReader(dict(self.options))

    def streamReader(self, schema) -> TarStream:  # noqa: N802
        return TarStream(dict(self.options))


def read_tar(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(TarSource)
    return spark.read.format("tar").options(path=path, **options).load()


def stream_tar(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(TarSource)
    return spark.readStream.format("tar").options(path=path, **options).load()


def distinct_members(index: DataFrame) -> DataFrame:
    """The index, or an error at a name that an archive has twice (also across micro-batches)."""
    again = index.groupBy("archive", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("header", "offset", "size")).alias("m"))
    fine = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated name "), "name")).cast("boolean"))
    return again.where(fine).select("archive", "name", "m.*")


def receipts(parts: DataFrame) -> DataFrame:
    """archive, name, offset, size, sha256 of members that are there whole: their parts follow one another
    and have their bytes; an empty member is an error, as is one whose parts don't fit."""
    own = parts.groupBy("archive", "name", "offset", "size").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("d"), F.max("part").alias("last"), F.sum(F.length("data")).alias("bytes"), F.max("sha256").alias("sha256")
    )
    why = F.when(F.col("size") == 0, "empty member ").when((F.col("n") != F.col("d")) | (F.col("last") + 1 != F.col("n")) | (F.col("bytes") != F.col("size")) | F.col("sha256").isNull(), "incomplete member ")
    return own.where(F.when(why.isNull(), True).otherwise(F.raise_error(F.concat(why, "name")).cast("boolean"))).select("archive", "name", "offset", "size", "sha256")


def same_receipts(found: DataFrame, known: DataFrame) -> DataFrame:
    """`found` without the members that `known` receipts hold already; an error where these tell of another source or content."""
    mine = found.join(known.select("archive", "name", *[F.col(c).alias(f"_{c}") for c in ("offset", "size", "sha256")]), ["archive", "name"], "left")
    other = F.col("_size").isNotNull() & ((F.col("_offset") != F.col("offset")) | (F.col("_size") != F.col("size")) | (F.col("_sha256") != F.col("sha256")))
    fresh = F.when(~other, F.col("_size").isNull()).otherwise(F.raise_error(F.concat(F.lit("receipt of another source: "), "name")).cast("boolean"))
    return mine.where(fresh).select(*found.columns)
