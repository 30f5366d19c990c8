"""Media columns: a Spark data source over directories of zip archives, and the writer of such directories.

The source plans byte ranges of the archives; the task of a range reads the archive's central directory and then those members whose
header starts in its range. Payloads come in Arrow batches. A member that can't be read is tried again by its offset, on its
own, with the file opened anew; at last it gives a row that tells the error.
"""

from __future__ import annotations

import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "archive string, member string, offset bigint, stored_bytes bigint, payload binary, attempts int, error string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("stored_bytes", pa.int64()), ("payload", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])
RANGE_BYTES = 128 << 20
BATCH_BYTES, BATCH_MEMBERS = 4 << 20, 500
RETRIES, PAUSE_S = 3, 0.2
#: A member that says it is larger than this isn't inflated; its row tells so.
MEMBER_BYTES = 1 << 30


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A path or URI as (file system, path in it)."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    archive: str
    low: int
    high: int


class Unreadable(ValueError):
    """What no second try mends."""


def read_member(file: pa.NativeFile, info: zipfile.ZipInfo, most: int = MEMBER_BYTES) -> bytes:
    """The payload at a member's offset, checked against its size and CRC; no more than its size is inflated."""
    if max(info.file_size, info.compress_size) > most:
        raise Unreadable(f"member of {max(info.file_size, info.compress_size)} bytes; at most {most} are read")
    if info.flag_bits & 1:
        raise Unreadable("member is encrypted")
    if info.compress_type not in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED):
        raise Unreadable(f"compression {info.compress_type} isn't supported")
    file.seek(info.header_offset)
    header = file.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise ValueError("no member header at its offset")
    name, extra = struct.unpack("<HH", header[26:30])
    file.seek(info.header_offset + 30 + name + extra)
    data = file.read(info.compress_size)
    if info.compress_type == zipfile.ZIP_DEFLATED:
        inflate = zlib.decompressobj(-15)
        data = inflate.decompress(data, info.file_size + 1)
    if len(data) != info.file_size:
        raise ValueError("payload isn't as long as its member says")
    if zlib.crc32(data) != info.CRC:
        raise ValueError("payload doesn't match its CRC")
    return data


class Members(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.most = int(options.get("memberbytes", MEMBER_BYTES))

    def partitions(self) -> list[Range]:
        system, path = located(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        prefix = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        found = [Range(prefix + f.path, low, min(low + self.range_bytes, f.size)) for f in files if f.type == fs.FileType.File and f.path.endswith(".zip") for low in range(0, max(f.size, 1), self.range_bytes)]
        return sorted(found, key=lambda r: (r.archive, r.low)) or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        system, path = located(part.archive)

        def row(name: str | None, offset: int | None, stored: int | None, data: bytes | None, attempts: int, error: str | None) -> dict:
            return {"archive": part.archive, "member": name, "offset": offset, "stored_bytes": stored, "payload": data, "attempts": attempts, "error": error}

        try:
            with system.open_input_file(path) as file:
                members = zipfile.ZipFile(file).infolist()
        except (OSError, ValueError, NotImplementedError, struct.error, zipfile.BadZipFile) as e:
            if part.low == 0:
                yield pa.RecordBatch.from_pylist([row(None, None, None, None, 1, f"{type(e).__name__}: {e}"[:500])], _ARROW)
            return
        mine = sorted((m for m in members if part.low <= m.header_offset < part.high and not m.is_dir()), key=lambda m: m.header_offset)
        rows, size, file = [], 0, None
        try:
            for info in mine:
                data, error, attempts = None, None, 0
                while attempts < self.retries and data is None:
                    attempts += 1
                    try:
                        file = file or system.open_input_file(path)
                        data, error = read_member(file, info, self.most), None
                    except Unreadable as e:
                        error = f"{type(e).__name__}: {e}"[:500]
                        break
                    except (OSError, ValueError, struct.error, zlib.error) as e:
                        error = f"{type(e).__name__}: {e}"[:500]
                        if isinstance(e, OSError) and attempts < self.retries:
                            time.sleep(PAUSE_S * attempts)
                        if file:
                            file.close()
                        file = None
                rows.append(row(info.filename, info.header_offset, info.compress_size, data, attempts, error))
                size += len(data or b"")
                if size > BATCH_BYTES or len(rows) >= BATCH_MEMBERS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        finally:
            if file:
                file.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class ArchiveSource(DataSource):
    """``spark.read.format("archive_members").load(directory)``; options rangeBytes, retries, memberBytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Members:
        return Members({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, directory: str, range_bytes: int = RANGE_BYTES, retries: int = RETRIES, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """One row of SCHEMA for each member of the archives below a directory (or of one archive), in no order. Empty members: empty payloads.
    Broken members, encrypted ones, those of an unknown compression and those that say they have more than ``member_bytes``: null payload and the error; broken archives: one row with a null member. Members of the same name stay apart, by
    their offset. A directory that is empty or missing: no rows."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_members").option("rangeBytes", range_bytes).option("retries", retries).option("memberBytes", member_bytes).load(directory)


def write(rows: DataFrame, directory: str, archive_bytes: int = 256 << 20, level: int = 6) -> int:
    """Write rows (member STRING, payload BINARY or STRING) as zip archives, at least one for each partition with rows; returns the number of
    members. Rows with a null member or payload are left out; repeated names make repeated members; other columns play no part. An archive is written under another
    name and then renamed, so that a task that is run again replaces its own. ``archive_bytes`` of payloads go to one archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, path = located(directory)
        system.create_dir(path, recursive=True)
        part, attempt = context.partitionId(), context.taskAttemptId()
        out, archive, written, count, number = None, None, 0, 0, 0

        def finish() -> None:
            archive.close()
            out.close()
            system.move(f"{path}/part-{part:06}-{number:04}.{attempt}.tmp", f"{path}/part-{part:06}-{number:04}.zip")

        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    out = system.open_output_stream(f"{path}/part-{part:06}-{number:04}.{attempt}.tmp")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level)
                info = zipfile.ZipInfo(name)
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, payload, compresslevel=level)
                written += len(payload)
                count += 1
                if written >= archive_bytes:
                    finish()
                    archive, written, number = None, 0, number + 1
        if archive is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([count])], ["n"])

    slim = rows.where("member is not null and payload is not null").select("member", F.col("payload").cast("binary").alias("payload"))
    return slim.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def media_type(payload: Column, member: Column) -> Column:
    """By the first bytes of the payload, else by the ending of the name; null of a null payload."""

    def head(hexes: str, at: int = 1) -> Column:
        return F.hex(F.substring(payload, at, len(hexes) // 2)) == hexes

    magic = F.when(head("89504E470D0A1A0A"), "image/png").when(head("FFD8FF"), "image/jpeg").when(head("474946383761") | head("474946383961"), "image/gif")
    magic = magic.when(head("52494646") & head("57454250", 9), "image/webp").when(head("52494646") & head("57415645", 9), "audio/wav").when(head("25504446"), "application/pdf")
    magic = magic.when(head("66747970", 5), "video/mp4").when(head("494433"), "audio/mpeg").when(head("4F676753"), "audio/ogg").when(head("664C6143"), "audio/flac").when(head("1A45DFA3"), "video/webm")
    name = F.lower(member)
    magic = magic.when(name.endswith(".html") | name.endswith(".htm"), "text/html").when(name.endswith(".txt"), "text/plain").when(name.endswith(".json"), "application/json")
    return F.when(payload.isNotNull(), magic.otherwise("application/octet-stream"))


def jpeg_sizes(payload: pd.Series) -> pd.DataFrame:
    """Width and height from JPEGs' frame headers; null where there is none."""

    def size(data: bytes | None) -> tuple[int | None, int | None]:
        at = 2
        while data and at + 9 <= len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD9 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return None, None

    return pd.DataFrame([size(d) for d in payload], columns=["width", "height"], dtype="Int32")


def columns(members: DataFrame) -> DataFrame:
    """Members with media_type, n_bytes, md5; width and height of PNG, GIF and JPEG images; channels, sample_rate and seconds of WAV audio; columns of these names are replaced.
    Null where the payload isn't of such a kind, or too short for its header."""
    p = F.col("payload")

    def number(at: int, size: int, little: bool = False) -> Column:
        parts = [F.hex(F.substring(p, at + k, 1)) for k in range(size)]
        return F.conv(F.concat(*(parts[::-1] if little else parts)), 16, 10).cast("bigint")

    kind = media_type(p, F.col("member"))
    frame = F.pandas_udf(jpeg_sizes, "struct<width:int,height:int>")(F.when(kind == "image/jpeg", p))
    wav, rate = kind == "audio/wav", number(29, 4, True)
    told = members.withColumns({"media_type": kind, "n_bytes": F.octet_length(p).cast("bigint"), "md5": F.md5(p), "_frame": frame})
    return told.withColumns(
        {
            "width": F.when(kind == "image/png", number(17, 4)).when(kind == "image/gif", number(7, 2, True)).otherwise(F.col("_frame.width")).cast("int"),
            "height": F.when(kind == "image/png", number(21, 4)).when(kind == "image/gif", number(9, 2, True)).otherwise(F.col("_frame.height")).cast("int"),
            "channels": F.when(wav, number(23, 2, True)).cast("int"), "sample_rate": F.when(wav, number(25, 4, True)).cast("int"),
            "seconds": F.when(wav & (rate > 0), F.round((F.octet_length(p) - 44) / rate, 3)),
        }
    ).drop("_frame")
