"""Media columns in archives: a Spark data source over zip files of images.

Writing: each task streams its rows into archives of its own in a shared folder; a member is a grey 8-bit PNG.  An archive appears
under its final name once it is complete, so a task that runs again leaves the same files.

Reading: the source plans byte ranges of the archives from file sizes alone.  A range's reader takes the members whose headers start
in it, each by its offset: one that can't be read or fails its checksum is opened anew and tried again, without touching the others.
Members go on in Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import repeats, shared

#: Samples in an image row.
WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBERS = "doc_id long, n_bytes long, archive string, offset long, media binary"


def file_system(uri: str):
    """An Arrow file system and the path in it: file, hdfs, s3, gs, ... or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)


def payload(text: bytes) -> bytes:
    """Padded by zeros to a positive multiple of the width."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def encode_png(samples: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey samples, row by row, without row filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height = len(samples) // width
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, width)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + chunk(b"IEND", b"")


def decode_png(image: bytes) -> np.ndarray:
    """The samples (height x width) of an 8-bit grey PNG without row filters."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, shape = 8, [], None
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
            shape = (height, width)
        elif kind == b"IDAT":
            body.append(data)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("row filters aren't used here")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean (in thousandths) and a histogram of 8 bins."""
    h, w = samples.shape
    bins = np.bincount(samples.ravel() >> 5, minlength=8)
    return f"{w}x{h};mean={int(samples.sum(dtype=np.int64)) * 1000 // samples.size};hist=" + ",".join(map(str, bins.tolist()))


MANIFEST = "_manifest"


def write_archives(df: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """The texts of df(doc_id, text) as members of zip archives in a folder that all executors share.

    Each attempt of a task has archives of its own name; a list of those that the successful attempts have written comes last, and only
    listed archives are read.  So an attempt that is lost or repeated leaves nothing that counts, whatever the order of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        stream = archive = name = None
        members = written = 0
        names: list[str] = []

        def close() -> None:
            archive.close()
            stream.close()
            names.append(name)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), repeats.utf8(batch.column("text")), strict=True):
                if archive is None:
                    name = f"part-{task:06d}-{len(names):04d}-{attempt}.zip"
                    stream = fs.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                image = encode_png(payload(text))
                archive.writestr(zipfile.ZipInfo(f"{members:08d}_{'' if doc is None else doc}_{len(text)}.png"), image)
                members, written = members + 1, written + len(image)
                if written >= archive_bytes:
                    close()
                    archive, written = None, 0
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    df.mapInArrow(run, "archive string").write.parquet(f"{folder}/{MANIFEST}")


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, attempts: int):
        self.folder, self.range_bytes, self.attempts = folder, range_bytes, attempts

    def partitions(self) -> list[Range]:
        from pyarrow import fs as arrow

        fs, root = file_system(self.folder)
        found = fs.get_file_info(arrow.FileSelector(root, allow_not_found=True))
        listed = self.listed(fs, f"{root}/{MANIFEST}")
        sizes = sorted((f.path, f.size) for f in found if f.base_name.startswith("part-") and (listed is None or f.base_name in listed))
        return [Range(p, a, min(size, a + self.range_bytes)) for p, size in sizes for a in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    @staticmethod
    def listed(fs, path: str) -> set[str] | None:
        """The names in the manifest, one for each archive; None where there is no manifest, and all archives count."""
        import pyarrow.parquet as pq
        from pyarrow import fs as arrow

        files = [f.path for f in fs.get_file_info(arrow.FileSelector(path, allow_not_found=True)) if f.base_name.startswith("part-")]
        return {n for f in files for n in pq.read_table(f, filesystem=fs).column("archive").to_pylist()} if files else None

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = file_system(self.folder)
        with fs.open_input_file(partition.archive) as stream, zipfile.ZipFile(stream) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        rows: list[tuple] = []
        size = 0
        for m in sorted(members, key=lambda m: m.header_offset):
            _, doc, n = m.filename.removesuffix(".png").split("_")
            image = self.member(fs, partition.archive, m)
            rows.append((int(doc) if doc else None, int(n), partition.archive.rpartition("/")[2], m.header_offset, image))
            size += len(image)
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def member(self, fs, path: str, m: zipfile.ZipInfo) -> bytes:
        """A member by its offset; its checksum is verified.  Each attempt opens the archive anew."""
        for attempt in range(1, self.attempts + 1):
            try:
                with fs.open_input_file(path) as stream:
                    stream.seek(m.header_offset)
                    head = stream.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise zipfile.BadZipFile("no member starts here")
                    name, extra = struct.unpack_from("<HH", head, 26)
                    stream.seek(m.header_offset + 30 + name + extra)
                    body = stream.read(m.compress_size)
                if len(body) != m.file_size or zlib.crc32(body) != m.CRC:
                    raise zipfile.BadZipFile("the member fails its checksum")
                return body
            except (OSError, zipfile.BadZipFile) as e:
                if attempt == self.attempts:
                    raise OSError(f"{path}, member at {m.header_offset}: {e}") from e
        raise AssertionError

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "archive", "offset", "media"])


class ArchiveSource(DataSource):
    """spark.read.format("echofold_archive").option("path", folder): options range_bytes and attempts."""

    @classmethod
    def name(cls) -> str:
        return "echofold_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("attempts", ATTEMPTS)))


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, archive, offset, media of every member."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).option("path", folder).option("range_bytes", str(range_bytes)).load()


def decode(df: DataFrame) -> DataFrame:
    """Of df(doc_id, n_bytes, media): the payload's and the stored form's sizes and digests, and the feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image in batch.column("media").to_pylist():
                samples = decode_png(image)
                raw = samples.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_columns(df: DataFrame) -> DataFrame:
    """Every text of df(doc_id, text, ...) stored as an image in archives, read back and described.

    A null text counts as empty: 64 zero samples.  Repeated rows are members of their own; a null doc_id stays null.  Other columns are left out.
    The archives stay in the shared folder, since the result reads them.
    """
    spark = df.sparkSession
    shared.prepare(spark)
    folder = shared.shared_path(spark, "archives")
    write_archives(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), folder)
    return decode(read_archives(spark, folder))
