"""One file from all partitions of a table: a data source writer with a commit.

Every task writes the lines of its partition to a part of its own and tells the commit where it is and how many lines it has.  The commit joins the parts
of the tasks that succeeded, in the order of the partitions, between a header and a footer that the file has once; parts of failed attempts are never
read.  Bytes are copied in bounded pieces.  A file that people open is small by its purpose; large tables are written as folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import stages

FORMAT = "echofold_onefile"
COPY_BYTES = 1 << 20


def file_system(uri: str):
    """The Arrow file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    lines: int


class OneFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.header, self.separator, self.footer, self.empty = (json.loads(options[k]) for k in ("header", "separator", "footer", "empty"))
        self.folder = f"{self.path}.parts-{options['token']}"

    def write(self, iterator: Iterator) -> Part:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        partition, lines = TaskContext.get().partitionId(), 0
        path, separator = f"{folder}/{partition}-{uuid.uuid4().hex}", self.separator.encode()
        with fs.open_output_stream(path, compression=None) as out:
            for batch in iterator:
                found = [v.encode() for v in batch.column("value").to_pylist() if v is not None]
                if found:
                    out.write((separator if lines else b"") + separator.join(found))
                    lines += len(found)
        return Part(partition, path, lines)

    def commit(self, messages: list[Part | None]) -> None:
        fs, path = file_system(self.path)
        parts = sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.partition)
        temporary = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary, compression=None) as out:
            out.write((self.header if parts else self.empty).encode())
            for i, part in enumerate(parts):
                if i:
                    out.write(self.separator.encode())
                with fs.open_input_stream(part.path, compression=None) as source:
                    while piece := source.read(COPY_BYTES):
                        out.write(piece)
            if parts:
                out.write(self.footer.encode())
        with fs.open_output_stream(f"{path}.counts", compression=None) as out:
            out.write(json.dumps({"lines": sum(m.lines for m in parts), "parts": len(parts)}).encode())
        fs.move(temporary, path)
        self._clear(fs)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(file_system(self.path)[0])

    def _clear(self, fs) -> None:
        from pyarrow.fs import FileType

        folder = file_system(self.folder)[1]
        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> OneFileWriter:
        return OneFileWriter(self.options)


def write_lines(df: DataFrame, path: str, header: str = "", separator: str = "\n", footer: str = "\n", empty: str = "") -> dict[str, int]:
    """df(value), in its order, as one file; an earlier file there is replaced.  Gives the counts that the commit has: lines and parts.

    header and footer stand there once, `empty` alone where there are no rows; null values are left out.
    """
    spark = df.sparkSession
    stages.prepare(spark)
    spark.dataSource.register(OneFile)
    fs, target = file_system(path)
    fs.create_dir(target.rpartition("/")[0], recursive=True)
    texts = {"header": header, "separator": separator, "footer": footer, "empty": empty}
    rows = df.select(df["value"].cast("string").alias("value"))
    rows.write.format(FORMAT).options(token=uuid.uuid4().hex, **{k: json.dumps(v) for k, v in texts.items()}).mode("append").save(path)
    with fs.open_input_stream(f"{target}.counts", compression=None) as source:
        counts = json.loads(source.read())
    fs.delete_file(f"{target}.counts")
    return counts
