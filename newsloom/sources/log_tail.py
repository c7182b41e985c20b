"""The ends of log files: a data source that reads the last bytes of each file, from the first whole line on.

    spark.dataSource.register(LogTail)
    spark.read.format("log_tail").option("bytes", 500_000).load(folder)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fixed value: bytes of a log that are read
TAIL = 500_000


class Tail(InputPartition):
    def __init__(self, path: str, start: int, size: int):
        super().__init__((path, start, size))
        self.path, self.start, self.size = path, start, size


class LogTail(DataSource):
    """(file, value) of the lines, a partition for each file. Bytes that are no UTF-8 are dropped."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema) -> LogTailReader:
        return LogTailReader(self.options["path"], int(self.options.get("bytes", TAIL)))


class LogTailReader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[Tail]:
        import pyarrow.fs as fs

        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(root)
        found = [found] if found.is_file else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        logs = [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
        return [Tail(f.path, max(0, f.size - self.most), f.size) for f in logs]

    def read(self, partition: Tail | None) -> Iterator[tuple]:
        """Lines that begin within the last bytes; a folder without files is read as no partition."""
        import pyarrow.fs as fs

        if partition is None:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(partition.path) as f:
            at = max(0, partition.start - 1)  # one byte more tells whether a line begins there
            f.seek(at)
            tail = f.read(partition.size - at)
        if partition.start:
            tail = tail[tail.index(b"\n") + 1 :] if b"\n" in tail else b""
        for line in tail.removesuffix(b"\n").split(b"\n") if tail else []:
            yield partition.path, line.decode("utf-8", "ignore").removesuffix("\r")
