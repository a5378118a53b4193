"""A data source that lists and reads a tree of files in many tasks.

Spark's own file readers pass over names that start with ``_`` or ``.`` and over files without a byte; source trees have ``__init__.py`` and ``.gitignore``.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size bigint, status string, content binary"
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("status", pa.string()), ("content", pa.binary())])
#: A batch is handed on when it holds this many bytes or rows.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 4096


def skips(path: str, names: list[str]) -> bool:
    """Whether a run of whole components of ``path`` is one of ``names``."""
    padded = f"/{path}/"
    return any(f"/{name.strip('/')}/" in padded for name in names)


class LocalFiles:
    """Folders of the machine or of a mounted share; links are neither followed nor listed."""

    def __init__(self, root: str):
        self.root = root

    def entries(self, folder: str) -> list[tuple[str, bool, int]]:
        """(path, is a folder, size) of what a folder holds, by name; a folder that is gone or closed to us holds nothing."""
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                names = sorted(found, key=lambda e: e.name)
        except OSError:
            return []
        out = []
        for entry in names:
            try:
                info = entry.stat(follow_symlinks=False)
            except OSError:
                continue
            if stat.S_ISDIR(info.st_mode) or stat.S_ISREG(info.st_mode):
                out.append((f"{folder}/{entry.name}".lstrip("/"), stat.S_ISDIR(info.st_mode), info.st_size))
        return out

    def read(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as file:
            return file.read()


class RemoteFiles:
    """Folders of a store that Arrow knows by its URI."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(root)
        self.base = self.base.rstrip("/")

    def entries(self, folder: str) -> list[tuple[str, bool, int]]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/{folder}".rstrip("/"), allow_not_found=True))
        kinds = (fs.FileType.File, fs.FileType.Directory)
        return sorted((f.path[len(self.base) + 1 :], f.type == fs.FileType.Directory, f.size or 0) for f in found if f.type in kinds)

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(f"{self.base}/{path}") as file:
            return file.read()


def files_of(root: str) -> LocalFiles | RemoteFiles:
    if "://" in root and not root.startswith("file://"):
        return RemoteFiles(root)
    return LocalFiles(root.removeprefix("file://"))


class Folders(InputPartition):
    """What one task lists: some folders alone (their files), others with all below them."""

    def __init__(self, alone: list[str], whole: list[str]):
        super().__init__(0)
        self.alone, self.whole = alone, whole


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"].rstrip("/")
        self.names = json.loads(options.get("excluded", "[]"))
        self.suffixes = json.loads(options.get("suffixes", "[]"))
        self.also = set(json.loads(options.get("also", "[]")))
        self.max_bytes, self.tasks = int(options.get("max_bytes", "2000000")), int(options.get("tasks", "64"))

    def partitions(self) -> list[Folders]:
        """Folders are opened level by level until there is one for each task; at most ``tasks`` are open on a level, so planning stays small."""
        store, alone, level = files_of(self.root), [], [""]
        while level and len(level) < self.tasks:
            alone += level
            level = [p for folder in level for p, is_folder, _ in store.entries(folder) if is_folder and not skips(p, self.names)]
        parts = [Folders(alone[i :: self.tasks], level[i :: self.tasks]) for i in range(self.tasks)]
        return [p for p in parts if p.alone or p.whole] or [Folders([""], [])]

    def _wanted(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return name in self.also or ("." in name and name.rsplit(".", 1)[-1].lower() in self.suffixes)

    def _walk(self, store: LocalFiles | RemoteFiles, part: Folders) -> Iterator[tuple[str, int]]:
        stack = [(folder, True) for folder in part.whole] + [(folder, False) for folder in part.alone]
        while stack:
            folder, deep = stack.pop()
            for path, is_folder, size in store.entries(folder):
                if skips(path, self.names):
                    continue
                if is_folder:
                    if deep:
                        stack.append((path, True))
                elif self._wanted(path):
                    yield path, size

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, rows, held = files_of(self.root), [], 0
        for path, size in self._walk(store, partition):
            status, content = "too_large", None
            if size <= self.max_bytes:
                try:
                    status, content = "read", store.read(path)
                except OSError:  # gone or closed since it was listed
                    status = "unreadable"
            rows.append((path, size, status, content))
            held += len(content or b"")
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class TreeSource(DataSource):
    """Options: root, excluded and suffixes and also (lists as JSON), max_bytes, tasks."""

    @classmethod
    def name(cls) -> str:
        return "evigraph_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
