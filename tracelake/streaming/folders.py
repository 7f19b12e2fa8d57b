"""Folders that are watched: files are passed on once, after they have been quiet for a while.

``FolderSource`` is a streaming source that lists a folder at every trigger: one row a file and look, (path, length,
modified, seen). ``stable_files`` keeps, for each path, what it looked like last and since when; a file that has had one
length and time for ``quiet_s`` is passed on, and its state then only remembers that. Looks live in the stream's
checkpoint, so that a restart passes nothing on twice.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOOK = "path string, length long, modified double, seen double"
STABLE = "path string, length long, modified double, stable double"
STATE = "length long, modified double, since double, passed boolean"


class FolderReader(SimpleDataSourceStreamReader):
    """Lists ``path`` (any store that pyarrow opens) for names with ``suffix``; hidden names are left out."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def _looks(self) -> list[tuple]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        now = time.time()
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        named = [f for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_"))]
        return [(f.path, f.size, (f.mtime_ns or 0) / 1e9, now) for f in named]

    def initialOffset(self) -> dict:
        return {"look": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter(self._looks()), {"look": start["look"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        # A look cannot be had again; after a restart the folder is seen as it is now.
        return iter(self._looks())

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_looks"

    def schema(self) -> str:
        return LOOK

    def simpleStreamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def looks(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("folder_looks").option("path", path).option("suffix", suffix).load()


def stable_files(seen: DataFrame, quiet_s: float = 1.0) -> DataFrame:
    """Looks (path, length, modified, seen) to files (path, length, modified, stable), each path once.

    A look with another length or time starts the wait anew; looks of one batch are taken by their time. Empty files wait
    like others. What happens to a path after it was passed on is no longer followed.
    """

    def run(key, parts, state: GroupState):
        pdf = pd.concat(list(parts), ignore_index=True).sort_values("seen", kind="stable")
        length, modified, since, passed = state.get if state.exists else (None, None, None, False)
        out = []
        for row in pdf.itertuples():
            if passed:
                break
            if (row.length, row.modified) != (length, modified):
                length, modified, since = int(row.length), float(row.modified), float(row.seen)
            elif row.seen - since >= quiet_s:
                passed = True
                out.append((key[0], length, modified, float(row.seen)))
        state.update((length, modified, since, passed))
        if out:
            yield pd.DataFrame(out, columns=["path", "length", "modified", "stable"])

    return seen.where("path is not null").groupBy("path").applyInPandasWithState(run, STABLE, STATE, "append", GroupStateTimeout.NoTimeout)
