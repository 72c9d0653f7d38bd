"""A stream of new and rewritten documents below a folder, hidden ones included.

Spark's file stream passes over names that begin with `.` or `_`, and over files that
are written again. This one lists the tree at each trigger and compares it with what it knows: an offset
is the number of a difference, and differences are kept in a folder of their own, so that a batch which is repeated
after a failure has the same rows, and a stream that starts again goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from docloom.operators.documents import DEFAULT_GARBAGE
from docloom.sources.documents import read_file
from docloom.sources.sinks import write_file
from docloom.sources.tree import PAGE, Globs, TreeReader, entries
from docloom.storage import open_store

SCHEMA = "base string, path string, full string, name string, length long, modified long"


class Rows(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(rows)
        self.rows = rows


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.tree = TreeReader(options)
        self.state, self.page = options["state"].rstrip("/"), int(options.get("page", PAGE))
        self.number, self.known = 0, None

    def _difference(self, number: int) -> dict:
        return json.loads(read_file(f"{self.state}/{number}.json"))

    def _load(self) -> None:
        """All differences so far, in their order, are what is known."""
        store, at = open_store(self.state)
        names = [i.base_name for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True))]
        self.number, self.known = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0), {}
        for number in range(1, self.number + 1):
            change = self._difference(number)
            self.known.update(change["files"])
            for path in change["gone"]:
                self.known.pop(path, None)

    def _listed(self) -> dict[str, list[int]]:
        wanted = self.tree.globs.file_test()
        found = {}
        for folder, _ in self.tree.walk():
            for e in entries(self.tree.base + folder):
                if not e.directory and wanted(path := f"{folder}/{e.name}"):
                    found[path] = [e.size(), e.modified()]
        return found

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        if self.known is None:
            self._load()
        now = self._listed()
        files = {p: v for p, v in now.items() if self.known.get(p) != v}
        gone = [p for p in self.known if p not in now]
        if files or gone:
            self.number += 1
            write_file(f"{self.state}/{self.number}.json", json.dumps({"files": files, "gone": gone}).encode())
            self.known = now
        return {"number": self.number}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        files: dict[str, list[int]] = {}
        for number in range(start["number"] + 1, end["number"] + 1):
            change = self._difference(number)
            files.update(change["files"])
            for path in change["gone"]:
                files.pop(path, None)
        base = self.tree.base
        rows = [(base, p, base + p, p.rsplit("/", 1)[-1], *v) for p, v in sorted(files.items())]
        return [Rows(rows[a : a + self.page]) for a in range(0, len(rows), self.page)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Nothing to forget: differences are what is known."""


class TreeStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "doctreestream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> TreeStreamReader:
        return TreeStreamReader(dict(self.options))


def watch_tree(spark: SparkSession, root: str, state: str, include=None, exclude=None, garbage=None, page: int = PAGE) -> DataFrame:
    """Files below `root`, each when it is new and again when its size or time changes: `base, path, full, name, length, modified`.

    The globs mean what they mean in `select_paths`; rejected folders are not entered. `state`, a folder that the driver can write, belongs to
    one stream, with its checkpoint. What is known of the tree, a record per file, is the driver's, as with any
    stream of files. A file that is seen half written arrives again when it has grown: write aside and rename. Files that vanish give no rows.
    """
    spark.dataSource.register(TreeStream)
    globs = Globs(list(include or []), list(exclude or []), list(DEFAULT_GARBAGE if garbage is None else garbage))
    reader = spark.readStream.format("doctreestream").options(state=state, page=str(page), **{k: json.dumps(v) for k, v in globs._asdict().items()})
    return reader.load(root)
