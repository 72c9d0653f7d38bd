"""Document trees as a Spark data source, listed without what globs or filters reject.

`scan_tree` gives the rows of `select_paths(scan_documents(...))`, but a rejected
folder is not entered, and a filter on `path` narrows the listing as well:

    scan_tree(spark, root, exclude=["old/"]).filter("path LIKE '/de/%'")

Planning walks the folders that are left, with several threads, and keeps one short
record per folder, never one per file. Reading is dealt out by pages: a huge folder is
read by many tasks, each of which asks for the size of its share of the files, and small
folders go together. A task lists its folders whole to find its pages, so the number of tasks
is bounded and each takes neighbouring pages: a folder is not listed once per page.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from docloom.functions.paths import GlobList
from docloom.operators.documents import DEFAULT_GARBAGE
from docloom.storage import open_store

# Files of a page; folders listed at a time.
PAGE, THREADS = 10_000, 16
# Tasks that files are dealt to at most, or as many as shuffles have, where that is more.
TASKS = 128
FILES = "base string, path string, full string, name string, length long"
FOLDERS = "path string, entries long, pages int"


class Entry(NamedTuple):
    name: str
    directory: bool
    size: Callable[[], int]
    # nanoseconds since 1970, or 0 where the store does not tell
    modified: Callable[[], int]


def entries(folder: str) -> Iterator[Entry]:
    """What a folder holds, hidden names included. Sizes are asked for one by one, where the store allows it.

    Links are followed, but not one that leads to a folder which the path has come through already. A link to
    nothing counts as an empty file.
    """
    store, at = open_store(folder)
    if not isinstance(store, fs.LocalFileSystem):
        for i in store.get_file_info(fs.FileSelector(at)):
            yield Entry(i.base_name, i.type == fs.FileType.Directory, lambda i=i: i.size or 0, lambda i=i: i.mtime_ns or 0)
        return
    with os.scandir(at) as found:
        for e in found:
            directory = e.is_dir()
            if directory and e.is_symlink() and _leads_back(at, e.path):
                continue
            there = lambda e=e: os.path.exists(e.path)
            yield Entry(
                e.name, directory, lambda e=e, there=there: e.stat().st_size if there() else 0, lambda e=e, there=there: e.stat().st_mtime_ns if there() else 0
            )


def _leads_back(folder: str, link: str) -> bool:
    target, above = os.path.realpath(link), os.path.abspath(folder)
    while True:
        if os.path.realpath(above) == target:
            return True
        if above == os.path.dirname(above):
            return False
        above = os.path.dirname(above)


class Globs(NamedTuple):
    """The globs of a source set on plain strings, as `select_paths` has them on columns."""

    include: list[str]
    exclude: list[str]
    garbage: list[str]

    def folder_test(self) -> Callable[[str], bool]:
        inc, exc, gar = map(GlobList, self)
        gone = [_matcher(g.dir_names, g.dir_paths) for g in (exc, gar) if g.has_dir_globs()]
        kept = _matcher(inc.dir_names, inc.dir_paths) if inc.has_dir_globs() else None
        return lambda path: not any(g(path) for g in gone) and (kept is None or kept(path))

    def file_test(self) -> Callable[[str], bool]:
        inc, exc, gar = map(GlobList, self)
        gone = [_matcher(g.file_names, g.file_paths) for g in (exc, gar) if g.has_file_globs()]
        kept = _matcher(inc.file_names, inc.file_paths) if inc.has_file_globs() else None
        return lambda path: not any(g(path) for g in gone) and (kept is None or kept(path))


def _matcher(names: list[str], paths: list[str]) -> Callable[[str], bool]:
    tests = [rf"(?:.*/)?(?:{'|'.join(names)})"] if names else []
    tests += ["|".join(paths)] if paths else []
    whole = re.compile("(?s:" + "|".join(tests) + ")")
    return lambda path: whole.fullmatch(path) is not None


class Share(NamedTuple):
    """Pages from `first` up to `last`, itself not included, of the `pages` that the files of a folder are dealt to."""

    folder: str
    entries: int
    first: int
    last: int
    pages: int


class Page(InputPartition):
    def __init__(self, shares: list[Share]):
        super().__init__(shares)
        self.shares = shares


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base = options["path"].rstrip("/")
        self.globs = Globs(*(json.loads(options.get(k, "[]")) for k in Globs._fields))
        self.page = int(options.get("page", PAGE))
        self.tasks = int(options.get("tasks", TASKS))
        self.report = options.get("report") == "folders"
        self.starts: list[list[str]] = []

    def pushFilters(self, filters: list[Filter]):
        """Folders that no path allowed by the filters lies in are not entered. Spark tests the rows themselves."""
        for f in filters:
            if isinstance(f, EqualTo | StringStartsWith) and f.attribute == ("path",):
                self.starts.append([f.value])
            elif isinstance(f, In) and f.attribute == ("path",):
                self.starts.append(list(f.value))
            yield f

    def _allowed(self, folder: str) -> bool:
        below = folder + "/"
        return all(any(s is not None and (s.startswith(below) or below.startswith(s)) for s in some) for some in self.starts)

    def walk(self) -> Iterator[tuple[str, int]]:
        """Folders, from the root on, that are not rejected, with the number of their entries."""
        wanted = self.globs.folder_test()

        def open_(folder: str) -> tuple[str, int, list[str]]:
            below, n = [], 0
            for e in entries(self.base + folder):
                n += 1
                path = f"{folder}/{e.name}"
                if e.directory and wanted(path) and (self.report or self._allowed(path)):
                    below.append(path)
            return folder, n, below

        level = [""]
        with ThreadPoolExecutor(THREADS) as pool:
            while level:
                following = []
                for folder, n, below in pool.map(open_, level):
                    yield folder, n
                    following += below
                level = following

    def partitions(self) -> list[Page]:
        folders = [(folder, n, max(1, -(-n // self.page))) for folder, n in self.walk()]
        if self.report:
            whole = [Share(folder, n, 0, pages, pages) for folder, n, pages in folders]
            return [Page(whole[at : at + PAGE]) for at in range(0, len(whole), PAGE)]
        # what a task takes: a page, or more where there would be too many tasks
        room = max(self.page, -(-sum(n + pages for _, n, pages in folders) // self.tasks))
        made, held, size = [], [], 0
        for folder, n, pages in folders:
            each, first = n // pages + 1, 0
            while first < pages:
                last = min(pages, first - (size - room) // each)
                held.append(Share(folder, n, first, last, pages))
                size += (last - first) * each
                first = last
                if size >= room:
                    made.append(Page(held))
                    held, size = [], 0
        return [*made, Page(held)] if held else made

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if self.report:
            own = partition.shares
            yield pa.RecordBatch.from_pydict(
                {"path": [s.folder for s in own], "entries": [s.entries for s in own], "pages": pa.array([s.pages for s in own], pa.int32())}
            )
            return
        wanted = self.globs.file_test()
        for folder, _, first, last, pages in partition.shares:
            rows = []
            for e in entries(self.base + folder):
                path = f"{folder}/{e.name}"
                if e.directory or not first <= zlib.crc32(os.fsencode(e.name)) % pages < last or not wanted(path):
                    continue
                rows.append((self.base, path, self.base + path, e.name, e.size()))
                if len(rows) == self.page:
                    yield _files(rows)
                    rows = []
            if rows:
                yield _files(rows)


def _files(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 4 + [pa.int64()])]
    return pa.RecordBatch.from_arrays(columns, names=["base", "path", "full", "name", "length"])


class TreeSource(DataSource):
    """`spark.read.format("doctree")`: options `path`, `include`, `exclude`, `garbage` (JSON lists of globs), `page`
    (files of a page), `tasks` (tasks at most), and `report` = `folders` for one row per folder that was listed."""

    @classmethod
    def name(cls) -> str:
        return "doctree"

    def schema(self) -> str:
        return FOLDERS if self.options.get("report") == "folders" else FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def scan_tree(
    spark: SparkSession, root: str, include=None, exclude=None, garbage=None, page: int = PAGE, report: bool = False
) -> DataFrame:
    """One row per file below `root` that the globs let through: `base, path` (from `/`), `full, name, length`.

    The globs mean what they mean in `select_paths`. With `report`, instead one row per
    folder listed: `path`, `entries`, and the `pages` its files are dealt to. Filters on `path` (equality, `IN`,
    `LIKE 'x%'`) narrow the listing where the session has `spark.sql.python.filterPushdown.enabled`, which is turned on here.
    Each action lists anew.
    """
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    globs = Globs(list(include or []), list(exclude or []), list(DEFAULT_GARBAGE if garbage is None else garbage))
    tasks = max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    reader = spark.read.format("doctree").options(page=str(page), tasks=str(tasks), **{k: json.dumps(v) for k, v in globs._asdict().items()})
    return (reader.option("report", "folders") if report else reader).load(root)
