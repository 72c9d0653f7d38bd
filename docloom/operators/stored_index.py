"""A range index kept in files: sorted by name and value, and brought up to date by what has changed.

An index is a folder. Its data files hold rows (`name`, `value`, `uri`) in range
partitions over all three, so that a value that most documents have is cut like any other; no file is ever
changed. A generation is a list of files with the first and last (name, value) of
each (`files`), and the content hash of each document (`documents`); it is complete when
both are written, and readers take the last complete one. A search reads the files whose range meets the one asked
for, and no others. A refresh extracts the changed documents only, and writes anew only
the files that had rows of changed or removed ones.

There may be one writer at a time. Older generations stay until `vacuum`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.storage import apart, cut_wide, cut_wide_observed, open_store

# Rows of a data file, about.
FILE_ROWS = 1_000_000
KEY = ["name", "value", "uri"]


class Refreshed(NamedTuple):
    """What a refresh did: documents changed or new, and removed; files kept, and written."""

    changed: int
    removed: int
    kept: int
    written: int


class StoredIndex:
    """The index in a folder. `extract` gives rows (`uri`, `name`, `value`) of documents (`uri` and `content`)."""

    def __init__(self, spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame], file_rows: int = FILE_ROWS):
        self.spark, self.path, self.extract, self.file_rows = spark, path.rstrip("/"), extract, file_rows

    def generations(self) -> list[int]:
        """Numbers of complete generations."""
        store, at = open_store(self.path)
        if store.get_file_info(at).type != fs.FileType.Directory:
            return []
        found = []
        for entry in store.get_file_info(fs.FileSelector(at)):
            number = entry.base_name.removeprefix("generation-")
            if number != entry.base_name and number.isdigit():
                marks = store.get_file_info([f"{entry.path}/{part}/_SUCCESS" for part in ("files", "documents")])
                if all(m.type == fs.FileType.File for m in marks):
                    found.append(int(number))
        return sorted(found)

    def _part(self, generation: int, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/generation-{generation}/{part}")

    def files(self) -> DataFrame:
        """The present generation's files: `file`, `low` and `high` (structs of name and value), `rows`."""
        return self._part(self._present(), "files")

    def _present(self) -> int:
        known = self.generations()
        if not known:
            raise ValueError(f"no index in {self.path}")
        return known[-1]

    def refresh(self, documents: DataFrame, uri: str = "uri", content: str = "content") -> Refreshed:
        """Bring the index to the state of `documents`, which are all there are now; the first call builds it.

        Documents are compared by the SHA-256 of their contents. A null URI has no identity and is left out;
        of repeated URIs the content with the least hash counts; null contents count as empty.
        """
        known = self.generations()
        now = documents.filter(F.col(uri).isNotNull()).select(F.col(uri).alias("uri"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"))
        now = now.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
        current = cut_wide(now.groupBy("uri").agg(F.min("hash").alias("hash")), "index-documents")
        if known:
            before = self._part(known[-1], "documents")
            same = apart(before.join(current, ["uri", "hash"], "left_semi").select("uri"))
            stale = cut_wide(before.join(same, "uri", "left_anti").select("uri"), "index-stale")
            fresh = current.join(same, "uri", "left_anti")
        else:
            stale, fresh = None, current
        fresh, seen = cut_wide_observed(fresh, "index-fresh", F.count(F.lit(1)).alias("n"))
        removed = stale.join(current, "uri", "left_anti").count() if known else 0
        number = known[-1] + 1 if known else 0
        if known and not seen["n"] and not removed:
            return Refreshed(0, 0, self.files().count(), 0)
        changed = now.join(fresh, ["uri", "hash"], "left_semi").dropDuplicates(["uri", "hash"]).select("uri", "content")
        rows = self.extract(changed).select(*KEY)
        kept = None
        if known:
            files = self._part(known[-1], "files")
            # only the URIs of files are read to find those that have stale rows
            data = self._read([r.file for r in files.select("file").collect()])
            hit = [r.file for r in data.select("uri", _file().alias("file")).join(stale, "uri", "left_semi").select("file").distinct().collect()] if data else []
            kept = files.filter(~F.col("file").isin(hit)) if hit else files
            if hit:
                rows = rows.unionByName(self._read(hit).join(stale, "uri", "left_anti").select(*KEY))
        rows, counted = cut_wide_observed(rows, "index-rows", F.count(F.lit(1)).alias("n"))
        here = f"{self.path}/generation-{number}"
        if counted["n"]:
            ranges = max(1, math.ceil(counted["n"] / self.file_rows))
            rows.repartitionByRange(ranges, *KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(f"{here}/data")
            first = F.struct("name", "value")
            made = self.spark.read.parquet(f"{here}/data").groupBy(_file().alias("file")).agg(
                F.min(first).alias("low"), F.max(first).alias("high"), F.count(F.lit(1)).alias("rows")
            )
            made = cut_wide(made, "index-files")
        else:
            first = F.struct("name", "value")
            made = rows.select(F.lit("").alias("file"), first.alias("low"), first.alias("high"), F.lit(0).cast("long").alias("rows"))
        (kept.unionByName(made) if kept is not None else made).coalesce(1).write.mode("overwrite").parquet(f"{here}/files")
        # the last part that makes the generation a complete one
        current.write.mode("overwrite").parquet(f"{here}/documents")
        return Refreshed(seen["n"], removed, kept.count() if kept is not None else 0, made.count())

    def _read(self, files: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*files) if files else None

    def search(self, name: str, low: object = None, high: object = None, included: tuple[bool, bool] = (True, True)) -> DataFrame:
        """Rows (`uri`, `name`, `value`) of one name with values between `low` and `high`; None leaves an end open.

        The list of files is small and its ranges are compared first; the other files are not opened.
        """
        files = self.files()
        tests = [F.col("low.name") <= F.lit(name), F.col("high.name") >= F.lit(name)]
        if low is not None:
            tests.append((F.col("high.name") > F.lit(name)) | (F.col("high.value") >= self._as(files, low)))
        if high is not None:
            tests.append((F.col("low.name") < F.lit(name)) | (F.col("low.value") <= self._as(files, high)))
        met = files
        for test in tests:
            met = met.filter(test)
        rows = self._read([r.file for r in met.select("file").collect()])
        if rows is None:
            value = files.schema["low"].dataType["value"].dataType
            return files.select(F.lit("").alias("uri"), F.lit("").alias("name"), F.lit(None).cast(value).alias("value")).limit(0)
        found = rows.filter(F.col("name") == F.lit(name))
        if low is not None:
            found = found.filter(F.col("value") >= low if included[0] else F.col("value") > low)
        if high is not None:
            found = found.filter(F.col("value") <= high if included[1] else F.col("value") < high)
        return found.select("uri", "name", "value")

    @staticmethod
    def _as(files: DataFrame, value: object) -> Column:
        return F.lit(value).cast(files.schema["low"].dataType["value"].dataType)

    def vacuum(self) -> int:
        """Delete generations before the present one, but for the files it still uses; returns how many files went."""
        present = self._present()
        store, at = open_store(self.path)
        used = {r.file.rsplit("/generation-", 1)[1] for r in self.files().collect()}
        gone = 0
        for number in range(present):
            for part in ("files", "documents"):
                if store.get_file_info(f"{at}/generation-{number}/{part}").type == fs.FileType.Directory:
                    store.delete_dir(f"{at}/generation-{number}/{part}")
            data = f"{at}/generation-{number}/data"
            if store.get_file_info(data).type == fs.FileType.Directory:
                for f in store.get_file_info(fs.FileSelector(data)):
                    if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and f"{number}/data/{f.base_name}" not in used:
                        store.delete_file(f.path)
                        gone += 1
        return gone


def _file() -> Column:
    return F.col("_metadata.file_path")
