"""Reading document trees, single documents, listings and traces."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.paths import base_name
from docloom.sources.tree import entries as entries_of
from docloom.storage import Checked, cut_observed, issue_rows, open_store


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below `root`: `full` and `length`. Names beginning with `.` or `_` count like all others.

    Executors list the directories of one level at a time; the level found is
    written to the shared folder, and the driver sees how many directories it has.
    A folder that holds a third of all files is listed by one task; `tree.scan_tree` cuts it into pages, and does
    not enter rejected folders. A link to a folder that the path has come through is passed over. Stores are those that
    pyarrow opens; for another one pass a manifest to `scan_documents`.
    """

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for full in frame["full"]:
                below = full.rstrip("/")
                found = iter(entries_of(full))
                while rows := [(f"{below}/{e.name}", 0 if e.directory else e.size(), e.directory) for e in islice(found, 10_000)]:
                    yield pd.DataFrame(rows, columns=["full", "length", "directory"])

    level = spark.createDataFrame([(root,)], "full string")
    files = None
    while True:
        found, seen = cut_observed(
            level.repartition("full").mapInPandas(entries, "full string, length long, directory boolean"),
            "listing",
            F.count_if("directory").alias("directories"),
        )
        here = found.filter("NOT directory").select("full", "length")
        files = here if files is None else files.unionByName(here)
        if not seen["directories"]:
            return files
        level = found.filter("directory").select("full")


# Contents that a task holds at a time, unless one file is larger.
CONTENT_BYTES = 32 << 20


def read_contents(files: DataFrame, full: str = "full", content: str = "content") -> DataFrame:
    """Add each file's bytes, read by its path in the task that has the row: nothing is shuffled."""
    schema = T.StructType([*files.schema.fields, T.StructField(content, T.BinaryType())])
    at = files.columns.index(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for n, path in enumerate(batch.column(at).to_pylist()):
                held.append(read_file(path))
                size += len(held[-1])
                if size >= CONTENT_BYTES or n + 1 == batch.num_rows:
                    rows = batch.slice(start, n + 1 - start)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], names=schema.fieldNames())
                    start, held, size = n + 1, [], 0

    return files.mapInArrow(run, schema)


def read_file(path: str) -> bytes:
    store, at = open_store(path)
    with store.open_input_stream(at) as stream:
        return stream.readall()


def scan_documents(spark: SparkSession, root: str, manifest: DataFrame | None = None, content: bool = False) -> DataFrame:
    """One row per file below `root`: `base, path` (relative, from `/`), `full, name, length`.

    Hidden files are listed as well. With `manifest`, any DataFrame with `path`
    relative to the root (and `length`, if known), nothing is listed. Contents are
    read only when asked for; better to read them late, when delivering.
    """
    base = root.rstrip("/")
    if manifest is not None:
        path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), F.col("path")))
        found = manifest.withColumns(
            {"path": path, "base": F.lit(base), "full": F.concat(F.lit(base), path), "name": base_name(path)}
        )
    else:
        found = list_tree(spark, base).select(
            F.lit(base).alias("base"), F.col("full").substr(F.lit(len(base) + 1), F.length("full")).alias("path"), "full",
            base_name(F.col("full")).alias("name"), "length",
        )
    return read_contents(found) if content else found


def single_document(df: DataFrame, path: str = "path") -> Checked:
    """URI of a document loaded by itself: its path from the first `/` on."""
    named = df.withColumn("uri", F.regexp_extract(F.col(path), r"(?s)(/.*)$", 1))
    return Checked(
        named.filter("uri <> ''"),
        issue_rows(named.filter("uri = ''"), "document", F.col(path), "uri", "no-parent-dir", F.col(path)),
    )


def flatten_listing(df: DataFrame, payload: str, root: str, fields: tuple[str, ...] = ("nameref",)) -> DataFrame:
    """One row per item of a listing `{root: {list-items: {list-item: [...]}}}` held as JSON text.

    A payload that does not parse, or lacks the root, gives no rows: see `listing_issues`.
    """
    item = "struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">"
    schema = f"struct<`{root}`: struct<`list-items`: struct<`list-item`: array<{item}>>>>"
    items = F.from_json(F.col(payload), schema)[root]["list-items"]["list-item"]
    kept = [c for c in df.columns if c != payload]
    return df.select(*kept, F.inline(items))


def listing_issues(df: DataFrame, payload: str, root: str, entity: str) -> DataFrame:
    """An issue per payload that is no JSON, or has no list under `root`."""
    parsed = F.try_parse_json(F.col(payload))
    listed = F.try_variant_get(parsed, f"$['{root}']['list-items']['list-item']", "array<variant>")
    rule = F.when(F.col(payload).isNull() | parsed.isNull(), "malformed").when(listed.isNull(), "no-list")
    return issue_rows(df.withColumn("__rule", rule).filter("__rule IS NOT NULL"), "listing", F.col(entity), root, F.col("__rule"), None)


def parse_trace(files: DataFrame, file_name: str = "file_name", body: str = "body") -> Checked:
    """Requests and responses out of trace files, one JSON object each.

    `*-request.json` gives verb and url, `*-response.json` the status;
    `*-params.json` and other than JSON files are passed over, any other JSON
    file is an issue.
    """
    name = F.col(file_name)
    json = files.filter(name.endswith(".json") & ~name.endswith("-params.json"))
    entry = F.when(name.endswith("-request.json"), "request").when(name.endswith("-response.json"), "response")
    parsed = json.withColumns(
        {
            "entry": entry,
            "__json": F.from_json(F.col(body), "verb string, url string, status string"),
        }
    )
    request, response = F.col("entry") == "request", F.col("entry") == "response"
    good = parsed.filter(F.col("entry").isNotNull()).select(
        *[c for c in files.columns if c != body],
        "entry",
        F.when(request, F.col("__json.verb")).alias("verb"),
        F.when(request, F.col("__json.url")).alias("url"),
        F.when(response, F.col("__json.status")).alias("status"),
    )
    stray = parsed.filter(F.col("entry").isNull())
    return Checked(good, issue_rows(stray, "trace", F.col(file_name), "file", "unknown-suffix", None))


def read_trace(spark: SparkSession, folder: str) -> Checked:
    """Trace entries of a folder in file name order."""
    files = list_tree(spark, folder).filter(F.col("full").endswith(".json"))
    texts = read_contents(files).select(base_name(F.col("full")).alias("file_name"), F.col("content").cast("string").alias("body"))
    good, issue = parse_trace(texts)
    return Checked(good.orderBy("file_name"), issue)
