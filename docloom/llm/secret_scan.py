"""Secret scans with an incremental ledger of blobs, in DataFrame operations only.

Every version of every file is addressed by the digest of its content. A ledger
keeps which (blob, rule version) pairs have been scanned and what was found. A
scan reads only the pairs that the ledger lacks, then joins findings back to all
paths that have the blob. Nothing is scanned twice, however often it is copied.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.batches import name
from docloom.storage import cut, fresh_path


class Rule(NamedTuple):
    """`part` is the group whose length counts; a shorter match is dropped. `version` changes with the rule.

    `needs` is a pattern that every text with a long enough match satisfies: others are not walked.
    """

    kind: str
    pattern: str
    part: int
    least: int
    needs: str
    version: str = "1"


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]"""


# The base rules, in this order.
RULES = (
    Rule("assign", _ASSIGN + "+)", 2, 6, _ASSIGN + "{6,})"),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]+", 0, 24, "[0-9a-f]{24,}"),
)
_FINDING = "blob string, rule string, version string, spans array<struct<start:bigint,end:bigint>>"


def spans_of(text, rule: Rule):
    """Spans (code points, end exclusive) of the rule's leftmost matches that do not overlap, too short ones dropped.

    The pieces between matches and the matches themselves, in turn, make up the
    text, so their lengths give the places.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = whole if rule.part == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.part))
    found = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.char_length).alias("size"), F.transform(parts, F.char_length).alias("part"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    walked = F.aggregate(
        found,
        F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + F.coalesce(m["size"], F.lit(0))).cast("bigint").alias("at"),
            F.when(
                m["part"] >= rule.least,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + m["gap"]).cast("bigint").alias("start"),
                            (acc["at"] + m["gap"] + m["size"]).cast("bigint").alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(F.regexp_like(text, F.lit(rule.needs)), walked).otherwise(empty)


def _pair(rule: Rule):
    return F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"))


def _pairs(rules: tuple[Rule, ...]):
    return F.array(*map(_pair, rules))


class Ledger:
    """Tables below one shared folder: `scanned` (blob, rule, version) and `findings` (with spans)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "ledger")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rule string, version string")

    def findings(self) -> DataFrame:
        return self._read("findings", _FINDING)

    def scan(self, blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan those `blobs` (`blob`, `text`; repeats allowed) that some rule version has not seen.

        Findings are written before the pairs count as scanned: a job that is lost
        half-way is done again, and readers drop the findings it may have left twice.
        """
        wanted = _pairs(rules)
        known = self.scanned().distinct().groupBy("blob").agg(
            F.collect_set(F.struct("rule", "version")).alias("known")
        )
        # a blob has as many known pairs as there ever were rule versions: few
        fresh = blobs.groupBy("blob").agg(F.any_value("text").alias("text")).join(known, "blob", "left")
        fresh = fresh.withColumn("due", F.array_except(wanted, F.coalesce("known", F.array().cast("array<struct<rule:string,version:string>>"))))
        found = F.array(
            *[
                F.struct(
                    F.lit(r.kind).alias("rule"),
                    F.lit(r.version).alias("version"),
                    F.when(F.array_contains("due", _pair(r)), spans_of(F.col("text"), r)).alias("spans"),
                )
                for r in rules
            ]
        )
        out = fresh.filter(F.size("due") > 0).select("blob", found.alias("found"))
        out = cut(out, "ledger-run").select("blob", F.explode("found").alias("f")).filter("f.spans is not null")
        out.filter(F.size("f.spans") > 0).select("blob", "f.*").write.mode("append").parquet(f"{self.path}/findings")
        out.select("blob", "f.rule", "f.version").write.mode("append").parquet(f"{self.path}/scanned")


def scan_versions(
    df: DataFrame, path_column: str = "doc_id", text: str = "text", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Per row of `df`, a version of a file: its path, `blob` (SHA-256 of the text) and `found`.

    `found` lists kind, start and end of each span, by start, then in the order of
    `rules`. Null texts are empty; repeated rows and equal texts share a blob, each row
    is returned; other columns are not read; an empty table gives no rows.
    """
    ledger = ledger or Ledger(df.sparkSession)
    content = F.coalesce(name(text), F.lit(""))
    blob = F.sha2(content.cast("binary"), 256)
    ledger.scan(df.select(blob.alias("blob"), content.alias("text")), rules)
    order = {r.kind: i for i, r in enumerate(rules)}
    current = _pairs(rules)
    per_blob = (
        ledger.findings()
        .filter(F.array_contains(current, F.struct(F.col("rule"), F.col("version"))))
        .distinct()
        .select("blob", "rule", F.explode("spans").alias("s"))
        .select("blob", F.struct("s.start", F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("rule")).alias("turn"), F.col("rule").alias("kind"), "s.end").alias("f"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list("f")).alias("found"))  # spans of one text: no more than it has characters
    )
    per_blob = cut(per_blob, "ledger-found")
    paths = df.select(name(path_column).alias(path_column), blob.alias("blob"))
    return paths.join(per_blob, "blob", "left").select(
        path_column, "blob", F.coalesce("found", F.array().cast(per_blob.schema["found"].dataType)).alias("found")
    )
