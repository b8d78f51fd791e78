"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is named by the SHA-256 of its content. The ledger in a shared folder holds, per blob, the rule
versions it was scanned with, and the findings. A scan reads the text of one path per blob that lacks a rule version,
appends what it finds, and joins the findings of all blobs back to all paths. A second scan of the same versions reads no text.

Findings are written before the blobs are marked as scanned, and are distinct when read, so a scan that stops halfway is repeated safely.

Cases: null text is the empty blob; a path may have many versions, equal rows of one path and content each get the findings; an
empty table scans nothing; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.llm.common import shared_folder, stored
from quillstrata.plans.skew import HEAVY_ROWS, lookup


@dataclass(frozen=True)
class Rule:
    """A pattern; its group ``secret`` must have ``least`` characters, else the match is dropped without a retry."""

    kind: str
    pattern: str
    secret: int = 0
    least: int = 1
    revision: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}:{self.revision}"


# In the order of findings that start together; the first three are the base kinds.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        secret=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    # A run of at least 32 digits: shorter runs could only be dropped.
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

_SCANNED = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("versions", T.ArrayType(T.StringType()))])
_FINDINGS = T.StructType(
    [
        T.StructField("blob", T.BinaryType()),
        T.StructField("kind", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def rule_matches(texts: DataFrame, rule: Rule) -> DataFrame:
    """(blob, kind, version, start, end) of a rule's matches in code points, end exclusive, from (blob, text, todo).

    Positions are running sums of the lengths of the matches and of what lies between them.
    """
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    secrets = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.secret))
    hit = texts.where(F.array_contains("todo", rule.version) & F.col("text").rlike(rule.pattern))
    pieces = hit.select(
        "blob",
        F.posexplode(
            F.arrays_zip(
                F.transform(F.split("text", rule.pattern, -1), F.length).alias("before"),
                F.transform(found, F.length).alias("size"),
                F.transform(secrets, F.length).alias("secret"),
            )
        ).alias("pos", "piece"),
    ).where(F.col("piece.size").isNotNull())
    so_far = Window.partitionBy("blob").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("piece.before") + F.col("piece.size")).over(so_far)
    placed = pieces.select("blob", "piece", end.alias("end")).where(F.col("piece.secret") >= rule.least)
    return placed.select(
        "blob",
        F.lit(rule.kind).alias("kind"),
        F.lit(rule.version).alias("version"),
        (F.col("end") - F.col("piece.size")).cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"),
    )


class BlobLedger:
    """What has been scanned, in two append-only Parquet tables under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.scanned_path, self.findings_path = f"{folder}/scanned", f"{folder}/findings"
        for path, schema in ((self.scanned_path, _SCANNED), (self.findings_path, _FINDINGS)):
            nothing = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
            nothing.write.mode("append").parquet(path)

    def scanned(self) -> DataFrame:
        """(blob, versions): all rule versions each blob was scanned with."""
        table = self.spark.read.schema(_SCANNED).parquet(self.scanned_path)
        return table.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("versions"))

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        table = self.spark.read.schema(_FINDINGS).parquet(self.findings_path).distinct()
        return table.where(F.col("version").isin([r.version for r in rules]))

    def scan(self, versions: DataFrame, path: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is new in ``versions`` and return (path, blob), one row per row of it."""
        wanted = F.array(*[F.lit(r.version) for r in rules])
        named = versions.select(F.col(path).alias("path"), F.col(text).alias("text"), blob_id(F.col(text)).alias("blob"))
        paths = stored(named.select("path", "blob"), "paths")
        # The smallest path stands for its blob; only counts of 40 bytes a row move here, combined before the shuffle.
        todo = F.array_except(wanted, F.coalesce("versions", F.array().cast("array<string>")))
        new = paths.groupBy("blob").agg(F.min("path").alias("path")).join(self.scanned(), "blob", "left")
        new = stored(new.select("blob", "path", todo.alias("todo")).where(F.size("todo") > 0), "unseen")
        at, one = named.alias("v"), new.alias("n")
        chosen = at.join(one, F.expr("v.blob = n.blob and v.path <=> n.path")).select("n.blob", "v.text", "n.todo")
        # One expression over both sides of the join: it cannot be moved before it, to texts that were scanned already.
        hit = [F.when(F.array_contains("todo", r.version) & F.col("text").rlike(r.pattern), r.version) for r in rules]
        texts = chosen.where(F.size(F.array_compact(F.array(*hit))) > 0)
        # The few texts with a match, kept once for all rules.
        texts = stored(texts, "suspects").dropDuplicates(["blob"])
        found = reduce(DataFrame.unionByName, [rule_matches(texts, r) for r in rules])
        found.write.mode("append").parquet(self.findings_path)
        new.select("blob", F.col("todo").alias("versions")).write.mode("append").parquet(self.scanned_path)
        return paths


def scan_secrets(
    versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, folder: str | None = None,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """(path, blob, spans array<struct<start, rank, kind, end>>), in order, one row per row of ``versions``.

    ``folder`` is the ledger to continue; a new one is made without it.
    """
    spark = versions.sparkSession
    ledger = BlobLedger(spark, folder or shared_folder(spark, "ledger"))
    paths = ledger.scan(versions, path, text, rules)
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    spans = ledger.findings(rules).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans")
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    # One blob may have a third of the paths: beyond a size they are dealt to many tasks.
    return lookup(paths, spans, ["blob"], "path", paths.count(), heavy_rows).select(F.col("path").alias(path), "blob", F.coalesce("spans", none).alias("spans"))
