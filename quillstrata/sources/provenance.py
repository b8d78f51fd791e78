"""Checksums, content fingerprints and the dataset manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes) of every file under ``path`` but empty ones, which Spark leaves out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size_bytes"))


def file_sha256(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, sha256, size_bytes) of every file under ``path``, of any size: each is read in chunks, one file per task at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(batch["path"].to_pylist(), batch["size_bytes"].to_pylist()):
                store, inner = fs.FileSystem.from_uri(uri)
                total = hashlib.sha256()
                with store.open_input_stream(inner) as stream:
                    while chunk := stream.read(chunk_bytes):
                        total.update(chunk)
                yield pa.RecordBatch.from_pydict({"path": [uri], "sha256": [total.hexdigest()], "size_bytes": [size]})

    files = list_files(spark, path)
    # Files are dealt evenly: the reader packs them by size, which says little about a listing without contents.
    dealt = files.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return dealt.mapInArrow(digest, "path string, sha256 string, size_bytes bigint")


def artifact_table(files: DataFrame, root: str) -> DataFrame:
    """(artifact, sha256, size_bytes): paths relative to ``root``, so equal names in different folders stay apart."""
    base = root.rstrip("/")
    inside = F.regexp_replace("path", "^[a-zA-Z0-9+.-]+:/*", "/")
    top = "/" + base.split(":", 1)[-1].lstrip("/") if ":" in base.split("/")[0] else base
    relative = F.when(inside.startswith(top + "/"), F.substr(inside, F.lit(len(top) + 2))).otherwise(F.element_at(F.split("path", "/"), -1))
    return files.select(relative.alias("artifact"), "sha256", "size_bytes")


def _canonical(column: str) -> Column:
    value = F.col(column).cast("string")
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("null"))


def row_digest(columns: list[str], kind: str = "sha256") -> Column:
    """Digest of a row's length-prefixed values: no two different rows share an encoding."""
    encoded = F.concat_ws("|", *[_canonical(c) for c in columns])
    return F.md5(encoded) if kind == "md5" else F.sha2(encoded, 256)


def dataset_fingerprint(df: DataFrame, columns: list[str] | None = None, kind: str = "sha256") -> DataFrame:
    """(row_count, fingerprint): the same data gives the same value whatever its files or partitions."""
    digest = F.conv(F.substring(row_digest(columns or df.columns, kind), 1, 15), 16, 10)
    # Sum of 60-bit numbers: order does not matter, copies do count, and 38 digits hold 10^19 rows.
    return df.select(digest.cast("decimal(20,0)").alias("d")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.col("d").cast("decimal(28,0)")), F.lit(0)).cast("string").alias("fingerprint"),
    )


def dataset_manifest(
    df: DataFrame,
    artifacts: DataFrame,
    dataset_name: str,
    source_url: str,
    revision: str,
    license_name: str,
) -> DataFrame:
    """One row describing the dataset, with the number, size and combined digest of its files.

    ``artifacts`` comes from :func:`artifact_table` and is written beside the manifest, one row per file. The combined digest is an
    order-free sum over names and digests, so no task holds the list of files.
    """
    piece = F.conv(F.substring(F.sha2(F.concat_ws("|", "artifact", "sha256"), 256), 1, 15), 16, 10).cast("decimal(28,0)")
    files = artifacts.select("size_bytes", piece.alias("piece")).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("piece"), F.lit(0)).cast("string").alias("files_fingerprint"),
    )
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return files.select(
        F.lit(dataset_name).alias("dataset_name"),
        F.lit(source_url).alias("source_url"),
        F.lit(revision).alias("revision_sha"),
        F.lit(license_name).alias("license"),
        F.date_format(
            F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"
        ).alias("download_timestamp_utc"),
        rows.alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        "file_count",
        "total_bytes",
        "files_fingerprint",
    )


def write_manifest(manifest: DataFrame, path: str, artifacts: DataFrame | None = None) -> None:
    """The manifest as JSON under ``path``/manifest, and its files, one row each, under ``path``/artifacts."""
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    if artifacts is not None:
        artifacts.write.mode("overwrite").json(f"{path}/artifacts")
