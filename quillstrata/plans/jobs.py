"""End-to-end jobs: corpus preparation, and training with evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillstrata.operators.classifier import TextLabelModel, fit_classifier
from quillstrata.operators.clusters import cluster_ids
from quillstrata.operators.neardup import DEFAULT_PERMUTATIONS, DEFAULT_THRESHOLD
from quillstrata.operators.pii import sanitize_records
from quillstrata.operators.projection import filter_split, normalize_records
from quillstrata.operators.split import fixed_sample, grouped_split, require_leak_free, split_audit
from quillstrata.operators.validation import canonicalize_record, quarantined_records
from quillstrata.session import cut_lineage
from quillstrata.sources.sinks import write_quarantine, write_sft_jsonl, write_split_parquet

TEXTS = ["instruction", "response"]


def split_corpus(
    df: DataFrame,
    key: str = "record_id",
    text_col: str = "instruction",
    seed: int = 42,
    threshold: float = DEFAULT_THRESHOLD,
    num_perm: int = DEFAULT_PERMUTATIONS,
    mode: str = "components",
) -> DataFrame:
    """(key, cluster_id, split) of every row.

    Only keys and cluster numbers are materialized; the texts are not rewritten to storage on the way.
    """
    clustered = cluster_ids(df.select(key, text_col), text_col, key, threshold, num_perm, mode)
    return grouped_split(cut_lineage(clustered.select(key, "cluster_id")), key, seed=seed)


def prepare_corpus(
    df: DataFrame,
    output_dir: str | None = None,
    key: str = "record_id",
    seed: int = 42,
    eval_rows: int = 500,
    threshold: float = DEFAULT_THRESHOLD,
    num_perm: int = DEFAULT_PERMUTATIONS,
    mode: str = "components",
    validate: bool = False,
    sanitize: bool = False,
    normalize: bool = False,
) -> DataFrame:
    """Cluster, split, audit and write; returns the one-row audit.

    The audit comes before any split is written and raises on a shared cluster. Validation, masking and normalization
    are optional stages in front. Without ``output_dir`` nothing is written.
    """
    if validate:
        if output_dir is not None:
            write_quarantine(quarantined_records(df, key), f"{output_dir}/quarantine")
        df = canonicalize_record(df, key)
    if sanitize:
        df = sanitize_records(df, TEXTS)
    if normalize:
        df = normalize_records(df, output_instruction_col="instruction", output_response_col="response")
    if validate or sanitize or normalize:
        # Clustering and the final join both read the prepared texts: they are made once.
        df = cut_lineage(df)
    assigned = split_corpus(df, key, "instruction", seed, threshold, num_perm, mode)
    if output_dir is not None:
        # Read by the audit and by the write.
        assigned = cut_lineage(assigned)
    audit = split_audit(assigned)
    if output_dir is not None:
        require_leak_free(audit)
        split_rows = df.join(assigned, key)
        write_split_parquet(split_rows, f"{output_dir}/splits")
        written = df.sparkSession.read.parquet(f"{output_dir}/splits")
        write_sft_jsonl(written, f"{output_dir}/sft", partition_by="split")
        sample = fixed_sample(filter_split(written, "test"), eval_rows, key, seed)
        sample.write.mode("overwrite").parquet(f"{output_dir}/test_eval_{eval_rows}")
        chosen = df.sparkSession.read.parquet(f"{output_dir}/test_eval_{eval_rows}")
        write_sft_jsonl(chosen, f"{output_dir}/test_eval_{eval_rows}_sft")
    return audit


def train_and_evaluate(
    splits: DataFrame, model_path: str | None = None, **options
) -> tuple[TextLabelModel, DataFrame]:
    """Fit on the train split, score the test split; (model, one row per target)."""
    model = fit_classifier(filter_split(splits, "train"), **options)
    if model_path is not None:
        model.save(model_path)
    return model, model.evaluate(filter_split(splits, "test"))


def leakage_experiment(grouped: DataFrame, naive: DataFrame, **options) -> DataFrame:
    """The same model on both splits: (kind, target, samples, accuracy, macro_f1, weighted_f1)."""
    from pyspark.sql import functions as F

    parts = []
    for kind, splits in [("grouped", grouped), ("naive", naive)]:
        _, scores = train_and_evaluate(splits, **options)
        parts.append(scores.select(F.lit(kind).alias("kind"), "*"))
    return parts[0].unionByName(parts[1])
