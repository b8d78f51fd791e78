"""One thin query per operator over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstrata.llm import collocations, crf, decontam, divergence, infill, langid, minhash, mixing, secrets, simhash, substring, toxicity, warc
from quillstrata.llm.common import remainder
from quillstrata.llm.duck import ORACLE  # noqa: F401  (part of this module's interface)


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_distribution_divergence(spark, d):
    return divergence.quality_verdicts(_table(spark, d, "documents"))


def _span_list(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _span_count(kind):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op2_shape_field(spark, d):
    found = crf.find_spans(_table(spark, d, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(list(crf.BASE_KINDS)))
    counts = [_span_count(kind) for kind in crf.BASE_KINDS]
    digest = F.sha2(_span_list(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _span_list(F.col("spans")).alias("spans"))


def op3_toxicity(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    lexicon = toxicity.fit_lexicon(docs, _table(spark, d, "labels"), train=remainder(F.col("doc_id"), 4) != 2)
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op8_language_id(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text", "lang")
    model = langid.fit_language(docs, train=remainder(F.col("doc_id"), 3) != 1)
    found = langid.predict_language(docs.select("doc_id", "text"), model)
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score", "rejected")


def op4_blob_ledger(spark, d):
    found = secrets.scan_secrets(_table(spark, d, "documents"))
    base = F.filter("spans", lambda s: s["rank"] <= 3)

    counts = [_span_count(kind) for kind in ("assign", "access", "hex")]
    digest = F.sha2(_span_list(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _span_list(F.col("spans")).alias("spans"))


def op5_mixing(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, mixing.form_topic(F.col("text"))).select("doc_id", "mix.*")


def op6_warc(spark, d):
    return warc.archive_round_trip(_table(spark, d, "pages"))


def op7_simhash(spark, d):
    found = simhash.near_duplicates(_table(spark, d, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_decontaminate(spark, d):
    found = decontam.decontaminate(_table(spark, d, "documents"), _table(spark, d, "benchmark"))
    names = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", names, "contaminated")


def op10_substring(spark, d):
    found = substring.remove_repeats(_table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_minhash(spark, d):
    found = minhash.near_duplicates(_table(spark, d, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_collocations(spark, d):
    return collocations.collocations(_table(spark, d, "documents"))


def op13_fill_in_middle(spark, d):
    found = infill.fill_in_middle(_table(spark, d, "documents"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {
    "op1_distribution_divergence": op1_distribution_divergence,
    "op2_shape_field": op2_shape_field,
    "op3_toxicity": op3_toxicity,
    "op4_blob_ledger": op4_blob_ledger,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_substring": op10_substring,
    "op11_minhash": op11_minhash,
    "op12_collocations": op12_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}
