"""The pipeline's stages, each against plain Python on its own input, and the registration."""

import brute
import corpus_pipeline
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

import __spark_entry__
from quillstrata.llm.common import stored
from quillstrata.llm.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before.withColumn("score", F.lit("clash")), D), name.replace(" ", "-"))
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(new) <= set(old) and set(columns) <= set(after.columns)
        if name.startswith("simhash"):
            keys = list(old)
            assert set(new) == set(brute.components(keys, [brute.fingerprint(old[k].text) for k in keys]))
        elif name.startswith("benchmark"):
            items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
            verdicts = brute.decontaminated([(k, r.text) for k, r in old.items()], items)
            assert set(new) == {k for (k, _), v in verdicts.items() if not v[-1]}
        elif name == "pii":
            assert set(new) == set(old)
            for k, r in new.items():
                assert not brute.personal_spans(r.text) or not brute.personal_spans(old[k].text)
                assert (r.text == old[k].text) == (not brute.personal_spans(old[k].text))
                assert r.n_chars == len(r.text)
        elif name == "source mixing":
            assert 0.2 < len(new) / len(old) < 0.9
        else:
            assert len(new) > 0.7 * len(old)
        before = after.select(*columns)


def test_registered(spark):
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert "cluster_ids" in names


@pytest.mark.parametrize("name", list(ORACLE))
def test_oracle(spark, name):
    assert difference(QUERIES[name](spark, D), connect(D), ORACLE[name]) is None
