import hashlib
import os
import re
import sys

import pytest
from pyspark.sql import functions as F

from tabgauge.llm import bpe, quality, queries
from tests.llm.helpers import DOCS, ODD, SF, table
from tests.llm.test_dedup import brute_components, brute_fingerprint, jaccard

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES), corpus_pipeline


def test_all_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_each_stage_against_plain_python(spark, stages, tmp_path):
    """Every stage is compared on what its predecessor kept."""
    by_name, module = stages
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, queries.learnable(spark, SF))

    def plain(name, rows):
        if name == "quality_classifier":
            return {i for i, t in rows if model.score([t])[0] >= 0.7}
        if name == "exact_dedup":
            return set({t: i for i, t in sorted(rows)}.values())
        if name == "benchmark_decontamination":
            bare = lambda t: " " + " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())) + " "
            items = [bare(t) for _, t in table(SF, "benchmark")]
            return {i for i, t in rows if not any(x in bare(t) for x in items)}
        return None

    for k, (name, stage) in enumerate(module.STAGES[:-1]):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "simhash_near_dedup":
            label = brute_components([brute_fingerprint(t) for _, t in rows])
            groups = {}
            for (i, t), g in zip(rows, label.tolist()):
                groups.setdefault(g, []).append((i, t))
            stay = [min(g) for g in groups.values()]
            assert left <= {i for i, _ in stay}
            for i, t in stay:
                assert i in left or any(j in left and jaccard(t, u) >= 0.8 for j, u in stay)
        else:
            assert left == plain(name, rows), name
    made = {r.doc_id: r for r in module.STAGES[-1][1](spark, docs, SF).collect()}
    for r in docs.collect():
        data = b"".join(map(BYTES.__getitem__, made[r.doc_id].ids))
        assert data.decode() == r.text and made[r.doc_id].decoded_sha256 == hashlib.sha256(data).hexdigest() and made[r.doc_id].n_tokens == len(made[r.doc_id].ids)
    whole = {r.doc_id: list(r.ids) for r in module.run(spark, SF).collect()}
    assert whole == {i: list(r.ids) for i, r in made.items()}
    assert by_name


RANKS = bpe.load_ranks(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))
BYTES = {i: token for token, i in RANKS.items()}


def test_stages_take_odd_rows(spark, stages):
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS)
    for name, stage in stages[1].STAGES:
        for given in (rows, rows.where(F.lit(False)))[: 1 if name == "simhash_near_dedup" else 2]:  # its empty table: test_dedup
            found = stage(spark, given, SF)
            assert found.count() <= given.count()
            assert name == "byte_level_bpe" or found.columns == rows.columns
