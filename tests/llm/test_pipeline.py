"""The pipeline's stages, one after the other, against brute force."""

from collections import Counter

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from stressframe.llm import common, quality_rules, substring_dedup
from tests_llm_helpers import brute_classes, brute_windows


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.collect())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    start, quality, near, passages, mixed, packed = seen
    assert {r["doc_id"] for r in quality} < {r["doc_id"] for r in start}
    classes = brute_classes([(r["doc_id"], r["text"]) for r in quality])
    assert {r["doc_id"] for r in near} == set(classes.values())
    want = {i: (n - cut) for i, n, cut, _, _ in brute_windows([(r["doc_id"], r["text"]) for r in near], substring_dedup.LENGTH)}
    assert len(passages) == len(near) and all(want[r["doc_id"]] - 6 <= len(r["text"].encode()) <= want[r["doc_id"]] for r in passages)
    assert all(r["n_chars"] == len(r["text"]) for r in passages)
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in passages}
    firsts = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert firsts == Counter(r["doc_id"] for r in mixed)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_on_odd_input(spark, sf):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, `key` string, kept boolean, `lang_pred` string, position long, `block` int, __row int"
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    text = " ".join(f"{w}{k}" for k in range(12) for w in words)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, text, "en", "a"), (3, text, "en", "a"), (4, text + " more", None, None), (None, text, "en", "b"), (5, " ".join(f"x{k}" for k in range(30_000)), "xx", "b"), (6, "  \n", "en", None), (7, "short text", "de", "b"), (7, None, "de", "b")]
    df = spark.createDataFrame([(*r, 0, "d", "k", True, "l", 5, 6, 7) for r in rows], schema)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, df, sf)
        assert i == len(corpus_pipeline.STAGES) - 1 or got.columns == df.columns
        ids = Counter(r["doc_id"] for r in got.collect())
        if i == 0:
            assert ids == {3: 2, 4: 1, None: 1, 5: 1}
        elif i == 1:
            assert ids == {1: 1, 2: 1, 3: 1, None: 1, 5: 1, 6: 1, 7: 1}
        elif i == 2:
            assert ids == Counter(r[0] for r in rows)
        else:
            assert set(ids) == {r[0] for r in rows}
        assert stage(spark, df.limit(0), sf).count() == 0


def test_texts_go_to_python_in_small_batches(spark):
    """Memory of a task is bounded by bytes, not by rows: 4000 long texts don't go together, and none is lost."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    texts = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    rows = common.materialize(texts.mapInArrow(seen, "n long, size long")).collect()
    assert sum(r["n"] for r in rows) == 4000 and max(r["size"] for r in rows) < 2 * common.BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_a_task_of_quality_rules_takes_one_python_worker(spark, sf):
    """The distances are computed once in the last plan, though the filter and the columns both use them."""
    kept = quality_rules.keep(spark.read.parquet(f"{sf}/documents.parquet"))
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
