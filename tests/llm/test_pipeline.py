"""The pipeline's stages on a small folder, each against its rule."""

from __future__ import annotations

import corpus_pipeline
from linkwork.llm import lines, queries, simhash, stages

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        ids, before = {r.doc_id for r in out.collect()}, {r.doc_id for r in docs.collect()}
        assert ids <= before
        if n < 4:
            assert out.columns == columns
        if name == "quality_classifier":
            scores = queries.op5_quality_classifier(spark, SF).collect()
            assert ids == {r.doc_id for r in scores if r.predicted == 1}
        if name == "line_dedup":
            kept = {r.doc_id: r.kept for r in lines.line_dedup(docs).collect() if r.kept.strip()}
            assert kept == {r.doc_id: r.text for r in out.collect()}
        if name == "simhash_near_dedup":
            groups = simhash.simhash_groups(docs).collect()
            assert ids == {r.component_id for r in groups}
        if name == "benchmark_decontamination":
            assert len(ids) < len(before)
        docs = out
    assert ids == before and sum(r.length for r in docs.collect()) == docs.where("start = 0").groupBy().sum("doc_tokens").first()[0]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_distinct_documents_keep_one_row_of_each_group(spark, texts):
    def text(name, n=80):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(None, text("n")), (None, text("m")), (None, text("m")), (None, None), (None, "")]  # three groups without ids
    rows += [(7, text("a")), (7, text("b")), (8, text("a")), (9, text("b")), (9, text("b").upper())]  # two under id 7
    rows += [(10, text("c")), (10, text("c")), (11, text("c")), (3, text("d")), (12, text("n"))]
    out = stages.distinct_documents(spark, texts(rows), SF)
    assert out.columns == ["doc_id", "text", "key", "th", "h"]
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    want = [(0, ""), (0, text("m")), (0, text("n")), (3, text("d")), (7, text("a")), (7, text("b")), (10, text("c"))]
    assert got == want
    assert stages.distinct_documents(spark, texts([]), SF).count() == 0


CLASHES = ["_row", "_root", "_key", "_a", "_b", "_copies", "key", "h", "th", "score", "row", "id", "a", "b", "fp", "root", "name", "rest", "numbers", "kept", "none"]


def test_stages_keep_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (5, "a b c", None, "s", 5), (5, "a b c", None, "s", 5)], docs.schema)
    rows = docs.union(odd).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in CLASHES}).cache()
    plain = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
        got = out.collect()
        assert all(r[c] == c + ("" if r.doc_id is None else str(r.doc_id)) for r in got for c in CLASHES), name
        assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r.doc_id or -1, r.text or "") for r in stage(spark, plain, SF).collect()), name
        assert stage(spark, rows.limit(0), SF).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() > 0


def test_quality_stage_sends_a_text_once(spark, monkeypatch):
    from linkwork.llm import quality

    asked = []
    plain = quality.score
    monkeypatch.setattr(quality, "score", lambda docs, *a, **k: asked.append(docs.schema) or plain(docs, *a, **k))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    assert stages.good_quality(spark, docs, SF).columns == docs.columns
    assert "text" not in asked[0]["row"].dataType.names


def test_stages_hand_python_small_batches(spark):
    from linkwork.llm.common import BATCH_ROWS

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int32())], names=["n"])

    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
        for name, stage in corpus_pipeline.STAGES:
            for given, most in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("100", 100)):
                spark.conf.set(rows, given)
                if name in ("line_dedup", "simhash_near_dedup", "quality_classifier") and given != "10000":
                    continue  # these run jobs
                stage(spark, docs, SF)
                assert int(spark.conf.get(rows)) == most, name
        spark.conf.set(rows, "10000")
        corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        got = [r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n int").collect()]
        assert sum(got) == 5000 and max(got) <= BATCH_ROWS
    finally:
        spark.conf.set(rows, before)
