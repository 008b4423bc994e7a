import corpus_pipeline
from frames import clashing, frame, hard_rows

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mix", "pack"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        if name in ("quality", "near_duplicates"):
            assert 0 < after.count() < n
        docs, n = after, after.count()


def test_every_stage_copes_with_odd_and_no_documents(spark):
    for rows in (hard_rows(), []):
        for name, stage in corpus_pipeline.STAGES:
            docs = clashing(frame(spark, rows))
            after = stage(spark, docs, SMALL)
            if name != "pack":
                assert after.columns == docs.columns
            assert (after.count() > 0) == bool(rows), name


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in ends.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(ends) <= 1.02 * -(-total // 2048) + 1
