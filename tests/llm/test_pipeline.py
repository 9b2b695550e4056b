"""The pipeline's stages on a small table, each judged on its own input."""

import corpus_pipeline
from graphloom.llm import simhash


def test_stages(spark, small):
    folder, docs, seen = "/root/testdata/sf0.001", small("documents"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        seen[name] = out.toPandas()
        docs = spark.createDataFrame(seen[name]) if name != "sentencepiece" else docs
    kept, deduped, near, mixed = (seen[n] for n in ("toxicity", "line_dedup", "simhash_near_dedup", "source_mixing"))
    assert 0.8 * small("documents").count() < len(kept) and set(kept["doc_id"]) == set(deduped["doc_id"])
    lines = [x for t in deduped["text"] for x in t.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    assert near["text"].map(simhash.fingerprint).is_unique
    assert set(mixed["doc_id"]) <= set(near["doc_id"]) and seen["sentencepiece"]["exact"].all()
    assert len(seen["sentencepiece"]) == len(mixed)


def test_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "ids", "n_tokens", "exact"] and found.count() > 100


def test_run_with_odd_rows_and_without_rows(spark, odd, nothing, marks, tmp_path):
    """Nulls in every column, repeated rows and clashing names go through all stages; what is left are texts with words, each encoded exactly."""
    for name, docs in (("odd", odd), ("nothing", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        # Without labels no document is known to be toxic (those of marks call most texts toxic, so that all would go).
        marks.limit(0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if name == "nothing":
            assert rows == []
            continue
        # Blank texts (0, 1, 2 and one without an id) are never taken; 5 and 77 repeat earlier lines, 4 keeps its first line.
        assert {r["doc_id"] for r in rows} <= {3, 4, 6, 7, 8, 9, None} and {6} <= {r["doc_id"] for r in rows}
        assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) > 0 for r in rows)


def test_run_leaves_only_the_stages_results(spark):
    from graphloom import runtime

    before = len(runtime._written)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    # The last stage's own tables are read by the result; all others have gone.
    assert len(runtime._written) - before < 10
