import helpers as H
import corpus_pipeline
from tsumugi.llm.common import shared_dir
from test_python import check_packing


def test_stages(spark, tmp_path):
    folder = H.write_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        counts.append(docs.count())
    quality, exact, near = counts[1:4]
    assert counts[0] > quality > exact > near > 0
    rows = corpus_pipeline.run(spark, folder).collect()
    check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
    kept = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in rows} == kept


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_dedup", "mix_sources", "pack_sequences"]


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scratch_goes_stage_by_stage(spark, tmp_path):
    """Of all that run() wrote, the documents before packing and the packer's own tables are left."""
    import os

    from tsumugi.llm import common

    folder, before = H.write_tables(spark, tmp_path, H.rows()[:20]), len(common.MADE)
    corpus_pipeline.run(spark, folder).collect()
    left = [os.path.basename(p).rpartition("-")[0] for p in common.MADE[before:] if os.path.exists(p.removeprefix("file:"))]
    assert left[0] == "mix_sources" and set(left[1:]) == {"pieces"}
