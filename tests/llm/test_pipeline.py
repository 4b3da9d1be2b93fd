import os

import corpus_pipeline
from gleanframe.llm import decontaminate, mixing, simhash, token_files
from gleanframe.llm.common import table
from tests.conftest import SMALL


def test_stages_take_effect_in_order(spark):
    docs = table(spark, SMALL, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SMALL)
        if name != "token files":
            assert result.columns == table(spark, SMALL, "documents").columns
        seen[name] = [r.doc_id for r in result.select("doc_id").collect()]
        if name == "simhash near-dedup":
            assert set(seen[name]) == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        if name == "benchmark decontamination":
            bad = decontaminate.contaminated_pairs(docs, table(spark, SMALL, "benchmark")).collect()
            assert bad and set(seen[name]) == {r.doc_id for r in docs.collect()} - {r.doc_id for r in bad}
        if name == "mixing sources":
            assert len(seen[name]) == sum(r.copies for r in mixing.mix_report(docs).collect())
        docs = result
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)
    assert sorted(seen["token files"]) == sorted(seen["mixing sources"])


def test_toxic_documents_go_and_clean_ones_stay(spark):
    name, stage = corpus_pipeline.STAGES[0]
    kept = {r.doc_id for r in stage(spark, table(spark, SMALL, "documents"), SMALL).collect()}
    labels = table(spark, SMALL, "labels").collect()
    clean = [r.doc_id for r in labels if r.toxic == 0]
    toxic = [r.doc_id for r in labels if r.toxic == 1]
    assert all(i in kept for i in clean)
    assert sum(i in kept for i in toxic) <= len(toxic) / 2


def test_run_gives_the_rows_of_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_empty_documents_pass_through(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SMALL, name).limit(0).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_stage_changes_what_it_keeps(spark):
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert all(texts[r.doc_id] == tuple(r) for r in docs.collect()), name


def test_tokens_follow_the_ids(spark):
    docs = table(spark, SMALL, "documents").limit(20)
    rows = sorted(token_files.encode_and_read(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
