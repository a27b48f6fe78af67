"""The pipeline, stage by stage, against the operators' own decisions."""

import corpus_pipeline
from fieldmark.llm import decontam, near_dedup, secrets
from fieldmark.llm.frames import settle, table


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_level_bpe"]
    docs = table(spark, sf, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(settle(stage(spark, kept[-1], sf)))
    assert all(k.columns == docs.columns for k in kept[:-1])
    n = [k.count() for k in kept]
    assert n[1] == n[0]  # every text has a language
    assert n[2] == near_dedup.near_groups(kept[1]).filter("kept").count() < n[1]
    hit = {r.doc_id for r in decontam.contaminations(kept[2], table(spark, sf, "benchmark")).collect()}
    assert hit and {r.doc_id for r in kept[3].collect()} == {r.doc_id for r in kept[2].collect()} - hit
    assert n[4] == n[3] == n[5]
    assert not [r for r in kept[4].collect() if secrets.spans_of(r.text)]
    assert not [r for r in kept[5].collect() if len(r.ids) != 4 * r.n_tokens]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
