"""The pipeline on the smallest tables, stage by stage."""

import collections
import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from cellweave.llm.common import table, written

    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = written(stage(spark, docs, SF))
        out.append((name, docs))
    return out


def test_stages(spark, stages):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in stages] == ["quality_rules", "exact_dedup", "ngram_join", "mixing", "packing"]
    assert all(sorted(d.columns) == sorted(docs.columns) for _, d in stages[:-1])
    rules, exact, near, mixed, packed = ([r.asDict() for r in d.collect()] for _, d in stages)
    assert rules and all(len(WORD.findall(r["text"])) >= 50 for r in rules)
    last = {}
    for r in rules:
        key = r["text"].encode().lower()
        last[key] = max(last.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(last.values())
    assert {r["doc_id"] for r in near} <= {r["doc_id"] for r in exact}

    def grams(t):
        w = WORD.findall(t.encode().lower().decode())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = {r["doc_id"]: grams(r["text"]) for r in exact}
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert {r["doc_id"] for r in near} == set(label.values())
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in near} and max(times.values()) <= 2
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == times
    assert corpus_pipeline.run(spark, SF).columns == stages[-1][1].columns
