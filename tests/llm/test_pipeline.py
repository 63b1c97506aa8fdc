"""The pipeline over the smallest tables, stage by stage."""

import itertools
import re

import corpus_pipeline
from panelsmith.llm.common import materialise

SMALL = "/root/testdata/sf0.001"


def firsts_of_classes(texts):
    """Smallest id of each class of texts whose five-word shingle sets have a similarity of 0.8, over all pairs."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in sets if root[i] == i}


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "near_copies":
            assert {r.doc_id for r in docs.collect()} == firsts_of_classes({r.doc_id: r.text for r in before.collect()})
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > 0.7 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert len(corpus_pipeline.run(spark, SMALL).toPandas()) == len(packed)
