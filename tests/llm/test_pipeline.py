"""The whole pipeline against brute-force versions of its stages, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from adlens.llm.common import staged
from tests.llm import test_decontam, test_jaccard, test_linededup
from tests.llm.fixtures_llm import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    names = list(stages)
    assert 4 <= len(names) <= 5

    good = staged(stages[names[0]](spark, docs, SF), "t")
    assert good.columns == columns
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in texts_of(good)}
    clean = [d for d, x in labels.items() if x == (1, 0)]
    assert sum(d in kept for d in clean) > 0.9 * len(clean)

    cut = staged(stages[names[1]](spark, good, SF), "t")
    assert cut.columns == columns
    assert sorted(texts_of(cut), key=str) == test_linededup.brute(texts_of(good))
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    one = staged(stages[names[2]](spark, cut, SF), "t")
    assert one.columns == columns
    assert sorted(d for d, _ in texts_of(one)) == [d for d, _, c in test_jaccard.brute(texts_of(cut)) if c == d]

    free = staged(stages[names[3]](spark, one, SF), "t")
    assert free.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, *_ in test_decontam.brute(texts_of(one), items)}
    assert sorted(d for d, _ in texts_of(free)) == sorted(d for d, _ in texts_of(one) if d not in hit)

    packed = stages[names[4]](spark, free, SF).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in texts_of(free)}
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "start", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed)
