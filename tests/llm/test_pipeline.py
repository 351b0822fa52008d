"""The pipeline's stages, each on what its predecessor kept, against the brute-force versions of the operators' own tests."""

import corpus_pipeline as pipeline
from gavelspark.llm import mixing
from gavelspark.llm.shared import table
from tests.llm import test_decontaminate, test_jaccard_join, test_quality_rules, test_substring_dedup
from tests.llm.cases import WORD, edge_rows, edges, nothing

FOLDER = "/root/testdata/sf0.001"


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_stages_match_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    before, kept = docs.collect(), {}
    for name, stage in pipeline.STAGES[:-1]:
        df = stage(spark, spark.createDataFrame(before, docs.schema), FOLDER)
        assert df.schema == docs.schema
        kept[name] = (before, df.collect())
        before = kept[name][1]
    given, left = kept["quality rules"]
    base = {r.doc_id for r in given if not test_quality_rules.failed(test_quality_rules.counted(r.text))}
    good = {r.doc_id for r in table(spark, FOLDER, "labels").where("quality = 1").collect()} & base
    assert {r.doc_id for r in left} <= base and len(good & {r.doc_id for r in left}) >= 0.95 * len(good)
    given, left = kept["n-gram Jaccard join"]
    want = {doc for doc, _, component in test_jaccard_join.brute_force([(r.doc_id, r.text) for r in given]) if doc == component}
    assert {r.doc_id for r in left} == want and len(left) == len(want)
    given, left = kept["substring dedup"]
    lost = test_substring_dedup.brute_force([(r.doc_id, r.text) for r in given])
    assert {r.doc_id: WORD.findall(r.text) for r in left} == {r.doc_id: lost.get(r.doc_id, WORD.findall(r.text)) for r in given if lost.get(r.doc_id, 1)}
    assert all(r.text == texts(given)[r.doc_id] and r.n_chars is not None for r in left if r.doc_id not in lost)
    given, left = kept["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    leaks = {doc for doc, _ in test_decontaminate.brute_force([(r.doc_id, r.text) for r in given], items)}
    assert {r.doc_id for r in left} == {r.doc_id for r in given} - leaks
    last = spark.createDataFrame(left, docs.schema)
    mix = pipeline.STAGES[-1][1](spark, last, FOLDER).collect()
    took = {r.doc_id: r.taken // r.size for r in mixing.taken(last).collect() if r.taken}
    assert {d: sum(r.doc_id == d for r in mix) for d in {r.doc_id for r in mix}} == took
    assert {tuple(r[:len(docs.columns)]) for r in mix} <= {tuple(r) for r in left}


def test_run_is_all_stages(spark):
    mix = pipeline.run(spark, FOLDER)
    assert mix.columns[:5] == table(spark, FOLDER, "documents").columns and mix.count() > 0


def test_stages_take_odd_documents(spark):
    for docs in (edges(spark), nothing(spark)):
        for _, stage in pipeline.STAGES:
            found = stage(spark, docs, FOLDER)
            assert found.columns[:len(docs.columns)] == docs.columns
            assert found.count() <= 3 * len(edge_rows())
