from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from gavelspark.llm import quality_rules as rules
from gavelspark.llm.queries import ALL
from tests.llm.cases import WORD, edge_rows, edges, nothing

FOLDER = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = Counter(line for line in text.split("\n") if WORD.search(line))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(n - 1 for n in lines.values()), len(inside)


def failed(n):
    return n[0] < 10 or 100 * n[4] > 20 * n[0]


def test_counts_match_brute_force(spark):
    for docs in (edges(spark), spark.read.parquet(f"{FOLDER}/documents.parquet")):
        found = rules.verdicts(docs, None).collect()
        expected = [(r.doc_id, *counted(r.text), failed(counted(r.text))) for r in docs.collect()]
        assert sorted(map(str, expected)) == sorted(str(tuple(r[:7])) for r in found)
        assert all(r.kept == (not r.base_failed) for r in found)


def test_forest_rejects_symbols_and_keeps_prose(spark):
    docs = spark.createDataFrame(
        [(k, " ".join(f"wo{k}rd{j % 40}a{j}" + ("%%%" if k % 7 == 0 else "") for j in range(60))) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 7 != 0), 0) for k in range(200)] + [(None, 1, 0), (5, None, 0)], LABELS)
    forest = rules.fit(docs, labels)
    kept = {r.doc_id for r in rules.verdicts(docs, forest).collect() if r.kept}
    assert kept == {k for k in range(300) if k % 7}
    again = rules.fit(docs.repartition(7), labels.repartition(3))
    assert again.threshold == forest.threshold and np.array_equal(again.cut, forest.cut)
    assert {r.doc_id for r in rules.keep(docs, forest).collect()} == kept


def test_edges_keep_all_columns(spark):
    docs = edges(spark)
    kept = rules.keep(docs, None)
    assert kept.schema == docs.schema
    want = [r for r in edge_rows() if not failed(counted(r[1]))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in kept.collect())


def test_batches_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "")], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)
    assert [tuple(r[1:7]) for r in rules.verdicts(docs, rules.fit(docs, labels)).collect()] == [(0, 0, 0, 0, 0, True)] * 3


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], LABELS)
    assert rules.fit(edges(spark), none) is None
    assert rules.fit(nothing(spark), none) is None
    assert rules.verdicts(nothing(spark), None).count() == 0
    assert rules.keep(nothing(spark), None).count() == 0


def test_query_covers_all_documents(spark):
    found = ALL["op1_quality_rules"](spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")
    good = found.join(labels, "doc_id").where("not base_failed")
    assert good.where("not kept").count() <= 0.02 * good.count()


def test_labels_of_any_number_type_or_text(spark):
    docs = spark.createDataFrame(
        [(k, " ".join(f"wo{k}rd{j % 40}a{j}" + ("%%%" if k % 7 == 0 else "") for j in range(60))) for k in range(300)], "doc_id long, text string")
    rows = [(k, int(k % 7 != 0), 0) for k in range(200)]
    forest = rules.fit(docs, spark.createDataFrame(rows, LABELS))
    for kind in ("bigint", "double", "string"):
        typed = spark.createDataFrame(rows + [(300, None, 0)], LABELS).withColumn("quality", F.col("quality").cast(kind))
        again = rules.fit(docs, typed.unionByName(typed.limit(0)))
        assert again.threshold == forest.threshold and np.array_equal(again.cut, forest.cut)
    text = spark.createDataFrame([(k, str(q) if k % 5 else "x", t) for k, q, t in rows], "doc_id long, quality string, toxic int")
    assert rules.fit(docs, text) is not None


def symbol_rows(n):
    """Documents with a share of symbols that few others have, and labels: bad ones have more of them, but not always."""
    texts = [" ".join(f"wo{k}rd{j}" + "%" * (j < k % 5 + 6 * (k % 9 == 0) * (k % 11 > 0)) for j in range(12)) + f" {'x' * (k % 17)}" for k in range(n)]
    return [(k, text) for k, text in enumerate(texts)], [(k, int(k % 9 > 0), 0) for k in range(n)]


def brute_threshold(forest, rows, labels):
    x = rules.statistics(pa.array([text for _, text in rows]))[1]
    good = np.array([quality for _, quality, _ in labels]) == 1
    scores = forest.scores(x)
    steps, most, threshold = [*sorted(set(scores), reverse=True), 0.0], 0, 1.0
    for s, below in zip(steps, steps[1:], strict=False):
        gain = (scores[~good] >= s).sum() - 10 * (scores[good] >= s).sum()
        if gain > most:
            most, threshold = gain, (s + below) / 2
    return threshold


def test_all_labelled_rows_are_fitted(spark):
    rows, labels = symbol_rows(24_000)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    assert rules.points(docs, marks).agg(F.sum("good"), F.sum("bad")).first()[:] == (21_333, 2_667)
    forest = rules.fit(docs, marks)
    x = rules.statistics(pa.array([text for _, text in rows]))[1]
    good = x[np.array([quality for _, quality, _ in labels]) == 1]
    good = good[np.lexsort(good.T)]
    whole = rules.grow(lambda t, random: good[random.choice(len(good), 256, replace=False)], x.min(0), x.max(0))
    assert np.array_equal(forest.cut, whole.cut) and np.array_equal(forest.path, whole.path)
    assert forest.threshold == brute_threshold(forest, rows, labels) < 1


def test_trees_draw_from_more_rows_than_come_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(rules, "TREES", 6)
    rows, labels = symbol_rows(4_000)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    forest = rules.fit(docs, marks)
    assert forest.threshold == brute_threshold(forest, rows, labels) < 1
    again = rules.fit(docs.repartition(7), marks.repartition(3))
    assert again.threshold == forest.threshold and np.array_equal(again.cut, forest.cut) and np.array_equal(again.path, forest.path)
    few = [(float(k), *[0.5] * 6) for k in range(700)]
    found = spark.createDataFrame([([*x], 1 + 3000 * (x[0] == 5), 1) for x in few] + [([-1.0] * 7, 0, 4)], "features array<double>, good long, bad long")
    drawn = [[tuple(x) for x in rules.tree_rows(found, 3_700)(t, None)] for t in range(6)]
    assert all(len(x) == 256 and set(x) <= set(few) for x in drawn) and len({tuple(x) for x in drawn}) == 6
    assert all(150 < x.count(few[5]) < 256 and max(n for row, n in Counter(x).items() if row != few[5]) == 1 for x in drawn)
    assert len(set().union(*drawn)) > 200
