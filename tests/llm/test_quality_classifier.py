import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from gavelspark.llm import quality_classifier as quality
from gavelspark.llm.queries import ALL
from tests.llm.cases import edge_rows, edges, nothing

LABELS = "doc_id long, quality int, toxic int"
FOLDER = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[a-z\x80-\U0010ffff]+|[0-9]+|[^a-z0-9\x80-\U0010ffff\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_features_are_counts_of_words_and_pairs():
    texts = ["Que%%% que&&& 12a, a  12A", None, "", "x", "one two one two"]
    rows, slots, values = quality.features(pa.array(texts))
    for k, text in enumerate(texts):
        w = words(text)
        counts = sorted(math.log1p(c) for c in [*Counter(w).values(), *Counter(zip(w, w[1:])).values()])
        length = math.sqrt(sum(c * c for c in counts))
        assert np.allclose(sorted(values[rows == k]), [c / length for c in counts])
        assert len(set(slots[rows == k])) == len(counts)


def test_updates_match_the_formula():
    leader = quality.Leader(4)
    z, n = [0.0] * 5, [0.0] * 5
    data = [([0, 2], [0.6, 0.8], 1), ([1], [1.0], 0), ([0, 1], [0.8, 0.6], 1), ([2], [1.0], 0)] * 5

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for slots, values, y in data:
        leader.update(np.array(slots), np.array(values), y)
        x = dict(zip([*slots, 4], [*values, 1.0]))
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
            z[i], n[i] = z[i] + g - s * w[i], n[i] + g * g
    assert np.allclose(leader.weights(), [weight(i) for i in range(5)])


def test_held_out_documents(spark):
    found = ALL["op4_quality_classifier"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.97
    assert np.mean([(r.predicted == r.quality) for r in rows]) > 0.95


def test_query_covers_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = ALL["op4_quality_classifier"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_not_seen(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} and {'bad' if k % 2 else 'fine'} text") for k in range(200)], "doc_id long, text string")
    labels = [(k, 1 - k % 2, 0) for k in range(200)]
    lied = [(k, q if zlib.crc32(str(k).encode()) % 5 else 1 - q, t) for k, q, t in labels]
    fits = [quality.fit(docs.repartition(n), spark.createDataFrame(rows, LABELS)) for n, rows in ((1, labels), (3, lied))]
    assert np.array_equal(*fits)
    assert {r.predicted for r in quality.scored(docs.where("doc_id % 2 = 0"), fits[0]).collect()} == {1}


def test_edges(spark):
    docs = edges(spark)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0), (6, 0, 1), (9, 3, 0)], LABELS)
    for marks in (labels, labels.where("quality = 1"), labels.where("false")):
        rows = quality.scored(docs, quality.fit(docs, marks)).collect()
        assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert quality.scored(nothing(spark), quality.fit(nothing(spark), labels)).count() == 0


def test_labels_of_any_number_type_or_text(spark):
    docs = edges(spark)
    rows = [(5, 1, 0), (6, 0, 0), (8, 1, 0), (9, 0, 0), (10, 1, 0), (7, None, 0)]
    base = quality.fit(docs, spark.createDataFrame(rows, LABELS))
    for kind in ("bigint", "double", "string"):
        typed = spark.createDataFrame(rows, LABELS).selectExpr("doc_id", f"CAST(quality AS {kind}) AS quality", "toxic")
        assert np.array_equal(quality.fit(docs, typed), base)
