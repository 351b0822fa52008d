import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gavelspark.llm import mixing
from gavelspark.llm.queries import ALL, ORACLE_SQL
from tests.compare import connect, differences
from tests.llm.cases import edge_rows, edges, nothing

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def water(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        room = total - sum(full.values())
        share = {s: room * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return share | full
        full |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_its_sql(spark, folder):
    assert differences(spark, connect(folder), folder, ALL["op2_mixing"], ORACLE_SQL["op2_mixing"]) == []


def test_targets_and_takings(spark):
    """One source with half of everything, one tiny, one null; several blocks for the large one."""
    rows = [(k, "w " * (k % 37 + 1), "big" if k % 2 else f"s{k % 5}") for k in range(3000)]
    rows += [(5000, "one two", "tiny"), (5001, "x " * 900, None), (5002, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in found:
        sizes[r.source] += r.size
    want = water(sizes)
    took = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        took[r.source] += r.taken
    assert all(want[s] - 40 <= took[s] <= want[s] for s in sizes)
    again = mixing.taken(docs.repartition(7)).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r[c] for c in COLUMNS) for r in found)


def test_draws_follow_the_hypergeometric_distribution(spark):
    total, marked, drawn = 40, 13, 17
    u = (F.col("id") + 0.5) / 20000.0
    frame = spark.range(20000).select(mixing.hypergeometric(*(F.lit(x).cast("long") for x in (total, marked, drawn)), u).alias("k"))
    got = {r.k: r["count"] / 20000 for r in frame.groupBy("k").count().collect()}
    for k in range(marked + 1):
        p = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
        assert abs(got.get(k, 0) - p) < 2e-4
    edge = spark.createDataFrame([(0, 0, 0), (5, 5, 2), (5, 0, 2), (7, 3, 7), (10 ** 9, 4 * 10 ** 8, 5 * 10 ** 8)], "n long, m long, d long")
    ks = [r.k for r in edge.select(mixing.hypergeometric(F.col("n"), F.col("m"), F.col("d"), F.lit(0.5)).alias("k")).collect()]
    assert ks[:4] == [0, 2, 0, 3] and abs(ks[4] - 2 * 10 ** 8) < 5


def test_tree_keeps_quotas_and_halves(spark):
    quotas = {0: 100, 1: 37, 2: 1, 3: 0, 4: 262}
    df = spark.createDataFrame(list(quotas.items()), "rank long, quota long")
    bounds = {r["rank"]: r.bounds for r in mixing.split_tree(df, 8, 3).collect()}
    assert {k: b[-1] for k, b in bounds.items()} == quotas
    sizes = [sum(b[j] - (b[j - 1] if j else 0) for b in bounds.values()) for j in range(8)]
    assert sizes == [50] * 8
    assert bounds == {r["rank"]: r.bounds for r in mixing.split_tree(df, 8, 3).collect()}


def test_mix_is_what_was_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 900)
    rows = [(k, " ".join(f"w{j}" for j in range(k % 11 + 1)), f"s{k % 4}", k) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    mix = mixing.mixed(docs).collect()
    took = {r.doc_id: r.taken // r.size for r in mixing.taken(docs).collect() if r.taken}
    assert Counter(r.doc_id for r in mix) == Counter(took)
    assert {tuple(r[:4]) for r in mix} <= set(rows)
    assert len({(r.doc_id, r.mix_copy) for r in mix}) == len(mix)
    shards = Counter(r.mix_shard for r in mix)
    assert len(shards) == 8  # of about 900 words each


def test_edges(spark):
    docs = edges(spark)
    found = mixing.taken(docs)
    assert found.columns == COLUMNS and found.count() == len(edge_rows())
    assert {r.doc_id for r in found.where("size = 0").collect()} == {1, 2, 3}
    mix = mixing.mixed(docs)
    assert mix.columns[:len(docs.columns)] == docs.columns
    assert {tuple(r)[:8] for r in mix.collect()} <= set(edge_rows())
    assert mixing.taken(nothing(spark)).count() == 0 and mixing.mixed(nothing(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.taken(blank).collect()] == [(0.0, 0), (0.0, 0)]
