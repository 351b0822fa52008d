from collections import Counter, defaultdict

import numpy as np

from gavelspark.llm import jaccard_join as join
from gavelspark.llm.components import components, merged
from tests.llm.cases import WORD, edge_rows, edges, nothing, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def brute_force(rows):
    """{(doc_id, n_shingles, component_id)}, by counting what every pair of documents shares."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for k, tokens in enumerate(sets):
        met = Counter(j for token in tokens for j in holders[token])
        for j, both in met.items():
            if 100 * both >= 80 * (len(tokens) + len(sets[j]) - both):
                parent[max(root(j), root(k))] = min(root(j), root(k))
        for token in tokens:
            holders[token].append(k)
    smallest = {}
    for k, (doc, _) in enumerate(rows):
        smallest[root(k)] = min(doc, smallest.get(root(k), doc))
    return Counter((doc, len(sets[k]), smallest[root(k)]) for k, (doc, _) in enumerate(rows))


def found(df):
    return Counter(map(tuple, df.collect()))


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(join.near_copies(docs)) == brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_family_of_edited_copies(spark):
    """Copies of one text with a few words changed each: many are linked only through others."""
    rows = []
    for k in range(160):
        words = prose(1, 150).split()
        for j in range(k % 5):
            words[(k * 37 + j * 53) % 150] = f"edit{k}and{j}"
        rows.append((1000 - k, " ".join(words)))
    rows += [(2000 + k, prose(1, 150) + " " + prose(k + 50, 20 + k)) for k in range(40)]  # from near to far
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(join.near_copies(docs)) == brute_force(rows)


def test_threshold_is_met_exactly(spark):
    base = [f"t{k}" for k in range(94)]  # 90 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:76])), (3, " ".join(base[:75])), (4, "ONE two"), (5, "one two"), (6, "two one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(join.near_copies(docs)) == brute_force(rows)
    assert {r.doc_id: r.component_id for r in join.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_edges(spark):
    got = found(join.near_copies(edges(spark)))
    rows = [(r[0], r[1]) for r in edge_rows()]
    want = brute_force([r for r in rows if r[0] is not None])
    want[(None, len(shingles(rows[4][1])), None)] += 1
    assert got == want
    assert join.near_copies(nothing(spark)).count() == 0


def test_keep_one(spark):
    docs = edges(spark)
    kept = join.keep_one(docs)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert join.keep_one(nothing(spark)).count() == 0


def test_groups_come_from_one_shuffle_and_copies_count_once(spark):
    """Groups of 1, 2 and many; equal postings come from several tasks."""
    rows = [(1, 5), (2, 7), (2, 6), (2, 7)] + [(3, k) for k in range(20) for _ in range(3)]
    members = join._members(spark.createDataFrame(rows, "token long, node long").repartition(3))
    first = list(range(join.LEADERS))
    want = [(2, 6, 1, [6, 7, None, None]), (2, 7, 2, [6, 7, None, None])] + [(3, k, min(k + 1, join.LEADERS + 1), first) for k in range(20)]
    assert sorted((r.token, r.node, r.place, r.leaders) for r in members.collect()) == want
    postings = spark.createDataFrame(rows, "token long, node long")
    plan = join._members(postings)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert join._members(postings)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_groups_of_the_same_classes_are_one(spark):
    rows = [(t, n) for t in range(12) for n in (5, 6)] + [(20, n) for n in (5, 6, 7)]
    merged = join._merged(join._members(spark.createDataFrame(rows, "token long, node long").repartition(3))).collect()
    assert sorted((r.node, r.place) for r in merged) == [(5, 1), (5, 1), (6, 2), (6, 2), (7, 3)]
    assert len({r.token for r in merged}) == 2 and len({(r.token, r.node) for r in merged}) == 5


def test_a_pair_is_formed_in_one_of_its_groups(spark, monkeypatch):
    """All pairs of different components, and those of the groups' leaders, leave the join once, however many groups they share."""
    rows = [(t, n, n % 3, k + 1) for t in range(9) for k, n in enumerate(n for n in range(8) if n != t)]
    groups = spark.createDataFrame(rows, "token long, node long, label long, place int")
    traits = spark.createDataFrame([(n, 50, *[1] * 4, *[0] * 8) for n in range(8)], ["node", *join._TRAITS])
    monkeypatch.setattr(join, "LEADERS", 2)
    listed = join.LISTED
    for leaders in (False, True):
        want = {(a, b) for t, a, x, k in rows for u, b, y, _ in rows if t == u and a < b and x != y and (k <= 2 or not leaders)}
        for limit in (listed, 3):
            monkeypatch.setattr(join, "LISTED", limit)
            met = join._met(groups, traits, 80, leaders)
            assert sorted(map(tuple, met.collect())) == sorted(want)
        monkeypatch.setattr(join, "LISTED", listed)
        with monkeypatch.context() as patched:
            patched.setattr(type(met), "distinct", lambda df: df)
            assert sorted(map(tuple, join._met(groups, traits, 80, leaders).collect())) == sorted(want)


def family(edits):
    """Copies of one text with a few words changed each, and texts that share a passage only."""
    rows = []
    for k in range(60):
        words = prose(1, 150).split()
        for j in range(k % 5):
            words[(k * 37 + j * 53) % 150] = f"edit{k}and{j}"
        rows.append((1000 - k, " ".join(words)))
    return rows + [(2000 + k, prose(k + 50, 100) + " " + prose(3, 9)) for k in range(edits)]


def test_few_pairs_are_compared_at_once(spark, monkeypatch):
    """A round costs more than it saves while pairs are few or it halves them not; results are the same with any number of rounds."""
    rows = family(30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rounds, met = [], join._met
    monkeypatch.setattr(join, "_met", lambda groups, traits, percent, leaders: rounds.append(leaders) or met(groups, traits, percent, leaders))
    monkeypatch.setattr(join, "CROSS", 0)
    monkeypatch.setattr(join, "LEADERS", 2)
    assert found(join.near_copies(docs)) == brute_force(rows)
    assert rounds == [False]
    rounds.clear()
    monkeypatch.setattr(join, "FEW", 0)
    assert found(join.near_copies(docs)) == brute_force(rows)
    assert rounds[0] and not rounds[-1]


def test_only_sets_of_candidates_are_made(spark, monkeypatch):
    """Texts that share a passage but are in no pair after the filters stay where they are."""
    rows = [(k, prose(k + 50, 100) + " " + prose(3, 9)) for k in range(40)] + [(100, prose(1, 90)), (101, prose(1, 90) + " end"), (101, prose(1, 90) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made, token_sets = [], join._token_sets

    def counted(*args):
        made.append(token_sets(*args).count())
        return token_sets(*args)

    monkeypatch.setattr(join, "_token_sets", counted)
    assert {r.component_id for r in join.near_copies(docs).where("doc_id >= 100").collect()} == {100}
    assert made[0] == 2


def test_labels_take_further_links(spark):
    random = np.random.default_rng(2)
    schema = "a long, b long"
    for n in (40, 90):
        old, new = (random.integers(0, 100, (n // 2, 2)).tolist() for _ in range(2))
        first = components(spark.createDataFrame(old, schema))
        want = {tuple(r) for r in components(spark.createDataFrame(old + new, schema)).collect()}
        got = [tuple(r) for r in merged(first, spark.createDataFrame(new, schema)).collect()]
        assert len(got) == len(set(got)) and set(got) == want
