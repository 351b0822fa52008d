from collections import Counter

import numpy as np

from gavelspark.llm import decontaminate as dec
from gavelspark.llm.queries import ALL
from tests.llm.cases import WORD, edge_rows, edges, nothing, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, doc_id long"


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_force(docs, items):
    """{(doc_id, item_id): similarity}, comparing every window with every item."""
    found = {}
    for doc, text in docs:
        words = split(text)
        for item, other in items:
            wanted = split(other)
            n, width = len(wanted), min(len(wanted), 5)
            if not n:
                continue
            b = Counter(tuple(wanted[k:k + width]) for k in range(n - width + 1))
            known = set(wanted)
            for start in range(len(words) - n + 1):
                if words[start + n // 2] not in known and words[start + n // 3] not in known:
                    continue
                a = Counter(tuple(words[k:k + width]) for k in range(start, start + n - width + 1))
                similarity = sum((a & b).values()) / sum((a | b).values())
                if similarity >= 0.8:
                    found[(doc, item)] = max(similarity, found.get((doc, item), 0))
    return {k: round(v, 9) for k, v in found.items()}


def found(df):
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in df.collect()}


def test_documents_match_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert found(ALL["op6_decontamination"](spark, folder)) == brute_force(docs, items)


def test_edited_passages(spark):
    items = [(1, prose(1, 90)), (2, prose(2, 45)), (3, "a b c"), (4, ""), (5, None), (6, prose(2, 45)), (7, "x y " * 12)]
    docs = []
    for k in range(60):
        words = prose(1 + k % 2, 90 if k % 2 == 0 else 45).split()
        for j in range(k % 4):
            words[(k * 31 + j * 17) % len(words)] = "EDIT"
        docs.append((k, prose(k + 9, 40) + " " + " ".join(words[k % 3:]).upper() + " " + prose(k + 70, 33)))
    docs += [(90, "one a b c two"), (91, "a b d c"), (92, "x y " * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    want = brute_force(docs, items)
    assert 0 < len(want) < len(docs) * 2
    assert found(dec.matches(df, table)) == want
    assert found(dec.matches(df, table, block_items=2)) == want
    kept = {r.doc_id for r in dec.clean(df, table, block_items=3).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_index_finds_all_within_the_radius():
    random = np.random.default_rng(5)
    marks = random.integers(0, 2 ** 63, 300, np.uint64)
    index = dec.Length(np.arange(300), np.zeros((300, 1), np.uint64), marks)
    for mark in marks[:40]:
        for flips in range(0, 30, 3):
            near = mark
            for bit in random.choice(64, flips, replace=False):
                near = near ^ (np.uint64(1) << np.uint64(bit))
            want = [k for k in range(300) if int(near ^ marks[k]).bit_count() <= dec.RADIUS]
            assert index.within_radius(near).tolist() == want


def test_edges(spark):
    docs = edges(spark)
    items = spark.createDataFrame([(1, prose(3, 30), 0), (2, "same " * 20, 0), (None, "ONE", 0)], ITEMS)
    got = Counter((r.doc_id, r.item_id) for r in dec.matches(docs, items).collect())
    assert got == Counter({(5, 1): 2, (6, 2): 1, (4, -1): 1})
    kept = dec.clean(docs, items)
    assert kept.schema == docs.schema
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(str(r) for r in edge_rows() if r[0] not in (4, 5, 6))
    assert dec.matches(nothing(spark), items).count() == 0
    assert dec.clean(docs, items.where("false")).count() == docs.count()


def all_windows(docs, items):
    """{(doc_id, item_id)}, comparing windows of all lengths with every item."""
    met = set()
    for doc, text in docs:
        words = split(text)
        for item, other in items:
            wanted = split(other)
            width = min(len(wanted), 5)
            b = Counter(tuple(wanted[k:k + width]) for k in range(len(wanted) - width + 1))
            grams = [tuple(words[k:k + width]) for k in range(len(words) - width + 1)]
            for first in range(len(grams)):
                for last in range(first + 1, min(len(grams), first + 2 * b.total()) + 1):
                    a = Counter(grams[first:last])
                    if 5 * (a & b).total() >= 4 * (a | b).total():
                        met.add((doc, item))
    return met


def test_documents_shorter_than_an_item(spark):
    items = [(1, prose(1, 59)), (2, prose(2, 5)), (3, "a b c"), (4, prose(4, 45))]
    docs = [(k, " ".join(prose(1, 59).split()[:k])) for k in (58, 50, 49, 48, 47, 46, 5)]
    docs += [(1, prose(2, 4)), (2, "a b"), (3, " ".join(prose(4, 45).split()[1:]))]
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    want = {(58, 1), (50, 1), (49, 1), (48, 1), (3, 4)}
    assert all_windows(docs, items) == want
    for any_length in (False, True):
        got = found(dec.matches(df, table, any_length=any_length))
        assert set(got) == want and got[58, 1] == round(54 / 55, 9)
        assert {r.doc_id for r in dec.clean(df, table, any_length=any_length).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_windows_of_all_lengths(spark):
    items = [(1, prose(1, 45)), (2, prose(2, 30)), (3, "x y " * 12), (4, prose(1, 45) + " and"), (5, "a b c")]
    docs = []
    for k in range(40):
        words = prose(1 + k % 2, (45, 30)[k % 2]).split()
        for j in range(k % 3):
            at = (k * 31 + j * 17) % len(words)
            words[at:at + 1] = [["more", words[at]], []][(k + j) // 3 % 2]
        docs.append((k, prose(k + 9, 12) + " " + " ".join(words[k % 4:]) + " " + prose(k + 70, 9)))
    docs += [(90, "so x y x y x y x y x y x y x y x y x y z"), (91, "a b d c"), (92, " ".join([*prose(1, 45).split()[:20], *prose(1, 45).split()[21:]]) + " z" * 9)]
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    want = all_windows(docs, items)
    assert (92, 1) in want and len(want) > len(found(dec.matches(df, table)))
    assert set(found(dec.matches(df, table, any_length=True))) == want
    assert {r.doc_id for r in dec.clean(df, table, any_length=True).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_similarities_match_counters():
    random = np.random.default_rng(7)
    a, b = random.integers(-1, 9, (50, 12)), random.integers(0, 9, (50, 15))
    want = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = Counter(v if v >= 0 else ("other", k) for k, v in enumerate(x)), Counter(y)
        want.append((p & q).total() / (p | q).total())
    assert dec.similarities(a, b).tolist() == want
    assert dec.similarities(a[:0], b[:0]).tolist() == []


def test_windows_share_their_counts(monkeypatch):
    """Fingerprints are those of each window by itself, in few pieces or many, and a text's shingles are mixed once for each length, not once for each window and shingle."""
    random = np.random.default_rng(3)
    tokens = random.integers(0, 2 ** 63, 900, np.uint64)
    for size in (1, 7, 64):
        starts = np.flatnonzero(random.random(900 - size + 1) < 0.3)
        for limit in (1 << 15, 50):
            monkeypatch.setattr(dec, "_TOKENS", limit)
            assert dec.window_fingerprints(tokens, starts, size).tolist() == dec.fingerprints(tokens[starts[:, None] + np.arange(size)]).tolist()
        assert dec.window_fingerprints(tokens, starts[:0], size).tolist() == []
    monkeypatch.undo()
    texts = [prose(1, 60), prose(2, 50)]
    benchmark = dec.Benchmark.of([1, 2], texts)
    calls, mix = [], dec.mix
    monkeypatch.setattr(dec, "mix", lambda x: calls.append(x.size) or mix(x))
    docs = [prose(k + 9, 30) + " " + texts[k % 2] + " " + prose(k + 70, 30) for k in range(50)]
    assert {(row, item) for row, item, *_ in dec.find(dec.pa.array(docs), benchmark, 80)} == {(k, 1 + k % 2) for k in range(50)}
    assert sum(calls) <= 50 * 2 * 120 and len(calls) <= 2


def test_entries_in_turns(monkeypatch):
    """Windows meet the same items when index entries and pairs are looked at a few at a time."""
    items = [prose(1, 45), prose(1, 45) + " more", "x y " * 12, prose(1, 44) + " end"]
    docs = dec.pa.array([prose(5, 20) + " " + prose(1, 45) + " x y" * 30, None, "x y " * 11, prose(1, 40)])
    benchmark = dec.Benchmark.of([1, 2, 3, 4], items)
    want = dec.find(docs, benchmark, 80, True)
    assert {(r[0], r[1]) for r in want} >= {(0, 1), (0, 2), (0, 3), (0, 4), (2, 3)}
    for name in ("_ENTRIES", "_TOKENS", "_COMPARED"):
        monkeypatch.setattr(dec, name, 1)
    assert dec.find(docs, benchmark, 80, True) == want
