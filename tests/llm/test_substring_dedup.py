import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from gavelspark.llm import substring_dedup as dedup
from gavelspark.llm.words import find_words
from tests.llm.cases import WORD, edge_rows, edges, nothing, prose


def brute_chunks(text, min_words=dedup.MIN_WORDS):
    """{first word: words} of a text's chunks, one word at a time."""
    words = WORD.findall(text or "")
    hashes = [int(x) >> 20 for x in find_words(pa.array([text], pa.string())).hashes]
    cuts = [0]
    for k in range(len(words)):
        rolled = sum(hashes[k - j] << j for j in range(min(k + 1, 3)))
        if rolled & dedup.CUT_MASK == 0:
            cuts.append(k + 1)
    cuts = sorted({*cuts, len(words)})
    found = {}
    for start in cuts:
        ends = [c for c in cuts if c - start >= min_words]
        if ends:
            found[start] = tuple(words[start:ends[0]])
    return found


def brute_force(rows):
    """{doc_id: words left} of the documents that lose words."""
    chunks = {doc: brute_chunks(text) for doc, text in rows}
    places = defaultdict(list)
    for doc, found in chunks.items():
        for start, words in found.items():
            places[words].append((doc, start))
    left = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone, stays = set(), set()
        for start, chunk in chunks[doc].items():
            if len(places[chunk]) > 1:
                (stays if min(places[chunk]) == (doc, start) else gone).update(range(start, start + len(chunk)))
        if gone - stays:
            left[doc] = [w for k, w in enumerate(words) if k not in gone - stays]
    return left


def found(df):
    return {r.doc_id: WORD.findall(r.text) for r in df.collect()}


def test_chunks_match_brute_force():
    texts = [prose(3, 400), "", None, "a " * 90, prose(5, 19), prose(6, 20), "one\ntwo"]
    words = find_words(pa.array(texts))
    rows, starts, ends, digests = dedup.chunks(words, dedup.MIN_WORDS)
    begin = np.searchsorted(words.rows, np.arange(len(texts)))
    got = defaultdict(dict)
    for row, start, end in zip(rows, starts, ends, strict=True):
        got[int(row)][int(start - begin[row])] = int(end - start)
    assert {k: {s: len(w) for s, w in brute_chunks(t).items()} for k, t in enumerate(texts) if brute_chunks(t)} == got


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(dedup.shortened(docs)) == brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_passages_of_over_fifty_words_go(spark):
    rng = random.Random(3)
    passages = [prose(500 + k, 51 + k % 30).split() for k in range(40)]
    rows, clean = [], []
    for k in range(240):
        words = prose(k, rng.randrange(20, 90)).split()
        if k % 2:
            at = rng.randrange(len(words))
            words[at:at] = passages[k % 40] if k % 4 == 1 else passages[(k * 7) % 40]
        else:
            clean.append(k)
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = found(dedup.shortened(df))
    assert got == brute_force(rows)
    assert not set(clean) & set(got)
    left = {k: " ".join(got.get(k, WORD.findall(text))) for k, text in rows}
    whole = Counter(tuple(p) for p in passages for t in left.values() if " ".join(p) in t)
    assert all(n == 1 for n in whole.values())


def test_all_columns_stay(spark):
    docs = edges(spark)
    rest = dedup.deduplicated(docs)
    assert rest.schema == docs.schema
    got = sorted((tuple(r) for r in rest.collect()), key=str)
    assert len(got) == len(edge_rows())
    lost = brute_force([(r[0], r[1]) for r in edge_rows() if r[0] is not None])
    for row in got:
        same = [r for r in edge_rows() if r[0] == row[0] and r[2:4] == row[2:4] and r[5:] == row[5:]]
        if row[0] in lost:
            assert WORD.findall(row[1]) == lost[row[0]] and row[4] == len(row[1])
        else:
            assert row in same


def test_same_id_with_other_text(spark):
    docs = spark.createDataFrame(
        [(1, prose(1, 60)), (2, prose(9, 30) + " " + prose(1, 60)), (2, prose(8, 70)), (3, prose(1, 60)), (None, prose(1, 60))], "doc_id long, text string")
    left = [(r.doc_id, len(WORD.findall(r.text))) for r in dedup.deduplicated(docs).collect()]
    assert (1, 60) in left and (2, 70) in left and (None, 60) in left and 3 not in {x for x, _ in left}
    assert min(n for x, n in left if x == 2) < 45
    assert dedup.deduplicated(nothing(spark)).count() == 0
    assert dedup.shortened(nothing(spark)).count() == 0
