import random
import re
import zlib
from collections import Counter

from gavelspark.llm import spelling
from gavelspark.llm.queries import ALL
from tests.llm.cases import edges, nothing

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))


def brute(rows):
    """The contract, word by word, with every pair of words compared."""
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    out = {}
    for w, n in words.items():
        top = min(near[w], key=lambda v: (-words[v], v), default=None)
        form = top if top is not None and words[top] >= 5 * n else None
        out[w] = [form, None, n, len(near[w]), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row[1] = root
    return out


def test_scan_finds_exactly_the_pairs_of_one_edit():
    rnd = random.Random(5)
    for letters in ("ab", "abé", "abcd"):
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))) for _ in range(300)})
        assert set(spelling.near_in_block(words)) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_rows_equal_brute_force(spark):
    rnd = random.Random(9)
    base = ["colour", "neighbour", "theatre", "organise", "travelling", "programme"]
    rows = []
    for k in range(400):
        word = rnd.choice(base)
        if k % 7 == 0:
            i = rnd.randrange(len(word))
            word = word[:i] + rnd.choice("xyz") + word[i + 1:]
        if k % 11 == 0:
            word = word[:2] + word[3:]
        rows.append((k, f"The {word.upper() if k % 5 == 0 else word}, {word}s and Straße {word}é"))
    rows += [(None, "colour colour"), (5, "colour colour"), (500, None), (501, "")]
    got = {r["word"]: [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]]
           for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert any(v[0] for v in got.values())


def test_odd_rows(spark):
    assert spelling.variants(nothing(spark)).count() == 0
    got = spelling.variants(edges(spark)).collect()
    assert {r["word"] for r in got} == set(brute([(r[0], r[1]) for r in edges(spark).collect()]))


def test_query_matches_brute_force_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["word"]: [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]]
           for r in ALL["op13_spelling"](spark, "/root/testdata/sf0.001").collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs])
