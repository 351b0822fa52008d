import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from gavelspark.llm import language_id as lid
from gavelspark.llm.queries import ALL
from tests.llm.cases import edge_rows, edges, nothing

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    """What a model reads: gaps as spaces, three before the text and one after."""
    out = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    body = " ".join(out)
    return f"   {body} " if body else ""


class Brute:
    """Interpolated Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        self.counts = [None] * 5
        self.counts[4] = Counter(t[k:k + 4] for t in map(plain, texts) for k in range(len(t) - 3))
        for n in (3, 2, 1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.d, self.total, self.kinds = [0] * 5, [None] * 5, [None] * 5
        for n in range(1, 5):
            ones, twos = (sum(c == k for c in self.counts[n].values()) for k in (1, 2))
            self.d[n] = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
            self.total[n], self.kinds[n] = Counter(), Counter()
            for g, c in self.counts[n].items():
                self.total[n][g[:-1]] += c
                self.kinds[n][g[:-1]] += 1

    def p(self, gram, floor):
        for n in range(1, 5):
            g = gram[4 - n:]
            total = self.total[n][g[:-1]]
            if total:
                c = self.counts[n][g]
                floor = floor * self.d[n] * self.kinds[n][g[:-1]] / total + (c - self.d[n]) / total * (c > 0)
        return floor


def test_entropies_match_brute_force(spark):
    docs = spark.createDataFrame(
        [(k, t, lang) for k, (t, lang) in enumerate([
            ("The cat sat on the mat, that cat!", "en"), ("And the dog; then 12 more cats", "en"), ("Der Hund und die Katze", "de"), ("Über allen Gipfeln ist Ruh", "de"),
            ("日本語の文章", "ja"), ("日本\U00020000語", "ja"), ("no label", None), (None, "en"), ("", "de"), ("1 2 3", "en")] * 3)], "doc_id long, text string, lang string")
    models = lid.fit(docs, sample=10 ** 6)
    used = [r for r in docs.collect() if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert models.languages == ["de", "en", "ja"]
    brute = [Brute([r.text for r in used if r.lang == lang]) for lang in models.languages]
    alphabet = len({c for r in used for c in plain(r.text)})
    texts = ["the hound", "Katzé und x", "日本", "\n\n so Über \U00020000 1a", "q", None, "3", " z"]
    entropy, counts = models.entropies(pa.array(texts))
    for k, text in enumerate(texts):
        t = plain(text)
        assert (counts[k] > 0) == bool(t)
        for j, b in enumerate(brute):
            want = [-math.log(b.p(t[i:i + 4], 1 / (alphabet + 1))) for i in range(len(t) - 3)]
            assert not want or math.isclose(entropy[k, j], sum(want) / len(want), rel_tol=1e-9), (text, j)


def test_held_out_documents(spark):
    found = ALL["op3_language_id"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count() == found.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in rows) < 0.05 * len(rows)


def test_rejection(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    models = lid.fit(docs)
    _, score, rejected = models.judged(pa.array(["zxqj kvwq zzxq jqxv " * 20, docs.first().text, "русский текст здесь"]))
    assert rejected.tolist() == [True, False, True] and score[0] < 1 and score[2] < 1


def test_edges(spark):
    docs = edges(spark)
    models = lid.fit(docs)
    assert models.languages == ["de", "en", "fr", "xx"] or set(models.languages) <= {"de", "en", "fr", "xx"}
    found = lid.identified(docs, models).collect()
    assert len(found) == len(edge_rows())
    assert {r.doc_id: r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == dict.fromkeys((1, 2, 3), "und")
    assert all(r.lang_pred != "und" for r in found if r.doc_id not in (1, 2, 3))
    assert lid.identified(nothing(spark), models).count() == 0
    none = lid.fit(nothing(spark))
    assert {(r.lang_pred, r.score) for r in lid.identified(docs, none).collect()} == {("und", 0.0)}


def test_probabilities_sum_to_one(spark):
    models = lid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    letters = np.array([0, *map(ord, "abcdefghijklmnopqrstuvwxyzßäöüéèêçñóíáàúëîïôûâœ")])
    for context in ("the", "zqx", "  d"):
        a, b, c = (0 if x == " " else ord(x) for x in context)
        p = models.probabilities(np.full(len(letters), (a << 21) | b), (c << 21) | letters)
        assert (p > 0).all() and (np.abs(p.sum(0) - 1) < 0.02).all()
