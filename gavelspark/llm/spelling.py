"""Spelling variants: words one edit apart, found by a banded edit-distance scan of a sorted word list.

Words: maximal runs of Latin letters (`[A-Za-z\\u00C0-\\u00FF]+`), A-Z lower-cased; a run whose crc32 of `<doc_id>:<run>` is
divisible by 199 loses one code point (at crc % length), which plants misspellings. All of this is column expressions; counts are
partial sums before the shuffle, so a hot word costs one row a task. Words of at least 6 code points and 5 occurrences remain.

Blocks. If a and b are one edit apart and a is not the longer, then a's first floor(|a|/2) code points equal b's, or a's last
ceil(|a|/2) equal b's (the edit lies in one half only). So every word goes to four blocks: as the shorter word of its own length
(prefix and suffix key), and as the longer word of a pair whose shorter has one code point less. Each near pair then meets in a
block keyed by the shorter word's length and half; blocks hold distinct words that share half of their letters, never occurrences.

Scan. In each block the words are sorted (suffix blocks by their reversed spelling); every word q of the block's own length walks
the later words of its length and all words one longer, in order, and a pair found is reported both ways round. The edit matrix of q against the current word is kept row by row, each row only the three cells around the
diagonal (distances above 1 are all 2). A word shares its first LCP rows with the word before it, so only the rows after the common
prefix are computed; when a row has no cell of 1 or less, every word with that prefix is skipped at once (they form one range of the
sorted list, found by bisection). Pairs from several blocks are made distinct.

Forms: a word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least 5 times its own;
the root follows forms to the end by repeated joins (n grows five-fold a step, so chains are short), each step written out.

Defined results: null texts have no runs; a null doc_id counts as empty text in the hash; equal words of repeated rows all count;
an empty table gives no rows; words without near words have n_near 0 and null form; form_n is null when form is. Other columns
of the input are not carried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
DROP_EVERY = 199
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 6, 5, 5
_END = "\U0010ffff"


def spelled(docs: DataFrame) -> DataFrame:
    """One row a run: the run as the corpus spells it, lower-cased, planted deletions done."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__doc"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(RUN), F.lit(0))).alias("__run"),
    ).select("__doc", F.translate("__run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("__run"))
    h = F.crc32(F.concat_ws(":", "__doc", "__run").cast("binary"))
    at = (h % F.length("__run")).cast("int")
    cut = F.concat(F.col("__run").substr(F.lit(1), at), F.col("__run").substr(at + 2, F.length("__run")))
    return runs.select(F.when(h % DROP_EVERY == 0, cut).otherwise(F.col("__run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of at least MIN_LENGTH code points seen MIN_COUNT times or more."""
    return (spelled(docs).groupBy("word").agg(F.count("*").alias("n"))
            .where((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT)))


def _half(word: Column, length: Column, side: str) -> Column:
    if side == "p":
        return word.substr(F.lit(1), F.floor(length / 2).cast("int"))
    keep = (length - F.floor(length / 2)).cast("int")
    return F.reverse(word.substr(F.length(word) - keep + 1, keep))


def blocks(vocab: DataFrame) -> DataFrame:
    """side, size, half, word: four rows a word, the suffix blocks' words reversed."""
    w, size = F.col("word"), F.length("word")
    rows = []
    for side in ("p", "s"):
        for shorter in (size, size - 1):
            rows.append(F.struct(F.lit(side).alias("side"), shorter.alias("size"), _half(w, shorter, side).alias("half"),
                                 (w if side == "p" else F.reverse(w)).alias("spelled")))
    return vocab.select(F.explode(F.array(*rows)).alias("b")).select("b.*")


def _scan(q: str, words: list[str], start: int = 0) -> Iterator[str]:
    """The words of a sorted list, from `start`, exactly one edit away from q.

    rows[t] holds cells t-1, t, t+1 of row t of the edit matrix of the current prefix against q, capped at 2. A word keeps the
    rows of the prefix it shares with the word before; a row without a cell below 2 ends every word of that prefix at once.
    """
    m = len(q)
    rows = [(2, 0, 1 if m >= 1 else 2)]
    prefix, i = "", start
    while i < len(words):
        w = words[i]
        common, limit = 0, min(len(prefix), len(w), len(rows) - 1)
        while common < limit and prefix[common] == w[common]:
            common += 1
        del rows[common + 1:]
        a0, b0, c0 = rows[-1]
        dead = 0
        for t in range(common + 1, len(w) + 1):
            ch = w[t - 1]
            a = min(b0 + 1, a0 + (0 if 2 <= t <= m + 1 and q[t - 2] == ch else 1), 2) if t - 1 <= m else 2
            b = min(c0 + 1, a + 1, b0 + (0 if t <= m and q[t - 1] == ch else 1), 2) if t <= m else 2
            c = min(b + 1, c0 + (0 if t < m and q[t] == ch else 1), 2) if t + 1 <= m else 2
            rows.append((a, b, c))
            if a > 1 and b > 1 and c > 1:
                dead = t
                break
            a0, b0, c0 = a, b, c
        if dead:
            prefix = w[:dead]
            i = bisect_left(words, prefix + _END, i)
            continue
        prefix = w
        shift = m - len(w)
        if -1 <= shift <= 1 and rows[-1][shift + 1] == 1:
            yield w
        i += 1


def near_in_block(words: list[str]) -> Iterator[tuple[str, str]]:
    """(q, w) for every two words of a sorted list exactly one edit apart, both ways round, by the scan of `_scan`."""
    for k, q in enumerate(words):
        for w in _scan(q, words, k + 1):
            yield q, w
            yield w, q


def _block_pairs(size: int, words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of a block: each word of the block's own length against the later ones of that length and all longer ones."""
    own = sorted(w for w in words if len(w) == size)
    longer = sorted(w for w in words if len(w) == size + 1)
    for k, q in enumerate(own):
        for w in _scan(q, own, k + 1):
            yield q, w
            yield w, q
        for w in _scan(q, longer):
            yield q, w
            yield w, q


def _pairs_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = []
        for side, size, words in zip(frame["side"], frame["size"], frame["words"]):
            pairs = _block_pairs(int(size), list(words))
            found += [(a[::-1], b[::-1]) for a, b in pairs] if side == "s" else list(pairs)
        yield pd.DataFrame(found, columns=["a", "b"], dtype=object)


def near_pairs(vocab: DataFrame) -> DataFrame:
    """a, b: both directions of every pair of vocabulary words exactly one edit apart."""
    return (blocks(vocab).groupBy("side", "size", "half").agg(F.collect_set("spelled").alias("words"))
            .where(F.size("words") > 1)
            .select("side", "size", "words")
            .mapInPandas(_pairs_of, "a string, b string")
            .distinct())


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for every vocabulary word."""
    from gavelspark.llm.shared import written

    vocab = written(vocabulary(docs))
    pairs = near_pairs(vocab)
    counts = vocab.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    best = (pairs.join(counts, "b").groupBy("a")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("k"), F.col("b").alias("b"))).alias("top")))
    words = written(vocab.join(best, vocab["word"] == best["a"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.k") >= FORM_RATIO * F.col("n"), F.col("top.b")).alias("form"),
        F.when(-F.col("top.k") >= FORM_RATIO * F.col("n"), -F.col("top.k")).cast("long").alias("form_n"),
    ))
    forms = words.where(F.col("form").isNotNull()).select(F.col("word").alias("__at"), F.col("form").alias("__next"))
    rooted = words.withColumn("root", F.coalesce("form", "word"))
    while True:
        step = written(rooted.join(forms, rooted["root"] == forms["__at"], "left")
                       .withColumn("__moved", F.col("__next").isNotNull())
                       .withColumn("root", F.coalesce("__next", "root")).drop("__at", "__next"))
        moved = step.where("__moved").limit(1).count()
        rooted = step.drop("__moved")
        if not moved:
            return rooted.select("word", "form", "root", "n", "n_near", "form_n")
