"""Documents with what real ones may hold: nulls, empty and long texts, repeats, columns with names that operators use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, component_id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, words: int) -> str:
    """Different words for different seeds, in lines of a dozen."""
    out = [f"w{(seed * 7919 + k * 104729) % 99991}x{seed % 13}" for k in range(words)]
    return "\n".join(" ".join(out[k:k + 12]) for k in range(0, words, 12))


def edge_rows() -> list[tuple]:
    return [
        (1, None, None, None, None, 1, None, 1), (2, "", "en", "a", 0, 2, True, 2), (3, " \n\t ", "en", "a", 4, 3, True, 3),
        (4, "one", "en", None, 3, 4, True, 4), (None, "no id here but words enough to count as many", "de", "b", 9, 5, True, 5),
        (5, prose(3, 30), "en", "a", 9, 6, True, 6), (5, prose(3, 30), "en", "a", 9, 6, True, 6),
        (6, "same " * 5000, "fr", "c", 25000, 7, False, 7), (7, prose(11, 6000), "en", "a", 60000, 8, None, 8),
        (8, "tab\tand nbsp em é日本語 \U0001f600 # $ % & | < > *", "en", "", 30, 9, True, 9),
        (9, "a line\na line\n\n \na line\nother", "en", "b", 30, 1, True, 1), (10, prose(4, 40), "xx", "b", 9, 6, True, 6),
    ]


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
