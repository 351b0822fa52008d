"""Personal data in texts: fixed patterns, then anchors found by Aho-Corasick and expanded by small local parsers.

The base spans come from four patterns, each scanned leftmost and without overlaps within its kind; a match that fails its check
(ip parts above 255, card digits outside 13..19 or failing Luhn, phone digits outside 9..15) is dropped, not tried again shorter.

The method then runs one Aho-Corasick automaton over the text (A-Z lower-cased, so places do not move) for three sorts of anchor:
at-signs, schemes (`://`) and identifier cues (street words, account and IBAN words). From each anchor a parser walks outwards
by characters and decides alone where the span begins and ends:
- `@`: local part to the left, labels of the domain to the right; kept when neither end is a dot and the last label has two letters.
- `://`: a login in the authority (`user:secret@host`) is a `login` span, from the scheme's first letter to the `@`.
- street word: up to four name words to the left and a house number before them make an `address`, the word's dot included.
- account cue: after a few separators, an IBAN (country, check digits, 11 to 30 letters or digits, in groups) that passes the mod-97
  check, or 6 to 17 digits in groups, makes an `account` span.
Spans of the method that overlap a base span of their kind, or an earlier span of the method of their kind, are left out, so the
base spans stay as they are.

All work runs on Arrow batches of bounded text size inside Spark tasks, each text by itself; nothing is shuffled.

Defined results: a null or empty text has no spans, and its hash is that of the empty string; rows with equal doc_id are each
reported (null doc_id too); very long texts are scanned whole, digit runs of any length included. Positions count code points,
ends exclusive. Other columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from gavelspark.llm.shared import by_batches

# The base patterns and the order of kinds in a joined list.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("address", "account", "login")

STREET_WORDS = ("street", "st.", "avenue", "ave.", "road", "rd.", "lane", "boulevard", "blvd.", "drive", "way", "place", "square",
                "straße", "strasse", "calle", "rue", "avenida")
ACCOUNT_WORDS = ("iban", "account", "acct", "a/c", "bank account", "routing number")
SCHEMES = ("://",)

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LABEL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
_ALNUM = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def _small_number(part: str, top: int) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= len(str(top)) and int(digits or "0") <= top


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        v = ord(ch) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four patterns, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_small_number(p, 255) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(ch.isdigit() and ch.isascii() for ch in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("at", ("@",)), ("scheme", SCHEMES), ("street", STREET_WORDS), ("account", ACCOUNT_WORDS)):
        for word in words:
            found.add_word(word, (kind, word))
    found.make_automaton()
    return found


def _email_at(text: str, at: int) -> tuple[int, int] | None:
    start = at
    while start > 0 and text[start - 1] in _LOCAL:
        start -= 1
    while start < at and text[start] == ".":
        start += 1
    end, labels = at + 1, []
    while True:
        k = end
        while k < len(text) and text[k] in _LABEL:
            k += 1
        if k == end or text[end] == "-" or text[k - 1] == "-":
            break
        labels.append(text[end:k])
        end = k
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in _LABEL:
            end += 1
        else:
            break
    if start == at or text[at - 1] == "." or len(labels) < 2 or not (len(labels[-1]) >= 2 and labels[-1].isalpha()):
        return None
    return start, end


def _login_at(text: str, colon: int) -> tuple[int, int] | None:
    start = colon
    while start > 0 and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    k = colon + 3
    while k < len(text) and text[k] not in "/?#@ \t\r\n\x0b\x0c":
        k += 1
    if start == colon or k >= len(text) or text[k] != "@" or ":" not in text[colon + 3:k] or k == colon + 3:
        return None
    return start, k + 1


def _address_at(text: str, lowered: str, start: int, end: int) -> tuple[int, int] | None:
    if (start > 0 and lowered[start - 1].isalpha()) or (end < len(text) and text[end - 1] != "." and lowered[end].isalpha()):
        return None
    k, names = start, 0
    while names < 4:
        j = k
        while j > 0 and text[j - 1] == " ":
            j -= 1
        if j == k or j == 0:
            break
        w = j
        while w > 0 and text[w - 1].isalpha():
            w -= 1
        if w == j or not text[w].isupper() or (w > 0 and not text[w - 1].isspace()):
            break
        k, names = w, names + 1
    j = k
    while j > 0 and text[j - 1] == " ":
        j -= 1
    if names == 0 or j == k:
        return None
    d = j
    while d > 0 and text[d - 1].isascii() and text[d - 1].isalnum():
        d -= 1
    number = text[d:j]
    digits = number.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    if not (1 <= len(digits) <= 5 and digits.isdigit() and len(number) - len(digits) <= 1) or (d > 0 and text[d - 1].isalnum()):
        return None
    return d, end


def iban_valid(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit() and code.isascii() and code.isalnum()):
        return False
    moved = (code[4:] + code[:4]).upper()
    number = "".join(str(int(ch, 36)) for ch in moved)
    return int(number) % 97 == 1


def _account_at(text: str, end: int) -> tuple[int, int] | None:
    k, skipped = end, 0
    while k < len(text) and skipped < 12 and not (text[k].isascii() and text[k].isalnum() and text[k].isupper() or text[k].isdigit()):
        k += 1
        skipped += 1
    if k < len(text) and text[k:k + 2].lower() == "no" and not text[k:k + 3][-1:].isalnum():
        k += 2
        while k < len(text) and text[k] in " .:#":
            k += 1
    start, groups, j = k, [], k
    while j < len(text) and len(groups) < 9:
        g = j
        while g < len(text) and text[g] in _ALNUM:
            g += 1
        if g == j:
            break
        groups.append(text[j:g])
        if g + 1 < len(text) and text[g] in " -" and text[g + 1] in _ALNUM:
            j = g + 1
        else:
            j = g
            break
    best = None
    for m in range(len(groups), 0, -1):
        code = "".join(groups[:m])
        stop = start + len(" ".join(groups[:m]))
        if iban_valid(code.upper()):
            best = (start, stop)
            break
        if code.isdigit() and 6 <= len(code) <= 17:
            best = (start, stop)
            break
    return best


def method_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans grown from anchors: emails, logins in urls, addresses and accounts."""
    lowered = text.translate(_LOWER)
    out = []
    for last, (kind, word) in automaton().iter(lowered):
        first = last - len(word) + 1
        if kind == "at":
            got, name = _email_at(text, first), "email"
        elif kind == "scheme":
            got, name = _login_at(text, first), "login"
        elif kind == "street":
            got, name = _address_at(text, lowered, first, last + 1), "address"
        else:
            if (first > 0 and lowered[first - 1].isalpha()) or (last + 1 < len(text) and lowered[last + 1].isalpha()):
                continue
            got, name = _account_at(text, last + 1), "account"
        if got:
            out.append((name, *got))
    return out


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, each in the order of the joined lists."""
    if not text:
        return [], []
    base = base_spans(text)
    taken: dict[str, list[tuple[int, int]]] = {}
    for kind, s, e in base:
        taken.setdefault(kind, []).append((s, e))
    added = []
    for kind, s, e in sorted(method_spans(text), key=lambda x: (x[1], -x[2])):
        if any(s < e2 and s2 < e for s2, e2 in taken.get(kind, [])):
            continue
        taken.setdefault(kind, []).append((s, e))
        added.append((kind, s, e))
    order = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
    every = sorted(base + added, key=lambda x: (order[x[0]], x[1], x[2]))
    return base, every


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, s, e in found)


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
    out = {name: [] for name in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
    for doc, text in zip(ids, texts):
        base, every = spans(text)
        out["doc_id"].append(doc)
        for kind in BASE_KINDS:
            out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(every))
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([
        ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string()), ("spans", pa.string()),
    ]))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for every row of `docs`."""
    return by_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), _batch, SCHEMA)
