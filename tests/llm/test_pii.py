import hashlib

import regex

from gavelspark.llm import pii
from gavelspark.llm.queries import ALL
from tests.llm.cases import edges, nothing


def brute_base(text):
    """Every start tried in turn with the `regex` engine, which is not the one the operator uses."""
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+){3}"),
                          ("card", r"[0-9](?:[ -]?[0-9])+"), ("phone", r"\+[0-9][ ().0-9-]+[0-9]")):
        at, compiled = 0, regex.compile(pattern)
        while at <= len(text):
            m = compiled.search(text, at)
            if not m:
                break
            digits = [c for c in m.group() if c in "0123456789"]
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and pii.luhn("".join(digits)),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                found.append((kind, m.start(), m.end()))
            at = m.end() if m.end() > m.start() else m.start() + 1
    return found


TEXTS = [
    "Mail a.b@x.co or hi.52@mail1.example.com; ip 10.0.0.255 and 300.1.1.1 and 1.2.3.4.5; card 4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (743) 555-3824 and +12 34 and +44 20 7946 0958 12345 678901 23; é日本 x@y.z a@b.cd",
    "Live at 221B Baker Street, IBAN: GB82 WEST 1234 5698 7654 32 or account no. 12345678; see https://bob:pw@host.com/x",
    "0" * 5000 + " 12.34.56.78 " + "9" * 30,
]


def test_base_spans_equal_a_plain_scan():
    for text in TEXTS:
        assert pii.base_spans(text) == brute_base(text)


def test_method_adds_addresses_accounts_and_logins_and_keeps_the_base():
    text = TEXTS[2]
    base, every = pii.spans(text)
    assert set(base) <= set(every)
    added = {(k, text[s:e]) for k, s, e in every if (k, s, e) not in base}
    assert added == {("address", "221B Baker Street"), ("account", "GB82 WEST 1234 5698 7654 32"), ("account", "12345678"),
                     ("login", "https://bob:pw@")}
    assert pii.iban_valid("GB82WEST12345698765432") and not pii.iban_valid("GB83WEST12345698765432")


def test_rows_of_every_kind(spark):
    got = {r["doc_id"]: r for r in pii.found(edges(spark)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1]["base_sha256"] == empty and got[1]["spans"] == "" and got[1]["n_email"] == 0
    assert len(pii.found(edges(spark)).collect()) == 12 and pii.found(nothing(spark)).count() == 0
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in pii.found(rows).collect():
        base = brute_base(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert r["n_card"] == sum(k == "card" for k, _, _ in base) and r["n_phone"] == sum(k == "phone" for k, _, _ in base)


def test_query_on_the_table(spark):
    got = ALL["op12_pii"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got.n_email.sum() > 0 and got.n_phone.sum() > 0
