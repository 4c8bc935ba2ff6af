import hashlib
import random
import re

from tapedeck.llm import pii
from tests.llm.fixtures import SF, awkward, frame

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def good(kind, v):
    n = sum(c.isdigit() for c in v)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 13 <= n <= 19 and luhn(v), "phone": 9 <= n <= 15}[kind]


def plain(text):
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "", re.A) if good(k, m[0])] for k, p in PLAIN.items()}


def check(spark, rows, extra=True):
    got = pii.personal_data(frame(spark, rows, extra)).collect()
    assert len(got) == len(rows)
    left = [(d, t) for d, t in rows]
    for r in got:
        for k, (d, t) in enumerate(left):
            want = plain(t)
            base = ",".join(s for v in want.values() for s in v)
            if d == r.doc_id and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, want.values())) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest():
                assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
                del left[k]
                break
        else:
            raise AssertionError(r)


CASES = [
    "a@b.c@d.e a@b.c.%x@y.z x@y @z.w ..%@a.b-c.d",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.999999999999999999999 001.002.003.004 9" * 2,
    "4111 1111 1111 1111 4111-1111-1111-1111-2 7 -4111111111111111 5 4111111111111111",
    "+1 (234) 567-8901 +12 +1++2345678901 ++1-2-3-4-5-6-7-8-9. +1 234 567 8901 2345 678",
    "é été 中 4111111111111111 😀 a.b@c.de",
    "9" * 50000, "1 " * 20000, "a" * 50000, "a." * 20000 + "@" + "b." * 20000 + "c", "+1" + " " * 30000, "1.1." * 9000,
]


def test_awkward_rows(spark):
    check(spark, awkward() + [(100 + i, t) for i, t in enumerate(CASES)] + [(None, CASES[0])])


def test_random_strings(spark):
    r = random.Random(11)
    check(spark, [(i, "".join(r.choice("19a.@-+ ()%é") for _ in range(r.randint(0, 60)))) for i in range(600)])
    check(spark, [(i, "".join(r.choice("0123456789- ") for _ in range(r.randint(0, 60)))) for i in range(300)])


def test_whole_small_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], extra=False)


def test_added_kinds_and_context(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433"), (2, "his ssn is 123-45-6789"), (3, "part 123-45-6789"), (4, "pay by card 4111111111111111"), (5, "serial 4111111111111111")]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[1].spans == "iban:5:32" and got[2].spans == "ssn:11:22" and got[3].spans == ""
    assert got[4].scores[0] > got[5].scores[0] and got[5].n_card == 1


def test_mask(spark):
    rows = [(1, "mail a@b.co now"), (2, None), (3, ""), (4, "x 4111111111111111"), (5, "+4111111111111111 é 1.2.3.4!")]
    df = frame(spark, rows)
    out = pii.mask(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("mail [EMAIL] now", 16), 2: (None, None), 3: ("", 0), 4: ("x [CARD]", 8), 5: ("+[CARD] é [IP]!", 15)}


def test_empty_table(spark):
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_columns_of_any_name_stay(spark):
    df = frame(spark, [(1, "mail a@b.co now"), (2, None)]).selectExpr("*", "'k' as _spans", "'l' as _email", "'m' as `a.b`", "'n' as spans", "'o' as plain", "'p' as masked", "'q' as _was_null", "'r' as row")
    out = pii.mask(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "mail [EMAIL] now" and got[2].text is None
    for r in got.values():
        assert (r["_spans"], r["_email"], r["a.b"], r["spans"], r["plain"], r["masked"], r["_was_null"], r["row"]) == tuple("klmnopqr")


def test_many_spans_of_one_text(spark):
    text = " ".join(f"u{i}@host.org" for i in range(20_000))
    df = frame(spark, [(1, text)])
    got = pii.personal_data(df).collect()[0]
    assert got.n_email == 20_000
    assert got.base_sha256 == hashlib.sha256(",".join(plain(text)["email"]).encode()).hexdigest()


def test_many_spans_are_masked_in_pieces(spark):
    text = " ".join(f"é u{i}@host.org, ip 10.0.0.{i % 300}" for i in range(1_000))
    want = re.sub(r"10\.0\.0\.(\d+)", lambda m: "[IP]" if int(m[1]) < 256 else m[0], re.sub(r"u\d+@host\.org", "[EMAIL]", text))
    assert pii.mask(frame(spark, [(1, text)], extra=False)).first().text == want
