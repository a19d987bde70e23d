import hashlib
import random
import time
from bisect import bisect_right
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, docs
from voucherflow.llm import pii as P

PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_base(text):
    """The contract's four searches, one after the other."""
    out = [(m.start(), m.end(), "email") for m in P.EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in PLAIN_IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in P.CARD.finditer(text):
        d = "".join(re.findall("[0-9]", m[0]))
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + n % 2), 10)) for n, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in P.PHONE.finditer(text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[2])))


@settings(max_examples=400)
@given(st.text(alphabet="ab.@-_+ 0123456789()é,", max_size=60))
def test_base_spans_equal_the_plain_searches(text):
    assert P.base_spans(text) == plain_base(text)


def test_base_spans_on_given_texts(spark, folder):
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect():
        assert P.base_spans(r["text"]) == plain_base(r["text"])


@pytest.mark.parametrize(("digits", "ok"), [("4539578763621486", True), ("4539578763621487", False), ("0", True), ("18", True)])
def test_luhn(digits, ok):
    assert P.luhn(digits) is ok


@pytest.mark.parametrize(("iban", "ok"), [("GB82WEST12345698765432", True), ("GB82WEST12345698765431", False), ("DE89370400440532013000", True), ("GB82", False)])
def test_mod97(iban, ok):
    assert P.mod97(iban) is ok


def kinds(text):
    return [s[2] for s in P.scan(text)[1]]


def test_checksums_and_context():
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"] and kinds("IBAN DE88 3704 0044 0532 0130 00 ok") == []
    assert kinds("my social security no 123-45-6789") == ["ssn"] and kinds("part 123-45-6789 in stock") == []
    assert kinds("call (212) 555-0147 now") == ["local_phone"] and kinds("nothing near 212-555-0147 here") == [] and kinds("order 212-555-0147 call") == []
    assert kinds("visa 4222222222222 paid") == ["card13"] and kinds("isbn 4222222222222 visa") == []


def test_redaction():
    assert P.redact("mail a@b.co or +1 (212) 555-0147.", P.scan("mail a@b.co or +1 (212) 555-0147.")[0]) == "mail [email] or [phone]."


def test_long_runs_take_time_in_proportion():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" * 50_000, "1." * 50_000, "a@" * 50_000, "1 " * 50_000):
        P.scan(text)


def test_digest(spark):
    text = "é a@b.co 10.0.0.1, 4539 5787 6362 1486 +1 (212) 555-0147"
    r = P.digest(P.find(docs(spark, [(1, text)]))).first()
    want = ",".join(f"{k}:{a}:{b}" for a, b, k in plain_base(text))
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_awkward_rows(spark):
    got = P.digest(P.find(awkward(spark))).collect()
    assert len(got) == 11 and sum(r["n_email"] for r in got) == 1
    assert {r["base_sha256"] for r in got if not r["spans"]} == {hashlib.sha256(b"").hexdigest()}
    assert P.find(awkward(spark).where("false")).count() == 0


def test_random_cards_need_their_checksum():
    r = random.Random(3)
    for _ in range(200):
        d = "".join(r.choice("0123456789") for _ in range(16))
        assert (kinds(f"x {d} y") == ["card"]) == P.luhn(d)


@pytest.mark.parametrize(("text", "found"), [
    ("ES91 2100 0418 4502 0005 1332 BIC", ["ES91 2100 0418 4502 0005 1332"]), ("ES9121000418450200051332 EUR", ["ES9121000418450200051332"]),
    ("AT611904300234573201 BANK", ["AT611904300234573201"]), ("AB12 CDEF AT611904300234573201 BANK", ["AT611904300234573201"]),
    ("AT611904300234573201 DE89 3704 0044 0532 0130 00", ["AT611904300234573201", "DE89 3704 0044 0532 0130 00"]), ("AT611904300234573202 BANK", [])])
def test_a_word_after_an_iban_does_not_hide_it(text, found):
    assert [text[a:b] for a, b in P.ibans(text)] == found


def test_a_text_of_contacts_takes_time_in_proportion():
    """Base and further spans side by side, a megabyte of them."""
    text = "a@b.co 212-555-0147 phone +1 (212) 555-0147, call 212-555-0148 " * 16_000
    start = time.perf_counter()
    base, every = P.scan(text)
    assert len(text) > 1_000_000 and time.perf_counter() - start < 15
    assert len(base) == 32_000 and len(every) > len(base)


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 6)), max_size=12), st.integers(0, 45), st.integers(1, 5))
def test_overlap_by_bisection(spans, a, n):
    taken = [(x, x + m, "email") for x, m in spans]
    starts, ends = P._merged(taken)
    at = bisect_right(ends, a)
    assert (at < len(starts) and starts[at] < a + n) == any(x < a + n and a < y for x, y, _ in taken)
