import hashlib
import random
import re
import time

import llm_cases
import pytest

from gridtide.llm import pii, queries

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if valid(k, m.group())]


def base(text):
    return [span for span in pii.find_spans(text) if span[0] in pii.BASE_KINDS]


def test_base_kinds_equal_the_patterns_on_random_text():
    draw = random.Random(1)
    for _ in range(6000):
        text = "".join(draw.choice("0123456789.+-@ ()ab%ü") for _ in range(draw.randint(0, 120)))
        assert base(text) == brute(text), text


def test_long_digit_chains_and_overlapping_candidates():
    for text in ("1.2.3.4.5.6.7.8.9", "999.1.1.1 1.1.1.1", "0001.1.1.255", "9" * 6000, "a@b@c.de", "a@b.c@d.e", "+1 2", "++49 (30) 1234567.", "4" + " 4" * 40):
        assert base(text) == brute(text), text


def test_added_kinds():
    text = "iban: DE89 3704 0044 0532 0130 00, ssn 123-45-6789 see https://me:pw@example.com/x and token = \"a1b2c3d4e5f6a7b8c9d0\""
    kinds = [kind for kind, _, _ in pii.find_spans(text) if kind not in pii.BASE_KINDS]
    assert kinds == ["address", "account", "account", "account"]
    assert pii.masked("write to a.b@c.org now") == "write to <EMAIL> now"
    assert pii.masked("clean text") == "clean text"


def test_awkward_rows(spark):
    docs = llm_cases.frame(spark, llm_cases.awkward_rows())
    rows = pii.span_digest(docs).collect()
    assert len(rows) == len(llm_cases.awkward_rows())
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone == 0 and r.spans == "" for r in rows if r.doc_id in (4, 5, 6))
    masked = pii.mask_documents(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert pii.span_digest(docs.limit(0)).count() == 0


def test_query_equals_the_patterns(spark):
    texts = dict(llm_cases.read(SF, "SELECT doc_id, text FROM documents"))
    rows = queries.QUERIES["op8_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = brute(texts[row.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in PATTERNS]
        assert row.spans.startswith(joined)


REPEATED = [
    "http://", "http://a:b", "http://a:b@", "https://@", "token", "token=", "token:a-", "tokenA1b2c3d4e5f6a7b8c9d0", "iban", "iban AB12", "ibanAB12CDEF3456GHIJ7890 ",
    "ssn", "ssn 123-45-678", "@", "a@", "a@b", "a@b.", "a.b@c.d ", "1", "1.", "1.1.1.", "256.1.1.1 ", "1-", "4111 ", "+", "+1", "+1(", "+1 2", "password:password ", "a" * 50, " ",
]


@pytest.mark.parametrize("part", REPEATED)
def test_a_megabyte_of_one_anchor_takes_linear_time(part):
    text = part * ((1 << 20) // len(part))
    start = time.process_time()
    spans = pii.find_spans(text)
    assert time.process_time() - start < 5
    short = part * (3000 // len(part))
    assert [s for s in pii.find_spans(short) if s[0] in PATTERNS] == brute(short)
    assert all(0 <= start < end <= len(text) for _, start, end in spans)


def test_account_numbers_end_where_the_check_sum_holds():
    number = "DE89370400440532013000"
    assert pii.iban_end(number) == pii.iban_end(number + "12345678") == 22
    assert pii.iban_end("DE89 3704 0044 0532 0130 00 and") == 27
    assert pii.iban_end("DE88370400440532013000") == 0 and pii.iban_end("DE89") == 0
    run = "secrettokensecrettokensecret token: a1b2c3d4e5f6a7b8c9d0"
    assert [run[s:e] for k, s, e in pii.find_spans(run) if k == "account"] == ["a1b2c3d4e5f6a7b8c9d0"]
