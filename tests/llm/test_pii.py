import hashlib
import random
import re
import time

from newsloom.llm import pii


def luhn(digits):
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d) * (2 if place % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_card(s):
    digits = re.sub("[^0-9]", "", s)
    return 12 <= len(digits) <= 19 and luhn(digits)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", is_card),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def brute(text):
    """The contract's patterns one after another, without anchors."""
    found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, pattern, good) in enumerate(RULES) for m in re.finditer(pattern, text or "") if good(m[0])]
    return [x[2] for x in sorted(found)]


def random_texts(n, seed):
    draw = random.Random(seed)
    bits = list("@.+-_%() 0123456789aZ\né😀") + ["@", ".", "a@b.c", "10.0.0.255", ".256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 (30) 1234567", "+1", "378282246310005", "00000000", "x@y", "tel:", "http://", "iban "]
    return ["".join(draw.choices(bits, k=draw.randint(0, 40))) for _ in range(n)]


def test_base_spans_are_those_of_the_patterns():
    seen = set()
    for text in random_texts(30_000, 3):
        spans = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.find(text) if k < pii.BASE]
        assert spans == brute(text), text
        seen |= {s.split(":")[0] for s in spans}
    assert seen == {"email", "ip", "card", "phone"}


def kinds(text):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text) if k >= pii.BASE]


def test_addresses_need_a_person():
    assert kinds("see https://jane:pw@host.example/x and https://host.example/y") == [("address", "https://jane:pw@host.example")]
    assert kinds("MAILTO:joe@localhost, sip:ann@example.org; Tel:+49-30-1234567.") == [("address", "MAILTO:joe@localhost"), ("address", "sip:ann@example.org"), ("address", "Tel:+49-30-1234567")]
    assert kinds("hotel:12345 xhttp://a@b tel:123 mailto:nobody ssh://git@[2001:db8::1]:22") == [("address", "ssh://git@[2001:db8::1]")]


def test_accounts_need_a_cue_and_a_check():
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 thanks") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert kinds("iban DE88 3704 0044 0532 0130 00, GB82WEST12345698765432") == []
    assert kinds("Account no. 12-345-678, passport: AB1234567 SSN 078-05-1120") == [("account", "12-345-678"), ("account", "AB1234567"), ("account", "078-05-1120")]
    assert kinds("account of 2019; subaccount 12345678; accounts 12345678; account 12345; Kontonummer 1234567890") == [("account", "1234567890")]


def test_whole_table(spark):
    texts = [*random_texts(400, 4), None, "", "İ a@b.co " * 3000, "mail 😀 joe@example.org"]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "a@b.co", 1, "x"), (0, texts[0], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, kind string").repartition(3)
    got = pii.digests(pii.scan(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ["email:0:6"] if r["doc_id"] is None else brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and s.split(":")[0] in pii.KINDS[: pii.BASE]] == want
        assert [r[f"n_{k}"] for k in pii.KINDS[: pii.BASE]] == [sum(s.startswith(f"{k}:") for s in want) for k in pii.KINDS[: pii.BASE]]
    assert pii.digests(pii.scan(docs.limit(0))).count() == 0


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "mail joe@example.org or mailto:joe@example.org now", 50, "a"), (2, "clean", 7, None), (3, None, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string")
    got = {r["doc_id"]: tuple(r)[1:] for r in pii.redact(docs).collect()}
    assert got == {1: ("mail [EMAIL] or [ADDRESS] now", 29, "a"), 2: ("clean", 7, None), 3: (None, None, "b")}
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0


def test_work_grows_with_the_length():
    for piece in ("1", "1.", "1 ", "+1", "a@", "@", "a", "http://a", "mailto:a", "account ", "iban de12", "+1 ()", "1.1.1.1", "-", "a.b@"):
        text = piece * (1_000_000 // len(piece))
        begun = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - begun < 6, piece
