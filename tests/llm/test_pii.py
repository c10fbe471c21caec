"""Spans against plain regular expressions."""

import random
import re

from gridindex.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_regular_expressions():
    rng, anchors = random.Random(3), pii._anchors()
    fixed = ["", "a@b.co@d.com", "x.@y-.z.", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (255) 555-8013 ", "é1.1.1.1", "+1()", "+1 2", "+12", "0001.2.3.999", "+1 2.3.4.5.6.7.8.9.0"]
    texts = fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for alphabet in ("a@.b-", "12. -+", "0123456789 -", "+1(2) .-3é", "a@b.c+1 2") for _ in range(3000)]
    texts += ["".join(rng.choice("0123456789") + rng.choice(["", "", " ", "-", "."]) for _ in range(rng.randint(12, 40))) for _ in range(5000)]
    assert all([x for x in pii.find(t, anchors) if x[1] < 4] == brute(t) for t in texts)
    assert any(x[1] == 2 for t in texts for x in pii.find(t, anchors))


def test_cues_add_spans():
    anchors = pii._anchors()
    kinds = lambda t: [pii.KINDS[k] for _, k, _ in pii.find(t, anchors)]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 ok") == ["account"]
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00 ok") == []
    assert kinds("SSN 123-45-6789.") == ["ssn"]
    assert kinds("see ftp://me:pw@host.example/x") == ["email", "url"] or "url" in kinds("see ftp://me:pw@host.example/x")
    assert kinds("see https://host.example/x") == []


def test_scan_rows(spark):
    rows = [(1, "a@b.co", "x"), (2, None, "y"), (3, "", "z"), (1, "a@b.co", "x"), (None, "call +1 (255) 555-8013", "q")]
    out = pii.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(out) == 5 and sum(r.n_email for r in out) == 2 and sum(r.n_phone for r in out) == 1
    assert {r.spans for r in out if r.doc_id == 1} == {"email:0:6"}
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
