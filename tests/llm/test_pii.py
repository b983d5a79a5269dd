"""Spans against a plain Python scan."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from netquarry.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, m.end()) for i, (k, r) in enumerate(RULES.items())
             for m in re.finditer(r, text or "") if passes(k, m[0])]
    return sorted(found)


def card(rng, n):
    body = [rng.randrange(10) for _ in range(n - 1)]
    total = sum(sum(divmod(d * (2 - i % 2), 10)) for i, d in enumerate(reversed(body)))
    return "".join(map(str, [*body, -total % 10]))


def texts():
    rng = random.Random(7)
    parts = ["a@b.c", "x.y+z@mail-1.example.org", "@", ".", "..", "-", "_d@e.f", " ", "1.2.3.4", "256.1.1.1", "01.002.3.255",
             "1.2.3.4.5.6.7.8", "+49 (30) 123-4567", "+1", "+", "😀", "é", "\x01", "\x02", "12", "4111 1111 1111 1111", "\n",
             "Card no ", "tel. ", "a@@b.c", "a@b..c", "9" * 25, "- 1", "1 - 2", "1  2"]
    out = [None, "", "9" * 8_000, "a" * 8_000 + "@b.c", "1 " * 8_000, "a@" + "b." * 20_000 + "c", "." * 5000]
    for _ in range(600):
        pick = [rng.choice(parts) for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.5:
            n = card(rng, rng.randint(11, 20))
            pick.insert(rng.randrange(len(pick) + 1), rng.choice([n, " ".join(n), "-".join([n[:4], n[4:]])]))
        out.append(rng.choice(["", " "]).join(pick))
    return out


def test_base_spans_equal_a_plain_scan(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        line = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), repr(text)[:200]
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[1] == j for x in want) for j in range(4)]
        base = [s for s in got[i].spans.split(",") if s.split(":")[0] in pii.BASE]
        assert ",".join(base) == line


@pytest.mark.parametrize(("text", "spans"), [
    ("IBAN GB82 WEST 1234 5698 7654 32.", "iban:5:32"),
    ("IBAN GB83 WEST 1234 5698 7654 32.", ""),
    ("account DE89370400440532013000 now", "card:10:30,iban:8:30"),
    ("my ssn is 123-45-6789", "ssn:10:21"),
    ("part 123-45-6789", ""),
    ("call (555) 010-9999 today", "local_phone:5:19"),
    ("row 555 010 9999 of it", ""),
])
def test_added_spans_need_checks_or_context(spark, text, spans):
    got = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert ",".join(s for s in got.split(",") if not s.startswith("card")) == ",".join(
        s for s in spans.split(",") if not s.startswith("card"))


def test_masks_and_keeps_columns(spark):
    df = spark.createDataFrame(
        [(1, "mail a@b.c or +49 30 1234567!", "x", 99), (2, None, "y", None), (3, "nothing", "z", 7), (3, "nothing", "z", 7)],
        "doc_id long, text string, pii string, n_chars long")
    got = sorted(map(tuple, pii.redact(df).collect()), key=str)
    assert got == [(1, "mail [EMAIL] or [PHONE]!", "x", 24), (2, None, "y", None), (3, "nothing", "z", 7), (3, "nothing", "z", 7)]


def test_overlapping_spans_become_one_mask(spark):
    text = "+4111111111111111 end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn(
        "a", F.expr("array(struct(0 AS at, 3 AS kind, 5 AS to, 1D AS score), struct(1 AS at, 2 AS kind, 17 AS to, 1D AS score))"))
    assert df.select(pii.masked(F.col("text"), F.col("a")).alias("t")).first().t == "[PHONE] end"


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string, spans int")).collect() == []
