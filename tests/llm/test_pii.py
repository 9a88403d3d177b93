"""Personal data against the plain patterns, one text at a time."""

import hashlib
import re

import pytest
from llm.helpers import ODD, SF, empty_documents, odd_documents, write_tables
from pyspark.sql import functions as F

from riskloom.llm import pii, queries

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        out += [(m.start(), k, m.end(), kind) for m in p.finditer(text or "") if good(kind, m.group())]
    return sorted(out)


def check(row, text):
    spans = base_spans(text)
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    for kind in PLAIN:
        assert row[f"n_{kind}"] == sum(s[3] == kind for s in spans)
    kept = [s for s in row.spans.split(",") if s.split(":")[0] in PLAIN]
    assert ",".join(kept) == joined


def test_query_equals_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_pii(spark, SF).collect()
    assert len(rows) == len(texts) and any(r.spans for r in rows)
    for r in rows:
        check(r, texts[r.doc_id])


TRICKY = ["a@b.c_x@d.e", "a@b.c%x@d.e.f", "x@y", "@a.b", "a@b..c", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "300.1.1.1.1", "001.02.3.4",
          "4111-1111 1111-1111", "4111 1111 1111 1112", "+1 (555) 010-9999.", "+1 2", "+12345678901234567890", "1 2 3 4",
          "12.34@56.78", "x" * 3000 + "@" + "y" * 3000 + ".com", "1" * 3000, "é@b.co é+49 170 1234567🙂 10.0.0.1", "a@b.c" * 50,
          "1-1--1 1  1" * 10, "+1-" * 100 + "9", "0" * 12, "255.255.255.255.", "0000000000255.1.1.1"]


def test_tricky_texts(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TRICKY)) + [(100 + k, t) for k, (_, t) in enumerate(ODD)],
                                 "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op10_pii(spark, str(tmp_path)).collect():
        check(r, texts[r.doc_id])


def test_other_kinds(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 ok", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 01",
             "my ssn is 078-05-1120", "part 078-05-1120"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    kinds = [{pii.KINDS[s.kind] for s in r.pii} for r in rows]
    assert "iban" in kinds[0] and "iban" in kinds[1] and "iban" not in kinds[2]
    assert "ssn" in kinds[3] and "ssn" not in kinds[4]
    scores = pii.find_pii(spark.createDataFrame([("call +49 170 1234567",), ("xx +49 170 1234567",)], "text string"))
    a, b = [r.pii[0].score for r in scores.collect()]
    assert a > b


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co, ip 10.0.0.1!"), (2, None), (3, "none"), (4, "")], "i int, text string")
    got = {r.i: r.text for r in pii.redact(df).collect()}
    assert got == {1: "mail [EMAIL], ip [IP]!", 2: None, 3: "none", 4: ""}


def test_odd_and_empty(spark):
    odd = odd_documents(spark)
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    left = out.select(F.explode(pii.spans_of(F.coalesce("text", F.lit("")))).alias("s")).filter("s.kind = 0")
    assert left.count() == 0
    assert pii.find_pii(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("digits, valid", [("4111111111111111", True), ("4111111111111112", False), ("0", True)])
def test_luhn(spark, digits, valid):
    assert spark.range(1).select(pii.luhn(F.lit(digits)).alias("v")).first().v is valid


def test_iban_before_capitals_and_digits(spark):
    iban = "AT61 1904 3002 3457 3201"
    texts = [f"{iban} BANK details", f"{iban} 2024 5678", f"{iban} please", f"see {iban}", f"{iban} 99 XY", "AT61 1904 3002 3457 3202 BANK"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i, t in enumerate(texts):
        spans = [t[s.start:s.end] for s in got[i].pii if pii.KINDS[s.kind] == "iban"]
        assert spans == ([iban] if i < 5 else [])


def test_scores_are_given(spark, tmp_path):
    d = write_tables(spark, tmp_path, documents=spark.createDataFrame(
        [(1, "write mail a@b.co and 10.0.0.1"), (2, None)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in queries.op10_pii(spark, d).collect()}
    assert rows[1].scores.split(",")[0] == "1.00" and len(rows[1].scores.split(",")) == 2 and rows[2].scores == ""
