"""Loan lines as they came: typed cells, problems and the line itself."""

from riskloom.schemas import LOAN_SCHEMA
from riskloom.sources.files import read_loan_records

NAMES = [f.name for f in LOAN_SCHEMA.fields]


def line(**cells):
    given = {"loan_id": "1", "loan_amnt": "1000.0", "term": " 36 months", "grade": "A", "fico_range_low": "700", "issue_d": "1996-01-02"}
    return ",".join((given | cells).get(n, "") for n in NAMES)


def test_lines_with_and_without_problems(spark, tmp_path):
    lines = [",".join(NAMES), line(), line(loan_id="2", loan_amnt="a lot", issue_d="1996-13-40"), line(loan_id="x", fico_range_low="7.5"),
             line(loan_id="3", purpose='"car, red"'), "4,5,6", line(loan_id="7") + ",more", line(loan_id="8", loan_amnt="")]
    (tmp_path / "loans.csv").write_text("\n".join(lines) + "\n")
    rows = read_loan_records(spark, str(tmp_path / "loans.csv")).collect()
    assert len(rows) == 7
    found = [(r.loan_id, list(r.problems)) for r in rows]
    assert found == [(1, []), (2, ["loan_amnt:type", "issue_d:type"]), (None, ["loan_id:type", "fico_range_low:type"]), (3, []),
                     (4, ["record:malformed"]), (7, ["record:malformed"]), (8, [])]
    assert rows[0].term == " 36 months" and rows[3].purpose == "car, red" and rows[6].loan_amnt is None
    assert rows[4].record == "4,5,6" and rows[0].record is None
    (tmp_path / "empty.csv").write_text(",".join(NAMES) + "\n")
    assert read_loan_records(spark, str(tmp_path / "empty.csv")).count() == 0
