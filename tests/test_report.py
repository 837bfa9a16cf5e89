"""The way from files to a report."""

import datetime as dt

import pytest

from caseflow.__main__ import main
from caseflow.operators.drift import SchemaDriftError
from caseflow.plans.definitions import DEFINITIONS
from caseflow.plans.ingest import ingest
from caseflow.plans.report import local_number
from tests.test_cleaning import write_csv


def test_ingest_and_report(spark, tmp_path):
    path = write_csv(tmp_path / "INFLUD26.csv", [{}] * 30)
    out, baseline = str(tmp_path / "cases"), str(tmp_path / "baseline.json")
    done = ingest(spark, [path], out, baseline, dt.date(2026, 9, 1))
    assert done["reports"][2026]["rows_dropped"] == 0 and done["findings"] == []
    small = write_csv(tmp_path / "INFLUD26b.csv", [{}] * 10)
    with pytest.raises(SchemaDriftError):
        ingest(spark, {2026: small}, out, baseline, dt.date(2026, 9, 1))
    assert spark.read.parquet(out).count() == 30
    assert main(["--today", "2026-09-01", "report", out, "--out", str(tmp_path / "r")]) == 0
    text = next((tmp_path / "r").glob("*.md")).read_text()
    assert "no case in the previous window" in text and "fatality among closed cases" in text
    assert "primeira execucao" in text and "## Panorama" in text and "comparison" not in text
    assert main(["--today", "2026-09-01", "report", out, "--out", str(tmp_path / "r")]) == 0
    later = [p.read_text() for p in (tmp_path / "r").glob("*.md")]
    assert sum("primeira execucao" in t for t in later) == 1 and len(later) == 2
    assert main(["report", out, "--out", str(tmp_path / "r"), "--uf", "XX"]) == 1


def test_numbers_and_definitions():
    assert (local_number(1234.5), local_number(None), local_number(1234)) == ("1.234,50", "n/d", "1.234")
    assert len(DEFINITIONS) == 11
