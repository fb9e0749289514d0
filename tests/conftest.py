import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from caseflow.session import get_session
    s = get_session("local[4]", 8)
    yield s
    s.stop()


def D(s):
    return None if s is None else dt.date.fromisoformat(s)


CASE_SCHEMA = ("unique_identifier string, rec_date date, decision_date date, decision string, "
               "ben_country_of_birth string, data_source string, form_type string, "
               "file_original string, row_original long")


def case_rows(spark, rows):
    """rows: (id, rec, dec_date, decision, country, source, form, file, row)."""
    conv = [(r[0], D(r[1]), D(r[2]), *r[3:]) for r in rows]
    return spark.createDataFrame(conv, CASE_SCHEMA)
