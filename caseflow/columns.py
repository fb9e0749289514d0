"""Column lists, markers and labels shared by every module.

FIXED VALUES: the literals below must stay exactly as written for results to
match the published pipeline (column names, null/redaction markers, recode
labels, thresholds, report layout). Change them only with the data contract.
"""

# ---- FIXED VALUES -----------------------------------------------------------

DATE_COLS = (
    "status_date",
    "natz_test_date",
    "intv_date",
    "natz_date",
    "lpr_date",
    "rec_date",
    "decision_date",
    "latest_notice_date",
    "latest_rfe_date",
    "latest_noid_date",
)

YEAR_COLS = (
    "ben_year_of_birth",
    "latest_trvl_depart_yr",
    "latest_trvl_return_yr",
)

# Whole-cell markers that mean "no value" in the raw extracts.
NULL_MARKERS = ("null", "(b)(6)", "(b)(3) (b)(6) (b)(7)(c)")

# A FOIA redaction code anywhere in a cell: "(b)" or "b(<digit>)", any case.
REDACTION_REGEX = r"(?i)\(b\)|b\([0-9]\)"

# form_id -> (file-name prefix, label)
FORMS = {
    "i821": ("PAER0021096_i821_", "I-821 TPS applications"),
    "i821d": ("PAER0021096_i821d_", "I-821D DACA applications"),
}

GENDER_LABELS = {"F": "Female", "M": "Male", "U": "Unknown"}

TPS_FORM_TYPE_LABELS = {
    "This is my annual registration/re-registration application": "TPS - Re-registration",
    "This is my first application": "TPS - Initial",
}

DACA_INITIAL = "DACA - Initial"
DACA_RENEWAL = "DACA - Renewal"

UNLISTED_COUNTRY = "Unlisted Entry (Any foreign country not listed)"
OTHER_COUNTRIES = "All other countries"

APPROVED = "Approved"
ELIS = "ELIS"
C3 = "C3"

# Look-back windows (source label -> days before the snapshot date).
THRESHOLDS = (
    ("approved_within_6", 182),
    ("approved_within_12", 364),
    ("approved_within_18", 546),
)

# One output unit holds at most this many rows (spreadsheet row cap minus header).
MAX_ROWS_PER_UNIT = 1048575

# Day zero of spreadsheet serial dates.
SERIAL_DATE_ORIGIN = "1899-12-30"

# Published quarterly report layout: label then 20 value cells.
REPORT_PERIODS = ("Q1", "Q2", "Q3", "Q4", "FY")
REPORT_METRICS = ("received", "approved", "denied", "pending")
REPORT_VALUE_TOKEN = r"[0-9][0-9,]*|[DH-]"
SUPPRESSION_CODES = ("D", "H")

# ---- derived -----------------------------------------------------------------

PROVENANCE = ("file_original", "row_original")
REPORT_CELL_COLS = tuple(f"{p}.{m}" for p in REPORT_PERIODS for m in REPORT_METRICS)
