"""Text cleaning as built-in expressions (C1-C5, C10, C16): no Python UDFs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.columns import ELIS, REDACTION_REGEX, SUPPRESSION_CODES

_WS = r"[\t\n\f\r\p{Z}]+"   # ICU \s
_NOT_LATIN1 = r"[^\x00-\xFF]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squish(c) -> Column:
    """Collapse every run of Unicode whitespace to one space and trim."""
    return F.trim(F.regexp_replace(_c(c), _WS, " "))


def repair_mojibake(c) -> Column:
    """C4: undo UTF-8 text that was decoded as Latin-1 once ("CÃ´te" -> "Côte").

    Encode to Latin-1 and read the bytes back as UTF-8; keep the original when a
    character has no Latin-1 form or the bytes are not valid UTF-8 (so correct
    text, ASCII and NULL pass through unchanged).
    """
    c = _c(c)
    latin1 = F.when(~c.rlike(_NOT_LATIN1), c)          # NULL instead of an encode error
    as_utf8 = F.encode(latin1, "ISO-8859-1").cast("string")
    return F.when(F.coalesce(F.is_valid_utf8(as_utf8), F.lit(False)), as_utf8).otherwise(c)


def redaction_flag(c) -> Column:
    """A FOIA redaction code appears anywhere in the cell; NULL -> false."""
    return F.coalesce(_c(c).rlike(REDACTION_REGEX), F.lit(False))


# blank or exactly "NA" once whitespace is squished; or a redaction code anywhere (its flag ends with the pattern)
_UNINFORMATIVE = r"^[\t\n\f\r\p{Z}]*(?:NA)?[\t\n\f\r\p{Z}]*$|" + REDACTION_REGEX


def is_informative(c) -> Column:
    """Text cell that is not NULL, blank, the literal ``NA`` or redacted (after squish).
    One regex per cell: squish only changes whitespace, which neither the ``NA``
    test (whitespace allowed around it) nor the redaction codes depend on."""
    c = _c(c)
    return c.isNotNull() & ~c.rlike(_UNINFORMATIVE)


def recode_values(c, mapping: Mapping[str, str]) -> Column:
    """Exact-match replacement; other values and NULL are kept."""
    c = _c(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return c if out is None else out.otherwise(c)


def resolve_country(raw, source, looked_up, default: str | None = None) -> Column:
    """ELIS rows carry a name (repaired), other rows a code resolved by the lookup;
    anything unresolved gets ``default`` (NULL for DACA, the "Unlisted" label for TPS)."""
    default_col = F.lit(default).cast("string")
    return (F.when(_c(source) == F.lit(ELIS), repair_mojibake(raw))
             .when(_c(looked_up).isNotNull(), _c(looked_up))
             .otherwise(default_col))


def to_int(c) -> Column:
    """Number (or numeric text) -> int, truncating toward zero; bad -> NULL."""
    return _c(c).cast("string").try_cast("double").try_cast("int")


def suppressed_value(c) -> Column:
    """C16 value: ``-`` -> 0, thousands commas dropped, codes/junk -> NULL."""
    c = _c(c)
    return F.translate(F.when(c == "-", F.lit("0")).otherwise(c), ",", "").try_cast("double")


def suppression_code(c) -> Column:
    """C16 code: the cell when it is a suppression code (D, H), else NULL."""
    return F.when(_c(c).isin(*SUPPRESSION_CODES), _c(c))
