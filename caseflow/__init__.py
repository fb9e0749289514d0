"""caseflow: case-record cleaning and point-in-time panels as Spark DataFrame plans.

Every public function is ``DataFrame -> DataFrame`` (usable with ``df.transform``)
or builds a DataFrame from a path; nothing collects rows to the driver except
one-row profile results that decide a schema (``operators.profile``).
"""

from caseflow.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
