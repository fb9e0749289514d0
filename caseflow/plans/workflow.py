"""The four steps of the reference workflow as functions and a command line:

    python -m caseflow.plans.workflow stage  RELEASE_DIR STAGING_DIR
    python -m caseflow.plans.workflow clean  STAGING_DIR FORM_ID CODES_CSV OUT_DIR
    python -m caseflow.plans.workflow panel  CLEANED_PARQUET PUBLISHED_CSV OUT_DIR
    python -m caseflow.plans.workflow facts  REPORT_TEXT_DIR OUT_PARQUET

Each step reads what the previous one wrote (Parquet), as the scripts do.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from caseflow.columns import FORMS
from caseflow.operators.lookup import country_code_table
from caseflow.operators.panel import lump_other, panel_vs_published
from caseflow.operators.profile import footer_profile
from caseflow.operators.quality import ChangeLog
from caseflow.plans import person_panel as PP
from caseflow.plans.clean import clean_cases, output_order
from caseflow.plans.public_facts import public_facts
from caseflow.sources.sinks import publish, write_by_fiscal_year, write_parquet
from caseflow.sources.staging import open_dataset, stage_forms
from caseflow.sources.text import scan_report_lines

FORM_OF = {"i821": "tps", "i821d": "daca"}
UNIT_LABEL = {"i821": "TPS", "i821d": "DACA"}


def stage(spark: SparkSession, release_dir: str, staging_dir: str, fmt: str = "parquet") -> None:
    """Raw extracts -> ``staging_dir/form_id=<id>/`` typed Parquet with provenance."""
    stage_forms(spark, release_dir, staging_dir, fmt)


def clean(spark: SparkSession, staging_dir: str, form_id: str, codes_csv: str, out_dir: str) -> list[str]:
    """One form's staged records -> ``<out_dir>/<form>-latest`` (zstd Parquet in the order of
    ``output_order``, published only if no row was lost) and ``<out_dir>/<form>-latest-by-fy`` (one unit per fiscal
    year); returns unit names. The change log goes to ``<out_dir>/<form>-changes``."""
    if form_id not in FORMS:
        raise ValueError(f"unknown form {form_id!r}; known: {sorted(FORMS)}")
    form = FORM_OF[form_id]
    log, source = ChangeLog(), f"{staging_dir}/form_id={form_id}"
    staged = open_dataset(spark, source)
    cleaned = clean_cases(staged, country_code_table(spark, codes_csv), form=form, check=False, log=log,
                          informative=footer_profile(spark, source, staged.schema))
    latest = f"{out_dir}/{form}-latest"
    publish(cleaned, latest, log, output_order(form))
    write_parquet(log.frame(spark), f"{out_dir}/{form}-changes")
    return write_by_fiscal_year(spark.read.parquet(latest).select(*cleaned.columns), f"{out_dir}/{form}-latest-by-fy",
                                label=UNIT_LABEL[form_id])


def panel(spark: SparkSession, cleaned: str, published_csv: str, out_dir: str) -> None:
    """Cleaned records + published counts -> quarterly and published-date panels, and
    the estimates of both stacked on the published series (``<out_dir>/...``)."""
    cases = spark.read.parquet(cleaned)
    pub = PP.published_from_csv(spark, published_csv)
    write_parquet(PP.quarterly_panel(cases), f"{out_dir}/panel_quarterly")
    quarters = spark.read.parquet(f"{out_dir}/panel_quarterly")
    write_parquet(PP.compare_quarters_to_published(quarters, pub), f"{out_dir}/quarterly_vs_published")
    last = pub.agg(F.max("report_date").cast("string")).first()[0]
    if last is not None:                           # the latest published date, compared by itself
        write_parquet(PP.compare_at_date(cases, pub, last), f"{out_dir}/point_in_time_vs_published")
    published = PP.published_panel(cases, pub)
    write_parquet(published, f"{out_dir}/panel_published")
    lumped = lump_other(published, PP.published_countries(pub))
    write_parquet(panel_vs_published(lumped, pub), f"{out_dir}/panel_vs_published")


def facts(spark: SparkSession, report_text_dir: str, out_path: str) -> None:
    """Report text files -> tidy facts (sorted), zstd Parquet."""
    write_parquet(public_facts(scan_report_lines(spark, report_text_dir), sort=True), out_path)


def main(argv: list[str] | None = None) -> None:
    from caseflow.session import get_session
    p = argparse.ArgumentParser(prog="caseflow")
    sub = p.add_subparsers(dest="step", required=True)
    s = sub.add_parser("stage")
    s.add_argument("release_dir")
    s.add_argument("staging_dir")
    s.add_argument("--format", default="parquet")
    c = sub.add_parser("clean")
    c.add_argument("staging_dir")
    c.add_argument("form_id")
    c.add_argument("codes_csv")
    c.add_argument("out_dir")
    n = sub.add_parser("panel")
    n.add_argument("cleaned")
    n.add_argument("published_csv")
    n.add_argument("out_dir")
    f = sub.add_parser("facts")
    f.add_argument("report_text_dir")
    f.add_argument("out_path")
    a = p.parse_args(argv)
    spark = get_session()
    if a.step == "stage":
        stage(spark, a.release_dir, a.staging_dir, a.format)
    elif a.step == "clean":
        for name in clean(spark, a.staging_dir, a.form_id, a.codes_csv, a.out_dir):
            print(name)
    elif a.step == "panel":
        panel(spark, a.cleaned, a.published_csv, a.out_dir)
    else:
        facts(spark, a.report_text_dir, a.out_path)


if __name__ == "__main__":
    main()
