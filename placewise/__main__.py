"""spark-submit -m placewise PLACES OUT: reports of raw places (JSON lines) as JSON lines, Parquet or text.

The environment may set what is not on the command line: see plans.settings.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from placewise.operators import report
from placewise.plans.analyze import analyze, analyze_cached
from placewise.plans.models import Models
from placewise.plans.settings import Settings
from placewise.sources import readers
from placewise.sources.cache import ReportCache


def load_models(name: str | None) -> Models | None:
    """The Models that `module:name` says; None for no name."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="placewise", description=__doc__)
    parser.add_argument("places", help="raw places, one JSON object a line; title and address are the key of a place")
    parser.add_argument("out")
    parser.add_argument("--annotations", help="a folder with a Parquet table for each annotation that there is, named after its schema (batches, aspects, themes, ...)")
    parser.add_argument("--parquet", action="store_true", help="write Parquet instead of JSON")
    parser.add_argument("--text", action="store_true", help="write pages to read instead of JSON")
    settings = Settings.from_environment()
    parser.add_argument("--models", default=settings.models or None, help="module:name of a plans.models.Models, asked for the annotations that aren't given")
    parser.add_argument("--require-verification", action="store_true", default=settings.require_verification)
    parser.add_argument("--cache", help="a folder of reports to take fresh ones from and put new ones in")
    parser.add_argument("--strict", action="store_true", help="count a missing verification as unavailable")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("placewise").getOrCreate()
    raw = readers.keyed(readers.read_places(spark, given.places))
    annotations = readers.read_annotations(spark, given.annotations) if given.annotations else None
    chosen = {"annotations": annotations, "require_verification": given.require_verification, "strict": given.strict, "ask": load_models(given.models)}
    if given.cache:
        reports = analyze_cached(raw, ReportCache(spark, given.cache), F.current_timestamp(), settings.cache_days, **chosen)
        reports.select("report").write.mode("overwrite").text(given.out)
        return
    reports = analyze(raw, **chosen)
    if given.text:
        report.panels(reports).select("report_text").write.mode("overwrite").text(given.out)
    else:
        readers.write_reports(reports, given.out, not given.parquet)


if __name__ == "__main__":
    main()
