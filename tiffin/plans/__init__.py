"""The job catalogue: scans, quality audits, the business questions and the
batch report (:mod:`tiffin.plans.report`)."""

from tiffin.plans import checks, questions
from tiffin.plans.catalog import CATALOG, query_functions, test_job

__all__ = ["CATALOG", "checks", "query_functions", "questions", "test_job"]
