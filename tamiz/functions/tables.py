"""Table functions for SQL: one row for each thing a text holds, joined to the text's row with LATERAL.

They are written in SQL, so Spark inlines them: the text is scanned once by the JVM and no Python process takes part. (Arrow table
functions are refused on the right of LATERAL by this Spark version.)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import EMAIL_PATTERN, URL_PATTERN


def _pattern(text: str) -> str:
    return "r'" + text + "'"


_FUNCTIONS = {
    # Every URL as ``extract_url_list`` finds them, with its host as ``url_host`` gives it.
    "report_urls": ("position INT, url STRING, host STRING", URL_PATTERN,
                    f"position + 1, found, lower(regexp_extract(found, {_pattern('://([^/:?]+)')}, 1))"),
    # Every address as ``extract_emails`` finds them, with its domain as ``extract_domain`` gives it.
    "report_emails": ("position INT, address STRING, domain STRING", EMAIL_PATTERN,
                      f"position + 1, found, regexp_extract(lower(found), {_pattern('@([a-zA-Z0-9.-]+)')}, 1)"),
}


def register_table_functions(spark: SparkSession) -> None:
    """Makes ``report_urls(content)`` and ``report_emails(content)`` known to the session.

    ``SELECT p.page_id, u.* FROM pages p, LATERAL report_urls(p.html) u``; positions count from 1, a null text gives no rows.
    """
    for name, (columns, pattern, shown) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(content STRING) RETURNS TABLE ({columns}) RETURN "
                  f"SELECT {shown} FROM posexplode(regexp_extract_all(content, {_pattern(pattern)}, 0)) AS t(position, found)")
