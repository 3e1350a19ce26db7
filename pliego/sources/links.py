"""Links to documents in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.functions.text import file_name

DOCUMENTS = ("xlsx", "csv", "zip", "ods", "xls")


def absolute(link: Column, page: Column) -> Column:
    """A link as it is meant on a page: absolute ones as they are, others below the page's host or folder."""
    host = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(page, r"[?#].*$", "")
    folder = F.when(path.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/"), F.regexp_replace(path, r"[^/]*$", "")).otherwise(F.concat(path, F.lit("/")))
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(host, link))
        .otherwise(F.concat(folder, link))
    )


def links(pages: DataFrame, id_col: str, url_col: str, html_col: str, endings: tuple[str, ...] | None = DOCUMENTS) -> DataFrame:
    """(id_col, link, url, file): every href of a page, in its order; only those with one of the endings if any are given."""
    found = F.regexp_extract_all(html_col, F.lit(r"(?i)href\s*=\s*[\"']([^\"'>]+)[\"']"), 1)
    rows = pages.select(id_col, F.col(url_col).alias("_page"), F.posexplode(found).alias("at", "link"))
    if endings:
        rows = rows.where(F.lower(F.regexp_replace("link", r"[?#].*$", "")).rlike(r"\.(" + "|".join(endings) + ")$"))
    url = absolute(F.col("link"), F.col("_page"))
    return rows.select(id_col, "at", "link", url.alias("url"), file_name(url).alias("file"))
