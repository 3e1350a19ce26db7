"""Rows of a sheet whose header stands somewhere below banners, and tables of well-known shape from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.functions.text import collapsed, unaccented

#: Column -> header spellings, lower case, without accents.
FACTS = {
    "departamento": ["departamento"],
    "municipio": ["municipio"],
    "anio": ["ano", "anio", "ano del hecho"],
    "tipo_corrupcion": ["tipo de corrupcion", "tipo_corrupcion"],
    "sector": ["sector"],
    "descripcion": ["descripcion", "hecho"],
}


def under_header(cells: DataFrame, marker: str, shape: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows below the header of a sheet, by column name.

    cells: row long, cells array<string>. The header is the first row that has a cell equal to marker, case and accents aside;
    a column's cell is found under the first header spelling that is there. Rows without any cell are left out, and a sheet
    without a header gives none.
    """
    key = lambda c: F.lower(unaccented(collapsed(c)))
    marked = cells.withColumn("_keys", F.transform("cells", key))
    header = marked.where(F.array_contains("_keys", marker)).agg(F.min_by(F.struct("row", "_keys"), "row").alias("_h"))
    rows = cells.crossJoin(F.broadcast(header)).where(F.col("row") > F.col("_h.row"))  # header: one row
    rows = rows.where(F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    # a sheet that repeats a header keeps the first
    def cell(names: Sequence[str]) -> Column:
        places = [F.nullif(F.array_position("_h._keys", n), F.lit(0)) for n in names]
        return F.nullif(F.trim(F.try_element_at("cells", F.coalesce(*places, F.lit(None)).cast("int"))), F.lit(""))

    return rows.select("row", *[cell(names).alias(name) for name, names in shape.items()])


def facts(cells: DataFrame) -> DataFrame:
    """External facts by department, municipality and year; a year that isn't all digits is null."""
    found = under_header(cells, "departamento", FACTS)
    year = F.when(F.col("anio").rlike(r"^\d+$"), F.col("anio").try_cast("int"))
    return found.withColumn("anio", year).drop("row").fillna("", ["departamento", "municipio"])


def read_sheet(spark, path: str, sheet: str | None = None) -> DataFrame:
    """A workbook's cells as `under_header` takes them; needs the openpyxl library. A sheet is a bounded file, read by the driver."""
    import openpyxl

    book = openpyxl.load_workbook(path, read_only=True, data_only=True)
    rows = (book[sheet] if sheet else book.active).iter_rows(values_only=True)
    data = [(i, [None if c is None else str(c) for c in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "row long, cells array<string>")
