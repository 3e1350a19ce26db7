"""Small tables with the mart's schemas, and comparison with a second SQL engine."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame, SparkSession

from pliego.schemas import SCHEMAS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows_to_df(spark: SparkSession, table: str, rows: list[dict], **more: str) -> DataFrame:
    """Rows with the table's schema, columns that a row does not mention null; more: further columns."""
    ddl = ", ".join([SCHEMAS[table], *(f"{c} {t}" for c, t in more.items())])
    names = spark.createDataFrame([], ddl).columns
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ddl)


def contract(i: object, **values: object) -> dict:
    base = {"id_contrato": f"C{i}", "row_id": f"r{i}", "source": "SECOP2", "nit_entidad_norm": "E1", "doc_proveedor_norm": "S1", "valor_contrato": 100.0, "fecha_firma": day("2023-03-01"), "modalidad_norm": "CONTRATACION_DIRECTA", "es_competitiva": False, "unspsc_segmento": 80}
    out = base | values
    return out | {"anio": out.get("anio", out["fecha_firma"].year if out["fecha_firma"] else None)}


def fired(df: DataFrame) -> dict[str, bool]:
    return {r["key"]: r["fired"] for r in df.collect()}


def _text(v: object) -> str:
    if isinstance(v, float | Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.10g}"
    return str(v) if isinstance(v, bool) else v.isoformat() if isinstance(v, dt.datetime) else repr(v)


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def table_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_text(r[i]) for i in order) for r in rows)


def same_as_oracle(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Asserts equal columns and rows; returns how many rows there are."""
    wanted = con.execute(sql)
    expected = table_of([c[0] for c in wanted.description], wanted.fetchall())
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0]
    assert got[1] == expected[1]
    return len(got[1])
