"""python -m pliego STEP IN OUT

pull     the datasets that the catalogue IN, a JSON file, describes, to part files below OUT; those complete already are left alone.
         --only NAME ..., --refresh for what was changed since, --pages N for a part of each slice. OUT/manifest.json records what is there
follow   the same as streams into keyed tables below OUT/tables: everything until now, then stop; run again for what came since
fetch    the documents that the pages IN (a Parquet table with url and html) link to, below OUT
marts    raw part files below IN (s1, s2, divipola, l1 to l4; secop1_slices/*/*, facts if there) to a mart below OUT
enrich   the mart IN with registration dates from the registers below IN (e1_ibague, e1_santarosa) to a mart below OUT
flags, score, backtest   tables over the mart IN below OUT
export   published lists over the mart IN below OUT
         backtest and export take --cases FILE, landmark cases to look up
report   quality of the mart IN, as Markdown at OUT
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pliego.plans import backtest, enrichment, exports, marts, quality, scoring
from pliego.plans.marts import Mart
from pliego.schemas import SCHEMAS
from pliego.sinks.artifacts import markdown, write_text
from pliego.sources import documents, files, links, manifest, pull

TABLES = [t for t in SCHEMAS if t not in ("flags", "quarantine", "stg_secop1")]
WRITTEN = {"flags": ("flag_contrato", "flag_entidad"), "score": ("flag_contrato", "flag_entidad", "contrato_score", "entidad_score", "municipio_score", "proveedor_score")}


def build(spark: SparkSession, raw: str) -> Mart:
    found = {k: files.parts(spark, f"{raw}/{k}", with_file=k in ("s1", "s2")) for k in ("s1", "s2", "divipola", "l1", "l2", "l3", "l4")}
    if files.exists(spark, f"{raw}/facts"):
        found["facts"] = files.parts(spark, f"{raw}/facts")
    return marts.build(spark, found, files.datasets(spark, f"{raw}/secop1_slices"))


def opened(spark: SparkSession, path: str) -> Mart:
    return marts.opened(spark, path, TABLES + ["stg_secop1"] * files.exists(spark, f"{path}/stg_secop1"))


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """The steps pull and follow; a summary is printed in any case."""
    with open(a.source, encoding="utf-8") as f:
        catalogue = json.load(f)
    record = f"{a.out.rstrip('/')}/manifest.json"
    os.makedirs(a.out, exist_ok=True)
    try:
        if a.step == "pull":
            pull.pull_all(spark, catalogue, a.out, record, a.only, a.refresh, a.pages)
        else:
            manifest.try_all({n: lambda n=n: pull.follow(spark, catalogue[n], f"{a.out.rstrip('/')}/tables/{n}").awaitTermination() for n in catalogue if not a.only or n in a.only})
    finally:
        entries = manifest.read(record)
        for row in pull.summary(record):
            print(json.dumps(row | enrichment.completeness(entries[row["name"]], row["pulled"]), ensure_ascii=False))


def main(argv: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(prog="pliego", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    cli.add_argument("step", choices=["pull", "follow", "fetch", "marts", "enrich", "flags", "score", "backtest", "export", "report"])
    cli.add_argument("source", metavar="IN")
    cli.add_argument("out", metavar="OUT")
    cli.add_argument("--cases", metavar="FILE", help="landmark cases, JSON or YAML")
    cli.add_argument("--doubted", metavar="SLUG", nargs="*", default=[], help="cases whose matches were looked at and are none")
    cli.add_argument("--only", metavar="NAME", nargs="*", default=[], help="of the catalogue's datasets")
    cli.add_argument("--refresh", action="store_true", help="what was changed since the last pull")
    cli.add_argument("--pages", metavar="N", type=int, help="of each slice")
    cli.add_argument("--version", metavar="TEXT", help="of the code, for the catalogue")
    a = cli.parse_args(argv)
    spark = SparkSession.builder.appName(f"pliego {a.step}").getOrCreate()
    if a.step in ("pull", "follow"):
        extract(spark, a)
        return
    if a.step == "fetch":
        found = links.links(spark.read.parquet(a.source).withColumn("page", F.monotonically_increasing_id()), "page", "url", "html")
        documents.gathered(found, {}, a.out)
        return
    if a.step == "marts":
        marts.saved(build(spark, a.source), a.out)
        return
    mart = opened(spark, a.source)
    if a.step == "enrich":
        found = enrichment.resolved(*[files.parts(spark, f"{a.source}/{k}") for k in ("e1_ibague", "e1_santarosa")])
        marts.saved(mart | {"dim_proveedor": enrichment.enriched(mart["dim_proveedor"], found)}, a.out)
    elif a.step == "report":
        write_text(spark, "\n".join(markdown(title, df) for title, df in quality.report(mart).items()), a.out)
    else:
        mart = scoring.run(mart, wanted=WRITTEN.get(a.step, scoring.SCORES), evidence=a.step == "score")  # lists show the evidence of few contracts
        cases = backtest.load_cases(spark, a.cases) if a.cases else None
        if a.step == "export":
            exports.run(mart, a.out, metrics=backtest.summed(backtest.run(mart, cases), a.doubted), version=a.version)
        else:
            marts.saved(backtest.run(mart, cases) if a.step == "backtest" else {k: mart[k] for k in WRITTEN[a.step]}, a.out)


if __name__ == "__main__":
    main()
