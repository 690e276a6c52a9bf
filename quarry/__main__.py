"""python -m quarry: ingest a collection, ask it, evaluate it, draft its question set, or manage the registry of collections."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import catalog, evaluate
from quarry.plans import evaluation
from quarry.plans.pipeline import STEPS, Ingestion
from quarry.session import cut, get_spark
from quarry.sources import snapshots


def registry(spark: SparkSession, root: str) -> DataFrame:
    """The registry's table, or one with the default collection alone."""
    return catalog.or_default(snapshots.Table(spark, f"{root}/registry", catalog.SCHEMA).read())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("--root", default="quarry-data", help="folder of all tables")
    p.add_argument("--collection", default=os.environ.get("COLLECTION") or "default", help="also by the environment variable COLLECTION")
    p.add_argument("--source", choices=catalog.SOURCES)
    p.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="of the source; may be given again")
    p.add_argument("--steps", help="comma-separated; all by default")
    p.add_argument("--list-steps", action="store_true")
    p.add_argument("--list-collections", action="store_true")
    p.add_argument("--add-collection", metavar="NAME")
    p.add_argument("--remove-collection", metavar="NAME")
    p.add_argument("--title", default="")
    p.add_argument("--description", default="")
    p.add_argument("--ask", metavar="QUESTION", help="the answer is also put into the collection's history")
    p.add_argument("--evaluate", action="store_true", help="metrics of the golden set, written and printed")
    p.add_argument("--compare", action="store_true", help="dense against hybrid retrieval over the golden set")
    p.add_argument("--benchmark", action="store_true", help="dense against hybrid retrieval on the synthetic corpus")
    p.add_argument("--alpha", type=float, default=0.5, help="weight of the dense side")
    p.add_argument("--bootstrap", type=int, metavar="PER_PAGE", help="draft so many questions a page as candidates")
    p.add_argument("--approve", action="store_true", help="merge the candidates into the golden set")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.list_steps:
        print("\n".join(STEPS))
        return 0
    options = dict(o.split("=", 1) for o in a.option)
    spark = get_spark()
    reg, kept = registry(spark, a.root), snapshots.Table(spark, f"{a.root}/registry", catalog.SCHEMA)
    if a.add_collection:
        kept.update(lambda r: catalog.register(catalog.or_default(r), a.add_collection, a.title or a.add_collection, a.source or "mediawiki", a.description, **options).coalesce(1))
        return 0
    if a.remove_collection:
        kept.update(lambda r: catalog.remove(catalog.or_default(r), a.remove_collection).coalesce(1))
        return 0
    if a.list_collections:
        for r in reg.orderBy(F.col("name") != "default", "name").collect():
            print(f"{r['name']}\t{r['source']}\t{r['title']}")
        return 0
    if a.benchmark:
        dense, hybrid = evaluation.benchmark(spark, alpha=a.alpha)
        print(evaluate.comparison_report(evaluate.compare(dense, hybrid), a.alpha, hybrid.count()))
        return 0
    entry = catalog.get(reg, a.collection)
    job = Ingestion(spark, a.root, a.collection, a.source or entry["source"], catalog.source_options(entry) | options)
    if a.ask:
        q = spark.createDataFrame([(1, a.ask)], "qid long, question string")
        answers = cut(job.ask(q), "answers")
        evaluation.Evaluation(job).log(answers)
        print(json.dumps(answers.first().asDict(recursive=True), indent=2, ensure_ascii=False))
        return 0
    kept = evaluation.Evaluation(job)
    if a.bootstrap is not None:
        print(f"{kept.bootstrap(a.bootstrap).count()} candidates")
        return 0
    if a.approve:
        print(f"{kept.approve()} questions added")
        return 0
    if a.evaluate:
        summary = kept.evaluate()
        print(evaluate.report(summary, summary.first()["eval_time_s"]))
        return 0
    if a.compare:
        print(evaluate.comparison_report(kept.compare(a.alpha), a.alpha, kept.questions().count()))
        return 0
    for step in job.run(a.steps.split(",") if a.steps else None):
        print(f"done: {step}", flush=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
