"""python -m storyproof run --train train.csv --test test.csv --novel a.txt --novel b.txt --out folder
python -m storyproof evaluate --labels gold.csv --out folder
python -m storyproof index --chunks chunks.parquet --index folder [--merge]
python -m storyproof stream --claims folder --index folder --out folder [--every "10 seconds"]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from storyproof import schemas
from storyproof.config import load
from storyproof.plans.evaluation import MAPPING, evaluate
from storyproof.plans.pipeline import execute, index_rows, query_rows
from storyproof.sources.paths import Files
from storyproof.streaming import asof, segments


def add(spark: SparkSession, chunks: str, index: str, merge: bool = False) -> dict[str, int]:
    version = segments.append(spark, index, index_rows(spark.read.parquet(chunks)))
    return {"version": segments.merge(spark, index) if merge else version}


def answer(spark: SparkSession, claims: str, index: str, out: str, config: str | None = None, every: str | None = None) -> dict[str, str]:
    """Answers to claims as batch=N folders of Parquet under out/answers; out/checkpoint knows which claims were answered."""
    arriving = query_rows(spark.readStream.schema(schemas.CLAIM).json(claims))

    def write(df: DataFrame, batch: int) -> None:
        df.drop("batch").write.mode("overwrite").parquet(f"{out}/answers/batch={batch}")

    asof.answer_stream(arriving, lambda: segments.load(spark, index), write, f"{out}/checkpoint", load(config).retrieval, strict=True, every=every).awaitTermination()
    return {"answers": f"{out}/answers"}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="storyproof", description="Checks summaries of characters against novels.")
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="a whole run with its files")
    run.add_argument("--train", required=True)
    run.add_argument("--test", required=True)
    run.add_argument("--novel", action="append", required=True, help="a text file; its name is the book's; may be repeated, the order counts")
    run.add_argument("--copy-results", help="a path that the results are copied to besides")
    told = commands.add_parser("evaluate", help="compares a run with labels")
    told.add_argument("--labels", required=True)
    told.add_argument("--aggregation", default="max_conf", choices=("max_conf", "vote"))
    told.add_argument("--int-label-map", default=MAPPING)
    for c in (run, told):
        c.add_argument("--out", required=True)
        c.add_argument("--config", help="a YAML file")
        c.add_argument("--run-id")
    grown = commands.add_parser("index", help="adds a table of chunks to a stored index, as a new version")
    grown.add_argument("--chunks", required=True, help="Parquet files of chunks, such as those of a run")
    grown.add_argument("--merge", action="store_true", help="make one segment of all afterwards")
    asked = commands.add_parser("stream", help="answers claims as they arrive, each from the index as it is then")
    asked.add_argument("--claims", required=True, help="a folder that JSON lines of claims arrive in")
    asked.add_argument("--out", required=True)
    asked.add_argument("--config", help="a YAML file")
    asked.add_argument("--every", help='ask for new claims so often, such as "10 seconds"; without, answer what is there and end')
    for c in (grown, asked):
        c.add_argument("--index", required=True)
    a = p.parse_args(argv)
    if a.command in ("index", "stream"):
        spark = SparkSession.builder.appName("storyproof").getOrCreate()
        print(json.dumps(add(spark, a.chunks, a.index, a.merge) if a.command == "index" else answer(spark, a.claims, a.index, a.out, a.config, a.every), indent=2))
        return
    spark, cfg = SparkSession.builder.appName("storyproof").getOrCreate(), load(a.config)
    if a.command == "run":
        made = execute(spark, a.train, a.test, a.novel, a.out, cfg, a.run_id)
        if a.copy_results:
            store = Files(spark)
            for name in store.names(made["results"]):
                store.copy(f"{made['results']}/{name}", f"{a.copy_results.rstrip('/')}/{name}")
    else:
        made = evaluate(spark, a.labels, a.out, a.run_id, a.aggregation, a.int_label_map, cfg)
    print(json.dumps(made, indent=2))


if __name__ == "__main__":
    main()
