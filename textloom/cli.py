"""spark-submit textloom/cli.py check|stats|build-corpus ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.engine import PRESETS, Engine
from textloom.functions.text import roughly_indonesian
from textloom.operators.relational import file_source, share_by
from textloom.sources.files import load_corpus, read_files


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textloom")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-corpus")
    build.add_argument("folder")
    build.add_argument("out")
    check = commands.add_parser("check")
    check.add_argument("docs")
    check.add_argument("corpus", help="a folder of files")
    check.add_argument("--out", required=True)
    check.add_argument("--preset", choices=PRESETS, default="cepat")
    stats = commands.add_parser("stats")
    stats.add_argument("folder")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    if args.command == "build-corpus":
        load_corpus(spark, args.folder).write.mode("overwrite").parquet(args.out)
    elif args.command == "check":
        engine = Engine(spark, load_corpus(spark, args.corpus))
        result = engine.check(load_corpus(spark, args.docs, preprocess=False), **PRESETS[args.preset])
        result.scores.write.mode("overwrite").json(f"{args.out}/scores")
        result.matches.write.mode("overwrite").json(f"{args.out}/matches")
        engine.report_html(result).write.mode("overwrite").json(f"{args.out}/html")
    else:
        rows = read_files(spark, args.folder).where("error is null")
        stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
        rows = rows.select(file_source(stem).alias("source"), roughly_indonesian(F.col("text")).alias("indonesian"), F.octet_length("text").alias("bytes"))
        rows.agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.count_if("indonesian").alias("indonesian")).show()
        share_by(rows, "source").show(truncate=False)


if __name__ == "__main__":
    main()
