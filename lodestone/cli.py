"""Command line: learn a directory into an index, recall passages from it, tune the settings of either, list models."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import fields, replace

from pyspark.sql import SparkSession

from lodestone import engine
from lodestone.config import IndexConfig, QueryConfig
from lodestone.functions import models
from lodestone.operators import index, render, search, tune
from lodestone.sources.files import read_directory, read_eval_set

INDEX_PLACES = (os.environ.get("LODESTONE_INDEX", ""), ".lodestone/index")
CORPUS_PLACES = (os.environ.get("LODESTONE_CORPUS", ""), "knowledge", "docs")


def first_of(places: tuple[str, ...], what: str) -> str:
    for p in places:
        if p and os.path.exists(p):
            return p
    sys.exit(f"no {what} at any of: {', '.join(p for p in places if p)}")


def _with(cfg, args):
    """The config with the options that were given."""
    return replace(cfg, **{f.name: tuple(v) if isinstance(v, list) else v for f in fields(cfg) if (v := getattr(args, f.name, None)) is not None})


def _options(parser: argparse.ArgumentParser, cls) -> None:
    for f in fields(cls):
        name, default = f"--{f.name.replace('_', '-')}", getattr(cls(), f.name)
        if isinstance(default, bool):
            parser.add_argument(name, action=argparse.BooleanOptionalAction)
        elif isinstance(default, tuple):
            parser.add_argument(name, nargs="*")
        else:
            parser.add_argument(name, type=type(default))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestone")
    sub = parser.add_subparsers(dest="command", required=True)
    learn = sub.add_parser("learn", help="index a directory")
    _options(learn, IndexConfig)
    recall = sub.add_parser("recall", help="answer a question")
    recall.add_argument("question", nargs="+")
    recall.add_argument("--format", choices=("human", "json", "block"), default="human" if sys.stdout.isatty() else "block")
    _options(recall, QueryConfig)
    tuned = sub.add_parser("tune", help="find settings for labelled questions")
    tuned.add_argument("what", choices=("recall", "learn"))
    tuned.add_argument("questions")
    tuned.add_argument("--trials", type=int, default=0)
    tuned.add_argument("--objective", default="hit_rate")
    tuned.add_argument("--save", help="file for the best settings")
    tuned.add_argument("--mode", choices=("hybrid", "semantic", "bm25"))
    tuned.add_argument("--model")
    tuned.add_argument("--k", type=int, default=5)
    for p in (learn, recall, tuned):
        p.add_argument("--index")
        p.add_argument("--config")
    for p in (learn, tuned):
        p.add_argument("--corpus")
    sub.add_parser("models", help="list the models")
    sub.add_parser("init", help="check that a model's files are in place").add_argument("model", nargs="?", default="")
    args = parser.parse_args(argv)

    if args.command == "models":
        for m in (*sorted(models.MODELS.values(), key=lambda m: m.key), models.resolve(models.NONE)):
            print(f"{m.key}\t{m.dim}\t{m.max_length if m.dim else 0}\t{m.pooling if m.dim else ''}")
        return
    if args.command == "init":
        if lacks := models.missing(models.resolve(args.model)):
            sys.exit("put these files in place: " + ", ".join(map(str, lacks)))
        return
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    if args.command == "learn" or args.command == "tune" and args.what == "learn":
        cfg = _with(IndexConfig.load(args.config) if args.config else IndexConfig(), args)
        if cfg.model == models.NONE and getattr(args, "stem", None) is None and not args.config:
            cfg = replace(cfg, stem=True)
        files = read_directory(spark, args.corpus or first_of(CORPUS_PLACES, "corpus"), cfg.include, cfg.exclude)
        if args.command == "learn":
            engine.make_index(files, cfg, args.use_ivf).save(args.index or INDEX_PLACES[-1])
            return
        queries, labels = read_eval_set(spark, args.questions)
        query_cfg = QueryConfig(mode="bm25" if cfg.model == models.NONE else args.mode or "hybrid", k=args.k)
        best, score = tune.tune_index(lambda c: engine.make_index(files, c), lambda q: engine.with_vectors(q, cfg.model), queries, labels, tune.drawn(cfg, args.trials), query_cfg, args.objective)
        print(f"{args.objective} {score:.4f}: {best}")
        if args.save:
            best.save(args.save)
        return
    built = index.load(spark, args.index or first_of(INDEX_PLACES, "index"))
    base = _with(QueryConfig.load(args.config) if args.config else QueryConfig(), args)
    base = engine.settled(built, base, args.mode is not None, bool(args.config) or getattr(args, "title_boost", None) is not None)
    if args.command == "tune":
        queries, labels = read_eval_set(spark, args.questions)
        asked = queries if base.mode == "bm25" else engine.with_vectors(queries, built.model)
        best, score = tune.tune_query(built, asked, labels, tune.sampled(base, args.trials), args.objective)
        print(f"{args.objective} {score:.4f}: {best}")
        if args.save:
            best.save(args.save)
        return
    shown = engine.recall(built, engine.questions(spark, " ".join(args.question)), base)
    if args.format == "json":
        print((shown.transform(render.as_json).select("json").first() or ["[]"])[0])
        return
    out = (render.context_block(shown) if args.format == "block" else render.human(shown)).orderBy("rank")
    if args.format == "human":
        print(search.backend(built), file=sys.stderr)
    for row in out.collect():
        print(row[-1])


if __name__ == "__main__":
    main()
