"""Command line, for ``spark-submit`` or ``python -m taleweave``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from taleweave.operators import workflows
from taleweave.sources.readers import read_columnar


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="taleweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    prepare = commands.add_parser("prepare", help="raw text or CSV to a typed columnar dataset")
    prepare.add_argument("kind", choices=["category", "importance", "cloze"])
    prepare.add_argument("source")
    prepare.add_argument("output")
    for name, tasks in (
        ("classify", ["ending", "category", "importance", "text"]),
        ("score", ["ending", "category", "importance", "text", "pair", "rating"]),
        ("regress", ["pair", "text"]),
        ("generate", ["cloze", "story"]),
        ("multitask", ["category", "importance"]),
    ):
        command = commands.add_parser(name)
        command.add_argument("task", choices=tasks)
        command.add_argument("data", help="saved dataset")
        command.add_argument("output")
        command.add_argument("--seed", type=int, default=69 if name == "regress" else 690)
        if name == "score":
            command.add_argument("--model", required=True, help="folder of a saved model")
        if name in ("classify", "regress"):
            command.add_argument("--save", help="folder for the fitted model")
        if name == "classify":
            command.add_argument("--resume", help="folder of finished stages, to go on after the last one")
        if name in ("classify", "generate"):
            command.add_argument("--test", help="separate test dataset")
        if name == "generate":
            command.add_argument("--top-p", type=float, default=0.9)
            command.add_argument("--top-k", type=int, default=0, help="0: no limit")
            command.add_argument("--temperature", type=float, default=1.0)
            command.add_argument("--repetition-penalty", type=float, default=1.0)
            command.add_argument("--max-new-tokens", type=int, default=50)
        if name in ("classify", "score"):
            command.add_argument("--learner", choices=["bayes", "logistic"], default="bayes")
        if name != "score":
            for part in ("train", "validation", "test"):
                command.add_argument(f"--max-{part}-samples", type=int)
    commands.add_parser("evaluate", help="metrics of a prediction file").add_argument("source")
    for command in commands.choices.values():
        command.add_argument("--overwrite", action="store_true", help="replace a non-empty output")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("taleweave").getOrCreate()
    if args.command == "prepare":
        run = getattr(workflows, f"prepare_{args.kind}")
        run(spark, args.source, args.output, args.overwrite)
        return
    if args.command == "evaluate":
        workflows.post_evaluate(spark, args.source).show(truncate=False)
        return
    data = read_columnar(spark, args.data)
    common = {"seed": args.seed, "overwrite": args.overwrite}
    if getattr(args, "test", None):
        common["test"] = read_columnar(spark, args.test)
    if args.command != "score":
        given = {s: getattr(args, f"max_{s}_samples") for s in ("train", "validation", "test")}
        common["limits"] = {s: n for s, n in given.items() if n is not None}
    if args.command == "classify":
        report = workflows.classify(data, args.task, args.output, save=args.save, learner=args.learner, resume=args.resume, **common)
    elif args.command == "regress":
        report = workflows.regress(data, args.task, args.output, save=args.save, **common)
    elif args.command == "score":
        report = workflows.score(data, args.task, args.model, args.output, args.overwrite, args.learner)
    elif args.command == "generate":
        decode = {n: getattr(args, n) for n in ("top_p", "top_k", "temperature", "repetition_penalty", "max_new_tokens")}
        report = workflows.generate_endings(data, args.task == "cloze", args.output, **common, **decode)
    else:
        report = workflows.multitask(data, args.task, args.output, **common)
    report.show(truncate=False)


if __name__ == "__main__":
    main()
