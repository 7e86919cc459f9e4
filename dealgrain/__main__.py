"""Commands over folders of agreements: python -m dealgrain COMMAND ...; results are Parquet tables and JSON documents."""

from __future__ import annotations

import argparse
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dealgrain", description=__doc__)
    add = p.add_subparsers(dest="command", required=True).add_parser
    mine = add("mine", help="mine a folder of agreements and write its tables")
    mine.add_argument("root")
    mine.add_argument("out")
    mine.add_argument("--config", required=True, help="settings, JSON or YAML")
    mine.add_argument("--taxonomy", required=True, help="a list of entries, or an object with entries")
    for name in ("verdicts", "classifications", "standards", "scopes"):
        mine.add_argument(f"--{name}", help=f"a Parquet table of {name}")
    mine.add_argument("--hints", help="hints by document, JSON or YAML")
    mine.add_argument("--template", help="a file with the text of our own paper")
    project = add("project", help="make a playbook of mined tables")
    project.add_argument("mined")
    project.add_argument("out")
    project.add_argument("--config", required=True)
    project.add_argument("--standards")
    for name, told in (("check", "list what is wrong with a playbook"), ("digest", "print its digest"), ("prompt", "print it as Markdown"), ("html", "print it as a page")):
        add(name, help=told).add_argument("playbook")
    lint = add("lint", help="list what is odd about a folder of agreements")
    lint.add_argument("root")
    induce = add("induce", help="print a taxonomy of the headings of a folder of agreements")
    induce.add_argument("root")
    induce.add_argument("--name", default="induced")
    return p


TABLES = "clauses scope order diffs reversals moves observations pending quarantine".split()


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    from dealgrain.operators import classify
    from dealgrain.plans import mine, playbook
    from dealgrain.plans.base import checkpoint
    from dealgrain.sources import config, files

    if a.command in ("check", "digest", "prompt", "html"):
        with open(a.playbook, encoding="utf-8") as f:
            doc = json.load(f)
        if a.command == "check":
            found = playbook.problems(doc)
            print("\n".join(f"{'error' if blocking else 'warning'} {at}: {m}" for m, at, blocking in found) or "fine")
            return int(any(blocking for _, _, blocking in found))
        print(json.dumps(playbook.digest(doc), ensure_ascii=False, indent=2) if a.command == "digest" else getattr(playbook, a.command)(doc))
        return 0
    spark = _session()
    if a.command == "lint":
        for r in files.lint(files.scan(spark, a.root).select(files.F.col("document_id").alias("folder"), "file_name")).orderBy("level", "code", "folder", "detail").collect():
            print(r.level, r.code, r.folder, r.detail)
        return 0
    if a.command == "induce":
        rows = files.parsed(files.scan(spark, a.root)).where("ord >= 0 and heading is not null")
        print(config.taxonomy_yaml(classify.induce(rows, checkpoint).select("id", "label", "status", "documents"), a.name), end="")
        return 0
    settings = config.config(config.load(a.config))
    held = lambda name: spark.read.parquet(getattr(a, name)) if getattr(a, name, None) else None
    if a.command == "mine":
        entries = config.load(a.taxonomy)
        none = spark.createDataFrame([], "key string, deviation string, direction string, magnitude string")
        template = open(a.template, encoding="utf-8").read() if a.template else None
        verdicts = held("verdicts")
        mined = mine.mine_folder(
            spark, a.root, config.taxonomy(spark, entries["entries"] if isinstance(entries, dict) else entries), [], none if verdicts is None else verdicts, classifications=held("classifications"), standards=held("standards"),
            scopes=held("scopes"), hints=config.hints(spark, config.load(a.hints)) if a.hints else None, settings=settings, template=template,
        )
        for name in TABLES:
            getattr(mined, name).write.mode("overwrite").parquet(f"{a.out}/{name}")
    else:
        mined = mine.Mined(*[spark.read.parquet(f"{a.mined}/{name}") for name in TABLES])
        playbook.write_atomic(mine.project(mined, settings.agreement, held("standards"), settings.min_evidence), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
