"""Commands: python -m casframe.cli [-C dir] COMMAND ...

Exit code 0: done; 1: failed; 2: called wrongly.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from casframe.functions.codecs import DIRECTORY, Corrupt
from casframe.functions.text import abbreviated, first_line, human_bytes, iso_timestamp, message_lines, printable_path, printable_snippet
from casframe.operators import graph, repack, search
from casframe.repository import Layout, Repository, RepositoryError, fsck_folder

VERSION = "casframe 0.1.0"


class _Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise _Usage(message)


def _positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("must be a positive number")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="casframe", allow_abbrev=False)
    p.add_argument("-C", dest="dirs", action="append", default=[])
    p.add_argument("--metadata", default=Layout.metadata)
    p.add_argument("--token", default=Layout.token)
    sub = p.add_subparsers(dest="command", parser_class=_Parser)
    sub.add_parser("init").add_argument("dir", nargs="?", default=".")
    for name in ("snapshot", "commit"):
        s = sub.add_parser(name)
        s.add_argument("-m", "--message", default="Snapshot")
        s.add_argument("--workers", type=_positive)
    s = sub.add_parser("log")
    s.add_argument("revision", nargs="?", default="HEAD")
    s.add_argument("--oneline", action="store_true")
    s.add_argument("-n", "--limit", type=_positive, default=50)
    s = sub.add_parser("diff")
    s.add_argument("before", nargs="?")
    s.add_argument("after", nargs="?")
    s = sub.add_parser("restore")
    s.add_argument("revision")
    s.add_argument("--to")
    s.add_argument("-f", "--force", action="store_true")
    sub.add_parser("upgrade")
    sub.add_parser("repack").add_argument("--dry-run", action="store_true")
    sub.add_parser("index").add_argument("--embedder", default="builtin")
    s = sub.add_parser("find")
    s.add_argument("query")
    s.add_argument("-n", "--limit", type=_positive, default=5)
    sub.add_parser("fsck").add_argument("dir", nargs="?", default=".")
    sub.add_parser("help")
    sub.add_parser("version")
    return p


def run(args: Sequence[str], spark: SparkSession | None = None, out=sys.stdout, err=sys.stderr) -> int:
    """One command; its exit code."""
    try:
        given = parser().parse_args(args)
    except _Usage as e:
        print(f"error: {e}", file=err)
        return 2
    if given.command in (None, "help"):
        parser().print_help(out)
        return 0
    if given.command == "version":
        print(VERSION, file=out)
        return 0
    at = os.getcwd()
    for d in given.dirs:
        at = os.path.join(at, d)
    spark = spark or SparkSession.builder.appName("casframe").getOrCreate()
    try:
        return _commands[given.command](spark, at, Layout(given.metadata, given.token), given, out)
    except _Usage as e:
        print(f"error: {e}", file=err)
        return 2
    except (RepositoryError, Corrupt, ValueError, RuntimeError, OSError) as e:
        print(f"error: {e}", file=err)
        return 1


def _init(spark, at, layout, given, out) -> int:
    print(f"Initialized empty repository in {Repository.init(spark, os.path.join(at, given.dir), layout).meta}", file=out)
    return 0


def _snapshot(spark, at, layout, given, out) -> int:
    r = Repository.open(spark, at, layout)
    if given.workers:
        spark.conf.set("spark.sql.shuffle.partitions", given.workers)
    print(f"Snapshot {r.snapshot(given.message)[:12]} {given.message.strip()}", file=out)
    return 0


def _log(spark, at, layout, given, out) -> int:
    r = Repository.open(spark, at, layout)
    if r.head() is None:
        print("No snapshots yet.", file=out)
        return 0
    rows = r.log(given.revision, given.limit).select("id", abbreviated("id").alias("short"), "parents", iso_timestamp("epoch_sec", "nano").alias("date"), message_lines("message").alias("lines"), first_line("message").alias("first"))
    for c in rows.toLocalIterator():
        if given.oneline:
            print(f"{c.short} {c.first}", file=out)
            continue
        print(f"commit {c.id}", *(f"Parent: {p}" for p in c.parents), f"Date:   {c.date}", "", *(f"    {x}" for x in c.lines), "", sep="\n", file=out)
    return 0


def _diff(spark, at, layout, given, out) -> int:
    rows = Repository.open(spark, at, layout).diff(given.before, given.after)
    kind = F.coalesce("after.kind", "before.kind")
    n = 0
    for c in rows.select("status", F.concat(printable_path("path"), F.when(kind == DIRECTORY, "/").otherwise("")).alias("path")).toLocalIterator():
        print(f"{c.status}\t{c.path}", file=out)
        n += 1
    print("No changes." if not n else f"{n} change{'s' * (n > 1)}", file=out)
    return 0


def _restore(spark, at, layout, given, out) -> int:
    r = Repository.open(spark, at, layout)
    to = os.path.join(at, given.to) if given.to else None
    print(f"Restored {r.restore(given.revision, to, given.force)[:12]} to {to or r.root}", file=out)
    return 0


def _upgrade(spark, at, layout, given, out) -> int:
    print("Upgraded repository to format 2" if Repository.open(spark, at, layout).upgrade() else "repository is already format 2", file=out)
    return 0


def _repack(spark, at, layout, given, out) -> int:
    plan = Repository.open(spark, at, layout).repack(given.dry_run)
    s = repack.stats(plan).withColumns({"a": human_bytes("before"), "b": human_bytes("after")}).first()
    if not s.rewritten:
        print("nothing to repack.", file=out)
    else:
        print(f"{'would repack' if given.dry_run else 'repacked'} {s.rewritten} objects: {s.a} -> {s.b} ({s.percent:.0f}% smaller)", file=out)
    return 0


def _index(spark, at, layout, given, out) -> int:
    name = search.LEXICAL if given.embedder == "builtin" else given.embedder
    try:
        search.embedder(name)
    except ValueError as e:
        raise _Usage(str(e)) from None
    s = Repository.open(spark, at, layout).index(name).first()
    print(f"indexed {s.blobs} blobs ({s.chunks} chunks) with {name}", file=out)
    if s.skipped:
        print(f"skipped {s.skipped} blobs with no extractable text", file=out)
    return 0


def _find(spark, at, layout, given, out) -> int:
    if not given.query.strip():
        raise _Usage("find requires a query")
    rows = Repository.open(spark, at, layout).find(given.query, given.limit)
    for x in rows.withColumns({"first": first_line("message"), "shown": printable_snippet("snippet")}).orderBy(F.desc("score"), "blob_id").collect():
        print(f'{x.blob_id[:12]}  {x.path}  (snapshot: "{x["first"]}", {x.commit_id[:12]})', f"    {x.shown}", sep="\n", file=out)
    return 0


def _fsck(spark, at, layout, given, out) -> int:
    found = fsck_folder(spark, os.path.join(at, given.dir), layout)
    for severity, id_, message in found:
        print(f"{severity}: {f'{id_}: ' if id_ else ''}{message}", file=out)
    errors, warnings = (sum(s == w for s, _, _ in found) for w in ("error", "warning"))
    print(f"{errors} errors, {warnings} warnings", file=out)
    return 1 if errors else 0


_commands = {"init": _init, "snapshot": _snapshot, "commit": _snapshot, "log": _log, "diff": _diff, "restore": _restore, "upgrade": _upgrade, "repack": _repack, "index": _index, "find": _find, "fsck": _fsck}

if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
