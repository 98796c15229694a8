"""Command line: codequarry --project P [--architecture] [--report] [--trace] [--docs], or codequarry P for a tree and a report.

Exit codes: 0 done, 1 bad input, configuration or scan, 4 output cannot be written.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from codequarry.operators import config
from codequarry.operators.shared import forget
from codequarry.plans import reports, run
from codequarry.sources.tree import ScanError

VERSION = "0.1.0"


class Parser(argparse.ArgumentParser):
    """Wrong arguments are bad input like any other: exit code 1."""

    def error(self, message: str):
        print(self.format_usage() + message, file=sys.stderr)
        raise SystemExit(1)


def parser() -> Parser:
    out = Parser(prog="codequarry", description="Deterministic evidence about a source tree.")
    out.add_argument("--project", metavar="PATH", help="the directory to study")
    for name, text in (("architecture", "write the directory tree"), ("report", "write all text files as one document"), ("trace", "write imports, calls and their confirmed targets"), ("docs", "write reports of docs/public and docs/private")):
        out.add_argument(f"--{name}", action="store_true", help=text)
    out.add_argument("--output", metavar="PATH", help="where reports go; a folder of the project's name is made there")
    out.add_argument("--registry", metavar="PATH", help="a personal registry of ignore rules")
    out.add_argument("--minus-gitignore", action="store_true", help="do not apply .gitignore files")
    out.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    return out


def ask_private(read: Callable[[str], str] = input) -> bool:
    """Consent to read an excluded docs/private; anything but yes or no is asked again, and the end of input is a no."""
    while True:
        try:
            answer = read("docs/private is excluded by the ignore rules. Include it in this run? [y/N] ").strip().lower()
        except EOFError:
            return False
        if answer in ("y", "yes"):
            return True
        if answer in ("", "n", "no"):
            return False


def main(argv: list[str] | None = None, spark: SparkSession | None = None, consent: Callable[[], bool] = ask_private) -> int:
    options = parser()
    given = sys.argv[1:] if argv is None else argv
    if len(given) == 1 and not given[0].startswith("-"):
        given = ["--project", given[0], "--architecture", "--report"]
    try:
        args = options.parse_args(given)
    except SystemExit as stop:
        return int(stop.code or 0)
    wanted = args.architecture or args.report or args.trace or args.docs
    if not args.project or not wanted:
        if args.project or wanted:
            print("a project and at least one of --architecture, --report, --trace, --docs are needed", file=sys.stderr)
            return 1
        options.print_help()
        return 0
    root = Path(args.project).expanduser().resolve()
    if not root.is_dir():
        print(f"not a directory: {root}", file=sys.stderr)
        return 1
    base = Path(args.output).expanduser().resolve() if args.output else Path.cwd() / "reports"
    output = base / (root.name or "root")
    if output == root:
        print("reports would be written into the project itself", file=sys.stderr)
        return 1
    if output.exists() and not output.is_dir():
        print(f"not a directory: {output}", file=sys.stderr)
        return 4
    session = None
    try:
        rules = config.load(root, Path(args.registry).expanduser() if args.registry else None)
        session = spark or SparkSession.builder.appName("codequarry").getOrCreate()
        name = root.name or "root"
        if args.architecture or args.report or args.trace:
            entries = run.scan(session, root, rules, (output,), gitignore=not args.minus_gitignore)
            if entries.where("NOT is_directory").isEmpty():
                print("no files to study")
            else:
                study(args, session, root, name, output, entries)
        if args.docs:
            print("\n".join(run.documentation_lines(run.documentation(session, root, output, rules, consent))))
    except (config.ConfigurationError, ScanError, run.DocumentationError) as error:
        print(error, file=sys.stderr)
        return 1
    except OSError as error:
        print(f"output cannot be written: {error}", file=sys.stderr)
        return 4
    finally:
        if session is not None:
            forget(session)
    return 0


def study(args: argparse.Namespace, spark: SparkSession, root: Path, name: str, output: Path, entries) -> None:
    if args.architecture:
        reports.write(output / f"{name}-architecture.md", run.architecture_text(entries, name))
    if args.report or args.trace:
        found = run.evidence(entries, root)
        if args.report:
            target = output / f"{name}-project-report.md"
            for line in run.report_log(found):
                print(line)
            reports.write(target, run.report_text(found, name))
            print("\n".join(run.summary_lines(found, target)))
        if args.trace:
            reports.write(output / f"{name}-trace.md", run.trace_text(run.trace(found.select("path", "language", "status", "content"))))


if __name__ == "__main__":
    sys.exit(main())
