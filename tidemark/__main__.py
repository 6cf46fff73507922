"""Command line: prints what a change of a git repository affects, on one line, for a test runner or an analyser."""

from __future__ import annotations

import argparse
import logging
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tidemark", description=__doc__)
    p.add_argument("command", nargs="?", default="analyze", choices=["analyze"])
    p.add_argument("-o", "--output", default="phpunit", help="phpunit for tests, psalm or phpstan for all files")
    p.add_argument("--from", dest="since", help="ref to compare from")
    p.add_argument("--to", dest="until", help="ref to compare to; alone it says nothing")
    p.add_argument("--staged", action="store_true", help="staged changes only")
    p.add_argument("--full-scan-pattern", help="expression or glob of files whose change asks for everything")
    p.add_argument("--test-pattern", help="expression for test files")
    p.add_argument("--no-cache", action="store_true", help="parse all files again")
    p.add_argument("--clear-cache", action="store_true", help="forget the kept graph first")
    p.add_argument("--cache-stats", action="store_true", help="say how many files were parsed")
    p.add_argument("-p", "--parallel", type=int, help="number of tasks at a time")
    p.add_argument("-c", "--config", help="settings file")
    p.add_argument("-m", "--method-level", action="store_true", help="by method; the default")
    p.add_argument("--file-level", action="store_true", help="by file: faster, less precise")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    said = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO if said.verbose or said.cache_stats else logging.WARNING, format="[tidemark] %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    from tidemark.plans.analyze import Options, analyze
    from tidemark.session import session

    options = Options(said.output, said.since, said.until, said.staged, said.full_scan_pattern, said.test_pattern, not said.no_cache, said.clear_cache, said.config, said.file_level)
    try:
        options.checked()
        spark = session(f"local[{said.parallel or '*'}]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
        spark.sparkContext.setLogLevel("ERROR")
        sys.stdout.write(analyze(spark, os.getcwd(), options))
    except Exception as e:  # noqa: BLE001 - one line for the shell that called
        print(f"[tidemark] {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
