"""Changes from git: the commands, and their output as rows. Diffs are small, so they are read on the driver."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_HUNK = re.compile(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@")


def _revisions(since: str | None, until: str | None, staged: bool) -> list[str]:
    """Staged changes, a range, the changes since a ref, or the work tree against HEAD; ``until`` alone says nothing."""
    if staged:
        return ["--cached"]
    if since and until:
        return [f"{since}...{until}"]
    return [since or "HEAD"]


def names_command(since: str | None = None, until: str | None = None, staged: bool = False) -> list[str]:
    """Names of added, copied, modified and renamed files."""
    return ["git", "diff", "--name-only", "--diff-filter=ACMR", *_revisions(since, until, staged)]


def hunks_command(since: str | None = None, until: str | None = None, staged: bool = False) -> list[str]:
    return ["git", "diff", "--unified=0", "--diff-filter=ACMR", *_revisions(since, until, staged)]


def _run(command: list[str], root: str) -> str:
    done = subprocess.run(command, cwd=root, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"{' '.join(command)} failed: {done.stderr.strip()}")
    return done.stdout


def parse_hunks(diff: str) -> list[tuple[str, int, int]]:
    """(path, start, count) of the new side of each hunk; a count that is left out is 1."""
    out, path = [], None
    for line in diff.split("\n"):
        if line.startswith("diff --git"):
            path = line[line.index("b/") + 2 :] if "b/" in line else None
        elif line.startswith("+++ b/"):
            path = line[len("+++ b/") :]
        elif path and (m := _HUNK.match(line)):
            out.append((path, int(m[1]), int(m[2]) if m[2] is not None else 1))
    return out


def hunks_of_diffs(diffs: DataFrame) -> DataFrame:
    """path, start, cnt of the hunks in each diff of a table (diff); a diff is parsed by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([h for d in pdf["diff"] for h in parse_hunks(d or "")], columns=["path", "start", "cnt"])

    return diffs.select("diff").mapInPandas(run, "path string, start int, cnt int")


def changed_files(spark: SparkSession, root: str, since: str | None = None, until: str | None = None, staged: bool = False) -> DataFrame:
    names = [x.strip() for x in _run(names_command(since, until, staged), root).split("\n") if x.strip()]
    return spark.createDataFrame(list(enumerate(names)), "ord long, path string")


def changed_hunks(spark: SparkSession, root: str, since: str | None = None, until: str | None = None, staged: bool = False) -> DataFrame:
    return spark.createDataFrame(parse_hunks(_run(hunks_command(since, until, staged), root)), "path string, start int, cnt int")


def php_changes_or_all(spark: SparkSession, root: str, project: DataFrame) -> DataFrame:
    """path: PHP files that differ from HEAD (added, copied, modified) or are not tracked; all of the project if git fails."""
    try:
        said = _run(["git", "diff", "--name-only", "--diff-filter=ACM", "HEAD"], root) + "\n" + _run(["git", "ls-files", "--others", "--exclude-standard"], root)
    except (RuntimeError, OSError):
        return project.select("path")
    names = dict.fromkeys(x.strip() for x in said.split("\n") if x.strip().endswith(".php"))
    return spark.createDataFrame([(n,) for n in names], "path string").join(project.select("path"), "path", "left_semi")
