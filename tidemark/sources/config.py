"""The YAML settings file."""

from __future__ import annotations

import os

# Names that are tried, in this order, if no file is named.
DEFAULT_NAMES = (".tidemark.yml", "tidemark.yml", "config.yml")


def full_scan_patterns(path: str | None = None, root: str = ".") -> list[str] | None:
    """The patterns that ask for a full run: None if no file sets them (the defaults hold), an empty list if a file
    turns them off. A named file that is missing is an error."""
    if path is not None:
        path = os.path.join(root, path)
        if not os.path.isfile(path):
            raise FileNotFoundError(f"no settings file {path}")
    else:
        path = next((p for name in DEFAULT_NAMES if os.path.isfile(p := os.path.join(root, name))), None)
        if path is None:
            return None
    import yaml

    with open(path, encoding="utf-8") as f:
        said = yaml.safe_load(f)
    found = said.get("full_scan_patterns") if isinstance(said, dict) else None
    return None if found is None else [str(x) for x in found]
