"""URL filters: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

Rules are (verdict, host, path prefix). A rule fits its host and all subdomains of it if the url's
path starts with the rule's path; of the rules that fit, the longest (host and path together) wins,
and a block wins over an allow of the same text. Where none fits, the verdict is ``default``.

The array of digests is one file, sent once to each executor by ``addFile`` (an executor that comes
later fetches it again) and memory-mapped by its workers. A url probes one key for each pair of a
host suffix and a path length that rules have; a digest that is found counts only if the stored
full string is the same, so collisions cannot decide. No row moves: the plan has no shuffle.

The rules are a driver-side list of at most ``MAX_RULES``; a longer list is refused with an error.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule;
white space, ports and user names in a host stay as they are; urls of any length are judged whole; repeated rows come
back repeated, those of a null id too; an empty table gives no rows, and no rules give every url the default; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches, shared_file

MAX_RULES = 20_000_000

_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    m = _HOST.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class DigestFilter:
    """Sorted digests with the strings they stand for, in two files that are memory-mapped."""

    def __init__(self, folder: str):
        self.keys = np.load(f"{folder}.keys.npy", mmap_mode="r")
        self.ends = np.load(f"{folder}.ends.npy", mmap_mode="r")
        self.blob = np.load(f"{folder}.blob.npy", mmap_mode="r")
        self.block = np.load(f"{folder}.block.npy", mmap_mode="r")

    @staticmethod
    def arrays(rules: Iterable[tuple[str, str, str]], digest=xxhash.xxh64_intdigest) -> dict[str, np.ndarray]:
        known: dict[bytes, bool] = {}
        for verdict, host, path in rules:
            key = (host + path).encode()
            known[key] = known.get(key, False) or verdict == "block"
            if len(known) > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
        keys = sorted((digest(k), k, b) for k, b in known.items())
        return {
            "keys": np.array([k for k, _, _ in keys], np.uint64),
            "ends": np.cumsum([0, *(len(s) for _, s, _ in keys)]).astype(np.int64),
            "blob": np.frombuffer(b"".join(s for _, s, _ in keys), np.uint8),
            "block": np.array([b for _, _, b in keys], bool),
        }

    def probe(self, texts: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """For each text the row of its rule, or -1."""
        if not texts or not len(self.keys):
            return np.full(len(texts), -1, np.int64)
        wanted = np.fromiter((digest(t) for t in texts), np.uint64, len(texts))
        at, out = np.searchsorted(self.keys, wanted, "left"), np.full(len(texts), -1, np.int64)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted):
            row = int(at[k])
            while row < len(self.keys) and self.keys[row] == wanted[k]:  # all strings of that digest
                if self.blob[self.ends[row] : self.ends[row + 1]].tobytes() == texts[k]:
                    out[k] = row
                    break
                row += 1
        return out


_OPEN: dict[str, DigestFilter] = {}


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """<id_col>, host, path, rule, verdict of every row. Rule paths are empty or start with ``/``."""
    rules = list(rules)
    spark = pages.sparkSession
    name = "urls-" + hashlib.sha256(repr(rules).encode()).hexdigest()[:24]
    for part, array in DigestFilter.arrays(rules).items():
        data = io.BytesIO()
        np.save(data, array)
        spark.sparkContext.addFile(shared_file(spark, f"{name}.{part}.npy", data.getvalue()))
    lengths = sorted({len(path.encode()) for _, _, path in rules})
    kind = pages.schema[id_col].dataType.simpleString()

    def run(cols):
        if name not in _OPEN:
            _OPEN[name] = DigestFilter(SparkFiles.get(name))
        index, parts = _OPEN[name], [split_url(u) for u in cols[1]]
        texts, owner = [], []
        for k, (host, path) in enumerate(parts):
            h, p = host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass")
            for s in [0, *(m.end() for m in re.finditer(rb"\.", h))] if h else []:
                for n in lengths:
                    if n <= len(p):
                        texts.append(h[s:] + p[:n])
                        owner.append(k)
        best: dict[int, tuple] = {}
        for k, text, row in zip(owner, texts, index.probe(texts), strict=True):
            if row >= 0:
                best[k] = max(best.get(k, (0, False, b"")), (len(text), bool(index.block[row]), text))
        rule = [best[k][2].decode() if k in best else None for k in range(len(parts))]
        verdict = [("block" if best[k][1] else "allow") if k in best else default for k in range(len(parts))]
        return [cols[0], [h for h, _ in parts], [p for _, p in parts], rule, verdict]

    return map_batches(pages.select(id_col, url_col), run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string", rows=4096)
