"""Checks before a release: what has to be there, what must not, and digests that have to hold."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sparkgauge.sources.digests import file_digest

REQUIRED = ("README.md", "bench.py", "__spark_entry__.py")
MOST_BYTES = 5 << 20
# Signs of secrets: private keys, cloud keys, bearer tokens, passwords given as literals.
SECRETS = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", r"\bhf_[A-Za-z0-9]{30,}\b", r"(?i)\b(?:password|secret|api_key)\s*=\s*['\"][^'\"]{8,}['\"]")
FORBIDDEN = (".npy", ".npz", ".parquet", ".zip", ".pt", ".bin", ".safetensors")


def read_sums(path: Path) -> list[tuple[str, str]]:
    """(digest, name) of a list of SHA-256 sums."""
    return [(d, n.removeprefix("*")) for d, n in (line.split(maxsplit=1) for line in path.read_text().splitlines() if line.strip())]


def problems(root: str | Path, files: Sequence[str], required: Sequence[str] = REQUIRED, most: int = MOST_BYTES, sums: str | None = None) -> list[tuple[str, str]]:
    """(file, what is wrong) for the files of a source tree, which are few and small."""
    root = Path(root)
    out = [(n, "missing") for n in required if not (root / n).is_file()]
    for name in files:
        p = root / name
        if not p.is_file():
            out.append((name, "listed but missing"))
            continue
        if p.stat().st_size > most:
            out.append((name, "too large"))
        if p.suffix in FORBIDDEN:
            out.append((name, "data or weights"))
        text = p.read_bytes().decode("utf-8", "ignore") if p.stat().st_size <= most else ""
        out += [(name, "looks like a secret") for s in SECRETS if re.search(s, text)]
    if sums:
        at = root / sums
        for digest, name in read_sums(at):
            p = at.parent / name
            if not p.is_file() or file_digest(p) != digest:
                out.append((str(p.relative_to(root)), "missing or changed"))
    return sorted(set(out))


def as_table(spark: SparkSession, found: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(found, "file string, problem string")
