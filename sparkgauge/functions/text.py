"""Text normalisation for duplicate detection."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLANKS = re.compile(r"\s+")


def normalize(text: str) -> str:
    """Entities decoded, compatibility forms composed, case folded, white space collapsed and trimmed."""
    return _BLANKS.sub(" ", unicodedata.normalize("NFKC", html.unescape(text)).casefold()).strip()


@F.arrow_udf(StringType())
def _normalized(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else normalize(t) for t in texts.to_pylist()], pa.string())


def normalized_text(column: Column) -> Column:
    return _normalized(column)


def plain_text(column: Column) -> Column:
    """The same for text without entities, compatibility forms or special case rules, inside code generation."""
    return F.trim(F.regexp_replace(F.lower(column), r"\s+", " "))
