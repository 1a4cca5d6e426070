"""Keys of names. Each stage has its own rule; all are computed once, at ingest."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACES = r"^\s+|\s+$"


@F.pandas_udf(StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no such function."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _SPACES, "")


def popularity_key(c: Column) -> Column:
    """Trimmed, without a leading A-; case and accents count."""
    return trimmed(F.regexp_replace(trimmed(c), r"^A-", ""))


def collection_key(c: Column) -> Column:
    """Without accents, lower case, trimmed."""
    return trimmed(F.lower(without_marks(c)))


def token_key(c: Column) -> Column:
    """The collection key with letters, digits and spaces only, runs of spaces as _."""
    return F.regexp_replace(F.regexp_replace(collection_key(c), r"[^a-z0-9\s]", ""), r"\s+", "_")


def file_key(c: Column) -> Column:
    """As the token key, with case kept."""
    return F.regexp_replace(trimmed(F.regexp_replace(without_marks(c), r"[^a-zA-Z0-9\s]", "")), r"\s+", "_")
