"""Path functions as columns."""

from __future__ import annotations

import fnmatch
import posixpath
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from provgraph.functions.enums import KINDS


# Words for the stage of a file at the end of its name.
STAGED = r"(?i)[_-]?(?:final|draft|debug|diagnostic|intermediate)$"


def directory(path: Column) -> Column:
    """Everything before the last slash; '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """From the last dot of the name on, without it; '' for none and for names that begin with their only dot."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def kind(path: Column) -> Column:
    out = F.lit("file")
    ext = F.lower(suffix(path))
    for name, values in KINDS.items():
        out = F.when(ext.isin(values), name).otherwise(out)
    return out


def series(name: Column) -> Column:
    """The last run of digits as ``#``."""
    return F.regexp_replace(name, r"\d+(\D*)$", "#$1")


def template(name: Column) -> Column:
    """Every run of digits as ``{n}``, a trailing stage word as ``-{stage}``."""
    return F.regexp_replace(F.regexp_replace(name, r"\d+", "{n}"), STAGED, "-{stage}")


def path_key(path: Column) -> Column:
    """The form in which paths are compared where case does not count."""
    return F.lower(F.regexp_replace(path, r"\\", "/"))


def short_id(kind: Column, value: Column) -> Column:
    """A stable id of something without a file: its kind and a part of a digest."""
    return F.concat(kind, F.lit(":"), F.left(F.sha2(value, 256), F.lit(24)))


def prefixes(path: Column) -> Column:
    """All directories above a path, the top as ''."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


@F.pandas_udf(StringType())
def normalized(path: pd.Series) -> pd.Series:
    """NFC, forward slashes, no drive or leading slash, ``.`` dropped and ``..`` resolved."""

    def one(p: str | None) -> str | None:
        if p is None:
            return None
        p = unicodedata.normalize("NFC", p).replace("\\", "/")
        unc = p.startswith("//")
        p = re.sub(r"^[A-Za-z]:", "", p)
        p = posixpath.normpath(p).lstrip("/")
        while p.startswith("../"):
            p = p[3:]
        return ("//" if unc else "") + ("" if p in (".", "..") else p)

    return path.map(one)


def glob_regex(pattern: str) -> str:
    """A glob as a Java regular expression; ``*`` crosses slashes, ``dir/**`` takes all below."""
    if pattern.endswith("/**"):
        return "^" + re.escape(pattern[:-3]) + "(/.*)?$"
    return "^" + re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"(?s:\1)$", fnmatch.translate(pattern))


def excluded(path: Column, include: list[str], exclude: list[str], secret: list[str]) -> Column:
    """Whether a path is left out: secret or excluded, or not among the included ones."""
    any_of = lambda globs: F.coalesce(*[F.when(path.rlike(glob_regex(g)), True) for g in globs], F.lit(False)) if globs else F.lit(False)
    return any_of(secret) | any_of(exclude) | (~any_of(include) if include else F.lit(False))
