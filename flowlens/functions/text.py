"""String expressions: name rules, formula-injection guard, filename cleaning."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .columns import contains_any


def spoofability(name: Column) -> Column:
    """Spoofability class from a feature name; aggregate patterns win."""
    return (F.when(contains_any(name, C.AGGREGATE_PATTERNS), F.lit(C.SPOOF_AGGREGATE))
            .when(contains_any(name, C.ATTACKER_CONTROLLABLE_PATTERNS), F.lit(C.SPOOF_CONTROLLABLE))
            .otherwise(F.lit(C.SPOOF_UNCLASSIFIED)))


def spoof_weight(cls: Column) -> Column:
    out = F.lit(None).cast("double")
    for label, w in reversed(C.SPOOF_WEIGHTS):
        out = F.when(cls == label, F.lit(w)).otherwise(out)
    return out


def identity_like(name: Column) -> Column:
    """Substring rule (case-insensitive)."""
    return contains_any(name, C.IDENTITY_LEAK_PATTERNS)


def identity_like_regex(name: Column) -> Column:
    """Token-boundary rule."""
    return name.rlike(C.IDENTITY_NAME_REGEX)


def formula_guard(c: Column) -> Column:
    """Prefix a quote to text that a spreadsheet would run as a formula, sparing numbers."""
    risky = c.rlike(r"^[=+\-@]") & c.try_cast("double").isNull()
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def clean_filename(path: Column, max_len: int = 255) -> Column:
    """Basename, control characters removed, unsafe characters to '_', truncated."""
    base = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)$", 1)
    no_ctrl = F.regexp_replace(base, r"[\x00-\x1f\x7f]", "")
    safe = F.regexp_replace(no_ctrl, r"[^A-Za-z0-9._\- ]", "_")
    trimmed = F.trim(safe)
    return F.substring(F.when(trimmed == "", F.lit("upload.csv")).otherwise(trimmed), 1, max_len)


def first_path_segment(path: Column, root: str | None = None) -> Column:
    """First folder below ``root`` (the attack category of a folder-tree dataset)."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, r"^file:", "")
    if root:
        r = root.rstrip("/").replace("\\", "/")
        if r.startswith("file:"):
            r = r[5:]
        p = F.substring_index(p, r + "/", -1)
    return F.split(p, "/").getItem(0)
