"""Column expressions on text that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\x0c\r"


def lower_az(c: Column) -> Column:
    """Lower-case A-Z alone.  Text of ASCII bytes only takes the faster lower()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def strip_white(c: Column) -> Column:
    """Strip space and U+0009 to U+000D at both ends."""
    return F.btrim(c, F.lit(WHITE))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def names_beside(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes to clash with none of ``columns``."""
    taken, free = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        free.append(name)
    return free
