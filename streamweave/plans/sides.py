"""What a program writes beside its records: lines for the standard outputs, held until they are taken, and lines for files.

A side is a stream of ``to`` (stdout, stderr, or a file's name) and ``value`` (text, with its line end if it has one). Files are folders of part
files: one that the program names outright has that name; those that the records name stand below ``folder`` as ``to=<name>``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .stream import Stream

STANDARD = ("stdout", "stderr")
_HELD: list[Stream] = []


def deliver(side: Stream, named: list[str] | None, folder: str, append: bool = False) -> None:
    """Hold the lines for the standard outputs and write the others. ``named``: the names, where the program tells them."""
    if named is None or set(named) & set(STANDARD):
        _HELD.append(side.where(F.col("to").isin(*STANDARD)))
    body = side.df.where(F.col("value").isNotNull()).orderBy(*side.by()).select(F.regexp_replace("value", "\n$", "").alias("value"), "to")
    mode = "append" if append else "overwrite"
    if named is None:
        files = body.where(~F.col("to").isin(*STANDARD))
        if not files.isEmpty():
            files.repartition("to").sortWithinPartitions("to").write.mode(mode).partitionBy("to").text(folder)
        return
    for name in dict.fromkeys(named):
        if name not in STANDARD:
            body.where(F.col("to") == name).select("value").write.mode(mode).text(name)


def taken() -> list[tuple[str, str]]:
    """(output, text) of all lines for the standard outputs since they were last taken, in order."""
    out = [(r["to"], r["value"]) for side in _HELD for r in side.df.orderBy(*side.by()).select("to", "value").collect()]
    _HELD.clear()
    return out
