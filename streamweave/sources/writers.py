"""Writers: a stream as lines of text, written by the tasks that hold them; columnar formats as they are.

Absent fields (NULL) leave no ``k=v``; in formats with one header they are written empty. Order holds within and
across part files, whose names follow it.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stream import Stream, col, text_double
from .readers import SUFFIXES, separator


def as_text(c: Column, t: T.DataType, ofmt: str | None = None) -> Column:
    """A value as text; doubles that are whole numbers keep no exponent below 2**53; ``ofmt``: a printf format for doubles."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        if ofmt:
            return F.format_string(ofmt, c.cast("double"))
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def _texts(s: Stream, ofmt=None) -> list[tuple[str, Column]]:
    return [(c, as_text(col(c), s.dtype(c), ofmt)) for c in s.columns]


def _csv_cell(c: Column, sep: str, always: bool = False) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if always else F.when(c.contains(sep) | c.contains('"') | c.contains("\n") | c.contains("\r") | c.rlike(r"^\s|\s$"), quoted).otherwise(c)


def _tsv_cell(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def _json_text(s: Stream) -> Column:
    """A record as JSON, with numbers for texts that write them."""

    def bare(c: Column) -> Column:
        one = F.to_json(F.array(c))
        return F.substring(one, F.lit(2), F.char_length(one) - 2)

    cells = []
    for n in s.columns:
        c, t = col(n), s.dtype(n)
        shown = F.when(text_double(c).isNotNull() & ~F.lower(c).rlike("inf|nan"), c).otherwise(bare(c)) if isinstance(t, T.StringType) else as_text(c, t) if isinstance(t, (T.DoubleType, T.FloatType)) else bare(c)
        cells.append(F.when(c.isNotNull(), F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), shown)))
    return F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))


def lines(s: Stream, fmt: str, fs=None, ps=None, ofmt=None, header=True, quote_all=False, barred=False, right=False, infer=False) -> tuple[str | None, Column]:
    """The header (if the format has one) and each record's text. ``infer``: texts that write numbers are numbers in JSON."""
    texts = _texts(s, ofmt)
    names = [n for n, _ in texts]
    none = F.lit("")
    if fmt in ("csv", "csvlite"):
        sep = separator(fs, ",")
        top = sep.join(f'"{n}"' if quote_all or any(x in n for x in (sep, '"', "\n")) else n for n in names)
        return top if header else None, F.concat_ws(sep, *[F.coalesce(_csv_cell(c, sep, quote_all), none) for _, c in texts])
    if fmt in ("tsv", "asv", "usv"):
        sep = {"tsv": "\t", "asv": "\x1f", "usv": "␟"}[fmt]
        cell = _tsv_cell if fmt == "tsv" else (lambda c: c)
        return sep.join(names) if header else None, F.concat_ws(sep, *[F.coalesce(cell(c), none) for _, c in texts])
    if fmt in ("json", "jsonl"):
        return None, F.to_json(F.struct(*map(col, names))) if not infer else _json_text(s)
    if fmt in ("dkvp", "dkvpx"):
        sep, eq = separator(fs, ","), separator(ps, "=")
        cell = (lambda c: _csv_cell(c, sep)) if fmt == "dkvpx" else (lambda c: c)
        return None, F.concat_ws(sep, *[F.concat(F.lit(n + eq), cell(c)) for n, c in texts])
    if fmt == "nidx":
        return None, F.concat_ws(separator(fs, " "), *[c for _, c in texts])
    if fmt == "markdown":
        top = "| " + " | ".join(names) + " |\n| " + " | ".join("---" for _ in names) + " |"
        return top, F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(c, F.lit("|"), F.lit("\\|")), none) for _, c in texts]), F.lit(" |"))
    if fmt == "xtab":
        wide = max(map(len, names), default=0)
        return None, F.concat(F.concat_ws("\n", *[F.concat(F.lit(n.ljust(wide + 1)), c) for n, c in texts]), F.lit("\n"))
    if fmt in ("dcf", "recutils"):
        cont = "\n " if fmt == "dcf" else "\n+ "
        return None, F.concat(F.concat_ws("\n", *[F.concat(F.lit(n + ": "), F.replace(c, F.lit("\n"), F.lit(cont))) for n, c in texts]), F.lit("\n"))
    if fmt == "yaml":
        return None, F.concat(F.lit("---\n"), F.concat_ws("\n", *[F.concat(F.lit(n + ": "), F.when(c.rlike(r"[:#{}\[\]\"'\n]|^\s|\s$|^$"), F.to_json(F.array(c)).substr(F.lit(2), F.char_length(F.to_json(F.array(c))) - 2)).otherwise(c)) for n, c in texts]))
    if fmt == "pprint":
        shown = [(n, F.when(c == "", F.lit("-")).otherwise(F.coalesce(c, F.lit("-")))) for n, c in texts]
        got = s.df.agg(*[F.max(F.char_length(c)) for _, c in shown]).first() if shown else []
        widths = [max(len(n), w or 0) for (n, _), w in zip(shown, got)]
        pad = (lambda c, w: F.lpad(c, w, " ")) if right else (lambda c, w: F.rpad(c, w, " "))
        cells = [pad(c, w) for (_, c), w in zip(shown, widths)]
        heads = [n.rjust(w) if right else n.ljust(w) for n, w in zip(names, widths)]
        if barred:
            rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
            return f"{rule}\n| {' | '.join(heads)} |\n{rule}", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        return " ".join(heads).rstrip(), F.rtrim(F.concat_ws(" ", *cells))
    raise ValueError(f"no format {fmt}")


def render(s: Stream, fmt: str, **options) -> DataFrame:
    """The records' texts in order, one column ``value``; a header is the first row."""
    top, value = lines(s, fmt, **options)
    df = s.df.select(value.alias("value"), F.lit(1).alias("_h"), *map(col, s.hidden))
    if top is not None:
        head = s.df.sparkSession.createDataFrame([(top, 0)], "value string, _h int").select("value", "_h", *[F.lit(None).cast(s.df.schema[c].dataType).alias(c) for c in s.hidden])
        df = df.unionByName(head)
    return df.orderBy("_h", *s.by()).select("value")


def text_of(s: Stream, fmt: str, **options) -> str:
    """A small stream's whole text, at the driver."""
    out = [r[0] for r in render(s, fmt, **options).collect()]
    if fmt == "json":
        return "[\n" + ",\n".join(out) + "\n]\n"
    return "\n".join(out) + "\n" * bool(out)


def write(s: Stream, path: str, fmt: str | None = None, mode: str = "overwrite", by=(), compression=None, **options) -> None:
    """Write to a folder of part files; ``by``: fields whose values name subfolders."""
    if fmt is None:
        fmt = SUFFIXES.get(path.rstrip("/").lower().rsplit(".", 1)[-1], "dkvp")
    by = list(by)
    if fmt in ("parquet", "orc"):
        w = (s.df.select(*map(col, s.columns)) if by else s.sorted()).write.mode(mode)
        (w.partitionBy(*by) if by else w).format(fmt).save(path)
        return
    body = s.select([c for c in s.columns if c not in by]) if by else s
    top, value = lines(body, fmt, **options)
    df = s.df.select(value.alias("value"), *map(col, by), *map(col, s.hidden))
    if by:
        df = df.repartition(*map(col, by)).sortWithinPartitions(*map(col, by), *s.by())
    elif s.order and not s.as_scanned():
        df = df.orderBy(*s.by())
    df = df.select("value", *map(col, by))
    if top is not None:
        # each part file carries the header, as Spark's own CSV files do
        df = df.mapInArrow(functools.partial(_headed, top=top, keys=by), df.schema)
    w = df.write.mode(mode)
    if fmt in ("asv", "usv"):
        w = w.option("lineSep", "\x1e" if fmt == "asv" else "␞")
    if compression:
        w = w.option("compression", compression)
    (w.partitionBy(*by) if by else w).text(path)


def _headed(batches, top: str, keys: list[str]):
    """A header before the first row of each task, or of each key of a task."""
    import pyarrow as pa

    last = None
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            k = tuple(r[c] for c in keys)
            if last is None or k != last:
                out.append({**r, "value": top})
            last = k
            out.append(r)
        yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
