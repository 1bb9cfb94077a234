"""Readers: each gives a stream in scan order, text fields as they are written.

Line formats are split where Spark splits files, so they scale as text does. So are CSV files but those in which a quoted value goes on over
lines, and JSON files that hold a record a line: one pass over the lines finds them, unless ``multiline`` says so. Every CSV or TSV file has its own
header. In csvlite, pprint and markdown a record's header may stand in an earlier split: a pass over the lines tells which. Yaml is read a whole
file to a task.

Field names that only the data can tell are found in one pass, in the order of first appearance; naming them
(``fields``) spares that pass.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stream import Stream, col, text_double, text_long

#: Names of separators.
SEPARATORS = {
    "comma": ",", "tab": "\t", "space": " ", "spaces": " +", "whitespace": "[ \t]+", "pipe": "|", "semicolon": ";", "colon": ":", "equals": "=", "newline": "\n", "lf": "\n", "crlf": "\r\n",
    "slash": "/", "ascii_esc": "\x1b", "ascii_null": "\x00", "asv_fs": "\x1f", "asv_rs": "\x1e", "usv_fs": "␟", "usv_rs": "␞",
}
SUFFIXES = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "dkvp": "dkvp", "nidx": "nidx", "xtab": "xtab", "md": "markdown", "yaml": "yaml", "yml": "yaml", "parquet": "parquet", "orc": "orc", "rec": "recutils", "dcf": "dcf"}


def separator(s: str | None, default: str) -> str:
    return default if s is None else SEPARATORS.get(s, s)


def _lines(spark: SparkSession, path, sep: str | None = None, comments: str | None = None, shown: str | None = None) -> DataFrame:
    """Lines in order, without those that begin with ``comments`` or ``shown``; the latter go to the standard output."""
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    if shown:
        from ..plans.sides import deliver

        told = reader.text(path).where(F.col("value").startswith(shown)).select(F.lit("stdout").alias("to"), F.concat("value", F.lit("\n")).alias("value"), F.monotonically_increasing_id().alias("_o:line"))
        deliver(Stream(told, (("_o:line", True),)), ["stdout"], "")
        comments = shown
    df = reader.text(path).withColumn("_ord", F.monotonically_increasing_id())
    return df.where(~F.col("value").startswith(comments)) if comments else df


def _stream(df: DataFrame) -> Stream:
    from ..plans.stream import HIDDEN

    names = [c for c in df.columns if c not in ("_ord", "_pos")]
    keep = [c for c in ("_ord", "_pos") if c in df.columns]
    return Stream(df.select(*map(col, names), *[F.col(c).alias(HIDDEN + c) for c in keep]), tuple((HIDDEN + c, True) for c in keep))


def _spread(df: DataFrame, pairs: Column, fields=None) -> Stream:
    """An array of (k, v) pairs as fields; a key that comes again gets _2, _3, ... behind it."""
    numbered = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda o: o["k"] == p["k"])).alias("n")))
    named = F.transform(numbered, lambda p: F.struct(F.when(p["n"] > 1, F.concat(p["k"], F.lit("_"), p["n"].cast("string"))).otherwise(p["k"]).alias("k"), p["v"].alias("v")))
    extra = [c for c in ("_ord", "_pos") if c in df.columns]
    held = df.select(named.alias("_p"), *extra)
    if fields is None:
        place = F.struct(*[F.col(c) for c in extra], F.col("i"))
        keys = held.select(*extra, F.posexplode("_p").alias("i", "p")).groupBy("p.k").agg(F.min(place).alias("o")).orderBy("o")
        fields = [r[0] for r in keys.collect()]  # the field names
    m = F.map_from_entries(F.col("_p"))
    held = held.withColumn("_m", m)
    return _stream(held.select(*[F.try_element_at("_m", F.lit(k)).alias(k) for k in fields], *extra))


def _files(spark: SparkSession, path) -> list[str]:
    """The files of a path, in the order of their names."""
    return [_plain(f) for f in sorted(spark.read.text(path).inputFiles())]


def _plain(uri: str) -> str:
    """A file's name of its address."""
    from urllib.parse import unquote

    return re.sub("^file:/+", "file:///", unquote(uri))


def _first_lines(spark: SparkSession, files: list[str], comments: str | None, quote: str | None) -> list[str | None]:
    """The first line of each file that is neither blank nor a comment (with those that a quoted value in it goes on over); a few files at a time."""
    from multiprocessing.pool import ThreadPool

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def first(name: str) -> str | None:
        path = jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(conf).open(path)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            line = lines.readLine()
            while line is not None and (not line.strip("\ufeff") or comments and line.startswith(comments)):
                line = lines.readLine()
            while line is not None and quote and line.count(quote) % 2:
                more = lines.readLine()
                if more is None:
                    break
                line += "\n" + more
            return line
        finally:
            lines.close()

    with ThreadPool(min(16, max(1, len(files)))) as pool:
        return pool.map(first, files)


def _unlike(names: list[str]) -> list[str]:
    """Names that come again get _2, _3, ... behind them."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def _runs(items: list[tuple]) -> list[tuple]:
    """``(what, file)``: what, with the files that follow each other and share it."""
    out: list[tuple] = []
    for what, f in items:
        if out and out[-1][0] == what:
            out[-1][1].append(f)
        else:
            out.append((what, [f]))
    return out


def _in_order(df: DataFrame, files: list[str]) -> DataFrame:
    if len(files) == 1:
        return df.withColumn("_ord", F.monotonically_increasing_id())
    return df.withColumn("_ord", F.col("_metadata.file_path")).withColumn("_pos", F.monotonically_increasing_id())


def _headed(spark, path, read_one, split, fields, header, comments, quote) -> Stream:
    """Files with headers: those that share one are read together, one such run after the other. ``read_one``: of names and files; ``split``: a header's names."""
    from ..operators.joins import concat

    files = _files(spark, path)
    lines = list(zip(files, _first_lines(spark, files, comments, quote)))
    told = [(tuple(split(line)) if header else tuple(str(i + 1) for i in range(len(split(line)))), f) for f, line in lines if line is not None]
    if fields and not header:
        told = [(tuple(fields), f) for _, f in told]
    parts = [read_one(_unlike(list(names)), some) for names, some in _runs(told)]
    if not parts:
        return _stream(spark.createDataFrame([], "_ord bigint"))
    return concat(*parts) if len(parts) > 1 else parts[0]


def _ragged(spark, names, files, cells, header, comments) -> Stream:
    """Records of any length: cells beyond the names stand under their places; cells that lack are absent."""
    file = F.col("_metadata.file_path")
    lines = spark.read.text(files).select("value", file.alias("_f"), F.monotonically_increasing_id().alias("_ord")).where("value <> ''")
    if comments:
        lines = lines.where(~F.col("value").startswith(comments))
    if header:
        tops = lines.groupBy("_f").agg(F.min("_ord").alias("_h"))
        lines = lines.join(tops, "_f").where("_ord <> _h")
    rows = lines.select(cells(F.col("value")).alias("c"), F.col("_f").alias("_ord"), F.col("_ord").alias("_pos"))
    most = rows.agg(F.max(F.size("c"))).first()[0] or 0
    names = [*names, *[str(i + 1) for i in range(len(names), most)]]
    return _stream(rows.select(*[F.try_element_at("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names)], "_ord", "_pos"))


def _cells(sep: str, quote: str):
    """Of a line without line ends in quotes: its cells."""
    s, k = re.escape(sep), re.escape(quote)
    cell = rf"(?:^|{s})({k}(?:[^{k}]|{k}{k})*{k}|(?:(?!{s}).)*)"

    def bare(c):
        return F.when(c.rlike(f"(?s)^{k}.*{k}$"), F.replace(F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit(quote * 2), F.lit(quote))).otherwise(c)

    return lambda value: F.transform(F.regexp_extract_all(value, F.lit(cell), F.lit(1)), bare)


def _csv(spark, path, fields=None, header=True, fs=None, ragged=False, quote='"', comments=None, multiline=None, pass_comments=None, **_):
    from ..operators.joins import concat

    if pass_comments:
        _lines(spark, path, shown=pass_comments)
        comments = pass_comments

    sep = separator(fs, ",")

    def read_some(names, files, multi) -> Stream:
        reader = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("sep", sep).option("quote", quote).option("escape", quote).option("multiLine", multi)
        reader = reader.option("header", header).option("nullValue", "\u0001").option("emptyValue", "").option("mode", "FAILFAST").option("enforceSchema", True)
        reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        if comments:
            reader = reader.option("comment", comments)
        df = _in_order(reader.csv(files), files)
        # every row has every field: what stands empty in the file is empty, not absent
        return _stream(df.select(*[F.coalesce(col(c), F.lit("")).alias(c) for c in names], *[c for c in ("_ord", "_pos") if c in df.columns]))

    def read_one(names, files) -> Stream:
        if ragged or comments and len(comments) > 1:
            return _ragged(spark, names, files, _cells(sep, quote), header, comments)
        if multiline is not None:
            return read_some(names, files, multiline)
        odd = F.pmod(F.char_length("value") - F.char_length(F.replace("value", F.lit(quote), F.lit(""))), F.lit(2)) == 1
        whole = {r[0] for r in spark.read.text(files).select("value", F.col("_metadata.file_path").alias("f")).where(odd).select("f").distinct().collect()}  # names of files
        whole = set(map(_plain, whole))
        parts = [read_some(names, some, multi) for multi, some in _runs([(f in whole, f) for f in files])]
        return concat(*parts) if len(parts) > 1 else parts[0]

    return _headed(spark, path, read_one, lambda line: _split_csv(line, sep, quote), fields, header, comments, quote)


def _split_csv(line: str, sep: str, quote: str = '"') -> list[str]:
    if len(sep) > 1:
        return line.lstrip("\ufeff").split(sep)
    import csv

    return next(csv.reader([line.lstrip("\ufeff")], delimiter=sep, quotechar=quote))


def _tsv(spark, path, fields=None, header=True, comments=None, ragged=False, **_):
    def read_one(names, files) -> Stream:
        if ragged or comments and len(comments) > 1:
            return _ragged(spark, names, files, lambda value: F.transform(F.split(value, "\t", -1), _untsv), header, comments)
        reader = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("sep", "\t").option("quote", "").option("header", header).option("nullValue", "\u0001")
        reader = reader.option("emptyValue", "").option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        if comments:
            reader = reader.option("comment", comments)
        df = _in_order(reader.csv(files), files)
        return _stream(df.select(*[_untsv(F.coalesce(col(c), F.lit(""))).alias(c) for c in names], *[c for c in ("_ord", "_pos") if c in df.columns]))

    def split(line: str) -> list[str]:
        return [re.sub(r"\\([tn\\])", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), c) for c in line.lstrip("\ufeff").split("\t")]

    return _headed(spark, path, read_one, split, fields, header, comments, None)


def _untsv(c: Column) -> Column:
    mark = "\u0001"
    c = F.replace(c, F.lit("\\\\"), F.lit(mark))
    c = F.replace(F.replace(c, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))
    return F.replace(c, F.lit(mark), F.lit("\\"))


def _json(spark, path, multiline=None, schema=None, **_):
    if multiline is None:  # unless every line is a record
        value = F.trim("value")
        multiline = not spark.read.text(path).where((value != "") & ~value.rlike(r"^\{.*\}$")).isEmpty()
    reader = spark.read.option("multiLine", multiline)
    df = (reader.schema(schema) if schema else reader).json(path)
    return _stream(df.withColumn("_ord", F.monotonically_increasing_id()))


def _pairs(parts: Column, ps: str) -> Column:
    """``k=v`` texts as pairs; one without the separator stands under its place."""
    n = len(ps)
    return F.transform(parts, lambda p, i: F.struct(
        F.when(F.instr(p, ps) > 0, F.substring_index(p, ps, 1)).otherwise((i + 1).cast("string")).alias("k"),
        F.when(F.instr(p, ps) > 0, F.substring(p, F.instr(p, ps) + n, F.char_length(p))).otherwise(p).alias("v"),
    ))


def _dkvp(spark, path, fields=None, fs=None, ps=None, comments=None, pass_comments=None, rs=None, fs_regex=None, ps_regex=None, repeated=False, **_):
    lines = _lines(spark, path, separator(rs, "\n") if rs else None, comments, pass_comments).where("value <> ''")
    parts = F.split("value", fs_regex or re.escape(separator(fs, ",")) + "+" * repeated, -1)
    if ps_regex:  # the first match stands for the separator
        parts = F.transform(parts, lambda p: F.when(p.rlike(ps_regex), F.array_join(F.split(p, ps_regex, 2), "\u0001")).otherwise(p))
    return _spread(lines, _pairs(parts, "\u0001" if ps_regex else separator(ps, "=")), fields)


def _quoted(spark, path, fields=None, fs=None, ps=None, **_):
    """DKVP with CSV quotes: separators within quotes do not count."""
    sep, eq = separator(fs, ","), separator(ps, "=")
    lines = _lines(spark, path).where("value <> ''")
    cell = rf'(?:"(?:[^"]|"")*"|[^"{re.escape(sep)}])+'
    parts = F.regexp_extract_all("value", F.lit(cell), F.lit(0))
    bare = lambda c: F.when(c.startswith('"') & c.endswith('"'), F.replace(F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    pairs = F.transform(_pairs(parts, eq), lambda p: F.struct(bare(p["k"]).alias("k"), bare(p["v"]).alias("v")))
    return _spread(lines, pairs, fields)


def _nidx(spark, path, fields=None, fs=None, comments=None, pass_comments=None, rs=None, fs_regex=None, **_):
    lines = _lines(spark, path, separator(rs, "\n") if rs else None, comments, pass_comments).where("value <> ''")
    sep = separator(fs, " ")
    parts = F.filter(F.split("value", fs_regex if fs_regex else re.escape(sep) + "+" if len(sep) == 1 else sep), lambda p: p != "")
    n = len(fields) if fields else lines.select(F.max(F.size(parts))).first()[0] or 0
    return _stream(lines.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(fields[i] if fields else str(i + 1)) for i in range(n)], "_ord"))


def _xtab(spark, path, fields=None, ps=None, **_):
    blocks = _lines(spark, path, "\n\n").where("trim(BOTH '\n' FROM value) <> ''")
    lines = F.filter(F.split("value", "\n"), lambda p: p != "")
    gap = "[ \t]+" if ps is None else re.escape(separator(ps, " ")) + "+"
    pairs = F.transform(lines, lambda p: F.struct(F.element_at(F.split(p, gap, 2), 1).alias("k"), F.coalesce(F.try_element_at(F.split(p, gap, 2), F.lit(2)), F.lit("")).alias("v")))
    return _spread(blocks, pairs, fields)


def _dcf(spark, path, fields=None, **_):
    blocks = _lines(spark, path, "\n\n").where("trim(BOTH '\n' FROM value) <> ''")
    joined = F.regexp_replace("value", "\n[ \t]+", " ")
    lines = F.filter(F.split(joined, "\n"), lambda p: p.contains(":"))
    pairs = F.transform(lines, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.trim(F.substring(p, F.instr(p, ":") + 1, F.char_length(p))).alias("v")))
    return _spread(blocks, pairs, fields)


def _recutils(spark, path, fields=None, **_):
    blocks = _lines(spark, path, "\n\n").where("trim(BOTH '\n' FROM value) <> ''")
    joined = F.regexp_replace(F.regexp_replace("value", r"\\\n", ""), "\n\\+ ?", "\u0001")
    lines = F.filter(F.split(joined, "\n"), lambda p: p.contains(":") & ~p.startswith("#") & ~p.startswith("%"))
    value = lambda p: F.replace(F.regexp_replace(F.substring(p, F.instr(p, ":") + 1, F.char_length(p)), "^ ", ""), F.lit("\u0001"), F.lit("\n"))
    pairs = F.transform(lines, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), value(p).alias("v")))
    return _spread(blocks.where(F.size(lines) > 0), pairs, fields)


def _splits(batches):
    """``(split, rows)``: the batches' rows, apart where the split of a file that they come from changes."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts, files = batch.column("_b").to_numpy(), batch.column("_f")
        cuts = np.flatnonzero((starts[1:] != starts[:-1]) | np.not_equal(*(files.slice(k, n - 1).to_numpy(zero_copy_only=False) for k in (0, 1)))) + 1
        for lo, hi in zip([0, *cuts], [*cuts, n]):
            yield (files[int(lo)].as_py(), int(starts[lo])), batch.slice(lo, hi - lo)


def _split_ends(batches):
    """Of each split: whether it holds a blank line, and the first line after the last one (or of all)."""
    import numpy as np
    import pyarrow as pa

    at, blank, line = None, False, None
    schema = pa.schema([("_f", pa.string()), ("_b", pa.int64()), ("blank", pa.bool_()), ("line", pa.string())])
    told = lambda: pa.RecordBatch.from_pylist([{"_f": at[0], "_b": at[1], "blank": blank, "line": line}], schema=schema)
    for key, rows in _splits(batches):
        if at is not None and key != at:
            yield told()
        if key != at:
            at, blank, line = key, False, None
        none = rows.column("blank").to_numpy(zero_copy_only=False)
        since = 0
        if none.any():
            since = int(np.flatnonzero(none)[-1]) + 1
            blank, line = True, None
        if line is None and since < rows.num_rows:
            line = rows.column("value")[since].as_py()
    if at is not None:
        yield told()


def _under_headers(batches, starts: dict):
    """Lines with the header above them. ``starts``: the header that holds where a split begins; None where the next line is one."""
    import numpy as np
    import pyarrow as pa

    at = header = None
    for key, rows in _splits(batches):
        if key != at:
            at, header = key, starts[key]
            above = header is None  # whether what stands above is no line
        none = rows.column("blank").to_numpy(zero_copy_only=False)
        top = ~none & np.concatenate([[above], none[:-1]])
        heads = pa.array([header, *rows.column("value").filter(pa.array(top)).to_pylist()], pa.string())
        kept = ~none & ~top
        h = heads.take(pa.array(np.cumsum(top)[kept]))
        header, above = heads[-1].as_py(), bool(none[-1])
        out = rows.filter(pa.array(kept))
        yield pa.RecordBatch.from_arrays([out.column("_f"), out.column("_b"), out.column("_i"), h, out.column("value")], ["_f", "_b", "_i", "h", "value"])


def _stanzas(spark, path, cells, fields=None, skip: str | None = None) -> Stream:
    """Stanzas apart by blank lines, each with its header line, split where Spark splits files. ``cells``: of a line, its cells.

    One pass tells, in a small row for each split, which header holds where the next one begins."""
    value = F.regexp_replace("value", r"\r\z", "")
    lines = spark.read.option("lineSep", "\n").text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    if skip:
        lines = lines.where(~F.col("value").rlike(skip))
    lines = _as_dealt(lines.select(F.col("value").rlike(r"^[ \t]*$").alias("blank"), "value", "_f", "_b", "_i"))
    ends = lines.mapInArrow(_split_ends, "_f string, _b bigint, blank boolean, line string").collect()  # a row for each split
    starts, file, header = {}, None, None
    for f, b, blank, line in sorted(ends, key=lambda r: r[:2]):
        if f != file:
            file, header = f, None
        starts[f, b] = header
        header = line if blank or header is None else header
    rows = lines.mapInArrow(functools.partial(_under_headers, starts=starts), "_f string, _b bigint, _i bigint, h string, value string")
    rows = rows.select(F.col("_f").alias("_ord"), F.struct("_b", "_i").alias("_pos"), "h", cells(F.col("value")).alias("c"))
    name = lambda i: F.coalesce(F.try_element_at("h", i + 1), (i + 1).cast("string"))
    if fields is None:  # of each header and number of cells, the names
        tops = rows.groupBy("h", F.size("c").alias("n")).agg(F.min(F.struct("_ord", "_pos")).alias("_ord")).select(cells(F.col("h")).alias("h"), "n", "_ord")
        fields = _spread(tops.select(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(name(i).alias("k"), F.lit("").alias("v"))).alias("p"), "_ord"), F.col("p")).columns
    held = rows.select(cells(F.col("h")).alias("h"), "c", "_ord", "_pos").select(F.transform("c", lambda v, i: F.struct(name(i).alias("k"), v.alias("v"))).alias("p"), "_ord", "_pos")
    return _spread(held, F.col("p"), fields)


def _as_dealt(df: DataFrame) -> DataFrame:
    """The rows in partitions that stay the same in every job; else splits could change with the cores at hand."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def _csvlite(spark, path, fields=None, fs=None, **_):
    sep = separator(fs, ",")
    cell = rf'(?:^|{re.escape(sep)})("(?:[^"]|"")*"|[^{re.escape(sep)}]*)'
    bare = lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return _stanzas(spark, path, lambda p: F.transform(F.regexp_extract_all(p, F.lit(cell), F.lit(1)), bare), fields)


def _pprint(spark, path, fields=None, **_):
    def cells(p):
        inner = F.regexp_replace(p, r"^\| *| *\|$", "")
        return F.transform(F.when(p.startswith("|"), F.split(inner, r" *\| *")).otherwise(F.split(F.trim(p), " +")), lambda c: F.when(c == "-", F.lit("")).otherwise(c))

    return _stanzas(spark, path, cells, fields, r"^\+[-+]+\+$")


def _markdown(spark, path, fields=None, **_):
    return _stanzas(spark, path, lambda p: F.split(F.regexp_replace(p, r"^\| *| *\| *$", ""), r" *\| *"), fields, r"^\|[ :|-]+\|\s*$")


def _yaml(spark, path, fields=None, **_):
    """Documents or a list of flat maps: ``key: value`` lines, apart by ``---`` or a dash."""
    files = spark.read.text(path, wholetext=True).withColumn("_ord", F.monotonically_increasing_id())
    docs = files.select("_ord", F.posexplode(F.split(F.regexp_replace("value", r"(?m)^- ", "---\n"), r"(?m)^---\s*$")).alias("_pos", "text"))
    lines = F.filter(F.split("text", "\n"), lambda p: p.rlike(r"^\s*[^#\s][^:]*:(\s|$)"))
    unquote = lambda c: F.regexp_replace(c, r"""^(["'])(.*)\1$""", "$2")
    pairs = F.transform(lines, lambda p: F.struct(unquote(F.trim(F.substring_index(p, ":", 1))).alias("k"), unquote(F.trim(F.substring(p, F.instr(p, ":") + 1, F.char_length(p)))).alias("v")))
    return _spread(docs.where(F.size(lines) > 0), pairs, fields)


def _fixed(spark, path, fields=None, widths=None, **_):
    """Fixed-width columns: ``fields`` and their ``widths``."""
    lines = _lines(spark, path)
    out, at = [], 1
    for n, w in zip(fields, widths):
        out.append(F.trim(F.substring("value", at, w)).alias(n))
        at += w
    return _stream(lines.select(*out, "_ord"))


def _gen(spark, path, field="i", start=1, stop=100, step=1, **_):
    """Numbers instead of a file."""
    from ..operators.reshape import seqgen

    return seqgen(spark, field, start, stop, step)


def _columnar(kind):
    def read_it(spark, path, **_):
        return _stream(getattr(spark.read, kind)(path).withColumn("_ord", F.monotonically_increasing_id()))

    return read_it


READERS = {
    "csv": _csv, "csvlite": _csvlite, "tsv": _tsv, "json": _json, "jsonl": lambda spark, path, **k: _json(spark, path, multiline=False, **k), "dkvp": _dkvp, "dkvpx": _quoted, "nidx": _nidx, "xtab": _xtab,
    "pprint": _pprint, "markdown": _markdown, "dcf": _dcf, "recutils": _recutils, "yaml": _yaml, "fixed": _fixed, "gen": _gen, "parquet": _columnar("parquet"), "orc": _columnar("orc"),
    "asv": lambda spark, path, **k: _records(spark, path, "\x1f", "\x1e"), "usv": lambda spark, path, **k: _records(spark, path, "␟", "␞"),
}


def _records(spark, path, fs: str, rs: str) -> Stream:
    lines = _lines(spark, path, rs).where(F.trim(F.regexp_replace("value", "\n", "")) != "")
    cells = F.split(F.regexp_replace("value", "^\n", ""), re.escape(fs), -1)
    top = lines.orderBy("_ord").select(cells, "_ord").first()
    return _stream(lines.where(F.col("_ord") != top[1]).select(*[F.try_element_at(cells, F.lit(i + 1)).alias(n) for i, n in enumerate(top[0])], "_ord"))


def read(spark: SparkSession, path, fmt: str | None = None, infer: bool = False, **options) -> Stream:
    """A stream of one or several paths (one after the other); the format by name, or by the path's suffix (behind that of a codec)."""
    first = path if isinstance(path, str) else path[0]
    if fmt is None:
        parts = [p for p in first.rstrip("/").lower().split(".")[1:] if p not in ("gz", "bz2", "zst", "z")]
        fmt = SUFFIXES.get(parts[-1] if parts else "", "dkvp")
    if fmt not in READERS:
        raise ValueError(f"no format {fmt}")
    if isinstance(path, (list, tuple)) and len(path) > 1:
        from ..operators.joins import concat

        s = concat(*[READERS[fmt](spark, p, **options) for p in path])
    else:
        s = READERS[fmt](spark, first, **options)
    return typed(s) if infer else s


def typed(s: Stream, but=()) -> Stream:
    """Text fields (but those named) of which every value that is not empty is a number become numbers (empty ones then NULL): one pass over the data."""
    texts = [c for c in s.columns if isinstance(s.dtype(c), T.StringType) and c not in but]
    if not texts:
        return s
    asked = []
    for i, c in enumerate(texts):
        given = F.coalesce(col(c) != "", F.lit(False))
        asked += [F.count_if(given).alias(f"n{i}"), F.count_if(given & text_long(col(c)).isNotNull()).alias(f"i{i}"), F.count_if(given & text_double(col(c)).isNotNull()).alias(f"d{i}")]
    got = s.df.agg(*asked).first()
    new = {}
    for i, c in enumerate(texts):
        n = got[f"n{i}"]
        if n and got[f"i{i}"] == n:
            new[c] = text_long(col(c))
        elif n and got[f"d{i}"] == n:
            new[c] = text_double(col(c))
    return s.with_columns(new)
