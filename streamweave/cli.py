"""Command lines: format flags, a chain of verbs, files.

``python -m streamweave --icsv --opprint sort -nr price then head -n 4 orders.csv``
"""

from __future__ import annotations

import os
import shlex
import sys

from .operators.programs import preloaded
from .operators.registry import VERBS, parse
from .plans.chain import chain
from .plans.sides import taken
from .sources.readers import read
from .sources.writers import text_of, write

FORMATS = {
    "csv": "csv", "csvlite": "csvlite", "tsv": "tsv", "tsvlite": "tsv", "json": "json", "jsonl": "jsonl", "dkvp": "dkvp", "dkvpx": "dkvpx", "nidx": "nidx", "xtab": "xtab", "pprint": "pprint", "markdown": "markdown", "md": "markdown", "yaml": "yaml",
    "dcf": "dcf", "recutils": "recutils", "rec": "recutils", "asv": "asv", "usv": "usv", "parquet": "parquet", "orc": "orc",
}
#: Letters of the two-letter format pairs, as in --c2j. Fixed values.
LETTERS = {"c": "csv", "t": "tsv", "j": "json", "l": "jsonl", "d": "dkvp", "n": "nidx", "x": "xtab", "p": "pprint", "b": "barred", "m": "markdown", "y": "yaml"}
#: Flags with a value: the option, and whether it is for reading, writing or both.
VALUED = {
    "--ifs": ("fs", "i"), "--ofs": ("fs", "o"), "--fs": ("fs", "io"), "--ips": ("ps", "i"), "--ops": ("ps", "o"), "--ps": ("ps", "io"), "--ofmt": ("ofmt", "o"), "--skip-comments-with": ("comments", "i"),
    "--irs": ("rs", "i"), "--rs": ("rs", "i"), "--ifs-regex": ("fs_regex", "i"), "--ips-regex": ("ps_regex", "i"), "--pass-comments-with": ("pass_comments", "i"),
}
SWITCHES = {
    "--implicit-csv-header": ("header", False, "i"), "--hi": ("header", False, "i"), "--headerless-csv-input": ("header", False, "i"), "--headerless-csv-output": ("header", False, "o"), "--ho": ("header", False, "o"), "--allow-ragged-csv-input": ("ragged", True, "i"),
    "--pass-comments": ("pass_comments", "#", "i"), "--repifs": ("repeated", True, "i"), "--lazy-quotes": ("lazy", True, "i"),
    "--ragged": ("ragged", True, "i"), "--quote-all": ("quote_all", True, "o"), "--barred": ("barred", True, "o"), "--barred-output": ("barred", True, "o"), "--right": ("right", True, "o"), "--skip-comments": ("comments", "#", "i"),
}
#: Accepted and without effect here: codecs go by suffix, inference is a choice of its own. Fixed values.
IGNORED = {"--gzin", "--bz2in", "--zstdin", "--no-color", "-M", "--always-color", "-C", "--mmap", "--no-mmap", "--no-fflush", "--fflush", "--no-auto-unflatten", "--infer-none", "-S", "--barred-input", "--jvstack", "--no-jvstack", "--jlistwrap", "--no-jlistwrap", "--infer-octal", "--infer-int-as-float", "--hash-records", "--no-hash-records", "-O", "-A", "--no-fsync", "--no-implicit-csv-header", "--csvlite-allow-ragged", "--quote-original", "--no-dedupe-field-names", "--dedupe-field-names"}
#: Accepted with a value that has no meaning here. Fixed values.
IGNORED_VALUED = {"--nr-progress-mod", "--records-per-batch", "--ors", "--key-color", "--value-color", "--pass-color", "--fail-color", "--help-color"}


def arguments(words: list[str]) -> dict:
    """What a command line asks for: formats, options, the chain's words, paths."""
    got = {"ifmt": None, "ofmt": None, "i": {}, "o": {}, "paths": [], "none": False, "out": None, "load": [], "flatsep": ".", "flatten": True, "in_place": False}
    if len(words) > 1 and words[0] == "-s":  # the first line of a file stands in front
        with open(words[1]) as f:
            words = [*shlex.split(f.readline()), *words[2:]]
        words = words[1:] if words and not words[0].startswith("-") and words[0] not in VERBS else words
    k = 0
    while k < len(words) and words[k].startswith("-"):
        w = words[k]
        name = w.lstrip("-")
        pair = name if len(name) == 3 and name[1] == "2" and w.startswith("--") else None
        if w in VALUED:
            option, sides = VALUED[w]
            k += 1
            for side in sides:
                got[side][option] = words[k]
        elif w in SWITCHES:
            option, value, sides = SWITCHES[w]
            for side in sides:
                got[side][option] = value
        elif w in ("--from", "--mfrom"):
            k += 1
            if w == "--from":
                got["paths"].append(words[k])
            else:
                while words[k] != "--":
                    got["paths"].append(words[k])
                    k += 1
        elif w in ("-i", "-o", "--io", "--to"):
            k += 1
            if w == "--to":
                got["out"] = words[k]
            else:
                got |= {"ifmt": FORMATS[words[k]]} if w != "-o" else {}
                got |= {"ofmt": FORMATS[words[k]]} if w != "-i" else {}
        elif w in ("--tz", "--load", "--mload", "--flatsep", "--oflatsep", "--jflatsep"):
            k += 1
            if w == "--tz":
                os.environ["TZ"] = words[k]
            elif w == "--load":
                got["load"].append(words[k])
            elif w == "--mload":
                while words[k] != "--":
                    got["load"].append(words[k])
                    k += 1
            else:
                got["flatsep"] = words[k]
        elif w in IGNORED_VALUED:
            k += 1
        elif w == "-I":
            got["in_place"] = True
        elif w == "-n":
            got["none"] = True
        elif w == "-N":
            got["i"]["header"] = got["o"]["header"] = False
        elif pair and pair[0] in LETTERS and pair[2] in LETTERS:
            got["ifmt"], got["ofmt"] = LETTERS[pair[0]], LETTERS[pair[2]]
            if got["ofmt"] == "barred":
                got["ofmt"], got["o"]["barred"] = "pprint", True
        elif name in FORMATS:
            got["ifmt"] = got["ofmt"] = FORMATS[name]
        elif name[:1] in "io" and name[1:] in FORMATS:
            got["ifmt" if name[0] == "i" else "ofmt"] = FORMATS[name[1:]]
        elif w == "--no-auto-flatten":
            got["flatten"] = False
        elif w not in IGNORED:
            raise ValueError(f"no option {w}")
        k += 1
    links, k = _links(words, k)
    got["links"] = links
    got["paths"] = words[k:] or got["paths"]
    return got


def _links(words: list[str], k: int) -> tuple[list[str], int]:
    """The words of the chain, and where the paths begin: behind the last verb's own words."""
    begin = k
    while True:
        if k >= len(words) or words[k] not in VERBS:
            raise ValueError("there is no verb" if k >= len(words) else f"no verb {words[k]}")
        start = k
        ends = [j for j in range(start + 1, len(words)) if words[j] == "then"]
        if ends:
            k = ends[0] + 1
            continue
        # the longest stretch that the verb takes, taking one word after the other
        stop = start + 1
        verb = VERBS[words[start]]
        while stop < len(words) and words[stop].startswith("-") and words[stop] in verb.flags:
            stop += 1 if verb.flags[words[stop]][1] == "true" or verb.flags[words[stop]][1].startswith("is-") else 2
        if verb.positional and not (verb.positional == "text" and any(x in words[start:stop] for x in ("-f", "-e"))):
            stop += 2 if verb.positional == "args" else 1
        parse(words[start:stop])
        return words[begin:stop], stop


def result(spark, got: dict, paths: list[str]):
    """The records that a command line gives for some paths, and their format."""
    if got["none"] or not paths:
        s = read(spark, "", "gen", start=1, stop=0)
    else:
        s = read(spark, paths if len(paths) > 1 else paths[0], got["ifmt"], **got["i"])
    with preloaded(got["load"]):
        s = chain(s, got["links"])
    fmt = got["ofmt"] or got["ifmt"] or "dkvp"
    if fmt in ("json", "jsonl"):
        got["o"]["infer"] = True
    elif got["flatten"]:
        s = chain(s, ["flatten", "-s", got["flatsep"]])  # nested fields are spread where a format has no nesting
    return s, fmt


def main(words: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    got = arguments(list(sys.argv[1:] if words is None else words))
    spark = SparkSession.builder.appName("streamweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if got["in_place"]:
        for path in got["paths"]:
            s, fmt = result(spark, got, [path])
            text = text_of(s, fmt, **got["o"])
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        return 0
    s, fmt = result(spark, got, got["paths"])
    for to, text in taken():
        (sys.stderr if to == "stderr" else sys.stdout).write(text)
    if got["out"]:
        write(s, got["out"], fmt, **got["o"])
    else:
        sys.stdout.write(text_of(s, fmt, **got["o"]))
    return 0
