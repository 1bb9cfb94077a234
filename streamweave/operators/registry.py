"""The table of verbs: a function of (stream, options) each, and how its options are written in a chain."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

VERBS: dict[str, Verb] = {}


@dataclasses.dataclass(frozen=True)
class Verb:
    name: str
    run: Callable
    #: flag -> (keyword, kind, value)
    flags: dict[str, tuple[str, str, object]]
    positional: str = ""


_KINDS = {"int": int, "float": float, "str": str, "list": lambda v: v.split(","), "num": lambda v: float(v) if any(x in v for x in ".eE") else int(v)}


def verb(name: str, flags: str = "", positional: str = ""):
    """Register a verb. ``flags``: words ``-n=n:int`` (a value) or ``-b=keep:true`` (a switch); several names with ``|``.

    ``positional``: the keyword that takes what follows the flags (``names``: one comma-separated word).
    """
    table = {}
    for word in flags.split():
        names, _, rest = word.partition("=")
        key, _, kind = rest.partition(":")
        for n in names.split("|"):
            table[n] = (key, kind, None)

    def add(f):
        VERBS[name] = Verb(name, f, table, positional)
        return f

    return add


def parse(words: list[str]) -> tuple[Verb, dict]:
    """A verb and its keyword arguments from the words of one link of a chain."""
    if not words or words[0] not in VERBS:
        raise ValueError(f"no verb {words[0] if words else ''!r}")
    v, options, i = VERBS[words[0]], {}, 1
    while i < len(words) and words[i].startswith("-") and len(words[i]) > 1:
        flag = words[i]
        if flag not in v.flags:
            if v.name in ("sec2gmt",) and flag[1:].isdigit():
                options["decimals"] = int(flag[1:])
                i += 1
                continue
            if v.positional:
                break
            raise ValueError(f"{v.name} has no option {flag}")
        key, kind, _ = v.flags[flag]
        if kind == "true":
            options[key] = True
        elif kind.startswith("is-"):
            options[key] = kind[3:]
        else:
            i += 1
            if i >= len(words):
                raise ValueError(f"{v.name} {flag} needs a value")
            if kind.startswith("sort-"):
                options.setdefault(key, []).extend((f, kind[5:]) for f in words[i].split(","))
            else:
                options[key] = _KINDS[kind](words[i])
        i += 1
    rest = words[i:]
    if v.positional and not (v.positional == "text" and ("text" in options or "path" in options)):
        if not rest:
            raise ValueError(f"{v.name} needs {v.positional}")
        if v.positional == "args":
            options["args"], rest = rest[:2], rest[2:]
        else:
            options[v.positional], rest = rest[0].split(",") if v.positional == "names" else rest[0], rest[1:]
    if rest:
        raise ValueError(f"{v.name}: what is {rest[0]!r}?")
    return v, options
