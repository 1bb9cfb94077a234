"""The verbs that run programs."""

from __future__ import annotations

import contextlib
import glob
import os

from ..plans.stream import Stream
from .registry import verb

_FLAGS = "-f=path:str -e=text:str -s=preset:str -x=x:true -q=q:true -S=text_only:true -F=floats:true --folder=folder:str"


#: Programs that stand in front of all others.
_LOADED: list[str] = []


@contextlib.contextmanager
def preloaded(paths: list[str]):
    """Have the files' functions and subroutines at hand in all programs; a folder gives its .prog files."""
    for p in paths:
        for name in sorted(glob.glob(f"{p}/*.prog")) if os.path.isdir(p) else [p]:
            with open(name) as f:
                _LOADED.append(f.read())
    try:
        yield
    finally:
        _LOADED.clear()


def _program(text, path):
    parts = _LOADED + ([open(path).read()] if path else []) + ([text] if text else [])
    if len(parts) == len(_LOADED):
        raise ValueError("there is no program")
    return "\n".join(parts)


def _presets(preset):
    if not preset:
        return None
    name, _, value = preset.partition("=")
    return {name: int(value) if value.lstrip("-").isdigit() else value}


@verb("put", _FLAGS, "text")
def put(s: Stream, text=None, path=None, preset=None, x=False, q=False, text_only=False, floats=False, folder="redirects") -> Stream:
    """A program for each record: it assigns fields, filters, emits; ``q`` gives only what is emitted.

    What it prints is held for ``plans.sides.taken``; outputs that the records name stand below ``folder``.
    """
    from ..plans.dsl import put as run

    return run(s, _program(text, path), q, x, _presets(preset), folder)


@verb("filter", _FLAGS, "text")
def filter(s: Stream, text=None, path=None, preset=None, x=False, q=False, text_only=False, floats=False, folder="redirects") -> Stream:
    """Records for which the program's last bare boolean is true (``x``: false)."""
    from ..plans.dsl import where

    out = where(s, _program(text, path), x, _presets(preset))
    return out.with_df(out.df.limit(0)) if q else out
