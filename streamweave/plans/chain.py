"""Chains of verbs as they are written: ``sort -nr x then head -n 4 -g a``."""

from __future__ import annotations

import shlex

from .stream import Stream


def split_chain(text: str | list[str]) -> list[list[str]]:
    words = shlex.split(text) if isinstance(text, str) else list(text)
    links: list[list[str]] = [[]]
    for w in words:
        if w == "then":
            links.append([])
        else:
            links[-1].append(w)
    if any(not link for link in links):
        raise ValueError("a chain has an empty link")
    return links


def chain(s: Stream, text: str | list[str], **streams) -> Stream:
    """Run a chain over a stream. ``streams``: streams that ``join -f NAME`` may name instead of a path."""
    from ..operators.registry import parse

    for words in split_chain(text):
        verb, options = parse(words)
        if verb.name == "join" and options.get("left") in streams:
            options["left"] = streams[options["left"]]
        s = verb.run(s, **options)
    return s
