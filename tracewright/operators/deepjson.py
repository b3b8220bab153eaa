"""JSON text of any depth, read and written without recursion: what the standard library does until a line is nested too deeply for it."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from json.decoder import scanstring

sys.set_int_max_str_digits(0)  # a number of thousands of digits is JSON too

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"null": None, "true": True, "false": False}


def _refuse(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_refuse).decode


def _scalar(text: str, at: int) -> tuple[object, int]:
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1, True)
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    m = _NUMBER.match(text, at)
    if not m:
        raise ValueError(at)
    whole, part, power = m.groups()
    return (float(m[0]) if part or power else int(whole)), m.end()


def _key(text: str, at: int) -> tuple[str, int]:
    """A member's name and where its value begins."""
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != '"':
        raise ValueError(at)
    name, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(at)
    return name, at + 1


def _walk(text: str) -> object:
    """One JSON value: open containers are kept in a list, innermost last."""
    open_: list[tuple[object, str | None]] = []  # container, name under which the next value goes
    at = 0
    while True:
        at = _SPACE.match(text, at).end()
        begins = text[at : at + 1]
        if begins in ("{", "[") and begins:
            empty = _SPACE.match(text, at + 1).end()
            value = {} if begins == "{" else []
            if text[empty : empty + 1] != ("}" if begins == "{" else "]"):
                name, at = _key(text, empty) if begins == "{" else (None, empty)
                open_.append((value, name))
                continue
            at = empty + 1
        else:
            value, at = _scalar(text, at)
        while open_:  # the value is whole; so may be the containers it closes
            box, name = open_[-1]
            if name is None:
                box.append(value)
            else:
                box[name] = value
            at = _SPACE.match(text, at).end()
            sign = text[at : at + 1]
            if sign == ",":
                if name is None:
                    at += 1
                else:
                    name, at = _key(text, at + 1)
                    open_[-1] = (box, name)
                break
            if sign != ("]" if name is None else "}"):
                raise ValueError(at)
            value, at = open_.pop()[0], at + 1
        else:
            if _SPACE.match(text, at).end() != len(text):
                raise ValueError(at)
            return value


def loads(text: str) -> object:
    """The value of one JSON text; ValueError where it isn't one. NaN and infinities are none."""
    try:
        return _decode(text)
    except RecursionError:
        return _walk(text)


def dumps(value: object, sort_keys: bool = False, compact: bool = True, name: Callable[[str], str] = str) -> str:
    """JSON text of a value; ``name`` is applied to every member's name."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    if name is str or not isinstance(value, (dict, list)):
        try:
            return json.dumps(value, ensure_ascii=False, sort_keys=sort_keys, separators=(comma, colon))
        except RecursionError:
            pass
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]  # (whether it is text as it stands, what it is)
    while todo:
        ready, x = todo.pop()
        if ready:
            out.append(x)
        elif isinstance(x, (dict, list)) and x:
            members = [(name(k), v) for k, v in x.items()] if isinstance(x, dict) else [(None, v) for v in x]
            if sort_keys and isinstance(x, dict):
                members.sort(key=lambda m: m[0])
            todo.append((True, "}" if isinstance(x, dict) else "]"))
            for i in range(len(members) - 1, -1, -1):
                k, v = members[i]
                todo.append((False, v))
                todo.append((True, (comma if i else "") + (json.dumps(k, ensure_ascii=False) + colon if k is not None else "")))
            out.append("{" if isinstance(x, dict) else "[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)
