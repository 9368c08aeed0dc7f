"""JSON repair and located errors.

One pass over tokens instead of rewriting passes: comments go, strings get straight
double quotes, bare keys get quotes, literals of other languages become JSON's, stray
commas go and missing ones come. Brackets are never closed. A text that parses is
returned as it is, and a repair that does not parse counts for nothing.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

TOKEN = re.compile(r"""(?P<gap>\s+)|(?P<note>/\*.*?\*/|//[^\n]*)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[\u201c\u201d](?:[^\u201c\u201d\\\n]|\\.)*[\u201c\u201d]|[\u2018\u2019](?:[^\u2018\u2019\\\n]|\\.)*[\u2018\u2019])|(?P<sign>[{}\[\]:,;])|(?P<word>[^\s{}\[\]:,;"'\u201c\u201d\u2018\u2019]+)""", re.S)
#: Literals of other languages.
LITERALS = {"True": "true", "False": "false", "None": "null", "undefined": "null", "NaN": "null", "Infinity": "null", "-Infinity": "null"}
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$")


def parses(text: str) -> bool:
    try:
        json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        return True
    except ValueError:
        return False


def quoted(token: str) -> str:
    if token[0] == '"':
        return token
    body = re.sub(r"\\(['\u2018\u2019])", r"\1", token[1:-1])
    return '"' + re.sub(r'(?<!\\)"', r'\\"', body) + '"'


def repair(text: str | None) -> str | None:
    """The text as valid JSON, or None if this cannot be had without guessing."""
    if text is None:
        return None
    text = text.removeprefix("\ufeff")
    if parses(text):
        return text
    tokens = [(m.lastgroup, m[0]) for m in TOKEN.finditer(text)]
    if sum(len(x) for _, x in tokens) != len(text):
        return None
    out: list[str] = []
    solid = [k for k, (kind, _) in enumerate(tokens) if kind not in ("gap", "note")]
    after = {k: solid[i + 1] for i, k in enumerate(solid[:-1])}
    was, last_comma = "", None  # the kind of the last solid token: "", open, close, value, colon, comma
    for k, (kind, x) in enumerate(tokens):
        if kind == "note":
            continue
        if kind == "gap":
            out.append(x)
            continue
        follows = tokens[after[k]][1] if k in after else ""
        if kind == "sign" and x in ",;":
            if was in ("value", "close") and follows not in ("}", "]", "", ",", ";"):
                last_comma = len(out)
                out.append(",")
                was = "comma"
            continue
        if kind != "sign" or x in "{[":
            if was in ("value", "close"):
                # A comma is missing before this value; it goes behind the last solid token.
                at = len(out)
                while at and out[at - 1].isspace():
                    at -= 1
                out.insert(at, ",")
        if kind == "str":
            out.append(quoted(x))
            was = "value"
        elif kind == "word":
            if follows == ":" and not was == "colon":
                out.append(json.dumps(x, ensure_ascii=False))
            else:
                out.append(LITERALS.get(x, x))
            was = "value"
        else:
            out.append(x)
            was = {"{": "open", "[": "open", "}": "close", "]": "close", ":": "colon"}[x]
    done = "".join(out)
    return done if parses(done) else None


def locate_error(text: str) -> tuple[int, int, int, str] | None:
    """Offset, line, column and message of the first syntax error."""
    try:
        json.loads(text)
    except json.JSONDecodeError as e:
        return e.pos, e.lineno, e.colno, e.msg
    return None


def repair_udf():
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(repair)

    return f


def lint_udf():
    @F.pandas_udf("pos int, line int, col int, message string")
    def f(s: pd.Series) -> pd.DataFrame:
        got = [locate_error(x) if x is not None else None for x in s]
        return pd.DataFrame([g or (None, None, None, None) for g in got], columns=["pos", "line", "col", "message"]).astype({"pos": "Int32", "line": "Int32", "col": "Int32"})

    return f


def checked_udf():
    """The repaired text, whether it parses, and what is wrong if not."""
    @F.pandas_udf("text string, ok boolean, error string")
    def f(s: pd.Series) -> pd.DataFrame:
        fixed = s.map(repair)
        wrong = [None if y is not None else "no text" if x is None else (locate_error(x) or (0, 0, 0, "Invalid JSON"))[3] for x, y in zip(s, fixed)]
        return pd.DataFrame({"text": fixed, "ok": fixed.notna(), "error": wrong})

    return f


#: A literal of either quote, up to the text's end if it stays open.
LITERAL = re.compile(r"""(["'])(?:\\.|(?!\1)[^\\])*(?:\1|\\?\Z)""", re.S)


def mask_udf():
    """Begins and ends of the string literals in a text."""
    @F.pandas_udf("array<array<int>>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [[m.start(), m.end()] for m in LITERAL.finditer(x)])

    return f


def set_path(target, path: list, value):
    """a copy of ``target`` with ``value`` at a path of keys and numbers; what is missing on the way is made."""
    if not path:
        return value
    head, *rest = path
    if isinstance(head, int):
        out = list(target) if isinstance(target, list) else []
        out += [None] * (head + 1 - len(out))
    else:
        out = dict(target) if isinstance(target, dict) else {}
    out[head] = set_path(out[head] if isinstance(head, int) else out.get(head), rest, value)
    return out


def patch_udf():
    """JSON text, JSON path (an array) and JSON value to the patched text."""
    @F.pandas_udf("string")
    def f(text: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json.dumps(set_path(json.loads(t), json.loads(p), json.loads(v)), ensure_ascii=False) for t, p, v in zip(text, path, value)])

    return f
