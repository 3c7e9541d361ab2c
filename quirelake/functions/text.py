"""Text kernels as column functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

#: Stands for a '.' or ',' between two digits while a text is cut (a private-use character).
DOT, COMMA = "\ue000", "\ue001"
SEPARATORS = " \\-)(;,:.\u3001\u3002\uff0c\uff1a\uff1b\uff08\uff09"


def tokens(text):
    """Words and separators in order. Space, - ) ( ; : and CJK punctuation separate; '.' and ',' too, unless they stand
    between two digits; no-break spaces count as spaces; each separator is a token of its own."""
    return _cut(text, f"(?<=[{SEPARATORS}])|(?=[{SEPARATORS}])", lambda x: x)


def _cut(text, pattern: str, form):
    """form of each piece between matches of pattern; marks between digits are hidden while the text is cut, and shown again.
    To split a text takes a third of the time of regexp_extract_all. A text without such marks is split at once, a text in
    ASCII brought into its form as a whole."""
    t = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    cut = lambda t: F.array_remove(F.split(t, pattern), "")
    hidden = F.regexp_replace(F.regexp_replace(t, "(?<=[0-9])\\.(?=[0-9])", DOT), "(?<=[0-9]),(?=[0-9])", COMMA)
    shown = F.transform(cut(hidden), lambda x: F.translate(form(x), DOT + COMMA, ".,"))
    return F.when(text.rlike(f"[{DOT}{COMMA}]|[0-9][.,][0-9]"), F.array_remove(F.array_remove(shown, "."), ",") if pattern.endswith("+") else shown).when(
        F.octet_length(text) == F.length(text), cut(form(text))).otherwise(F.transform(cut(t), form))


def is_word(token):
    return ~F.contains(F.lit(" -)(;,:.\u3001\u3002\uff0c\uff1a\uff1b\uff08\uff09"), token)


def words(text):
    """Lower-cased words of a text."""
    return _cut(text, f"[{SEPARATORS}]+", F.lower)


def token_list(text: str | None) -> list[str]:
    """tokens() in Python, for kernels that need those of few texts only."""
    t = _hidden(text)
    return [x.translate(SHOWN) for x in TOKEN.findall(t)] if DOT in t or COMMA in t else TOKEN.findall(t)


def word_list(text: str | None) -> list[str]:
    """words() in Python."""
    t = _hidden(text)
    if t.isascii():
        return WORD.findall(t.lower())
    return [w for x in WORD.findall(t) if (w := x.lower().translate(SHOWN)) not in (".", ",")]


SHOWN = {ord(DOT): ".", ord(COMMA): ","}
TOKEN, WORD, BETWEEN = re.compile(f"[{SEPARATORS}]|[^{SEPARATORS}]+"), re.compile(f"[^{SEPARATORS}]+"), re.compile("(?<=[0-9])[.,](?=[0-9])")


def _hidden(text: str | None) -> str:
    return BETWEEN.sub(lambda m: DOT if m[0] == "." else COMMA, (text or "").replace("\u00a0", " "))


def normalized(text):
    """The key form of a word: no-break spaces as spaces, lower case."""
    return F.lower(F.translate(text, "\u00a0", " "))


def preview(text, n: int = 100):
    """The first n characters, with ... if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def short_hash(text, n: int = 16):
    return F.left(F.sha2(text, 256), F.lit(n))


def occurrences(text, needle, limit: int = 100):
    """Zero-based starts of needle in text, overlapping ones too, the first limit of them."""
    # the text is cut in front of each occurrence, so it is read once: the pieces' lengths give the starts
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    sizes = F.transform(F.split(text, quoted, limit + 1), F.length)
    none = F.array().cast("array<int>")
    starts = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("starts")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")))["starts"]
    starts = F.when(F.startswith(text, needle), starts).otherwise(F.slice(starts, 2, limit))
    return F.slice(F.coalesce(F.when(F.length(needle) > 0, starts), none), 1, limit)


def before_context(text, start, mode: str, width: int = 80):
    """What stands before a match, back to the nearest stop of the mode, at most width characters."""
    stops = {"char": None, "bracket": "\\[\\]", "sentence": ".!?\\n", "comma": ",.!?;\\n"}[mode]
    left = F.substr(text, F.greatest(start - width + 1, F.lit(1)), F.least(start, F.lit(width)))
    return left if stops is None else F.regexp_extract(left, f"[^{stops}]*$", 0)


def after_context(text, end, mode: str, width: int = 80):
    stops = {"char": None, "bracket": "\\[\\]", "sentence": ".!?\\n", "comma": ",.!?;\\n"}[mode]
    right = F.substr(text, end + 1, F.lit(width))
    return right if stops is None else F.regexp_extract(right, f"^[^{stops}]*", 0)


def boolean(text):
    """true/1/on and false/0/off, any case; null otherwise."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "on"), F.lit(True)).when(t.isin("0", "false", "off"), F.lit(False))


def smart_quotes(text):
    """Straight double quotes as opening ones after a space, a bracket or the start, else as closing ones."""
    return F.regexp_replace(F.regexp_replace(text, '(^|[ (\\[])"', "$1\u201c"), '"', "\u201d")


def valid_xml(text):
    """Characters below a space as their code in hexadecimal between underscores: _1F_."""
    out = text
    for c in range(32):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"_{c:X}_"))
    return F.when(text.rlike("[\\x00-\\x1F]"), out).otherwise(text)


def wrap76(text):
    """Base64 in lines of 76 characters."""
    plain = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\\r\\n]", "")
    return F.regexp_replace(plain, "(.{76})(?=.)", "$1\n")

