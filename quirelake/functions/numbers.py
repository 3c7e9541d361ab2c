"""Number and date texts as column functions: list numbers, cell format codes, units, colours, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

# English number words.
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
ORDINALS = ("zeroth", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth")


def _at(values, i):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i + 1).cast("int"))


def roman(n):
    """Upper-case Roman numeral of n, digit by digit."""
    out = F.lit("")
    for place, names in ((1000, ("", "M", "MM", "MMM", "MMMM")), (100, ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")), (10, ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")), (1, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))):
        out = F.concat(out, _at(names, F.floor(n / place) % 10 if place < 1000 else F.floor(n / place)))
    return out


def letters(n):
    """A..Z, then AA, BB, ...: the letter repeated, up to 30 times; after 780 it begins anew."""
    m = (n - 1) % 780
    return F.repeat(F.char((m % 26 + 65).cast("int")), (F.floor(m / 26) + 1).cast("int"))


def ordinal(n):
    """1st, 2nd, 3rd, 4th, ..."""
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def _words(n, last):
    """Number words below 20,000, with the last one from last; capitalised."""
    tens, ones = _at(TENS, F.floor(n % 100 / 10)), n % 10
    round_tens = F.regexp_replace(tens, "y$", "ieth") if last is ORDINALS else tens
    low = F.when(n % 100 == 0, F.when(n == 0, last[0])).when(n % 100 < 20, _at(last, n % 100)).when(ones == 0, round_tens).otherwise(F.concat(tens, F.lit("-"), _at(last, ones)))
    thousands = F.when(n >= 1000, F.concat(_at(ONES, F.floor(n / 1000)), F.lit(" thousand")))
    hundreds = F.when(n % 1000 >= 100, F.concat(_at(ONES, F.floor(n % 1000 / 100)), F.lit(" hundred")))
    out = F.concat_ws(" ", thousands, hundreds, low)
    if last is ORDINALS:
        out = F.when((n % 100 == 0) & (n > 0), F.concat(out, F.lit("th"))).otherwise(out)
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))


def cardinal_text(n):
    """Words of a number below 20,000: One hundred five."""
    return _words(n, ONES)


def ordinal_text(n):
    return _words(n, ORDINALS)


def list_number(n, kind: str):
    """A list number in one of the formats of word processing; an unknown format is decimal."""
    padded = lambda width: F.when(F.length(n.cast("string")) < width, F.lpad(n.cast("string"), width, "0")).otherwise(n.cast("string"))
    formats = {
        "decimal": lambda: n.cast("string"),
        "decimalZero": lambda: padded(2),
        "upperRoman": lambda: roman(n), "lowerRoman": lambda: F.lower(roman(n)),
        "upperLetter": lambda: letters(n), "lowerLetter": lambda: F.lower(letters(n)),
        "ordinal": lambda: ordinal(n), "cardinalText": lambda: cardinal_text(n), "ordinalText": lambda: ordinal_text(n),
        "01, 02, 03, ...": lambda: padded(2), "001, 002, 003, ...": lambda: padded(3), "0001, 0002, 0003, ...": lambda: padded(4), "00001, 00002, 00003, ...": lambda: padded(5),
        "decimalEnclosedCircle": lambda: F.when(n.between(1, 20), F.decode(F.unhex(F.lpad(F.hex(9311 + n), 4, "0")), "UTF-16BE")).otherwise(n.cast("string")),
        "bullet": lambda: F.lit(""), "none": lambda: F.lit(""),
    }
    return formats.get(kind, formats["decimal"])()


def ole_date(days):
    """The timestamp of a serial date: days since 1899-12-30."""
    return F.timestamp_seconds(F.round((days - 25569) * 86400))


def to_ole(ts):
    return F.unix_timestamp(ts) / 86400 + 25569


def fixed(value, places: int, thousands: bool):
    """Half-up decimal text with so many places."""
    d = F.format_number(F.round(value.cast("decimal(28,10)"), places), places)
    return d if thousands else F.regexp_replace(d, ",", "")


def cell_text(code: str, value):
    """A number under a format code of 0, #, comma and percent signs; negative sections with parentheses or a minus sign
    show the absolute value."""
    def one(part: str):
        body = "".join(c for c in part if c in "0#,.%")
        places = len(body.partition(".")[2].replace("%", "").replace(",", ""))
        percent, thousands = "%" in part, "," in body.partition(".")[0]
        v = value * 100 if percent else value
        signed = "(" in part or part.startswith("-")
        text = fixed(F.abs(v) if signed else v, places, thousands)
        head, tail = part[: part.find(body[0])] if body else part, part[part.rfind(body[-1]) + 1 :] if body else ""
        return F.concat(F.lit(head), text, F.lit("%" if percent else ""), F.lit(tail)) if body else F.lit(part)

    parts = code.split(";")
    if len(parts) == 3:
        return value.cast("string")
    if len(parts) == 1:
        return one(parts[0])
    if len(parts) == 2:
        return F.when(value > 0, one(parts[0])).otherwise(one(parts[1]))
    return F.when(value > 0, one(parts[0])).when(value < 0, one(parts[1])).otherwise(one(parts[2]))


#: Twentieths of a point in one unit of length.
TWIPS = {"pt": 20.0, "px": 15.0, "in": 1440.0, "cm": 1440 / 2.54, "mm": 144 / 2.54, "pc": 240.0}


def twips(amount, unit):
    """A CSS length in twips; null for an unknown unit."""
    out = F.lit(None).cast("double")
    for name, k in TWIPS.items():
        out = F.when(F.lower(unit) == name, amount * k).otherwise(out)
    return out


def rgb(text):
    """#rgb or #rrggbb as three numbers; null otherwise."""
    t = F.regexp_extract(F.lower(text), "^#([0-9a-f]{6}|[0-9a-f]{3})$", 1)
    full = F.when(F.length(t) == 3, F.regexp_replace(t, "(.)", "$1$1")).otherwise(t)
    return F.when(full != "", F.array(*(F.conv(F.substring(full, i, 2), 16, 10).cast("int") for i in (1, 3, 5))))


def column_index(letters_):
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.split(F.upper(letters_), ""), F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))


def column_letters(n):
    """1 -> A, 27 -> AA, for up to three letters."""
    a = F.floor((n - 703) / 676) + 1
    b = F.floor((n - 27) / 26) % 26 + 1
    c = (n - 1) % 26
    return F.concat(F.when(n >= 703, F.char((a + 64).cast("int"))).otherwise(""), F.when(n >= 27, F.char((b + 64).cast("int"))).otherwise(""), F.char((c + 65).cast("int")))
