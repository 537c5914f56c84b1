"""Column expressions for cleaning and normalizing sequence text.

All of them are built-in expressions; those over arrays (``transform``,
``filter``) are evaluated row by row, the others inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must equal the formats read and written.
BRACKETED = r"\[.*?\]"
AMBIGUOUS_CLASS = "[XBZUO*]"
NOT_AVAILABLE = "NA"
NO_MATCH = "NO_MATCH"
FASTA_WIDTH = 60

# White space of any kind; trim() alone would only remove the space character.
WHITE_SPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Remove white space from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def fold_li(c: Column) -> Column:
    """Make isoleucine and leucine equal, keeping the case of all letters."""
    return F.replace(c, F.lit("I"), F.lit("L"))


def fold_li_upper(c: Column) -> Column:
    """Upper-case, then make isoleucine and leucine equal."""
    return F.translate(F.upper(c), "I", "L")


def strip_stops(c: Column) -> Column:
    """Remove stop-codon marks from both ends."""
    return F.btrim(c, F.lit("*"))


def strip_trailing_stops(c: Column) -> Column:
    """Remove stop-codon marks from the end only."""
    return F.rtrim(c, F.lit("*"))


def clean_residues(c: Column) -> Column:
    """The cleaning every k-mer source gets: upper case, outer stops removed."""
    return strip_stops(F.upper(c))


def strip_modifications(c: Column) -> Column:
    """Drop bracketed modifications: ``C[+57.02]AA`` becomes ``CAA``.

    The match is lazy, so nested brackets leave their tail behind, and it ends
    at a line feed.
    """
    return F.regexp_replace(c, "(?d)" + BRACKETED, "")


def peptide_from_modified(c: Column) -> Column:
    """Bare peptide of a modified-sequence string."""
    return strip(strip_modifications(c))


def key_upper(c: Column) -> Column:
    """Look-up key of a reference peptide."""
    return F.upper(strip(c))


_QUOTED = r"""(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+")"""
_INTEGER = r"[+-]?(?:0+|[1-9][0-9]*)"
_FLOAT = r"[+-]?(?:(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)"
_NAME = r"None|True|False"
_ITEM = rf"(?:{_QUOTED}|{_FLOAT}|{_INTEGER}|{_NAME})"
_JSON = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def _list_of(item: str) -> str:
    return rf"(?s)\A\[\s*(?:{item}(?:\s*,\s*{item})*+\s*,?)?\s*\]\z"


def _parse_list(c: Column, item: str = _QUOTED) -> Column:
    """Array of the tokens in a list literal; null when the text is anything
    but a list of such items from end to end.

    A trailing comma is legal in the literal but not in JSON.
    """
    body = _wide_escapes(F.regexp_replace(c, r",\s*\]$", "]"))
    return F.when(c.rlike(_list_of(item)), F.from_json(body, "array<string>", _JSON))


def _wide_escapes(c: Column) -> Column:
    """Escapes of two hexadecimal digits, which JSON lacks, as ones of four."""
    return F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")


def _float_text(item: Column) -> Column:
    """A decimal number as a literal's value prints: plain from 0.0001 to 1e16, else with an exponent of two digits."""
    value = item.try_cast("double")
    size, java = F.abs(value), value.cast("string")
    plain = F.regexp_replace(F.regexp_replace(value.try_cast("decimal(38,22)").cast("string"), "0+$", ""), r"\.$", ".0")
    plain = F.when((size == 0) & item.startswith("-"), F.lit("-0.0")).otherwise(plain)
    power = F.regexp_extract(java, "E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    scientific = F.concat(digits, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    wide = F.concat(digits, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))
    infinite = F.when(value < 0, "-inf").otherwise("inf")
    return (F.when(F.isnan(value) | (size == float("inf")), infinite).when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain)
            .when(F.abs(power) > 99, wide).otherwise(scientific))


def _item_text(item: Column) -> Column:
    """An item of a literal as its value prints."""
    quoted = F.get(F.from_json(F.concat(F.lit("["), _wide_escapes(item), F.lit("]")), "array<string>", _JSON), F.lit(0))
    whole = F.when(item.rlike("^[+-]?0+$"), F.lit("0")).otherwise(F.regexp_replace(item, r"^\+", ""))
    return (F.when(item.rlike("""^['"]"""), quoted).when(item.rlike(f"^(?:{_INTEGER})$"), whole)
            .when(item.rlike(f"^(?:{_NAME})$"), item).otherwise(_float_text(item)))


def _printed_list(c: Column) -> Column:
    """The printed items of a list literal; null when the text is anything but a list of literals."""
    items = F.regexp_extract_all(c, F.lit(f"({_ITEM})"), F.lit(1))
    return F.when(c.rlike(_list_of(_ITEM)), F.transform(items, _item_text))


def tokens_to_sequence(c: Column) -> Column:
    """Strict: join the cleaned tokens of a list literal; a bad literal fails.

    Tuples are literals too. A quoted string is a sequence of one-letter
    tokens, so brackets inside it are not a modification and survive.
    """
    s = strip(c)
    inner = F.concat(F.lit("["), F.substring(s, F.lit(2), F.length(s) - 2), F.lit("]"))
    listed = F.when(s.startswith("("), inner).otherwise(s)
    tokens = F.array_join(F.transform(_parse_list(listed), strip_modifications), "")
    quoted = F.array_join(_parse_list(F.concat(F.lit("["), s, F.lit("]"))), "")
    bad = F.raise_error(F.concat(F.lit("not a token list: "), c)).cast("string")
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(s.startswith("[") | s.startswith("("), F.coalesce(tokens, bad))
            .otherwise(F.coalesce(quoted, bad)))


def prediction_key(c: Column) -> Column:
    """Lenient: list literal, plain or joined prediction to a look-up key.

    Cleaning happens after joining; text that only looks like a list is used
    as it stands. Null stays null and therefore matches nothing.
    """
    s = strip(c)
    joined = F.when(s.startswith("["), F.coalesce(F.array_join(_printed_list(s), ""), s)).otherwise(s)
    return F.upper(strip(strip_modifications(joined)))


def count_or_zero(c: Column) -> Column:
    """Integer value of a count cell; anything unreadable counts as 0."""
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def percent(part: Column, total: Column) -> Column:
    """Percentage as a raw double, 0 for an empty total. Format it at the edge."""
    return F.when(total > 0, 100.0 * part / total).otherwise(F.lit(0.0))


def wrap(c: Column, width: int = FASTA_WIDTH) -> Column:
    """Break text into lines of ``width`` letters."""
    return F.regexp_replace(c, "(.{%d})(?=.)" % width, "$1\n")


def fasta_record(name: Column, seq: Column, width: int | None = None) -> Column:
    """One FASTA record without its final newline."""
    header = F.concat(F.lit(">"), name)
    if width is None:
        return F.concat(header, F.lit("\n"), seq)
    return F.when(F.length(seq) == 0, header).otherwise(F.concat(header, F.lit("\n"), wrap(seq, width)))


def category(pile: Column, in_reference: Column) -> Column:
    """Pile and reference state in one label."""
    return F.concat_ws("|", pile, F.when(in_reference, F.lit("in_reference")).otherwise(F.lit("novel")))


def pile_label(count1: Column, count2: Column, label1: str, label2: str) -> Column:
    """``shared``, ``only_<label1>`` or ``only_<label2>`` from the two counts."""
    return (F.when((count1 > 0) & (count2 > 0), F.lit("shared"))
            .when(count1 > 0, F.lit(f"only_{label1}"))
            .otherwise(F.lit(f"only_{label2}")))


def sorted_cell(ids: Column, sep: str = ";") -> Column:
    """Distinct ids in sorted order as an aggregate; an empty cell when there are none."""
    return F.array_join(F.array_sort(F.collect_set(ids)), sep)


def ordered_cell(order: Column, value: Column, sep: str = ";") -> Column:
    """Values with repeats in the given order as an aggregate."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), sep)
