"""Normal forms and full case folding, which Spark has no functions for: Arrow-batched UDFs, and which texts need them."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def _mapped(name: str):
    """One function object for each name, so that equal calls are evaluated once."""
    each = _EACH[name]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(each, na_action="ignore")

    run.__name__ = name
    return F.pandas_udf(run, "string")


def _form(form: str, text: str) -> str:
    return unicodedata.normalize(form, text)


def _folded(text: str) -> str:
    return unicodedata.normalize("NFC", text).casefold()


_EACH = {"nfc": functools.partial(_form, "NFC"), "nfd": functools.partial(_form, "NFD"), "casefold": str.casefold, "folded": _folded}


def nfc(text: Column) -> Column:
    return _mapped("nfc")(text)


def nfd(text: Column) -> Column:
    return _mapped("nfd")(text)


def casefold(text: Column) -> Column:
    return _mapped("casefold")(text)


def folded(text: Column) -> Column:
    """Form C, then full case folding."""
    return _mapped("folded")(text)


#: Blocks in which single characters are looked at: Latin with its phonetic letters, punctuation and symbols, kana and ideographs, Hangul syllables, full-width forms, pictographs.
BLOCKS = ((0x0, 0x2AF), (0x2000, 0x2BFF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF))


def _plain(c: str) -> bool:
    """Whether a character is in form C wherever it stands, and is folded by lower-casing and ``ß`` to ``ss``."""
    return unicodedata.normalize("NFC", c) == c and unicodedata.category(c)[0] != "M" and c.casefold() == c.lower().replace("ß", "ss")


@functools.cache
def odd() -> str:
    """A pattern of the characters that ask for normal form C or full case folding; texts without one need neither."""
    ranges: list[list[int]] = []
    for first, last in BLOCKS:
        for c in range(first, last + 1):
            if _plain(chr(c)):
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"
