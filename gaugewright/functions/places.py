"""Folding by true decomposition, and places of folded matches in the text as it was written."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPECIAL_FOLDS

_WIDE = re.compile("[\\u1100-\\u11ff\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff]")  # scripts whose letters are whole syllables or words


class _Folds(dict):
    """Code point -> what it folds to: lower case, decomposed, without marks of U+0300 to U+036F, special letters mapped."""

    def __init__(self, letters_only: bool):
        super().__init__()
        self.letters_only = letters_only

    def __missing__(self, point: int) -> str:
        out = "".join(SPECIAL_FOLDS.get(c, c) for c in unicodedata.normalize("NFD", chr(point).lower()) if not "̀" <= c <= "ͯ")
        if self.letters_only:
            out = "".join(c for c in out if unicodedata.category(c)[0] in "LN")
        self[point] = out
        return out


_TEXT, _LETTERS = _Folds(False), _Folds(True)


def place_of(text: str, needle: str) -> tuple[int, int] | None:
    """(begin, end) of the first place in ``text``, in UTF-16 units, whose letters and digits fold to those of ``needle``."""
    wanted = needle.translate(_LETTERS)
    if len(wanted) < (2 if _WIDE.search(wanted) else 3):
        return None
    at = text.translate(_LETTERS).find(wanted)
    if at < 0:
        return None
    seen, units, begin = 0, 0, None
    for c in text:
        if seen >= at + len(wanted) and unicodedata.category(c)[0] != "M":  # marks belong to the letter before them
            break
        seen += len(_LETTERS[ord(c)])
        if begin is None and seen > at:
            begin = units
        units += 1 + (c > "\uffff")
    return begin, units


def _places(texts: pa.Array, needles: pa.Array) -> pa.Array:
    found = [place_of(t, n) if t and n else None for t, n in zip(texts.to_pylist(), needles.to_pylist(), strict=True)]
    return pa.array([f and {"begin": f[0], "end": f[1]} for f in found], pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def fuzzy_place(text: Column, needle: Column) -> Column:
    """Place of the first folded match of ``needle`` in the raw ``text``: a struct of begin and end in UTF-16 units.

    Case, diacritics and everything but letters and digits are passed over on both sides. Null where either is null or
    empty, where nothing is found, or where the needle has fewer than three letters and digits (two in scripts of syllables).
    A match that begins or ends within a letter which folds to several takes the whole letter.
    """
    return F.arrow_udf(_places, "struct<begin int, end int>")(text, needle)


def _decomposed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.translate(_TEXT) for t in texts.to_pylist()], pa.string())


def decomposed(text: Column) -> Column:
    """Lower case without diacritics in any script, by canonical decomposition. ``text.fold`` does the same for letters of one base letter, without Python."""
    return F.arrow_udf(_decomposed, "string")(text)


def cut_utf16(text: Column, begin: Column, end: Column) -> Column:
    """Part of a text between two places in UTF-16 units; a pair that a place would split is read as U+FFFD."""
    units = F.encode(text, "UTF-16LE")
    return F.decode(F.substring(units, 2 * begin + 1, 2 * (end - begin)), "UTF-16LE")


def same_letters(a: Column, b: Column) -> Column:
    """Equality without regard to case and diacritics, by the root collation; nothing is rewritten, so it also serves joins and groups."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")


def in_order(text: Column) -> Column:
    """Sort key in the order of the root locale: letters before case and accents, not by bytes."""
    return F.collate(text, "UNICODE")
