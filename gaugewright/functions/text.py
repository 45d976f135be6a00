"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters without a decomposition, and what they fold to.
SPECIAL_FOLDS = {"đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l"}
#: Entities that stay text, in the order in which they are decoded.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
#: Question marks of several scripts.
QUESTION_MARKS = "?？؟"


@cache
def _single_folds() -> tuple[str, str]:
    """Letters of any script that decompose to one letter and marks of U+0300 to U+036F, and that letter, by rule from the Unicode tables."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0xAC00), *range(0xF900, 0x10000)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if base != c and all("\u0300" <= m <= "\u036f" for m in marks):
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def squeeze(col: Column) -> Column:
    """Runs of white space, non-breaking ones included, become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col, "[\\s\\u00a0\\ufeff]+", " "))


def strip_tags(html: Column) -> Column:
    """Visible text: scripts, styles and tags become blanks; &nbsp; and &amp; are decoded, other named entities dropped."""
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<script\\b.*?</script>", " "), "(?is)<style\\b.*?</style>", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "&nbsp;", " "), "&amp;", "&")
    return squeeze(F.regexp_replace(text, "(?i)&[a-z]+;", " "))


def html_text(html: Column, cap: int = 20000) -> Column:
    """Text of a fragment: tags out, six entities decoded, tags that decoding revealed out (twice), blanks before stops out."""
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    for _ in range(2):
        text = F.regexp_replace(text, "(?s)</?[a-zA-Z][^>]*>", " ")
    return F.substring(F.regexp_replace(squeeze(text), " ([.,;:!?])", "$1"), 1, cap)


def word_count(text: Column) -> Column:
    """Words between single blanks of a squeezed text; 0 for an empty one."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, " ")))


def fold(col: Column) -> Column:
    """Lower case without diacritics in any script: letters with marks by table, combining marks dropped, six special letters mapped.

    Syllables and letters whose marks lie outside U+0300 to U+036F stay composed; ``places.decomposed`` takes these apart too.
    """
    source, target = _single_folds()
    out = F.translate(F.lower(col), source, target)
    for letter, plain in SPECIAL_FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.regexp_replace(out, "[\\u0300-\\u036f]", "")


def normalize(col: Column) -> Column:
    """Folded letters and digits, everything else one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(col), "[^\\p{L}\\p{N}\\s]", " "), "\\s+", " "))


def tokens(col: Column) -> Column:
    return F.filter(F.split(normalize(col), " "), lambda x: x != "")


def fuzz(col: Column) -> Column:
    """Folded letters and digits without anything between them."""
    return F.regexp_replace(fold(col), "[^\\p{L}\\p{N}]", "")


def min_fuzz_length(col: Column) -> Column:
    return F.when(F.regexp_like(col, F.lit("[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]")), 2).otherwise(3)


def squash(col: Column) -> Column:
    """ASCII letters and digits in lower case, nothing else."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def merge_key(name: Column) -> Column:
    """Key under which spellings of one shop name meet."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[\\s\\u3000のー・]", ""), "(公式)?(店舗|本店|支店|店)$", "")


def in_windows(needle: Column, haystack: Column, short: int = 60, width: int = 40, least: int = 3) -> Column:
    """Is a text present: short ones must be contained; of long ones, three of five evenly spaced windows."""
    starts = F.array(*(F.lit(x) for x in (0.0, 0.2, 0.4, 0.6, 0.8)))
    found = F.aggregate(
        starts, F.lit(0), lambda n, s: n + F.contains(haystack, F.substring(needle, F.floor(s * (F.length(needle) - width)).cast("int") + 1, F.lit(width))).cast("int")
    )
    return F.when(F.length(needle) < short, F.contains(haystack, needle)).otherwise(found >= least)


def cap_ends(text: Column, cap: int, mark: str = " […] ") -> Column:
    """Long texts keep their head and tail, seven tenths and the rest of what the mark between leaves of the cap."""
    head = (cap - len(mark)) * 7 // 10
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(cap - len(mark) - head))))


def cap_words(text: Column, cap: int) -> Column:
    """Cut at the last blank within the cap and add an ellipsis."""
    cut = F.substring(text, 1, cap)
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(F.regexp_replace(cut, "\\s+\\S*\\z", ""), F.lit("…")))


def to_number(col: Column) -> Column:
    """Finite number of a non-blank string, else null."""
    x = F.try_cast(F.trim(col), "double") if hasattr(F, "try_cast") else F.trim(col).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def gtin_shape(col: Column) -> Column:
    return F.regexp_like(col, F.lit("^(\\d{8}|\\d{12,14})$"))


def gtin_valid(col: Column) -> Column:
    """Check digit of an 8, 12, 13 or 14 digit code: weights 3 and 1 alternate from the right."""
    digits = F.reverse(F.filter(F.split(col, ""), lambda x: x != ""))
    total = F.aggregate(F.transform(digits, lambda x, i: x.try_cast("int") * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return F.regexp_like(col, F.lit("^(\\d{8}|\\d{12}|\\d{13}|\\d{14})$")) & (total % 10 == 0)


def is_question(text: Column) -> Column:
    return F.regexp_like(text, F.lit(f"[{QUESTION_MARKS}]"))


def is_stub(answer: Column, least_words: int = 20) -> Column:
    """Short answers that do not end a sentence."""
    return (word_count(squeeze(answer)) < least_words) & ~F.regexp_like(F.trim(answer), F.lit("[.!?…。]$"))


def states_money(text: Column) -> Column:
    """A currency sign or code next to a digit."""
    return F.regexp_like(text, F.lit("\\p{Sc}\\s?\\d|\\d\\s?\\p{Sc}|\\b(USD|EUR|GBP|JPY|CHF)\\s?\\d|\\d\\s?(USD|EUR|GBP|JPY|CHF)\\b"))


def loose_date(col: Column) -> Column:
    """ISO dates, M/YYYY as the first of the month, YYYY as the first of January, else null."""
    iso = F.regexp_extract(col, "^(\\d{4}-\\d{2}-\\d{2})([T ].*)?$", 1)
    month = F.regexp_extract(col, "^(\\d{1,2})/(\\d{4})$", 1)
    year = F.regexp_extract(col, "^(?:\\d{1,2}/)?(\\d{4})$", 1)
    text = F.when(iso != "", iso).when(month != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-01"))).when(year != "", F.concat(year, F.lit("-01-01")))
    return text.try_cast("date")


def numbers_in(text: Column) -> Column:
    """Numbers of a text, thousands separators removed."""
    found = F.regexp_extract_all(text, F.lit("\\d+(?:,\\d{3})*(?:\\.\\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def phone_digits(col: Column) -> Column:
    return F.regexp_replace(col, "\\D", "")


def same_phone(a: Column, b: Column) -> Column:
    """Equal last digits, up to ten, if the shorter number has seven or more."""
    x, y = phone_digits(a), phone_digits(b)
    n = F.least(F.length(x), F.length(y), F.lit(10))
    return (n >= 7) & (F.right(x, n) == F.right(y, n))


#: Legal forms that a business name may end in, and short forms in addresses.
LEGAL_FORMS = ("inc", "llc", "ltd", "co", "corp", "company", "gmbh", "limited")
ADDRESS_FORMS = {"st": "street", "ave": "avenue", "av": "avenue", "rd": "road", "blvd": "boulevard", "ln": "lane", "dr": "drive", "hwy": "highway", "ste": "suite", "fl": "floor"}


def business_name(col: Column) -> Column:
    """Folded name without legal forms and punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(col), f"\\b({'|'.join(LEGAL_FORMS)})\\b", " "), "[^a-z0-9\\s]", " "), "\\s+", " "))


def address_tokens(col: Column) -> Column:
    """Words of an address, short forms written out."""
    forms = F.create_map(*(F.lit(x) for pair in ADDRESS_FORMS.items() for x in pair))
    words = F.filter(F.split(F.regexp_replace(fold(col), "[^a-z0-9\\s]", " "), "\\s+"), lambda x: x != "")
    return F.transform(words, lambda x: F.coalesce(F.try_element_at(forms, x), x))


def same_business(name_a: Column, name_b: Column) -> Column:
    """match, mismatch or skip: equal, one within the other, or three fifths of the words in common."""
    a, b = business_name(name_a), business_name(name_b)
    alike = (a == b) | F.contains(a, b) | F.contains(b, a) | (jaccard(F.split(a, " "), F.split(b, " ")) >= 0.6)
    return F.when(F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin(""), "skip").when(alike, "match").otherwise("mismatch")


def same_address(a: Column, b: Column) -> Column:
    """match, mismatch or skip: half of the words in common."""
    x, y = F.coalesce(address_tokens(a), F.array().cast("array<string>")), F.coalesce(address_tokens(b), F.array().cast("array<string>"))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), "skip").when(jaccard(F.array_distinct(x), F.array_distinct(y)) >= 0.5, "match").otherwise("mismatch")
