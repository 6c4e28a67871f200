"""Text analysis as column expressions: word tokens after Unicode word-break rules, lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKEN = 255

# Unicode word-break classes (UAX #29) and the scripts they treat apart, as ranges.
_MID_LETTER = r":·\x{387}\x{55F}\x{5F4}\x{2027}\x{FE13}\x{FE55}\x{FF1A}"
_MID_NUM_LET = r".'\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"
_MID_NUM = r",;\x{37E}\x{589}\x{60C}\x{60D}\x{66C}\x{7F8}\x{2044}\x{FE10}\x{FE14}\x{FE50}\x{FE54}\x{FF0C}\x{FF1B}"
_HAN = (
    r"\x{2E80}-\x{2FDF}\x{3005}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
    r"\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
)
_HIRAGANA = r"\x{3041}-\x{309A}\x{309D}-\x{309F}\x{1B001}-\x{1B11F}"
_KATAKANA = (
    r"\x{3031}-\x{3035}\x{309B}\x{309C}\x{30A0}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{32D0}-\x{3357}"
    r"\x{FF66}-\x{FF9D}"
)
_UNSPACED = (  # Thai, Lao, Myanmar, Khmer
    r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{19E0}-\x{19FF}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}"
)
_EXTEND = r"\p{M}\x{AD}\x{200C}\x{200D}"
_EMOJI = r"\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1FAFF}"


def token_pattern(java: bool = True) -> str:
    """The token pattern over lower-cased text, for Java or for an RE2 engine.

    Letter runs may hold one letter-joining mark between letters (don't, u.s.a), digit runs one
    number-joining mark between digits (3.14), and both join with each other and with underscores.
    Han and Hiragana give one token per character; Katakana and the South-East Asian scripts
    without spaces give one per run. The Java form matches the same tokens faster: a run of common
    letters before a character that joins nothing is taken at once, spaces and marks are skipped by
    one lookahead, and possessive groups neither backtrack nor recurse, however long a token is.
    """
    p = "+" if java else ""
    common = r"a-z\x{DF}-\x{F6}\x{F8}-\x{24F}"
    other_letter = rf"[^\P{{L}}{_HAN}{_HIRAGANA}{_KATAKANA}{_UNSPACED}]"
    if java:
        letter, in_word = f"[{common}{other_letter}]", f"[{common}{other_letter}{_EXTEND}]"
    else:
        letter, in_word = other_letter, f"(?:{other_letter}|[{_EXTEND}])"
    letters = f"{letter}{in_word}*"
    digits = rf"\p{{Nd}}[\p{{Nd}}{_EXTEND}]*"
    letter_run = f"{letters}(?:[{_MID_LETTER}{_MID_NUM_LET}]{letters})*{p}"
    digit_run = f"{digits}(?:[{_MID_NUM}{_MID_NUM_LET}]{digits})*{p}"
    low_line = r"[_\p{Pc}\x{202F}]"
    word = f"{low_line}*(?:{letter_run}|{digit_run})(?:{letter_run}|{digit_run}|{low_line})*{p}"
    single = f"[{_HAN}{_HIRAGANA}][{_EXTEND}]*"
    katakana = f"[{_KATAKANA}][{_KATAKANA}{_EXTEND}]*"
    unspaced = f"[{_UNSPACED}][{_UNSPACED}{_EXTEND}]*"
    token = f"{word}|{single}|{katakana}|{unspaced}|[{_EMOJI}]"
    if not java:
        return token
    apart = r"[\x00-&(-\-/;-@\[-^`{-\x7F]"
    plain = rf"[{common}]++(?={apart}|\.(?:{apart}|\z)|\z)"
    return rf"{plain}|(?=[a-z0-9_\x{{80}}-\x{{10FFFF}}])(?:{token})"


def tokenize(text: Column) -> Column:
    """Lower-cased word tokens of a text, in order; an empty array for a null text.

    Case folds one character to one character. A token longer than 255 characters is cut into
    pieces of that length; the check for one runs on the text, so ordinary rows skip the cut.
    """
    folded = F.lower(F.translate(F.coalesce(text, F.lit("")), "Σİ", "σi"))
    tokens = F.regexp_extract_all(folded, F.lit(token_pattern()), F.lit(0))
    cut = F.flatten(
        F.transform(
            tokens,
            lambda t: F.transform(
                F.sequence(F.lit(1), F.length(t), F.lit(MAX_TOKEN)), lambda at: F.substring(t, at, F.lit(MAX_TOKEN))
            ),
        )
    )
    has_long = F.coalesce(text, F.lit("")).rlike(rf"\A(?:\S{{0,{MAX_TOKEN}}}+\s++)*+\S{{{MAX_TOKEN + 1}}}")
    return F.when(has_long, cut).otherwise(tokens)


def bm25_idf(n_docs: Column, doc_freq: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - doc_freq + F.lit(0.5)) / (doc_freq + F.lit(0.5)))


def bm25_tf(tf: Column, doc_len: Column, avg_len: Column, k1: float, b: float) -> Column:
    """Saturating term frequency in (0, 1), discounted for fields longer than the average."""
    return tf / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * doc_len / avg_len))


def compact_length(doc_len: Column) -> Column:
    """A field length as a one-byte norm keeps it: exact below 40, then four significant bits."""
    over = doc_len - F.lit(24)
    shift = F.greatest(F.lit(0), F.length(F.bin(over)) - F.lit(4))
    rounded = F.lit(24) + F.call_function("shiftleft", F.call_function("shiftright", over, shift), shift)
    return F.when(doc_len < 40, doc_len).otherwise(rounded).cast("long")
