"""Character classes and row-local text functions of the Tibetan script, as Spark columns.

Null in, null out. Lengths and places count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TSHEG, SHAD = "་", "།"
#: The block, the punctuation that spacing looks at, and what ends a syllable.
BLOCK = r"\x{0F00}-\x{0FFF}"
PUNCTUATION_RANGES = ((0x0F04, 0x0F0A), (0x0F0D, 0x0F1F), (0x0F34, 0x0F34), (0x0F36, 0x0F36), (0x0F38, 0x0F38), (0x0F3A, 0x0F3F))
DELIMITERS = "་།༎༏༐༑༔ \n\t"
MARKS = ("༷", "༹")
UTTERANCE = "<utt>"
#: What (?U)\s matches.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

PUNCTUATION = frozenset(chr(c) for a, b in PUNCTUATION_RANGES for c in range(a, b + 1))
_PUNCTUATION_CLASS = "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in PUNCTUATION_RANGES)


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chars(text: Column) -> Column:
    """The characters; none for an empty text."""
    return F.when(F.length(text) > 0, F.split(text, "")).when(text.isNotNull(), F.array().cast("array<string>"))


def is_script_char(char: Column) -> Column:
    return char.rlike(f"^[{BLOCK}]$")


def is_punctuation(char: Column) -> Column:
    return char.rlike(f"^[{_PUNCTUATION_CLASS}]$")


def keep_script(text: Column) -> Column:
    """Only characters of the block and ASCII spaces."""
    return F.regexp_replace(text, f"[^{BLOCK} ]", "")


def space_after_double_shad(text: Column) -> Column:
    return F.regexp_replace(text, f"{SHAD}{SHAD}(?=[^ {SHAD}])", f"{SHAD}{SHAD} ")


def join_marks(text: Column) -> Column:
    """Spaces that a tokeniser put around the two marks go: one on each side at most."""
    for mark in MARKS:
        for found in (f" {mark} ", f" {mark}", f"{mark} "):
            text = F.replace(text, F.lit(found), F.lit(mark))
    return text


def collapse_tshegs(text: Column) -> Column:
    return F.regexp_replace(text, f"{TSHEG}{{2,}}", TSHEG)


def space_after_shad(text: Column) -> Column:
    """A space after each shad that neither a shad nor white space follows, the last character included."""
    return F.regexp_replace(text, rf"(?U){SHAD}(?![{SHAD}\s])", f"{SHAD} ")


#: What each variant turns into a shad: in files of finished predictions, and while normalising.
FILE_SHADS, MODE_SHADS = ("༑", "༏"), ("༑", "༎")


def _shads(text: Column, shads: tuple[str, ...]) -> Column:
    for s in shads:
        text = F.replace(text, F.lit(s), F.lit(SHAD))
    return text


def fix_punctuation(text: Column, shads: tuple[str, ...] = MODE_SHADS) -> Column:
    return collapse_tshegs(space_after_shad(_shads(text, shads)))


def fix_whole_punctuation(text: Column, shads: tuple[str, ...] = FILE_SHADS) -> Column:
    """fix_punctuation of a whole file's text at once: a shad before a line break has white space after it already."""
    return fix_punctuation(text, shads)


def fix_line_of_file(text: Column, last: Column, shads: tuple[str, ...] = FILE_SHADS) -> Column:
    """The same line by line: only the file's last line (without a break after it) gets a space after a shad at its end."""
    out = fix_punctuation(text, shads)
    return F.when(last | ~out.endswith(f"{SHAD} ") | text.endswith(" "), out).otherwise(F.rtrim(out))


def count_of(text: Column, part: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def punctuation_changes(text: Column, shads: tuple[str, ...] = FILE_SHADS) -> Column:
    """The change log of fix_punctuation: an array of type, from, to, count, without the changes that didn't occur."""
    shad = _shads(text, shads)
    spaced = space_after_shad(shad)
    entry = lambda kind, a, b, n: F.struct(F.lit(kind).alias("type"), F.lit(a).alias("from"), F.lit(b).alias("to"), n.cast("long").alias("count"))
    log = [entry("punctuation", s, SHAD, count_of(text, s)) for s in shads]
    log.append(entry("spacing", SHAD, f"{SHAD} ", count_of(spaced, f"{SHAD} ") - count_of(shad, f"{SHAD} ")))
    log.append(entry("punctuation", TSHEG * 2, TSHEG, F.length(spaced) - F.length(collapse_tshegs(spaced))))
    return F.filter(F.array(*log), lambda x: x["count"] > 0)


def syllables(text: Column) -> Column:
    """Cut after each tsheg; a rest without a letter is dropped."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s)[^{TSHEG}]*{TSHEG}|[^{TSHEG}]+$"), F.lit(0))
    return F.filter(parts, lambda x: x.endswith(TSHEG) | (strip(x) != ""))


def syllable_spans(text: Column) -> Column:
    """Texts of the syllables with their delimiter; a delimiter with nothing before it has none."""
    return F.regexp_extract_all(text, F.lit(f"[^{DELIMITERS}]+[{DELIMITERS}]"), F.lit(0))


def boundaries(text: Column) -> Column:
    """Places (from 0) of the delimiters."""
    c = chars(text)
    return F.array_compact(F.transform(c, lambda x, i: F.when(F.lit(DELIMITERS).contains(x), i)))


def places_of(text: Column, char: str) -> Column:
    """Places (from 0) of a character."""
    return F.array_compact(F.transform(chars(text), lambda x, i: F.when(x == char, i)))


def detach_utterance(text: Column) -> tuple[Column, Column]:
    """The text without the utterance mark, stripped, and whether it had one."""
    has = text.contains(UTTERANCE)
    return F.when(has, strip(F.replace(text, F.lit(UTTERANCE), F.lit("")))).otherwise(text), has


def attach_utterance(text: Column, has: Column) -> Column:
    return F.when(has, F.concat(text, F.lit(f" {UTTERANCE}"))).otherwise(text)


def spaced_chars(text: Column) -> Column:
    """Stripped, one space between the characters: a line of the corpus of a character language model."""
    return F.array_join(chars(strip(text)), " ")
