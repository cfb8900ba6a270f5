"""Left-to-right text operations that no composition of built-in functions states well, and their Arrow UDFs.

The plain functions take and give Python values; the UDFs take columns. Null in, null out.
"""

from __future__ import annotations

import re
import struct
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ductus.functions.draws import draw, draws, many_draws
from ductus.functions.script import DELIMITERS, PUNCTUATION, SHAD, TSHEG, UTTERANCE, WHITE_SPACE

DOUBLE = SHAD * 2


_BETWEEN = re.compile(f"(?<=[{''.join(sorted(PUNCTUATION))}]) +(?=[{''.join(sorted(PUNCTUATION))}])")


def space_punctuation(text: str) -> str:
    """Without the spaces between two punctuation marks, but the first one after a double shad stays."""
    out: list[str] = []
    start, tail = 0, ""
    for m in _BETWEEN.finditer(text):
        out.append(text[start : m.start()])
        tail = (tail + out[-1])[-2:]
        if tail == DOUBLE:
            out.append(" ")
            tail = f"{SHAD} "
        start = m.end()
    return "".join([*out, text[start:]]) if start else text


def split_unsegmented(text: str, longest: int) -> list[str]:
    """Chunks cut at the last shad, else tsheg, else space once `longest` characters have come together."""
    out: list[str] = []
    start, n = 0, len(text)
    while start + longest <= n:
        end = start + longest
        cut = next((at for mark in (SHAD, TSHEG, " ") if (at := text.rfind(mark, start + 1, end)) > 0), 0)
        if not cut:  # the next mark is the first that can be cut at
            cut = min((at for mark in (SHAD, TSHEG, " ") if (at := text.find(mark, end)) >= 0), default=n)
        if cut == n:
            break
        head = text[start : cut + 1]
        out.append(head.strip() + (" " if head.endswith(DOUBLE) else ""))
        start = cut + 1
    rest = text[start:].strip()
    return [*out, rest] if rest else out


def pack_units(units: list[str], longest: int) -> list[str]:
    """Lines of units joined by a space, each filled while it stays within `longest`."""
    out: list[str] = []
    line, size = [], 0
    for u in units:
        if line and size + 1 + len(u) > longest:
            out.append(" ".join(line))
            line, size = [], 0
        size += len(u) + (1 if line else 0)
        line.append(u)
    return [*out, " ".join(line)] if line else out


def pack_chunks(text: str, longest: int) -> list[str]:
    """Lines of the chunks of an unsegmented text; no space is added after a chunk that ends in a double shad."""
    out: list[str] = []
    now = ""
    for chunk in split_unsegmented(text, longest):
        more = (now if now.endswith(DOUBLE + " ") else now + " ") + chunk if now else chunk
        if now and len(more) > longest:
            out.append(now.rstrip())
            now = chunk
        else:
            now = more
    return [*out, now.strip()] if now.strip() else out


def merge_short(found: list[str], shortest: int, longest: int) -> list[str]:
    """A line below `shortest` takes in the lines after it while it stays within `longest`, until it is long enough."""
    out: list[str] = []
    i = 0
    while i < len(found):
        line = found[i]
        i += 1
        while len(line) < shortest and i < len(found):
            more = line + ("" if line.endswith(DOUBLE + " ") else " ") + found[i]
            if len(more) > longest:
                break
            line = more
            i += 1
        out.append(line)
    return out


def reflow(text: str, shortest: int, longest: int, segmented: bool) -> list[str]:
    """A cleaned text as lines of a wanted length."""
    found = pack_units(text.split(), longest) if segmented else pack_chunks(text, longest)
    return merge_short(found, shortest, longest)


def expand(text: str, rules: list[tuple[str, str]]) -> str:
    """Replacements one after another in the order of the rules, each seeing what the ones before have made."""
    for abbreviation, expansion in rules:
        if abbreviation in text:
            text = text.replace(abbreviation, expansion)
    return text


def swap(units: list[str], chance: float, seed: int, key: str) -> list[str]:
    """Neighbours swapped left to right without overlap, each pair that is reached with the given chance."""
    units, i = list(units), 0
    while i < len(units) - 1:
        if draw(seed, key, i) < chance:
            units[i], units[i + 1] = units[i + 1], units[i]
            i += 1
        i += 1
    return units


def swap_line(text: str, chance: float, segmented: bool, seed: int, key: str) -> str:
    """swap() over the words or the syllables of a line; the utterance mark is put aside and back."""
    has = UTTERANCE in text
    body = text.replace(UTTERANCE, "").strip() if has else text
    if segmented:
        units = body.split()
    else:
        units = [x + TSHEG for x in body.split(TSHEG)]
        last = units.pop()[:-1]
        units += [last] if last.strip() else []
    if len(units) >= 2:
        body = (" " if segmented else "").join(swap(units, chance, seed, key))
    return f"{body} {UTTERANCE}" if has else body


def chosen(n: int, k: int, seed: int, key: str) -> set[int]:
    """k of n places, drawn without replacement."""
    if not k:
        return set()
    if n > 200:
        return set(np.argsort(draws(seed, key, n), kind="stable")[:k].tolist())
    head, m = f"{seed}:{key}:", -(-n // 4)
    u = struct.unpack(f">{4 * m}I", b"".join([md5(f"{head}{i}".encode()).digest() for i in range(m)]))
    return {u.index(min(u[:n]))} if k == 1 else set(sorted(range(n), key=u.__getitem__)[:k])


def how_many(n: int, ratio: float, seed: int, key: str) -> int:
    """int(n ratio); where that is nothing, one with the chance of the ratio."""
    k = int(n * ratio)
    return k if k or not n else int(draw(seed, key, "one") < ratio)


def replace_some(text: str, part: str, other: str, ratio: float, seed: int, key: str) -> str:
    """A share of the occurrences of a character or digraph replaced (left to right, not overlapping)."""
    n = text.count(part)
    if not n:
        return text
    k = how_many(n, ratio, seed, key)
    if not k:
        return text
    pieces = text.split(part)
    taken = chosen(n, k, seed, key)
    return pieces[0] + "".join([(other if i in taken else part) + p for i, p in enumerate(pieces[1:])])


def insert_noise(text: str, chance: float, alphabet: str, seed: int, key: str) -> str:
    """After each character, with the chance, one character of the alphabet."""
    u = draws(seed, key, len(text))
    out, start = [], 0
    for i in np.flatnonzero(u < chance).tolist():
        out.append(text[start : i + 1])
        out.append(alphabet[int(u[i] / chance * len(alphabet))])
        start = i + 1
    return "".join([*out, text[start:]])


_SPAN, _DELIMITER = re.compile(f"[^{DELIMITERS}]+[{DELIMITERS}]"), re.compile(f"[{DELIMITERS}]")


def _spans(text: str) -> tuple[list[str], str]:
    """Syllables with their delimiter, and what follows the last delimiter."""
    last = max(map(text.rfind, DELIMITERS))
    return _SPAN.findall(text), text[last + 1 :]


def _n_boundaries(text: str) -> int:
    return len(_DELIMITER.findall(text))


def delete_syllables(text: str, ratio: float, seed: int, key: str) -> str:
    """Without a share of the syllables, one at least where there are two boundaries, and never all."""
    spans, tail = _spans(text)
    if _n_boundaries(text) < 2 or not spans:
        return text
    k = min(max(1, int(len(spans) * ratio)), len(spans) - 1)
    gone = chosen(len(spans), k, seed, key)
    return "".join(s for i, s in enumerate(spans) if i not in gone) + tail


def double_syllables(text: str, ratio: float, seed: int, key: str) -> str:
    """A share of the syllables said twice; the copy comes after the delimiter and has none of its own."""
    spans, tail = _spans(text)
    if _n_boundaries(text) < 2 or not spans:
        return text
    k = min(max(1, int(len(spans) * ratio)), len(spans))
    twice = chosen(len(spans), k, seed, key)
    return "".join(s + s.rstrip(DELIMITERS) if i in twice else s for i, s in enumerate(spans)) + tail


#: The one-way character rules in their order, then gigu both ways, then digraphs both ways.
LETTER_RULES = ("འབ", "སཔ", "ེི", "ལཡ", "ཕམ", "གང", "ཀག", "ཅཆ", "ནམ", "ཐད", "ཐཏ", "ཕཔ", "ཤས", "ཞཟ", "ྱྲ")
GIGU_RULES = ("ྀི", "ིྀ")
DIGRAPH_RULES = (("དྱ", "གྱ"), ("གྱ", "དྱ"))


def rule_noise(text: str, letters: float, syllable_share: float, seed: int, key: str) -> str:
    """All substitution rules, each over what the one before has made, then syllables dropped or doubled."""
    steps = [*(tuple(r) for r in LETTER_RULES + GIGU_RULES), *DIGRAPH_RULES]
    for i, (a, b) in enumerate(steps):
        text = replace_some(text, a, b, letters, seed, f"{key}:{i}")
    change = delete_syllables if draw(seed, key, "coin") < 0.5 else double_syllables
    return change(text, syllable_share, seed, f"{key}:{len(steps)}")


def _texts(f, kind=T.StringType(), once: bool = False):
    """An Arrow UDF of a text (and a key) from a plain function; once: not to be copied into filters above it."""
    arrow = pa.list_(pa.string()) if isinstance(kind, T.ArrayType) else pa.string()

    @F.arrow_udf(kind)
    def one(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in texts.to_pylist()], arrow)

    @F.arrow_udf(kind)
    def keyed(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x, k) for x, k in zip(texts.to_pylist(), keys.to_pylist())], arrow)

    if once:
        one = one.asNondeterministic()
    return lambda text, key=None: one(text) if key is None else keyed(text, key)


_LINES = T.ArrayType(T.StringType())


def spaced_punctuation(text: Column) -> Column:
    return _texts(space_punctuation, once=True)(text)


def unsegmented_chunks(text: Column, longest: int) -> Column:
    return _texts(lambda x: split_unsegmented(x, longest), _LINES)(text)


def reflowed(text: Column, shortest: int, longest: int, segmented: bool) -> Column:
    return _texts(lambda x: reflow(x, shortest, longest, segmented), _LINES)(text)


def swapped(text: Column, key: Column, chance: float, segmented: bool, seed: int) -> Column:
    return _texts(lambda x, k: swap_line(x, chance, segmented, seed, k))(text, key)


def syllables_deleted(text: Column, key: Column, ratio: float, seed: int) -> Column:
    return _texts(lambda x, k: delete_syllables(x, ratio, seed, k))(text, key)


def syllables_doubled(text: Column, key: Column, ratio: float, seed: int) -> Column:
    return _texts(lambda x, k: double_syllables(x, ratio, seed, k))(text, key)


def some_replaced(text: Column, key: Column, part: str, other: str, ratio: float, seed: int) -> Column:
    return _texts(lambda x, k: replace_some(x, part, other, ratio, seed, k))(text, key)


def insert_noises(texts: list[str], chance: float, alphabet: str, seed: int, keys: list[str]) -> list[str]:
    """insert_noise() of many texts."""
    n = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    u = many_draws(seed, keys, n) / 4294967296.0
    at = np.flatnonzero(u < chance)
    letters = np.frombuffer(alphabet.encode("utf-32-le"), "<u4")
    out = np.insert(codes, at + 1, letters[(u[at] / chance * len(alphabet)).astype(np.int64)]) if len(at) else codes
    ends = np.cumsum(n)
    stops = (ends + np.searchsorted(at, ends)).tolist()
    whole = out.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip([0, *stops], stops)]


#: Characters that are worked on at once.
_PIECE = 2_000_000


def _batches(f):
    """An Arrow UDF of a text and a key from a function of lists of texts and keys."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        given, names, out = texts.to_pylist(), keys.to_pylist(), []
        pieces = np.cumsum([len(x or "") for x in given]) // _PIECE
        for i in np.unique(pieces, return_index=True)[1].tolist():
            end = int(np.searchsorted(pieces, pieces[i], "right"))
            out += f([x or "" for x in given[i:end]], names[i:end])
        return pa.array([None if x is None else y for x, y in zip(given, out)], pa.string())

    return run


def noisy(text: Column, key: Column, chance: float, alphabet: str, seed: int) -> Column:
    return _batches(lambda x, k: insert_noises(x, chance, alphabet, seed, k))(text, key)


def rule_noises(texts: list[str], letters: float, syllable_share: float, seed: int, keys: list[str]) -> list[str]:
    """rule_noise() of many texts: each rule, which keeps lengths, over the letters of all of them."""
    n = np.array([len(t) for t in texts], np.int64)
    ends, codes = np.cumsum(n), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    steps = [*(tuple(r) for r in LETTER_RULES + GIGU_RULES), *DIGRAPH_RULES]
    for i, (a, b) in enumerate(steps):
        at = np.flatnonzero(codes == ord(a[0]))
        line = np.searchsorted(ends, at, "right")
        for j in range(1, len(a)):
            inside = at + j < ends[line]
            at, line = at[inside], line[inside]
            same = codes[at + j] == ord(a[j])
            at, line = at[same], line[same]
        found = np.bincount(line, minlength=len(texts))
        k = (found * letters).astype(np.int64)
        for r in np.flatnonzero((k == 0) & (found > 0)).tolist():
            k[r] = how_many(int(found[r]), letters, seed, f"{keys[r]}:{i}")
        some = np.flatnonzero(k)
        kept = k[line] > 0
        at, line = at[kept], line[kept]
        order = np.lexsort((many_draws(seed, [f"{keys[r]}:{i}" for r in some.tolist()], found[some]), line))
        first = np.searchsorted(line, line)
        taken = at[order[np.arange(len(line)) - first < k[line]]]
        for j, c in enumerate(b):
            codes[taken + j] = ord(c)
    whole, stops = codes.tobytes().decode("utf-32-le", "surrogatepass"), ends.tolist()
    out = []
    for start, stop, key in zip([0, *stops], stops, keys):
        change = delete_syllables if draw(seed, key, "coin") < 0.5 else double_syllables
        out.append(change(whole[start:stop], syllable_share, seed, f"{key}:{len(steps)}"))
    return out


def rule_noised(text: Column, key: Column, letters: float, syllable_share: float, seed: int) -> Column:
    return _batches(lambda x, k: rule_noises(x, letters, syllable_share, seed, k))(text, key)


def expanded(text: Column, rules: list[tuple[str, str]]) -> Column:
    return _texts(lambda x: expand(x, rules))(text)


_SHAD_ALONE = re.compile(f"{SHAD}(?![{SHAD}{WHITE_SPACE}])")
_TSHEGS = re.compile(f"{TSHEG}{{2,}}")


def postprocess(text: str, rules: list[tuple[str, str]], shads: tuple[str, ...]) -> tuple[str, list[int]]:
    """The text with its rules and punctuation, and how often each rule, each shad, the spaces and the tshegs changed it."""
    counts = []
    for abbreviation, expansion in rules:
        counts.append(text.count(abbreviation) if abbreviation else 0)
        if counts[-1]:
            text = text.replace(abbreviation, expansion)
    for s in shads:
        counts.append(text.count(s))
    for s in shads:
        text = text.replace(s, SHAD)
    spaced = _SHAD_ALONE.sub(f"{SHAD} ", text)
    out = _TSHEGS.sub(TSHEG, spaced)
    return out, [*counts, spaced.count(f"{SHAD} ") - text.count(f"{SHAD} "), len(spaced) - len(out)]


_CHANGE = T.StructType([T.StructField(c, T.StringType(), False) for c in ("type", "from", "to")] + [T.StructField("count", T.LongType())])


def postprocessed(text: Column, rules: list[tuple[str, str]], shads: tuple[str, ...]) -> Column:
    """normalised, and changes: type, from, to and count of what changed it; none of a null text."""
    kinds = [("abbreviation", a, e) for a, e in rules] + [("punctuation", s, SHAD) for s in shads]
    kinds += [("spacing", SHAD, f"{SHAD} "), ("punctuation", TSHEG * 2, TSHEG)]

    @F.arrow_udf(T.StructType([T.StructField("normalised", T.StringType()), T.StructField("changes", T.ArrayType(_CHANGE, False))]))
    def run(texts: pa.Array) -> pa.Array:
        out, which, counts, ends = [], [], [], [0]
        for t in texts.to_pylist():
            done, found = (None, []) if t is None else postprocess(t, rules, shads)
            out.append(done)
            for i, n in enumerate(found):
                if n > 0:
                    which.append(i)
                    counts.append(n)
            ends.append(len(which))
        at = pa.array(which, pa.int32())
        parts = [pa.array([k[i] for k in kinds], pa.string()).take(at) for i in range(3)]
        changes = pa.StructArray.from_arrays([*parts, pa.array(counts, pa.int64())], ["type", "from", "to", "count"])
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), changes)], ["normalised", "changes"])

    return run.asNondeterministic()(text)


_OTHER, _DOUBLE_SHAD = re.compile("[^\u0f00-\u0fff ]+"), re.compile(f"{DOUBLE}(?=[^ {SHAD}])")


def clean(text: str) -> str:
    """Script characters only, spaces after double shads, none between punctuation marks."""
    return space_punctuation(_DOUBLE_SHAD.sub(f"{DOUBLE} ", _OTHER.sub("", text.strip(WHITE_SPACE))))


def cleaned(text: Column, strip: bool = False) -> Column:
    """clean(); with `strip`, without white space at the ends."""
    return _texts((lambda x: clean(x).strip(WHITE_SPACE)) if strip else clean, once=True)(text)
