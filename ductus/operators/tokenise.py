"""Word tokenisation with a tokenizer of one's own, and the repair of its output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductus.functions import script
from ductus.functions.script import SHAD, TSHEG


class LongestMatch:
    """Tokens are the longest runs of syllables in a word list; a single syllable otherwise; shads stand alone."""

    def __init__(self, words: list[str], longest: int = 6):
        self.words, self.longest = {w.rstrip(TSHEG) for w in words}, longest
        self.starts = {w.partition(TSHEG)[0] for w in self.words}

    def __call__(self, text: str) -> list[str]:
        out: list[str] = []
        for run in text.replace(SHAD, f" {SHAD} ").split():
            syllables = [x + TSHEG for x in run.split(TSHEG)]
            syllables[-1] = syllables[-1][:-1]
            syllables = [s for s in syllables if s]
            i = 0
            while i < len(syllables):
                n = 1
                if syllables[i].rstrip(TSHEG) in self.starts:
                    n = next((n for n in range(min(self.longest, len(syllables) - i), 1, -1) if "".join(syllables[i : i + n]).rstrip(TSHEG) in self.words), 1)
                out.append(syllables[i] if n == 1 else "".join(syllables[i : i + n]))
                i += n
        return out


def tokenise(df: DataFrame, tokenizer: Callable[[str], list[str]], text: str = "text") -> DataFrame:
    """df with `tokenised` (tokens joined by a space, marks repaired) and `error` (null where it worked).

    A line that the tokenizer can't read stays as it is; blank lines aren't given to it.
    """

    @F.arrow_udf("tokenised string, error string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            done, errors = [], []
            for t in texts.to_pylist():
                try:
                    done.append(t if t is None or not t.strip() else " ".join(tokenizer(t)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  the line is kept and the error told
                    done.append(t)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.StructArray.from_arrays([pa.array(done, pa.string()), pa.array(errors, pa.string())], ["tokenised", "error"])

    out = df.withColumn("__x", run.asNondeterministic()(F.col(text)))
    return out.select(*df.columns, F.when(F.col("__x.error").isNull(), script.join_marks(F.col("__x.tokenised"))).otherwise(F.col(text)).alias("tokenised"), F.col("__x.error").alias("error"))
