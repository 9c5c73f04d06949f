"""Phonetic keys: words that sound alike share one."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spellings and the sound they stand for, applied in order to a lower-case word.
SOUNDS = (
    ("^(?:kn|gn|pn)", "n"), ("^wr", "r"), ("^x", "s"), ("^wh", "w"), ("mb$", "m"), ("tch|sch|sh", "x"), ("ch", "x"), ("ph", "f"), ("gh(?=[^aeiou]|$)", ""), ("th", "0"), ("ck", "k"), ("c(?=[eiy])", "s"), ("c", "k"),
    ("dg(?=[eiy])", "j"), ("g(?=[eiy])", "j"), ("g", "k"), ("q", "k"), ("x(?=[aeiou])", "x"), ("v", "f"), ("z", "s"), ("d", "t"), ("b$", "p"), ("w(?![aeiou])|y(?![aeiou])|h(?![aeiou])", ""),
)


def sound_key(word: str) -> str:
    """Consonant sounds of a word, its first vowel kept."""
    w = re.sub(r"[^a-z]", "", word.lower())
    for pattern, sound in SOUNDS:
        w = re.sub(pattern, sound, w)
    w = w[:1] + re.sub(r"[aeiou]", "", w[1:])
    return re.sub(r"(.)\1+", r"\1", w).upper()[:6]


def sounds_like(c: Column) -> Column:
    """sound_key of each word of a text; a batched Python function. soundex() is the built-in that stays in the JVM."""

    @F.pandas_udf(StringType())
    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else " ".join(filter(None, map(sound_key, t.split()))))

    return keys(c)
