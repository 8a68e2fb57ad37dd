"""Per-document counts that the quality rules and the quality classifier read."""

from __future__ import annotations

from itertools import repeat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlens.llm.common import WORD

# fixed values of the contract
SYMBOLS = "#*$%&|<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_short", "n_chars",
         "n_distinct", "longest_run", "n_enders")


def repeated_words(words: list[str], n: int = 3) -> int:
    """Words inside n-word windows found twice or more in the text, the first find included."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    inside = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in twice:
            inside[i:i + n] = b"\x01" * n
    return sum(inside)


def longest_run(words: list[str]) -> int:
    """Most times that one word stands in a row."""
    best = now = 1 if words else 0
    for same in map(str.__eq__, words, words[1:]):
        now = now + 1 if same else 1
        if now > best:
            best = now
    return best


def text_stats(text: str | None) -> tuple[int, ...]:
    """All counts of one text; a null text counts as empty. In the order of ``STATS``."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    lowered = text.lower()
    # letters that have another lower-case form
    upper = len(text) - sum(map(str.__eq__, text, lowered)) if len(lowered) == len(text) else sum(map(str.isupper, text))
    short = sum(map((4).__gt__, map(len, words)))
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines),
            upper, sum(map(text.count, "0123456789")), sum(map(text.count, "!?")), short, len(text), len(set(words)), longest_run(words),
            sum(map(str.endswith, words, repeat((".", ",", ";", ":")))))


@F.pandas_udf(StructType([StructField(c, LongType()) for c in STATS]))
def stats_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in text], columns=list(STATS), dtype="int64")
