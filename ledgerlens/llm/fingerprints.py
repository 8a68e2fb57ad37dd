"""64-bit SimHash fingerprints of word shingles."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest as _hash

from ledgerlens.llm.common import WORD_PATTERN

SHINGLE = 3
SEED = 42
# shingles whose bits are counted at once: bounds memory on very long texts
CHUNK = 1 << 16
_WORD = re.compile(WORD_PATTERN.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as a signed 64-bit integer.

    A-Z are lower-cased; words are joined by one space into shingles, repeats included; fewer words than a
    shingle: the whole sequence; no word: 0. A bit is 1 if set in over half of the shingles' XXH64 (seed 42).
    """
    # bytes.lower changes A-Z only, and the separators are ASCII, so bytes split as code points do
    words = _WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(map((1).__add__, map(len, words))))
    begins = [0, *ends]
    last = max(len(words) - shingle, 0) + 1
    spans = list(zip(begins[:last], ends[min(shingle, len(words)) - 1:]))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(spans), CHUNK):
        h = np.array([_hash(line[b:e - 1], SEED) for b, e in spans[i:i + CHUNK]], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(spans)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprint_udf(shingle: int = SHINGLE):
    @F.pandas_udf(LongType())
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in text], dtype="int64")
    return of
