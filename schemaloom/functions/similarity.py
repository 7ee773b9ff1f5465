"""Names of fields: tokens, and the ratio of their longest common subsequence."""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Abbreviations and what they stand for.
ABBREVIATIONS = {
    "id": "identifier", "no": "number", "num": "number", "qty": "quantity", "uom": "unit",
    "dt": "date", "ts": "timestamp", "addr": "address",
}
_HUMP = re.compile(r"([a-z0-9])([A-Z])|([A-Z])(?=[A-Z][a-z])")


def name_tokens(name: str) -> list[str]:
    """The words of a name: split at humps, blanks, ``_``, ``-`` and ``/``; abbreviations written out."""
    apart = _HUMP.sub(lambda m: f"{m[1]} {m[2]}" if m[1] else f"{m[3]} ", unicodedata.normalize("NFKC", name))
    words = [w.casefold() for w in re.split(r"[\s_\-/]+", apart) if w]
    return [ABBREVIATIONS.get(w, w) for w in words]


def ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|), 1 for two empty texts; the subsequence is found with a bit for each place of ``a``."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two text columns, null texts as empty."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype=float)
