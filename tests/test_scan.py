"""The scan of bytes against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions import scan
from winnow.operators import catalog

LETTERS = ["a", "b", "ab", "é", "漢", "\U0001f600", "\U00010400", " ", ".", "-", "\0", "_", "1"]


@pytest.mark.parametrize("places", [7, 64, 1 << 17])
def test_scan_finds_what_python_finds(monkeypatch, places):
    monkeypatch.setattr(scan, "PLACES", places)
    rng, words = np.random.default_rng(places), np.array([c < 0x20000 and bool(re.match(r"\w", chr(c))) for c in range(scan.CODES)])
    said = lambda n: "".join(rng.choice(LETTERS, n))
    texts = [said(rng.integers(0, 60)) for _ in range(40)] + ["", "", "a", "é"]
    some = [(texts[rng.integers(0, 40)] if rng.random() < 0.7 else said(40))[rng.integers(0, 20) :][: rng.integers(1, 40)] for _ in range(400)]
    terms = sorted({(b, k > 0, k > 1) for b, k in zip(some, rng.integers(0, 3, len(some)).tolist(), strict=True) if b})

    def bound(t: str, i: int) -> bool:
        return (i > 0 and words[ord(t[i - 1])]) != (i < len(t) and words[ord(t[i])])

    def has(t: str, body: str, begins: bool, ends: bool) -> bool:
        at = [m.start() for m in re.finditer(f"(?={re.escape(body)})", t)]
        return any((not begins or bound(t, i)) and (not ends or bound(t, i + len(body))) for i in at)

    data, stops = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([len(t.encode()) for t in texts])
    want = np.array([[has(t, *x) for x in terms] for t in texts])
    assert (scan.Scanner(terms, words).find(data, stops) == want).all() and want.any(0).sum() > 100
    assert scan.Scanner([], words).find(data, stops).shape == (len(texts), 0)


def test_word_characters_are_the_engines(spark):
    said = ["a", "é", "_", "-", "́", "‍", "Ⅰ", "漢", "\U00010400", "\U0001f600", "\0", "٣", "⃝"]
    told = [r.w for r in spark.createDataFrame([(x,) for x in said], "s string").coalesce(1).select(F.col("s").rlike(r"(?U)\w").alias("w")).collect()]
    assert catalog.word_codes(spark)[[ord(x) for x in said]].tolist() == told and sum(told) > 5
