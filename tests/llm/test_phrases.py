"""Phrase mining against direct counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, f long, a int, rank int, n string, body binary"


def counted(rows):
    """Counts of all phrases of one to five words, and of words, by language."""
    out, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    out[lang, tuple(w[i : i + m])] += 1
    return out, totals


def told(rows, support, top):
    counts, totals = counted(rows)
    found = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < support:
            continue
        longer = any(
            q_lang == lang and len(q) > len(p) and f >= support and 100 * f >= 100 * a
            and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (q_lang, q), f in counts.items() if len(q) > len(p) and f >= support
        )
        if not longer:
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.setdefault(lang, []).append(
                (-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], totals[lang])
            )
    return {
        (lang, rank): (p.decode(), -a, l, r, n, -score)
        for lang, all_of in found.items()
        for rank, (score, a, p, l, r, n) in enumerate(sorted(all_of)[:top], 1)
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["ox", "Hen", "cat", "é", "İ", "don't", "x\xa0y", "a\x1fb"] + [f"w{i}" for i in range(30)]
    fixed = ["red Ox runs far away", "red ox runs", "once upon a time there", "a a a a a a"]
    out = []
    for i in range(400):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(fixed))
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for p in parts)
        out.append((rng.choice([i, None]), text, rng.choice(["en", "en", "de", None, "und"])))
    out += [(1, None, "en"), (2, "", "en"), (3, " \t.\n", None), (4, "only", "fr")]
    out += [(900, "copy of one text with words", "de")] * 30
    # Words that only one document has, many times: a sample without it misses them all.
    out += [(5000 + i, f"rare{i} pair{i} here{i} now{i} ever{i}. " * 40, "es") for i in range(12)]
    return out


def collect(df):
    return {(r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, 3, "n", b"z") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("sample", [1, 3, 40])
def test_equal_to_direct_counts(spark, rows, sample):
    df = frame(spark, rows)
    assert collect(phrases.collocations(df, 20, 25, sample)) == told(rows, 20, 25)


def test_frequent_phrases_are_exact(spark, rows):
    got = {(r["lang"], r["phrase"]): r["f"] for r in phrases.frequent_phrases(frame(spark, rows), 20, 7).collect()}
    counts, totals = counted(rows)
    want = {(lang, " ".join(p)): f for (lang, p), f in counts.items() if f >= 20}
    want.update({(lang, ""): n for lang, n in totals.items() if n})
    assert got == want


def test_long_texts_are_cut_between_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 500)
    bodies = [(t or "").encode() for _, t, _ in rows]
    for body in bodies + [b"no break at all " * 90, b"", b"." * 1200]:
        parts = list(phrases._cut(body))
        assert b"".join(parts) == body and all(p[-1:] in (b".", b",", b"\n") for p in parts[:-1] if p != body)
    one = " ".join(t or "" for _, t, _ in rows) + "."
    got = phrases.frequent_phrases(spark.createDataFrame([(1, one, "en"), (2, one, "en")], "doc_id long, text string, lang string"), 20, 1)
    counts, _ = counted([(1, one, "en")] * 2)
    assert got.count() == sum(f >= 20 for f in counts.values()) + 1


def test_full_filter_counts_all(rows):
    words = phrases.Words.of("en", [(t or "").encode() for _, t, lang in rows if lang == "en"])
    counts, _ = counted([r for r in rows if r[2] == "en"])
    for everything in (np.full(1 << (phrases.FILTER_BITS - 3), 255, np.uint8), None):
        got = Counter()
        for length, first, count in phrases.countable(words, everything, None, range(1, 6), 5):
            got.update(dict(zip(words.phrases(first, length).to_pylist(), count.tolist())))
        assert got == {" ".join(p): f for (_, p), f in counts.items()}


def test_empty(spark, rows):
    df = frame(spark, rows)
    assert phrases.collocations(df.filter(F.lit(False))).count() == 0
    assert phrases.collocations(df, support=10**6).count() == 0
