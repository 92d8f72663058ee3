"""The corpus pipeline: what each stage keeps, on the smallest data."""

from __future__ import annotations

import os
import random
import sys

import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from panelcast.llm import simhash  # noqa: E402
from panelcast.llm.common import documents, settle  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_pass_documents_on(spark):
    pytest.importorskip("public_tokenizers")
    docs = documents(spark, SF)
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, SF))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3]
    assert docs.filter(docs.text.contains("@mail")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == sizes[4] and "ids_sha256" in out.columns


def test_one_row_of_a_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(5, text), (3, text), (3, text), (9, "other " + text[:50]), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 9]


def test_near_copies_equal_all_pairs(spark):
    rng = random.Random(8)
    words = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(80, 900))]
        words.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"New{rng.randint(0, 9999)}"
            words.append(" ".join(copy).upper() if edits == 0 else "  ".join(copy))
    words += ["one two", "One two", "one two three", "", " ", "a a a a a", "a a a"]
    # An own reading of the contract: bits set in over half the hashes of lower-cased 3-word shingles.
    prints = []
    for text in words:
        w = "".join(c.lower() if c.isascii() else c for c in text).split()
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
        prints.append(sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)))
    root = list(range(len(words)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, x in enumerate(prints):
        for j, y in enumerate(prints[:i]):
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    want = sorted({find(i) for i in range(len(words))})
    assert len(want) < len(words) - 15
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    told = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert told == {i: (f"{x:016x}", find(i)) for i, x in enumerate(prints)}


CLASH = "doc_id long, text string, lang string, source string, n_chars long, place long, _doc string, fp long, root int, severity double, p_toxic double, use int, size int, passes string"


def test_stages_leave_clashing_columns_alone(spark):
    pytest.importorskip("public_tokenizers")
    rest = (777, "d", 5, 6, 0.25, 0.5, 7, 8, "p")
    rows = [(i, f"plain words number {i} of a small text " + "and more " * i, "en", "s", 3, *rest) for i in range(8)]
    rows += [(20, "y" * 400_000, "en", "s", 400_000, *rest), (None, None, None, None, None, *rest)]
    docs = spark.createDataFrame(rows, CLASH).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, SF))
        assert docs.columns == [c.split()[0] for c in CLASH.split(", ")]
        for r in docs.collect():
            assert tuple(r)[5:] == rest
    assert docs.filter("doc_id = 20").count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_stages_take_empty_tables(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_ids_are_no_row_identity(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (None, c), (2, c), (7, a), (7, d), (7, d), (1, d.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert got == sorted([(0, b), (2, c), (7, a), (1, d.upper())])
    two = spark.createDataFrame([(7, a), (7, b), (None, c), (None, d)], docs.schema)
    assert corpus_pipeline.drop_near_duplicates(spark, two, SF).count() == 4
