"""A registered query scores words with two words of context."""

import math

import pytest

from tidewater.llm.queries import QUERIES


def test_third_order_is_registered(spark, tmp_path):
    texts = ["a b c", "a b c", "x b d", "y b d", "z b d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_backoff_trigrams"](spark, str(tmp_path)).collect()}
    # b is seen 5 times among 15 words; a b twice, and always before c: a bigram model would give c 2 of 5
    assert got[0].log10_score == pytest.approx(math.log10(2 / 15) + math.log10(2 / 2) + math.log10(2 / 2), abs=1e-4)
    # x b once, so b backs off to 5 of 15; x b d once, so d backs off to b d, 3 of 5
    assert got[2].log10_score == pytest.approx(math.log10(1 / 15) + math.log10(0.4 * 5 / 15) + math.log10(0.4 * 3 / 5), abs=1e-4)
    assert (got[0].n_seen, got[2].n_seen) == (2, 1)
