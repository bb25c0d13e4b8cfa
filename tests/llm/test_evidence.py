"""Evidence of texts with very many segments."""

import math

from tidemark.llm import toxicity


def test_all_segments_count():
    n = 40_000
    e = toxicity.evidence([5.0] * 60, n, 1.0, math.exp(8) / n)
    assert e > 300 and e > toxicity.evidence([5.0] * 50, n, 1.0, math.exp(8) / n)
