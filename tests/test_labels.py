"""The label before an amount, against a search of the whole text before it."""

from __future__ import annotations

import random
import re
import time

from sorrel.operators import factcheck as X


def test_labels_equal_a_search():
    rng = random.Random(3)
    for _ in range(20_000):
        head = "".join(rng.choices("売上高はのab、。\n\t 　:1", k=rng.randint(0, 40)))
        own = re.search(f"[^{re.escape(X.LABEL_STOP)}]{{0,{X.LABEL_MOST}}}$", head)
        assert X.label_of(head) == (own[0].rstrip(X.LABEL_TAIL) if own else ""), head


def test_a_label_is_no_search_of_the_whole_text():
    head, start = "売上高" * 1_000_000, time.perf_counter()
    assert X.label_of(head) == ("売上高" * 5) and time.perf_counter() - start < 0.05
