import random
import re
import time

import numpy as np
import pytest

from pactline.llm.toxic_channel import SIZE, Restorer

PLAIN = re.compile(r"^([^\w@$!|+]*)(.*?)([^\w@$]*|[$@!|+]{2,}[^\w]*)$", re.S)


def test_edges_equal_the_pattern_they_state():
    r = random.Random(6)
    for _ in range(60_000):
        t = "".join(r.choice("aé_0@$!|+.-,(*") for _ in range(r.randrange(1, 10)))
        assert Restorer.edges(t) == PLAIN.match(t).groups(), t


@pytest.mark.parametrize("t", [c * 100_000 + e for c in "!@$|+.-*,(_~#" for e in ("", "a")] + ["a" + c * 100_000 + "b" for c in "!@.-*,_"]
                         + ["!." * 50_000 + "a", "a" + "@!" * 50_000, "a." * 50_000, ". " * 50_000, "a" + ". " * 50_000 + "b"], ids=lambda t: f"{t[:3]}~{t[-2:]}")
def test_long_runs_of_signs_take_linear_time(t):
    own = Restorer(np.ones(SIZE ** 4, np.float32))
    start = time.time()
    own.text(t)
    assert time.time() - start < 5
