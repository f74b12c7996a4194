import random

import pytest
from pyspark.sql import functions as F

from pactline.llm import secret_scan as ss


@pytest.mark.parametrize("size", [1, 2, 3, 10])
def test_keys_of_sparse_cells_are_kept(llm_spark, size):
    r = random.Random(size)
    keys = llm_spark.createDataFrame([(f"cell{i}", size, r.random()) for i in range(2000) for _ in range(size)], "enc string, band int, p double")
    kept = keys.join(ss.cuts(keys), ["enc", "band"]).where(F.col("p") >= F.col("cut")).count()
    assert kept / keys.count() > 0.95, kept / keys.count()


@pytest.mark.parametrize("size", [1, 2, 3, 10])
def test_ordinary_tokens_of_sparse_cells_are_not(llm_spark, size):
    r = random.Random(size)
    tokens = llm_spark.createDataFrame([(f"cell{i}", size, 10 ** -r.uniform(3, 12)) for i in range(500) for _ in range(size)], "enc string, band int, p double")
    assert tokens.join(ss.cuts(tokens), ["enc", "band"]).where(F.col("p") >= F.col("cut")).count() == 0
