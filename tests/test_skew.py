from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from webloom.operators.skew import hot_keys, split_by_keys


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(weights=st.lists(st.integers(0, 5000), min_size=1, max_size=60),
       max_keys=st.integers(1, 20), min_rows=st.integers(0, 50))
def test_hot_key_count_is_bounded(spark, weights, max_keys, min_rows):
    df = spark.createDataFrame(list(enumerate(weights)), "k long, w long")
    hot = {r.k for r in hot_keys(df, "k", "w", max_keys, min_rows).collect()}
    total = sum(weights)
    threshold = max(min_rows, -(-total // max_keys))
    assert hot == {k for k, w in enumerate(weights) if w > threshold}
    assert len(hot) < max_keys or total == 0


def test_split_by_hot_keys(spark):
    big = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 3 + [(3, "c")], "k long, v string")
    hot, cold = split_by_keys(big, "k", spark.createDataFrame([(1,)], "k long"), "k")
    assert hot.count() == 50 and cold.count() == 4
