"""States of parts merge to that of the whole, without reading the parts again."""

import numpy as np
import pytest

from tidemark.functions.storage import settle
from tidemark.operators import profile, profile_state


def sample(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 17 == 0 else float(x), int(i % 400), None if i % 29 == 0 else f"w{i % 37}" * (1 + i % 3), 2.5)
            for i, x in enumerate(rng.lognormal(0, 1, 5000) * 100)]
    return spark.createDataFrame(rows, "x double, k int, s string, c double")


def test_merged_state_tells_the_exact_profile(spark):
    df = sample(spark)
    parts = [df.where("k % 3 = 0"), df.where("k % 3 = 1"), df.where("k % 3 = 2"), df.limit(0)]
    merged = profile_state.merge_states(*[profile_state.profile_state(p) for p in parts])
    got = {r["column"]: r for r in profile_state.state_report(merged).collect()}
    once = {r["column"]: r for r in profile_state.state_report(profile_state.profile_state(df)).collect()}
    exact = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    for c, want in exact.items():
        for name in ("n", "missing", "min", "max", "zeros", "negatives"):
            assert got[c][name] == once[c][name] == want[name]
        for name in ("mean", "std", "skewness", "kurtosis"):
            for told in (got, once):
                assert told[c][name] == pytest.approx(want[name], rel=1e-9) if want[name] is not None else told[c][name] is None
        assert abs(got[c]["n_distinct"] - want["n_distinct"]) <= max(1, 0.03 * want["n_distinct"])
        values = np.sort([r[0] for r in df.select(c).na.drop().collect()])
        for q in profile_state.QUANTILES:
            value = got[c][f"p{round(100 * q)}"]
            low, high = np.searchsorted(values, value, "left") / len(values), np.searchsorted(values, value, "right") / len(values)
            assert low - 0.02 < q < high + 0.02
    text = profile.categorical_profile(df).first()
    assert (got["s"]["n"], got["s"]["missing"], got["s"]["min_length"], got["s"]["max_length"]) == tuple(
        text[k] for k in ("n", "missing", "min_length", "max_length")
    )


def test_a_second_part_is_added_without_the_first(spark, tmp_path):
    df = sample(spark)
    path = str(tmp_path / "first")
    df.where("k < 200").write.parquet(path)
    state = settle(profile_state.profile_state(spark.read.parquet(path)), "state")
    both = profile_state.merge_states(state, profile_state.profile_state(df.where("k >= 200")))
    assert not any("first" in f.split("/")[-2] for f in both.inputFiles())
    assert {r["column"]: r["n"] for r in both.collect()}["k"] == 5000


def test_empty_and_missing(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    got = {r["column"]: r for r in profile_state.state_report(profile_state.profile_state(df)).collect()}
    assert got["x"]["missing"] == 2 and got["x"]["mean"] is None and got["x"]["p50"] is None and got["s"]["n_distinct"] == 0
