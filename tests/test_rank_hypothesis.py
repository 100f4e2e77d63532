"""The exact cut and rank against brute force on random small inputs."""

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tetrad.operators import rank

rows_st = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60)), min_size=1, max_size=60,
                   unique_by=lambda r: r[1])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st, cuts=st.lists(st.integers(0, 30), min_size=4, max_size=4),
       digits=st.sampled_from([1, 2]))
def test_first_n_equals_sorting(spark, rows, cuts, digits):
    import hashlib
    df = spark.createDataFrame(rows, "g int, id long").withColumn("k", rank.hash_key("id", 5))
    cut = spark.createDataFrame([(g, c) for g, c in enumerate(cuts)], "g int, cut long")
    got = {r.id for r in rank.first_n(df, "k", "id", cut, groups=["g"], digits=digits).collect()}
    want = set()
    for g in range(4):
        ids = sorted((hashlib.md5(f"{i}:5".encode()).hexdigest(), i) for gg, i in rows if gg == g)
        want |= {i for _, i in ids[:cuts[g]]}
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st, digits=st.sampled_from([1, 2]))
def test_exact_rank_equals_sorting(spark, rows, digits):
    import hashlib
    df = spark.createDataFrame(rows, "g int, id long").withColumn("k", rank.hash_key("id", 9))
    got = {(r.id, r["rank"]) for r in rank.exact_rank(df, "k", "id", groups=["g"], digits=digits).collect()}
    want = set()
    for g in {gg for gg, _ in rows}:
        ids = sorted((hashlib.md5(f"{i}:9".encode()).hexdigest(), i) for gg, i in rows if gg == g)
        want |= {(i, n + 1) for n, (_, i) in enumerate(ids)}
    assert got == want
