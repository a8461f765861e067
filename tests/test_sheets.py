from skein.plans import ownership as P


def test_parts_beyond_a_sheet_stay_in_their_module(spark, tmp_path):
    keys = [0, 1, 24, 25, 99999, 100000, 100001, 100024, 199999, 200000, 1200003]
    spark.createDataFrame([(k, k % 7) for k in keys], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, f"N{k}") for k in range(25)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = {(r["line"], r["module"], r["name"]) for r in P.api_entries(spark, str(tmp_path)).collect()}
    assert got == {(k % 25 * 100000 + k, f"src::m{k % 25}", f"fn_{k % 997}") for k in keys}
