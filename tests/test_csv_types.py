from quillion.sources.readers import read_csv


def test_values_beyond_the_first_rows_stay(spark, tmp_path):
    path = tmp_path / "late.csv"
    rows = [f"{i},{i},{i},12:30:00" for i in range(150)] + ["12.5,n/a,99999999999999999999,2024-01-02"]
    path.write_text("a,b,c,d\n" + "\n".join(rows) + "\n")
    df = read_csv(spark, str(path))
    assert df.agg({"a": "sum"}).first()[0] == 150 * 149 / 2 + 12.5
    last = [r for r in df.collect() if r["a"] == 12.5][0]
    assert (last["b"], int(last["c"]), last["d"]) == ("n/a", 99999999999999999999, "2024-01-02")
    assert df.where("b is null or c is null or d is null").count() == 0
