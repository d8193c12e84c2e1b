import json

import pytest

from quillion import cli, query, sinks


@pytest.fixture
def people(tmp_path):
    (tmp_path / "people.csv").write_text("name,age,city\nAnn,30,Ulm\nBo,25,Bonn\nCy,,Ulm\nDi,41,\n")
    return str(tmp_path / "people.csv")


def test_bound(spark, people):
    q = query(people, spark)
    assert q.schema().to_dict() == {"name": "STRING", "age": "INTEGER", "city": "STRING"}
    for name in ("people", "data", "whatever"):
        assert q.sql(f"SELECT name FROM {name} WHERE age > 28 ORDER BY name").to_list() == [{"name": "Ann"}, {"name": "Di"}]
    assert q.sql("SELECT name WHERE city = 'Ulm' ORDER BY age").to_list() == [{"name": "Ann"}, {"name": "Cy"}]


def test_again_and_lazy(spark, people):
    result = query(people, spark).sql("SELECT COUNT(*) AS n FROM people")
    assert list(result) == list(result) == [{"n": 4}] and result.columns == ["n"]


def test_sources_in_sql(spark, people, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps([{"name": "Ann", "sum": 5}, {"name": "Zed", "sum": 1}]))
    q = query(spark=spark)
    sql = f"SELECT * FROM '{people}' p JOIN '{tmp_path}/o.json' o ON p.name = o.name"
    assert q.sql(sql).to_list() == [{"name": "Ann", "age": 30, "city": "Ulm", "right_name": "Ann", "sum": 5}]
    assert q.sql(f"SELECT COUNT(*) AS n FROM {people}").to_list() == [{"n": 4}]


def test_nulls_last(spark, people):
    q = query(people, spark)
    assert [r["age"] for r in q.sql("SELECT age FROM people ORDER BY age")] == [25, 30, 41, None]
    assert [r["age"] for r in q.sql("SELECT age FROM people ORDER BY age DESC")] == [41, 30, 25, None]


def test_errors(spark, people):
    q = query(people, spark)
    with pytest.raises(ValueError, match="Failed to parse"):
        q.sql("SELEC name FROM people")
    with pytest.raises(RuntimeError):
        q.sql("SELECT nothing FROM people")
    with pytest.raises(ValueError, match="backend"):
        q.sql("SELECT 1 FROM people", backend="magic")
    with pytest.raises(ValueError):
        query(spark=spark).schema()
    assert q.sql("SELECT 1 AS x FROM people LIMIT 1", backend="duckdb").to_list() == [{"x": 1}]


def test_pushdown_shows(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS twice", "'x' AS s").write.parquet(str(tmp_path / "t.parquet"))
    result = query(spark=spark).sql(f"SELECT id FROM '{tmp_path}/t.parquet' WHERE twice > 50")
    plan = result.explain()
    assert result.optimizations() == {"PushedFilters": ["[IsNotNull(twice), GreaterThan(twice,50)]"], "PartitionFilters": [], "ReadSchema": ["struct<id:bigint,twice:bigint>"]}
    assert "PushedFilters: [IsNotNull(twice), GreaterThan(twice,50)]" in plan and "ReadSchema: struct<id:bigint,twice:bigint>" in plan


ROWS = [{"a": 1, "b": "x|y"}, {"a": None, "b": "z"}]


def test_formatters():
    assert sinks.as_markdown(ROWS) == "| a | b |\n| :--- | :--- |\n| 1 | x\\|y |\n| _NULL_ | z |\n\n_2 rows_"
    assert sinks.as_markdown(ROWS[:1], align={"a": "right"}, show_footer=False).splitlines()[1] == "| ---: | :--- |"
    assert sinks.as_csv(ROWS) == "a,b\n1,x|y\n,z\n" and sinks.as_csv(ROWS[:1], quote_all=True, delimiter=";") == '"a";"b"\n"1";"x|y"\n'
    assert json.loads(sinks.as_json([{"x": float("nan"), "y": [1, float("inf")]}])) == [{"x": None, "y": [1, None]}]
    assert sinks.as_json(ROWS[:1], compact=True) == '[{"a":1,"b":"x|y"}]'
    assert "NULL" in sinks.as_table(ROWS) and sinks.as_table(ROWS).endswith("2 rows") and sinks.as_table(ROWS[:1]).endswith("1 row")
    assert (sinks.as_table([]), sinks.as_csv([]), sinks.as_markdown([])) == ("No results found.", "", "_No results found._")
    with pytest.raises(ValueError, match="Available"):
        sinks.get_formatter("xls")


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    for kind in ("parquet", "json", "csv"):
        sinks.write(df, str(tmp_path / kind), kind)
        read = spark.read.option("header", True).option("inferSchema", True).format(kind).load(str(tmp_path / kind))
        assert sorted(map(tuple, read.collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path / "x.xls"))


def test_cli(spark, people, tmp_path, capsys):
    assert cli.main(["query", people, "SELECT name, age FROM people ORDER BY name", "-f", "json", "-l", "1"]) == 0
    assert json.loads(capsys.readouterr().out) == [{"name": "Ann", "age": 30}]
    assert cli.main(["query", f"SELECT COUNT(*) AS n FROM '{people}'", "-f", "csv", "--time"]) == 0
    assert capsys.readouterr().out.strip() == "n\n4"
    (tmp_path / "q.sql").write_text("SELECT name FROM people WHERE age = 25")
    assert cli.main(["query", people, "-q", str(tmp_path / "q.sql"), "-o", str(tmp_path / "out.md")]) == 0
    assert "| Bo |" in (tmp_path / "out.md").read_text()
    assert cli.main(["query", people, "SELECT * FROM people", "-o", str(tmp_path / "out.parquet")]) == 0
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 4
    capsys.readouterr()
    assert cli.main(["query", people, "SELECT name FROM people", "--explain"]) == 0 and "Physical Plan" in capsys.readouterr().out
    assert cli.main(["query", people, "SELECT FROM WHERE"]) == 1 and "Error" in capsys.readouterr().err
    assert cli.main(["query"]) == 1


def test_shell(spark, people, tmp_path, monkeypatch, capsys):
    typed = iter(["SELECT name", "FROM people WHERE age = 41;", "SELECT broken FROM people;", "exit"])
    monkeypatch.setattr("builtins.input", lambda prompt: next(typed))
    assert cli.main(["shell", people, "--history-file", str(tmp_path / "h")]) == 0
    out = capsys.readouterr()
    assert "Di" in out.out and "Error" in out.err and len((tmp_path / "h").read_text().splitlines()) == 2


def test_bound_source_leaves_other_views_alone(spark, tmp_path):
    """A user's view of the source's name stays as it is, no view is left behind, and columns know the source by its name."""
    path = tmp_path / "people.csv"
    path.write_text("name,age\nAnn,30\nBo,25\n")
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("people")
    before = {t.name for t in spark.catalog.listTables()}
    q = query(str(path), spark)
    assert q.sql("SELECT people.name FROM people WHERE people.age > 26").to_list() == [{"name": "Ann"}]
    assert q.sql("SELECT p.name FROM people p JOIN people AS o ON p.age < o.age").to_list() == [{"name": "Bo"}]
    assert q.sql(f"SELECT COUNT(*) AS n FROM data JOIN '{path}' f ON f.age = data.age").to_list() == [{"n": 2}]
    assert spark.sql("SELECT * FROM people").columns == ["x"] and {t.name for t in spark.catalog.listTables()} == before
    spark.catalog.dropTempView("people")
