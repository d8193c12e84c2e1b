import gzip
import http.server
import json
import threading
from datetime import date

import pytest

from quillion.sources import http as web
from quillion.sources.resolve import resolve, stem


def made(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_csv(spark, tmp_path):
    path = made(tmp_path, "a.csv", 'id,name,price,day\n1,"x, y",2.5,2024-01-15\n2,N/A,,15/01/2024\n3\n4,too,1,2024-01-01,many\n')
    assert rows(resolve(spark, path)) == [
        {"id": 1, "name": "x, y", "price": 2.5, "day": date(2024, 1, 15)},
        {"id": 2, "name": "N/A", "price": None, "day": date(2024, 1, 15)},
        {"id": 3, "name": None, "price": None, "day": None},
    ]


def test_csv_options(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("a;b\né;1\n".encode("latin-1"))
    assert rows(resolve(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1", delimiter=";")) == [{"a": "é", "b": 1}]
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("a\n5\n")
    assert rows(resolve(spark, str(tmp_path / "z.csv.gz"))) == [{"a": 5}]
    assert resolve(spark, made(tmp_path, "h.csv", "a,b\n")).collect() == []


def test_csv_line_ends_in_cells(spark, tmp_path):
    path = made(tmp_path, "m.csv", 'a,b\n"x\ny",1\n"say ""hi""",2\n')
    assert rows(resolve(spark, path, multi_line=True)) == [{"a": "x\ny", "b": 1}, {"a": 'say "hi"', "b": 2}]


def test_s3_names(spark, monkeypatch):
    asked = []
    monkeypatch.setattr("quillion.sources.readers.read_parquet", lambda spark, path: asked.append(path))
    resolve(spark, "s3://bucket/a/b.parquet")
    assert asked == ["s3a://bucket/a/b.parquet"]


def test_missing(spark, tmp_path):
    for name in ("no.csv", "no.parquet", "no.json", "no.jsonl", "no.md", "no.html"):
        with pytest.raises(FileNotFoundError):
            resolve(spark, str(tmp_path / name))
    with pytest.raises(OSError):
        resolve(spark, str(tmp_path / "no.xml"))


def test_parquet_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, 2023, 1), (2, 2023, 2), (3, 2024, 1)], "v int, year int, month int")
    df.write.partitionBy("year", "month").parquet(str(tmp_path / "p"))
    leaf = resolve(spark, str(tmp_path / "p" / "year=2023" / "month=2") + "#parquet")
    assert rows(leaf) == [{"v": 2, "year": 2023, "month": 2}]
    assert resolve(spark, str(tmp_path / "p") + "#parquet").where("year = 2023").count() == 2


def test_parquet_nested_and_codecs(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"a": "x"}, [[1], []])], "i int, l array<int>, m map<string,string>, n array<array<int>>")
    for codec in ("snappy", "gzip", "none"):
        df.write.option("compression", codec).parquet(str(tmp_path / codec))
        assert rows(resolve(spark, str(tmp_path / codec) + "#parquet")) == rows(df)


def test_jsonl(spark, tmp_path):
    path = made(tmp_path, "a.jsonl", '{"id": 1, "v": "a"}\n\nnot json\n[1]\n{"id": 2, "v": null}\n')
    assert rows(resolve(spark, path)) == [{"id": 1, "v": "a"}, {"id": 2, "v": None}]


@pytest.mark.parametrize(
    "document, path, expected",
    [
        ([{"a": 1}, {"a": 2}], None, [{"a": 1}, {"a": 2}]),
        ([{"data": [{"x": 1}]}], None, [{"data": [{"x": 1}]}]),
        ({"n": 2, "items": [{"a": 1}, {"a": 2}]}, None, [{"a": 1}, {"a": 2}]),
        ({"other": [{"a": 7}], "n": 1}, None, [{"a": 7}]),
        ({"a": 1, "b": "x"}, None, [{"a": 1, "b": "x"}]),
        ({"r": {"o": [{"id": 1}]}}, "r.o", [{"id": 1}]),
        ({"u": [{"n": "p", "t": [{"id": 1}, {"id": 2}]}, {"n": "q"}]}, "u[0].t", [{"id": 1}, {"id": 2}]),
        ({"u": [{"t": [{"id": 1}]}, {"n": "q"}, {"t": [{"id": 3}]}]}, "u[].t", [{"id": 1}, {"id": 3}]),
        ({"u": [{"a": 1}, {"a": 2}]}, "u[]", [{"a": 1}, {"a": 2}]),
    ],
)
def test_json(spark, tmp_path, document, path, expected):
    for indent in (None, 2):
        file = made(tmp_path, f"d{indent}.json", json.dumps(document, indent=indent))
        assert rows(resolve(spark, file + (f"#json:{path}" if path else ""))) == expected


def test_json_errors(spark, tmp_path):
    file = made(tmp_path, "d.json", json.dumps({"u": [{"a": 1}]}))
    for path, message in (("missing", "Key 'missing' not found"), ("u[5].a", "Index 5 out of range"), ("u[].a[]", "Only one")):
        with pytest.raises(ValueError, match=message):
            resolve(spark, f"{file}#json:{path}")


def test_xml(spark, tmp_path):
    path = made(
        tmp_path,
        "c.xml",
        '<catalog><meta>1</meta><product id="1" status="on"><name>Pen</name><price>1.50</price><made><city>Ulm</city><at kind="x">9</at></made></product>'
        '<product id="2" status="off"><name>Ink</name><tag>a</tag><tag>b</tag></product></catalog>',
    )
    expected = [
        {"@id": 1, "@status": "on", "made.at": 9, "made.city": "Ulm", "name": "Pen", "price": 1.5, "tag": None},
        {"@id": 2, "@status": "off", "made.at": None, "made.city": None, "name": "Ink", "price": None, "tag": "b"},
    ]
    assert rows(resolve(spark, path)) == expected
    assert rows(resolve(spark, path + "#xml:product")) == expected and resolve(spark, path).columns == sorted(expected[0])
    with pytest.raises(ValueError, match="comes twice"):
        resolve(spark, made(tmp_path, "o.xml", "<a><b>1</b></a>"))
    with pytest.raises(ValueError, match="has no element"):
        resolve(spark, path + "#xml:nothing").collect()


HTML = """<html><body><table><tr><th>Name</th><th>Age</th></tr><tr><td>Ann &amp; Co</td><td>30</td></tr><tr><td rowspan=2>Bo</td><td>25</td></tr><tr><td>26</td></tr></table>
<table><thead><tr><th>City</th></tr></thead><tbody><tr><td> New<br>York </td></tr></tbody></table></body></html>"""


def test_html(spark, tmp_path):
    path = made(tmp_path, "p.html", HTML)
    assert rows(resolve(spark, path)) == [{"Name": "Ann & Co", "Age": 30}, {"Name": "Bo", "Age": 25}, {"Name": "Bo", "Age": 26}]
    assert rows(resolve(spark, path + "#html:-1")) == rows(resolve(spark, path, match="York")) == [{"City": "New York"}]
    with pytest.raises(ValueError, match="none at place"):
        resolve(spark, path + "#html:2")
    with pytest.raises(ValueError, match="has no HTML table"):
        resolve(spark, made(tmp_path, "e.html", "<p>none</p>"))


def test_markdown(spark, tmp_path):
    text = "# T\n\n| Name | Count | Ok |\n|:-----|------:|---|\n| a\\|b | 1 | true |\n| - | n/a |\n| c | 3 | false | more |\n\ntext\n\nx | y\n--- | ---\n1 | 2024-01-15\n"
    path = made(tmp_path, "r.md", text)
    assert rows(resolve(spark, path)) == [{"Name": "a|b", "Count": 1, "Ok": True}, {"Name": None, "Count": None, "Ok": None}, {"Name": "c", "Count": 3, "Ok": False}]
    assert rows(resolve(spark, path + "#markdown:1")) == [{"x": 1, "y": date(2024, 1, 15)}]
    with pytest.raises(ValueError):
        resolve(spark, path + "#markdown:7")


def test_stem():
    assert stem("/a/b-c.csv") == "b_c" and stem("x.html#html:-1") == "x_1" and stem("2024.csv") == "t_2024"


@pytest.mark.parametrize(
    "text, kind",
    [(HTML, "html"), ("| a | b |\n|---|---|\n", "markdown"), ('[{"a": 1}]', "json"), ('{"a": 1}\n{"a": 2}\n', "jsonl"), ('{\n "a": [1]}', "json"), ("<?xml version='1.0'?><a/>", "xml"), ("a,b\n1,2\n", "csv")],
)
def test_sniffed(tmp_path, text, kind):
    (tmp_path / "f").write_text(text)
    assert web.sniffed(tmp_path / "f") == kind


def test_http(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("QUILLION_HTTP_CACHE", str(tmp_path / "cache"))
    files = {"/a.csv": "x\n1\n", "/api": '[{"y": 2}]', "/p.html": HTML}
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200 if self.path in files else 404)
            self.end_headers()
            self.wfile.write(files.get(self.path, "").encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert rows(resolve(spark, f"{at}/a.csv")) == rows(resolve(spark, f"{at}/a.csv")) == [{"x": 1}] and asked == ["/a.csv"]
        assert rows(resolve(spark, f"{at}/api")) == [{"y": 2}] and rows(resolve(spark, f"{at}/p.html#html:1")) == [{"City": "New York"}]
        resolve(spark, f"{at}/a.csv", force_download=True)
        resolve(spark, f"{at}/api#json", cache_dir=str(tmp_path / "own"))
        assert len(list((tmp_path / "own").iterdir())) == 1
        assert asked.count("/a.csv") == 2
        with pytest.raises(OSError, match="Failed to download"):
            resolve(spark, f"{at}/none.csv")
        web.clear_cache(f"{at}/a.csv")
        assert not web.cached_path(f"{at}/a.csv").exists()
        web.clear_all_cache()
        assert not (tmp_path / "cache").exists()
    finally:
        server.shutdown()
