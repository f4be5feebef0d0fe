import pytest
from pyspark.sql import functions as F

from skeinwork.config import EngineConfig
from skeinwork.functions import text as T
from skeinwork.sources import files


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v).cast("string"))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Authors: Zijian Zhang, University of Pennsylvania, 2025.", ["authors", "zijian", "zhang", "university", "of", "pennsylvania", "2025"]),
        ("这篇文章的作者都属于什么学校？", ["这篇文章的作者都属于什么学校"]),
        ("University university", ["university", "university"]),
        ('"Advances," (2025).', ["advances", "2025"]),
        ("gpt4 3.14 é", ["gpt4", "3.14"]),
        ("", []),
        (None, []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize("t"), t=text) == tokens


@pytest.mark.parametrize(("text", "yes"), [("hi", False), ("ab", False), ("hello", False), ("LLMs for mobility", True), ("这篇论文讲了什么？", True), (None, False), ("  a b  ", False)])
def test_should_decompose(spark, text, yes):
    assert one(spark, T.should_decompose("t"), t=text) is yes


@pytest.mark.parametrize(("raw", "paths"), [("a, b", ["a", "b"]), ("a，b", ["a", "b"]), ("a，b, c", ["a", "b", "c"]), ("", []), ("  x  ,, ", ["x"])])
def test_paths(spark, raw, paths):
    assert one(spark, T.split_paths("t"), t=raw) == paths == files.parse_paths(raw)


@pytest.mark.parametrize(
    ("url", "problem"),
    [
        ("http://remote.example/v1", "remote http"), ("http://localhost:8080/v1", None), ("https://remote.example/v1", None), ("http://[::1]:80/", None), ("http://127.0.0.1/", None),
        ("", "empty"), (None, "empty"), ("ftp://x/y", "scheme"), ("nonsense", "scheme"), ("https://u:p@x/y", "credentials"), ("https://x/" + "a" * 2100, "too long"),
    ],
)
def test_endpoints(spark, url, problem):
    assert one(spark, T.endpoint_problem("t"), t=url) == problem


def test_sub_queries(spark):
    assert one(spark, T.parse_sub_queries("r", "q"), r='```json\n["a", "b"]\n```', q="z") == ["a", "b"]
    assert one(spark, T.parse_sub_queries("r", "q"), r="[]", q="z") == ["z"]
    assert one(spark, T.parse_sub_queries("r", "q"), r="oops", q="z") == ["z"]
    assert one(spark, T.parse_sub_queries("r", "q"), r=None, q="z") == ["z"]


def test_keys_citations_strip(spark):
    assert one(spark, T.mask_key("t"), t=None) == "<not set>"
    assert one(spark, T.mask_key("t"), t="12345678") == "sk-...****"
    assert one(spark, T.mask_key("t"), t="sk-abcdefgh") == "sk-...efgh"
    assert one(spark, T.cited("t"), t="[S1] S2 S1 xS3") == ["S1", "S2"]
    assert one(spark, T.cited("t"), t=None) == []
    assert one(spark, T.strip("t"), t="　 a b\x1c\n") == "a b"
    assert one(spark, T.split_lines("t"), t="a\r\nb c\n") == ["a", "b", "c"]
    assert one(spark, T.or_else("a", "b", F.lit("legacy")), a="", b=None) == "legacy"


@pytest.mark.parametrize(("path", "kind"), [("/a/x.TXT", "text"), ("/a/x.pdf", "pdf"), ("/a/x.docx", "docx"), ("/a/.gitignore", None), ("/a/x", None), ("/a.b/x", None), ("/a/x.tar.gz", None), ("/a/.b.md", "text")])
def test_file_types(spark, path, kind):
    assert one(spark, files.file_type("t"), t=path) == kind


def test_malformed_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "c binary")
    assert df.select(T.valid_text("c")).first()[0] == "a�b"


def test_config():
    for name in ("top_k", "metrics_kept", "decompose_attempts"):
        with pytest.raises(ValueError):
            EngineConfig(**{name: 0})
    assert EngineConfig(alpha=7).alpha == 1
    with pytest.raises(ValueError):
        EngineConfig(min_k=9, max_k=3)


@pytest.mark.parametrize(("answer", "n", "expected"), [
    ("---段落3---\n-copper\n  * tin  \n·- zinc alloy", 1, [["copper", "tin", "zinc alloy"]]),
    ("---段落1---\nNile-Delta\n---段落2---\n\n  \n---段落3---\n** Ganges *", 3, [["Nile-Delta"], ["Ganges *"], []]),
    ("---段落4--- tail\nLoire\nLoire\n---段落\n-\n· Po", 2, [["Loire", "Loire"], ["", "Po"]]),
    ("stray\n ---段落1---\n\n---段落2---\nX-1", 3, [["stray"], ["X-1"], []]),
    ("a\n---段落9\nb", 1, [["a"]]),
    (None, 2, [[], []]),
    ("", 1, [[]]),
])
def test_entity_responses(spark, answer, n, expected):
    row = spark.createDataFrame([(answer, n)], "answer string, n int").select(T.parse_entity_response("answer", F.col("n")).alias("x")).first()
    assert row["x"] == expected
