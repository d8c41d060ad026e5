from __future__ import annotations

from corpusloom.config import Config
from corpusloom.operators import answers


def test_excerpts_and_web(spark):
    hits = spark.createDataFrame([(n, "L", "", "receita", "x" * 100) for n in range(10)], "rank int, book string, title string, kind string, text string")
    rows = answers.excerpts(hits, 420).collect()
    assert [r.number for r in rows] == [1, 2, 3] and rows[0].block.startswith("[1] L — trecho  (receita)\nxxx")
    web = spark.createDataFrame([(0, "t", "u", "c" * 700), (1, "t", "u", " "), (2, "t", "u", "d")], "position int, title string, url string, content string")
    assert [(r.number, len(r.content)) for r in answers.web_blocks(web, 3).collect()] == [(4, 600), (5, 1)]


def test_events():
    names = lambda e: [x[1] for x in e]
    assert names(answers.events([{"a": 1}], ["x", "y"])) == ["sources", "token", "token", "done"]
    assert names(answers.events([], [], [{"url": "u"}], searched=True)) == ["fallback", "searching", "web_sources", "done"]
    assert list(answers.events([{}, {}, {}], [], [{"url": "u"}], True))[2] == (2, "web_sources", [{"index": 4, "url": "u"}])

    def broken():
        yield "x"
        raise RuntimeError("model")

    assert names(answers.events([], broken())) == ["fallback", "token", "error"]


def test_standalone(spark):
    df = spark.createDataFrame([("q", "r ", True), ("q", "r", False), ("q", None, True), ("q", "x" * 401, True)], "q string, r string, h boolean")
    assert [r[0] for r in df.select(answers.standalone(*map(answers.F.col, "qrh"))).collect()] == ["r", "q", "q", "q"]


def test_config():
    assert Config.from_env({"CORPUSLOOM_TOP_K": "12", "CORPUSLOOM_INDEX_DIR": "/x"}) == Config(top_k=12, index_dir="/x")
