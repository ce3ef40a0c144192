"""Image hashes, benchmark files, SQL functions and the payload source on small cases."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfspark import session
from shelfspark.functions import sql_functions
from shelfspark.operators import evaluation, images
from shelfspark.sources import payload_source


def plain_dhash(px, w, h):
    from fractions import Fraction as Q

    def cell(y, x):
        total = Q(0)
        for j in range(h):
            for i in range(w):
                a = max(Q(0), min(Q(i + 1), Q((x + 1) * w, 9)) - max(Q(i), Q(x * w, 9)))
                b = max(Q(0), min(Q(j + 1), Q((y + 1) * h, 8)) - max(Q(j), Q(y * h, 8)))
                total += px[j * w + i] * a * b
        return total

    small = [[cell(y, x) for x in range(9)] for y in range(8)]
    bits = "".join("1" if small[y][x] < small[y][x + 1] else "0" for y in range(8) for x in range(8))
    return f"{int(bits, 2):016x}"


def test_difference_hash(spark):
    r = random.Random(3)
    rows = [(k, [r.randrange(256) for _ in range(w * h)], w, h) for k, (w, h) in enumerate([(9, 8), (1, 1), (18, 16), (13, 21), (5, 3), (40, 9)])]
    rows += [(90, [], 0, 0), (91, [1, 2], 3, 3), (92, None, 2, 2)]
    df = spark.createDataFrame(rows, "id int, px array<int>, w int, h int")
    got = {x.id: x.h for x in df.select("id", images.hex_hash(images.difference_hash(F.col("px"), F.col("w"), F.col("h"))).alias("h")).collect()}
    assert got == {k: plain_dhash(px, w, h) if k < 90 else None for k, px, w, h in rows}


def test_benchmark_violations(spark):
    case = {"id": "a", "query": "q", "slices": [], "expectedIntent": "product", "relevanceRules": [], "idealRelevance": {"x": 1}}
    files = {
        "good": json.dumps({"version": 3, "cases": [case, case | {"id": "b", "expectedIntent": "mission", "mission": {"requiredSlots": ["s"]}}]}),
        "text": "no json",
        "list": "[]",
        "none": None,
        "empty": "{}",
        "twice": json.dumps({"version": 1, "cases": [case, case, case | {"idealRelevance": None}]}),
        "slots": json.dumps({"version": 1.5, "cases": [case | {"expectedIntent": "mission"}, {}]}),
    }
    found = evaluation.benchmark_violations(spark.createDataFrame([*files.items()], "file string, body string"))
    got = {}
    for x in found.collect():
        got.setdefault(x.file, set()).add((x.path, x.rule))
    assert "good" not in got
    assert got["text"] == got["list"] == got["none"] == {("$", "object")}
    assert got["empty"] == {("$.version", "version"), ("$.cases", "cases")}
    assert got["twice"] == {("$.cases[1].id", "duplicate id"), ("$.cases[2].id", "duplicate id"), ("$.cases[2].idealRelevance", "ideal relevance")}
    assert {("$.version", "version"), ("$.cases[0].mission.requiredSlots", "required slots"), ("$.cases[1].id", "id"), ("$.cases[1].slices", "slices")} <= got["slots"]


def test_sql_functions(spark):
    assert "selector_cards" in sql_functions.register(spark)
    row = spark.sql("""SELECT normalized_text('Élan  Vital!') AS a, text_key('A-b') AS b, url_host(' https://www.Shop.example/x') AS c, price_fits(100, 30.0D) AS d, price_fits(100, 20.0D) AS e,
        hash_distance(7, 1) AS f, set_similarity(array('a', 'b'), array('b')) AS g, set_similarity(array(), array()) AS h, minor_units(1.005D) AS i""").first()
    assert tuple(row) == ("elan vital", "ab", "shop.example", True, False, 2, 0.5, 0.0, 101) or row.i == 100
    spark.createDataFrame([(1, '<li><a href="/x">T</a><b>$5</b></li>'), (2, None)], "id int, html string").createOrReplaceTempView("some_pages")
    config = json.dumps({"baseUrl": "http://e.com", "card": "li", "title": "a", "link": "a", "price": "b"})
    found = spark.sql(f"SELECT id, c.* FROM some_pages, LATERAL selector_cards(html, '{config}') c")
    assert found.columns == ["id", "place", "external_id", "title", "url", "price_text"]
    assert [(r.id, r.place, r.title, r.price_text) for r in found.collect()] == [(1, 0, "T", "$5")]
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT c.* FROM some_pages, LATERAL selector_cards(html, html) c").collect()


def test_clear_removes_what_was_written(spark):
    kept = session.written(spark.range(3), "kept")
    folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://"))
    assert os.path.exists(folder)
    session.clear(spark)
    assert not os.path.exists(folder)


def test_payload_source(spark, tmp_path):
    payload_source.register(spark)
    for source, lines in {"a": ['{"id": 1, "title": " T ", "price": "$1,234.50"}', "broken", ""], "b": ['{"title": "U"}'], "c": []}.items():
        (tmp_path / f"source={source}").mkdir()
        (tmp_path / f"source={source}" / "part-0.txt").write_text("\n".join(lines))
    (tmp_path / "source=a" / "_SUCCESS").write_text("")
    every = spark.read.format("payloads").option("path", str(tmp_path)).load()
    assert sorted(map(tuple, every.collect()), key=str) == sorted([("a", "1", "T", None, 123450, None), ("a", None, None, None, None, "broken"), ("b", "U", "U", None, None, None)], key=str)
    one = every.where("source = 'b' and title is not null")
    assert one.count() == 1 and one.rdd.getNumPartitions() == 1
    reader = payload_source.PayloadReader(str(tmp_path))
    assert len(reader.partitions()) == 3
    stream = spark.readStream.format("payloads").option("path", str(tmp_path)).load()
    run = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    (tmp_path / "source=b" / "part-1.txt").write_text('{"title": "V"}')
    (tmp_path / "source=c" / "part-1.txt").write_text('{"title": "W"}')
    run()
    assert {r.title for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"T", "U", "V", "W", None}
