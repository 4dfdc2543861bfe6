"""Elements of JSON files that are read in ranges, against the json library."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import elements


@pytest.fixture
def read(spark, tmp_path):
    """Elements and problems of a text that is read in ranges of so many bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def run(texts, cut, inner="conversations"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
        paths = []
        for i, text in enumerate(texts):
            (tmp_path / f"{cut}-{i}.json").write_text(text, encoding="utf-8")
            paths.append(str(tmp_path / f"{cut}-{i}.json"))
        good, bad = elements.elements(spark, paths, inner)
        out, problems = [[] for _ in texts], [[] for _ in texts]
        number = lambda path: int(path.rsplit("-", 1)[1].removesuffix(".json"))
        for r in good.select("path", "at", F.to_json("item").alias("v")).orderBy("path", "at").collect():
            assert len(out[number(r.path)]) + len([x for x in bad.collect() if x.path == r.path and 0 <= x.at < r.at]) == r["at"]
            out[number(r.path)].append(json.loads(r.v))
        for r in bad.collect():
            problems[number(r.path)].append(r["at"])
        return out, problems

    yield run
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def value(rng, depth):
    kind = rng.randrange(7)
    if depth <= 0 or not kind:
        return rng.choice([1, 2.5, None, True, 'a"b', "}],{[ \\\\", '\\"', "é\n"])
    if kind < 4:
        return {rng.choice(["a", "conversations", '}"']): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("cut", [140, 1_000_000])
def test_elements_of_any_ranges(read, cut):
    rng = random.Random(cut)
    texts, wanted = [], []
    for i in range(6):
        items = [{"id": j, "v": value(rng, 4)} for j in range(rng.randrange(1, 9))]
        whole = [items, {"x": [1, {"conversations": [7]}], "conversations": items, "z": [[1], {"k": 2}]}, {"x": 1, "y": items}][i % 3]
        texts.append(json.dumps(whole, indent=rng.choice([None, 2]), ensure_ascii=False))
        wanted.append([whole] if i % 3 == 2 else items)
    assert read(texts, cut) == (wanted, [[] for _ in texts])


def test_files_that_are_no_json(read):
    texts = ["[]", " [ ] ", "{}", '[1,"a}",[2]]', "[1,,2]", "[1,2", "xyz", "[1] 5", '{"a":{"b":1}', '[{"a":1},{"a":tru},{"a":3}]', "[1,]", '{"conversations":[]}',
        "\ufeff[{\"a\":1}]\n", '{"a":1', '{"a":1}}', '{"a":1}{"b":2}', "[1][2]", "", '"text"', '{"conversations":[{"a":1}],"b":[']
    good = [[], [], [{}], [1, "a}", [2]], [1, 2], [], [], None, [], [{"a": 1}, {"a": 3}], [1], [], [{"a": 1}], [], [], None, None, [], [], []]
    bad = [[], [], [], [], [1], [-1], [-1], [-1], [-1], [1], [1], [], [], [-1], [-1], [-1], [-1], [], [-1], [-1]]
    for cut in (6, 1000):
        out, problems = read(texts, cut)
        assert problems == bad
        assert all(g is None or g == o for g, o in zip(good, out, strict=True))


def test_the_object_itself_without_an_inner_array(read):
    assert read(['{"conversations": [1], "b": "}"}'], 7, None)[0] == [[{"conversations": [1], "b": "}"}]]
