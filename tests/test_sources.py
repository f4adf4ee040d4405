"""Listed and cached sources, and sinks whose folders don't meet."""

import os

from corpusflow.sources import readers, sinks


def test_the_newest_file_alone_is_opened(spark, tmp_path):
    for name, v in (("r_2024.json", 1), ("r_2025.json", 2), ("r_2023.json", 3)):
        (tmp_path / name).write_text(f'{{"v": {v}}}')
    (tmp_path / "r_2022.json").write_text("not json at all")
    got = readers.latest(spark, f"{tmp_path}/r_*.json", "v int")
    assert got.first().v == 2 and len(got.inputFiles()) == 1 and got.inputFiles()[0].endswith("r_2025.json")
    assert readers.latest(spark, f"{tmp_path}/none_*.json", "v int").count() == 0


def test_parts_are_made_once(spark, tmp_path):
    made = []

    def part(name, columns):
        def make():
            made.append(name)
            return spark.createDataFrame([(1, name)], columns)

        return make

    parts, path = [part("a", "id long, question string"), part("b", "id long, topic string")], str(tmp_path / "cache")
    first = sorted((r.question or "", r.topic or "") for r in readers.cached(spark, path, parts).collect())
    assert first == [("", "b"), ("a", "")] and made == ["a", "b"]
    assert readers.cached(spark, path, parts).count() == 2 and made == ["a", "b"]
    os.remove(f"{path}/_SUCCESS")  # a write that was killed
    assert readers.cached(spark, path, parts).count() == 2 and len(made) == 4
    assert readers.cached(spark, path, parts[:1], reload=True).count() == 1 and len(made) == 5
    wanted = spark.createDataFrame([(1,), (7,)], "id long")
    assert [r.id for r in readers.missing_pages(spark, path, wanted, "id").collect()] == [7]
    assert readers.missing_pages(spark, str(tmp_path / "nothing"), wanted, "id").count() == 2


def test_folders_of_different_values_differ(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1), ("a_b", 2), ("a b", 3), (None, 4)], "k string, v int")
    sinks.export_json(df, str(tmp_path / "out"), "k")
    assert len([d for d in os.listdir(tmp_path / "out") if d.startswith("_safe=")]) == 4


def test_appended_rows_are_defined(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d")], "id long, t string")
    got = sinks.append_new(df, str(tmp_path / "t"), "id")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c")] == sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect()))
