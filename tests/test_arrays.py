import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import arrays, cards


def objects(n, seed=0):
    r = random.Random(seed)
    odd = ["}{", '"', "\\", '\\"}', "]", "é漢😀", "\n", '{"a":', "},{", "plain", ""]
    return [{"id": f"p{i}", "name": "".join(r.choice(odd) for _ in range(r.randint(0, 12))), "card_faces": [{"name": r.choice(odd)}] * r.randint(0, 3), "prices": {"eur": r.choice(odd)}} for i in range(n)]


@pytest.mark.parametrize("layout", [{"indent": 2}, {"separators": (",", ":")}, {"indent": None, "ensure_ascii": False}])
def test_objects_of_an_array_read_by_many_tasks(spark, tmp_path, layout):
    want = objects(3000)
    path = tmp_path / "bulk.json"
    path.write_text(json.dumps(want, **layout))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        raw = spark.read.option("lineSep", "}").text(str(path))
        assert raw.rdd.getNumPartitions() > 10
        got = arrays.array_objects(spark, str(path)).orderBy("number").collect()
        assert [json.loads(r.value) for r in got] == want and [r.number for r in got] == list(range(3000))
        one = spark.read.schema(cards.CARD).option("multiLine", True).json(str(path))
        several = cards.bulk_cards(spark, str(path)).drop("at")
        assert sorted(map(str, several.collect())) == sorted(map(str, one.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_several_files_and_empty_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    (tmp_path / "b.json").write_text(" [ \n ] ")
    (tmp_path / "c.json").write_text('[{"id": "1"}]')
    (tmp_path / "d.json").write_text('[\n{"id": "2", "name": "x"},\n\n{"id": "3"}\n]\n')
    got = arrays.array_objects(spark, str(tmp_path)).select("number", F.get_json_object("value", "$.id").alias("id")).collect()
    assert sorted(map(tuple, got)) == [(0, "1"), (0, "2"), (1, "3")]


def test_the_last_object_of_a_card_counts(spark, tmp_path):
    rows = [{"id": f"p{i}", "oracle_id": "o", "name": f"n{i}", "card_faces": [{"name": f"f{i}"}] * (3 - i)} for i in range(3)] + [{"id": "p0", "oracle_id": "x", "name": "again", "prices": {"eur": "2.00"}}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, rows)))
    for c in (cards.bulk_cards(spark, str(tmp_path / "a.json")), cards.bulk_cards(spark, str(tmp_path / "b.json"), multi_line=False)):
        c = c.repartition(7)
        assert {r.card: r.name for r in cards.card_rows(c).collect()} == {"o": "n2", "x": "again"}
        assert [(r.card, r.face, r.name) for r in cards.face_rows(c).collect()] == [("o", 0, "f2")]
        assert {r.printing: r.card for r in cards.printing_rows(c).collect()} == {"p0": "x", "p1": "o", "p2": "o"}
        assert [(r.printing, str(r.price)) for r in cards.price_rows(c).collect()] == [("p0", "2.00")]
