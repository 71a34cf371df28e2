"""Readers on small files written here, in the layouts they are made for."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.features import catalogue
from gridloom.sources import generators as G
from gridloom.sources import images as IM
from gridloom.sources import sinks as K
from gridloom.sources import tabular as TB
from gridloom.sources import text as TX


def test_csv_and_gzip(spark, tmp_path):
    content = "Id, NAME ,Price\n1, ann ,2.5\n2,  bob,3\n"
    (tmp_path / "a.csv").write_text(content)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write(content)
    schema = {"id": "int", "name": "string", "price": "float"}
    for name, partitions in (("a.csv", None), ("b.csv.gz", 3)):
        rows = TB.read_csv(spark, str(tmp_path / name), schema, partitions).orderBy("id").collect()
        assert [tuple(r) for r in rows] == [(1, "ann", 2.5), (2, "bob", 3.0)]
    with pytest.raises(ValueError, match="not in the header"):
        TB.read_csv(spark, str(tmp_path / "a.csv"), {"other": "int"})


def test_tsv_without_quotes(spark, tmp_path):
    (tmp_path / "r.tsv").write_text('star_rating\treview_body\n5\t"great\n3\tso "so" \\ here\n')
    rows = TB.read_tsv(spark, str(tmp_path / "r.tsv"), {"review_body": "string", "star_rating": "int"}).collect()
    assert [tuple(r) for r in rows] == [('"great', 5), ('so "so" \\ here', 3)]


def test_headerless_tsv(spark, tmp_path):
    (tmp_path / "airfoil.dat").write_text("800\t0\t0.3048\t71.3\t0.00266337\t126.201\n1000\t0\t0.3048\t71.3\t0.00266337\t125.201\n")
    names = ["freq", "aoa", "chordlen", "freestreamvel", "ssdt", "ssoundpres"]
    rows = TB.read_headerless_tsv(spark, str(tmp_path / "airfoil.dat"), dict.fromkeys(names, "float"))
    assert rows.columns == names and rows.agg(F.sum("freq")).first()[0] == 1800.0


def test_in_memory_arrays(spark):
    df = TB.from_arrays(spark, [[1, 2], [3, 4]], [0, 1])
    assert [r["data"] for r in df.orderBy("row_id").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(ValueError):
        TB.from_arrays(spark, [[1]], [0, 1])


def test_feature_catalogue():
    spec = json.dumps({"featureArray": ["a", "b", "c"], "categorical": ["b", "c"], "featureToMap": {"b": {"x": 0, "y": 1}}})
    assert [(f.name, f.kind) for f in catalogue(spec)] == [("a", "numeric"), ("b", "one_hot"), ("c", "indexed")]


def test_reviews_and_parallel_text(spark, tmp_path):
    for folder, name, text in (("pos", "7_9.txt", "good\nfilm"), ("neg", "8_2.txt", "bad")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text(text)
    rows = TX.read_reviews(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [("good\nfilm", 1, 7, 9), ("bad", 0, 8, 2)]
    (tmp_path / "fra.txt").write_text("Go.\tVa !\nHi.\tSalut !\tattribution\n")
    assert [tuple(r) for r in TX.read_parallel(spark, str(tmp_path / "fra.txt")).collect()] == [("Go.", "Va !"), ("Hi.", "Salut !")]


def test_labelled_lines_tokens_and_code(spark, tmp_path):
    (tmp_path / "c.txt").write_text("__label__sauce __label__cheese How much does it cost?\nno label here\n")
    rows = TX.read_labelled_lines(spark, str(tmp_path / "c.txt")).collect()
    assert [(r["labels"], r["text"]) for r in rows] == [(["sauce", "cheese"], "How much does it cost?"), ([], "no label here")]
    (tmp_path / "vocab.txt").write_text("[PAD]\n the \n##s\n")
    assert [tuple(r) for r in TX.read_token_list(spark, str(tmp_path / "vocab.txt")).orderBy("id").collect()] == [("[PAD]", 0), ("the", 1), ("##s", 2)]
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "deep" / "A.java").write_text("class A {  \n\n  int x;\n}\n")
    (tmp_path / "src" / "note.md").write_text("x")
    rows = TX.read_code(spark, str(tmp_path / "src")).collect()
    assert len(rows) == 1 and rows[0]["lines"] == ["class A {", "  int x;", "}"]


def bitmap(path, pixels):
    """Write a 24-bit bitmap of (height, width, rgb) bytes."""
    height, width, _ = pixels.shape
    pad = (4 - width * 3 % 4) % 4
    body = b"".join(row[:, ::-1].tobytes() + b"\0" * pad for row in pixels[::-1])
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0)
    path.write_bytes(head + body)


def test_image_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    pictures = {}
    for folder, name in (("dog", "a.bmp"), ("cat", "b.bmp"), ("cat", ".hidden.bmp"), ("cat", "note.txt"), ("cat/deep", "c.bmp")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        pictures[name] = rng.integers(0, 256, (3, 2, 3), dtype=np.uint8)
        bitmap(tmp_path / folder / name, pictures[name])
    rows = {r["path"].rsplit("/", 1)[1]: r for r in IM.read_image_folder(spark, str(tmp_path)).collect()}
    assert {k: (r["class"], r["label"]) for k, r in rows.items()} == {"a.bmp": ("dog", 1), "b.bmp": ("cat", 0)}
    assert (rows["a.bmp"]["height"], rows["a.bmp"]["width"]) == (3, 2)
    assert np.allclose(rows["a.bmp"]["pixels"], pictures["a.bmp"].ravel())
    assert IM.read_image_folder(spark, str(tmp_path), max_depth=2).count() == 3
    (tmp_path / "synset.txt").write_text("dog a dog\ncat a cat\n")
    listed = IM.read_image_folder(spark, str(tmp_path), classes=IM.read_class_list(spark, str(tmp_path / "synset.txt")))
    assert {r["class"]: r["label"] for r in listed.collect()} == {"dog": 0, "cat": 1}


def test_idx_files(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (5, 784), dtype=np.uint8)
    (tmp_path / "images").write_bytes(bytes(16) + pixels.tobytes())
    (tmp_path / "labels").write_bytes(bytes(8) + bytes([3, 1, 4, 1, 9]))
    rows = IM.read_idx(spark, str(tmp_path / "images"), str(tmp_path / "labels")).orderBy("index").collect()
    assert [r["label"] for r in rows] == [3, 1, 4, 1, 9]
    assert np.allclose([r["pixels"] for r in rows], pixels)


def test_colour_records(spark, tmp_path):
    planes = np.random.default_rng(2).integers(0, 256, (4, 3, 32, 32), dtype=np.uint8)
    (tmp_path / "data.bin").write_bytes(b"".join(bytes([i]) + planes[i].tobytes() for i in range(4)))
    rows = {r["label"]: r["pixels"] for r in IM.read_colour_records(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert np.allclose(rows[2], planes[2].transpose(1, 2, 0).ravel())


def test_coco(spark, tmp_path):
    doc = {
        "images": [{"id": 5, "coco_url": "http://x/val2017/5.jpg"}, {"id": 6, "coco_url": "http://x/val2017/6.jpg"}],
        "annotations": [
            {"id": 1, "image_id": 5, "category_id": 90, "area": 4.0, "bbox": [1, 2, 3, 4]},
            {"id": 2, "image_id": 5, "category_id": 7, "area": 0.0, "bbox": [1, 2, 3, 4]},
            {"id": 3, "image_id": 6, "category_id": 7, "area": 0.0, "bbox": [1, 2, 3, 4]},
        ],
        "categories": [{"id": 7}, {"id": 90}],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    assert [tuple(r) for r in IM.read_coco(spark, str(tmp_path / "c.json")).collect()] == [(5, "val2017/5.jpg", 1, 1, 1.0, 2.0, 3.0, 4.0)]


def test_detection_indexes(spark, tmp_path):
    (tmp_path / "p").write_text(json.dumps({"a.jpg": [9, 9, 9, 9, 2, 0.1, 0.2, 0.3, 0.4]}))
    (tmp_path / "b").write_text(json.dumps({"b.jpg": [1, 0.1, 0.2, 0.3, 0.4]}))
    first = IM.read_detection_index(spark, str(tmp_path / "p")).first()
    second = IM.read_detection_index(spark, str(tmp_path / "b"), 0, 1).first()
    assert (first["image"], first["class"], second["class"]) == ("a.jpg", 2, 1)
    assert np.allclose([first["h"], second["x"]], [0.4, 0.1])


def test_digits(spark):
    df = spark.createDataFrame([("train/0123.jpg",)], "n string")
    assert df.select(IM.digits_from_name(F.col("n")).alias("d")).first()["d"] == [0, 1, 2, 3, 11, 11]


def test_generators(spark):
    assert [r["v"] for r in G.arange(spark, 0, 1, 0.3).orderBy("i").collect()] == pytest.approx([0, 0.3, 0.6, 0.9])
    assert [r["v"] for r in G.linspace(spark, 0, 1, 4, endpoint=False).orderBy("i").collect()] == pytest.approx([0, 0.25, 0.5, 0.75])
    assert G.eye(spark, 3, 4, -1).count() == 2 and G.full(spark, 2, 3, 1.0).count() == 6


def test_random_values(spark):
    df = spark.range(20000)
    drawn = df.select("id", G.random_uniform(1, "id").alias("u"), G.random_normal(2, "id").alias("n"), G.random_integer(3, "id", low=2, high=5).alias("i"))
    out = G.truncated_normal(drawn, "id", 4, target="t").toPandas().sort_values("id")
    assert abs(out["u"].mean() - 0.5) < 0.01 and abs(out["n"].std() - 1) < 0.03 and set(out["i"]) == {2, 3, 4}
    assert out["t"].abs().max() <= 2 and abs(out["t"].std() - 0.88) < 0.03
    again = G.truncated_normal(drawn.repartition(7), "id", 4, target="t").toPandas().sort_values("id")
    assert (again["t"].to_numpy() == out["t"].to_numpy()).all()
    counts = G.multinomial(df, "id", [0.5, 0.0, 0.5], 1).toPandas().set_index("outcome")["n"]
    assert counts.sum() == 20000 and counts[1] == 0
    shares = df.select(G.usage(F.col("id")).alias("u")).groupBy("u").count().toPandas().set_index("u")["count"] / 20000
    assert abs(shares["train"] - 0.8) < 0.01 and abs(shares["test"] - 0.1) < 0.01


def test_prediction_json(spark, tmp_path):
    df = spark.createDataFrame([(1, [(f"c{i}", 0.5 / (i + 1)) for i in range(7)])], "id int, top array<struct<class: string, prob: double>>")
    K.write_predictions(df, str(tmp_path / "p"), "id", "top")
    text = spark.read.text(str(tmp_path / "p")).first()["value"]
    assert len(json.loads(json.loads(text)["classes"])) == 5


def test_small_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(1500):
        (tmp_path / f"D{i}.java").write_bytes([b"a \n\nb", b"", b"\xef\xbb\xbfx\r\n"][i % 3])
    tasks, cut = [], TX.cut_lineage
    monkeypatch.setattr(TX, "cut_lineage", lambda df: tasks.append(df.rdd.getNumPartitions()) or cut(df))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = {r["path"].rsplit("/", 1)[1]: r["lines"] for r in TX.read_code(spark, str(tmp_path)).collect()}
    # Spark leaves out files without a byte.
    assert found["D0.java"] == ["a", "b"] and found["D2.java"] == ["\ufeffx"] and len(found) == 1000
    # By Spark's usual cost of a file there are 47 and more.
    assert tasks[0] <= 2 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_whole_files_are_what_the_text_reader_gives(spark, tmp_path):
    for i, content in enumerate([b"", b"\xef\xbb\xbfx\r\n", b"\xff\xfe y", "é日\0".encode()]):
        (tmp_path / f"{i} ä_1.txt").write_bytes(content)
    with gzip.open(tmp_path / "z_1.txt.gz", "wb") as out:
        out.write(b"packed")
    for pattern in ("*.txt", "*.txt.gz"):
        text = spark.read.option("pathGlobFilter", pattern).text(str(tmp_path), wholetext=True)
        want = text.select(F.hex("value"), "_metadata.file_path").collect()
        got = TX.whole_files(spark, str(tmp_path), pattern).select(F.hex("text"), "path").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == (3 if pattern == "*.txt" else 1)
