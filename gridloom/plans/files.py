"""Sources and sinks: tables are written to the shared folder in a foreign format and read back."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.operators import features as FE
from gridloom.operators.lookup import checked_lookup
from gridloom.operators.tensors import explode_rows
from gridloom.plans.registry import query, r6
from gridloom.session import scratch_path, spread
from gridloom.sources import images as IM
from gridloom.sources import sinks as K
from gridloom.sources import tabular as TB
from gridloom.sources import text as TX

PER_FILE = 2048


@query("csv_with_header", "S01", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_with_header(t):
    path = scratch_path(t.spark, "csv")
    padded = t.customer.select(
        F.col("c_custkey").alias("C_CUSTKEY"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("C_Name"), "c_nationkey",
        "c_acctbal", F.col("c_mktsegment").alias("C_MKTSEGMENT"),
    )
    padded.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return TB.read_csv(t.spark, path, {"c_custkey": "long", "c_name": "string", "c_acctbal": "double", "c_mktsegment": "string"})


@query("csv_gzip", "S02", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def csv_gzip(t):
    path = scratch_path(t.spark, "gz")
    t.orders.write.options(header=True, compression="gzip").csv(path)
    return TB.read_csv(t.spark, path, {"o_orderkey": "long", "o_totalprice": "double", "o_orderstatus": "string"}, partitions=t.spark.sparkContext.defaultParallelism)


@query("tsv_without_quotes", "S03", r"""
SELECT doc_id, md5(trim(regexp_replace('"' || text, '[\t\r\n]', '/', 'g'))) AS digest FROM documents""")
def tsv_without_quotes(t):
    path = scratch_path(t.spark, "tsv")
    body = F.concat(F.lit('"'), F.regexp_replace("text", "[\t\r\n]", "/"))
    rows = t.documents.select(F.col("doc_id").alias("DOC_ID"), body.alias("BODY"))
    rows.write.options(sep="\t", header=True, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    out = TB.read_tsv(t.spark, path, {"doc_id": "long", "body": "string"})
    return out.select("doc_id", F.md5(F.trim("body")).alias("digest"))


@query("tsv_without_header", "S04", """
SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, round(sum(l_tax), 2) AS tax FROM lineitem""")
def tsv_without_header(t):
    path = scratch_path(t.spark, "tsv")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    t.lineitem.select(*names).write.options(sep="\t").csv(path)
    out = TB.read_headerless_tsv(t.spark, path, dict.fromkeys(names, "double"))
    return out.agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.sum("l_tax"), 2).alias("tax"),
    )


@query("feature_catalogue", "S05 P04 P05", """
WITH m AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS ix FROM (SELECT DISTINCT p_type FROM part)),
x AS (SELECT p_partkey, list_concat([p_size::DOUBLE], [CASE WHEN k = ix THEN 1.0 ELSE 0.0 END::DOUBLE FOR k IN range((SELECT count(*) FROM m))]) AS data FROM part JOIN m USING (p_type))
SELECT p_partkey, unnest(data) AS v, generate_subscripts(data, 1) - 1 AS pos FROM x""")
def feature_catalogue(t):
    """A catalogue file names the feature order, the categorical columns and their value maps."""
    path = scratch_path(t.spark, "catalogue")
    kinds = [r["p_type"] for r in t.part.select("p_type").distinct().orderBy("p_type").collect()]
    spec = {"featureArray": ["p_size", "p_type"], "categorical": ["p_type"], "featureToMap": {"p_type": {k: i for i, k in enumerate(kinds)}}}
    t.spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(path)
    text = t.spark.read.text(path, wholetext=True).first()["value"]
    out = FE.featurize(t.part, FE.catalogue(text), [FE.Feature("p_retailprice")], "p_partkey")
    out = explode_rows(out, "data", ["p_partkey"])
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("parallel_sentences", "S06", r"""
SELECT md5(regexp_replace(q.text, '[\t\r\n]', ' ', 'g')) AS source, md5(regexp_replace(a.text, '[\t\r\n]', ' ', 'g')) AS target FROM conversations q JOIN conversations a
ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'""")
def parallel_sentences(t):
    from gridloom.plans.texts import question_pairs

    path = scratch_path(t.spark, "pairs")
    flat = [F.regexp_replace(c, "[\t\r\n]", " ") for c in ("qt", "ans")]
    question_pairs(t).select(F.concat_ws("\t", *flat).alias("value")).write.text(path)
    return TX.read_parallel(t.spark, path).select(F.md5("source").alias("source"), F.md5("target").alias("target"))


@query("review_paths", "S07", """
SELECT doc_id, quality AS label, (doc_id % 10)::INT AS score FROM labels""")
def review_paths(t):
    path = F.concat(
        F.lit("/data/train/"), F.when(F.col("quality") == 1, "pos").otherwise("neg"), F.lit("/"), "doc_id", F.lit("_"),
        (F.col("doc_id") % 10).cast("string"), F.lit(".txt"),
    )
    parts = TX.review_path_parts(F.col("path"))
    return t.labels.select(path.alias("path")).select(*[c.alias(n) for n, c in parts.items()])


@query("labelled_lines", "S08", r"""
SELECT array_to_string([lang, source], ',') AS labels, md5(regexp_replace(text, '^\s+|[\r\n]', '', 'g')) AS text FROM documents""")
def labelled_lines(t):
    path = scratch_path(t.spark, "lines")
    marks = F.concat(F.lit("__label__"), "lang", F.lit(" __label__"), "source", F.lit(" "))
    body = F.regexp_replace("text", r"^\s+|[\r\n]", "")
    t.documents.select(F.concat(marks, body).alias("value")).write.text(path)
    out = TX.read_labelled_lines(t.spark, path)
    return out.select(F.array_join("labels", ",").alias("labels"), F.md5("text").alias("text"))


IMAGE_PATHS = """CASE WHEN doc_id % 7 = 0 THEN '/data/img/' || source || '/.hidden' || doc_id || '.png' WHEN doc_id % 7 = 1 THEN '/data/img/' || source || '/deep/' || doc_id || '.png'
    WHEN doc_id % 7 = 2 THEN '/data/img/' || source || '/' || doc_id || '.txt' WHEN doc_id % 7 = 3 THEN '/data/img/' || source || '/' || doc_id || '.JPG' ELSE '/data/img/' || source || '/' || doc_id || '.bmp' END"""


@query("image_folder_labels", "S09 S10", f"""
WITH p AS (SELECT doc_id, source, {IMAGE_PATHS} AS path FROM documents WHERE doc_id % 7 >= 3), r AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS label FROM (SELECT DISTINCT source FROM p))
SELECT path, source AS class, label FROM p JOIN r USING (source)""")
def image_folder_labels(t):
    paths = t.documents.select(F.expr(IMAGE_PATHS).alias("path"))
    return IM.label_paths(paths, "path", "/data/img")


@query("binary_records", "S11", """
WITH b AS (SELECT vec_id, unnest([trunc(abs(x::DOUBLE) * 255) FOR x IN embedding]) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)
SELECT vec_id, p // 16 AS index, sum(v)::DOUBLE AS total, max(v)::DOUBLE AS largest FROM b GROUP BY 1, 2""")
def binary_records(t):
    """Each vector becomes a file with a 16 byte header and four 4 x 4 images."""
    cells = F.transform("embedding", lambda x: F.lpad(F.hex((F.abs(x.cast("double")) * 255).cast("int")), 2, "0"))
    files = t.embeddings.select("vec_id", F.unhex(F.concat(F.lit("00" * 16), F.array_join(cells, ""))).alias("content"))
    out = IM.split_records(files, "vec_id", "content", 16, 16).select("vec_id", "index", IM.bytes_to_array(F.col("record")).alias("x"))
    return out.select("vec_id", "index", A.total(F.col("x")).alias("total"), F.array_max("x").alias("largest"))


@query("colour_records", "S12", """
WITH e AS (SELECT vec_id, label, list_concat([trunc(abs(x::DOUBLE) * 255) FOR x IN embedding], [0, 0]) AS e FROM embeddings),
b AS (SELECT vec_id, label, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS p FROM e)
SELECT vec_id, label, (p % 22) * 3 + p // 22 AS pos, v::DOUBLE AS v FROM b""")
def colour_records(t):
    """A label byte and three 2 x 11 planes per vector, the last two bytes zero."""
    cells = F.transform("embedding", lambda x: F.lpad(F.hex((F.abs(x.cast("double")) * 255).cast("int")), 2, "0"))
    raw = F.unhex(F.concat(F.lpad(F.hex("label"), 2, "0"), F.array_join(cells, ""), F.lit("0000")))
    out = IM.with_colour_pixels(t.embeddings.select("vec_id", raw.alias("record")), "record", 2, 11)
    out = explode_rows(out, "pixels", ["vec_id", "label"])
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("review_files", "S07", """
SELECT d.doc_id, quality AS label, (d.doc_id % 10)::INT AS score, md5(text) AS digest FROM documents d JOIN labels USING (doc_id)""")
def review_files(t):
    """A file per labelled document in a folder per class, read back whole."""
    path = scratch_path(t.spark, "reviews")
    name = F.concat(F.when(F.col("quality") == 1, "pos").otherwise("neg"), F.lit("/"), "doc_id", F.lit("_"), (F.col("doc_id") % 10).cast("string"), F.lit(".txt"))
    rows = t.documents.join(t.labels, "doc_id").select(name.alias("name"), F.encode("text", "UTF-8").alias("content"))
    K.write_files(rows, path, "name", "content")
    return TX.read_reviews(t.spark, path).select("doc_id", "label", "score", F.md5("text").alias("digest"))


def gray_bytes(array: str = "embedding"):
    """A vector as unsigned bytes, hex-coded."""
    return F.array_join(F.transform(array, lambda x: F.lpad(F.hex((F.abs(x.cast("double")) * 255).cast("int")), 2, "0")), "")


def bitmap(pixels, side: int = 8):
    """A bitmap file of 24 bits a pixel, rows bottom up, gray; the side must be a multiple of four."""
    size = 3 * side * side
    little = lambda n, width: n.to_bytes(width, "little").hex()
    head = "424d" + little(54 + size, 4) + "00000000" + little(54, 4) + little(40, 4) + little(side, 4) + little(side, 4) + little(1, 2) + little(24, 2)
    head += "00000000" + little(size, 4) + "00000000" * 4
    rows = F.reverse(F.sequence(F.lit(0), F.lit(side - 1)))
    body = F.transform(rows, lambda r: F.regexp_replace(F.substring(pixels, r * 2 * side + 1, F.lit(2 * side)), "(..)", "$1$1$1"))
    return F.unhex(F.concat(F.lit(head), F.array_join(body, "")))


IMAGE_FILES = """c AS (SELECT label AS class, vec_id, unnest([trunc(abs(x::DOUBLE) * 255) FOR x IN embedding])::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)"""


@query("image_files", "S09", f"""
WITH {IMAGE_FILES} SELECT vec_id, 'class' || class AS class, dense_rank() OVER (ORDER BY 'class' || class) - 1 AS label, count(*) * 3 AS cells, sum(v) * 3 AS total, sum(v * (p + 1)) AS weighted
FROM c GROUP BY vec_id, class""")
def image_files(t):
    """An 8 x 8 picture per vector in a folder per class; classes are numbered by name."""
    path = scratch_path(t.spark, "images")
    name = F.concat(F.lit("class"), "label", F.lit("/"), "vec_id", F.lit(".bmp"))
    K.write_files(t.embeddings.select(name.alias("name"), bitmap(gray_bytes()).alias("content")), path, "name", "content")
    return _image_sums(IM.read_image_folder(t.spark, path))


def _image_sums(read):
    # Red, green and blue are equal; the weight of a pixel is its place.
    weighted = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0.0), lambda s, p: s + F.get("pixels", p * 3) * (p + 1))
    number = F.regexp_extract("path", r"/(\d+)\.bmp$", 1).cast("long")
    return read.select(number.alias("vec_id"), "class", "label", F.size("pixels").cast("long").alias("cells"), A.total(F.col("pixels")).alias("total"), weighted.alias("weighted"))


@query("listed_image_files", "S10", f"""
WITH {IMAGE_FILES} SELECT vec_id, 'class' || class AS class, (9 - class)::BIGINT AS label, count(*) * 3 AS cells, sum(v) * 3 AS total, sum(v * (p + 1)) AS weighted
FROM c WHERE class <> 4 GROUP BY vec_id, class""")
def listed_image_files(t):
    """The same with a class list in a file: it numbers the classes backwards and leaves one out."""
    path = scratch_path(t.spark, "listed")
    name = F.concat(F.lit("img/class"), "label", F.lit("/"), "vec_id", F.lit(".bmp"))
    K.write_files(t.embeddings.select(name.alias("name"), bitmap(gray_bytes()).alias("content")), path, "name", "content")
    labels = t.embeddings.agg(F.sort_array(F.collect_set("label"), asc=False).alias("l"))
    lines = F.transform("l", lambda c: F.concat(F.when(c == 4, F.lit("other")).otherwise(F.concat(F.lit("class"), c.cast("string"))), F.lit(" of pictures")))
    K.write_files(labels.select(F.lit("synset.txt").alias("name"), F.encode(F.array_join(lines, "\n"), "UTF-8").alias("content")), path, "name", "content")
    return _image_sums(IM.read_image_folder(t.spark, f"{path}/img", classes=IM.read_class_list(t.spark, f"{path}/synset.txt")))


def _pieces(vectors, files):
    """Vectors dealt to ``files`` files by id, each cut by id into pieces of at most PER_FILE vectors; ``part`` names the piece."""
    cut = vectors.withColumn("file", F.col("vec_id") % files).withColumn("piece", F.expr(f"vec_id div {files * PER_FILE}"))
    return cut.withColumn("part", F.concat("file", F.lit("-"), F.lpad(F.col("piece").cast("string"), 19, "0")))


def _places(cut):
    """One row per piece: its number by name, and the number in its file of its first record."""
    before = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("file", "piece", "part").agg(F.count(F.lit(1)).alias("n"))
    number = (F.row_number().over(Window.orderBy("part")) - 1).alias("number")
    return counts.select("part", "file", number, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_index"))


@query("idx_files", "S11", """
SELECT vec_id % 4 AS file, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS index, label, list_sum([trunc(abs(x::DOUBLE) * 255) FOR x IN embedding])::DOUBLE AS total FROM embeddings""")
def idx_files(t):
    """Four image files and four label files of 8 x 8 pictures, in pieces of bounded size."""
    path = scratch_path(t.spark, "idx")
    cut = _pieces(t.embeddings, 4)
    packed = cut.groupBy("part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", gray_bytes().alias("b")))), lambda s: s["b"]), "").alias("pictures"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", F.lpad(F.hex("label"), 2, "0").alias("b")))), lambda s: s["b"]), "").alias("labels"),
    )
    for kind, head in (("pictures", 16), ("labels", 8)):
        name = F.concat(F.lit(f"{kind}/part-"), "part", F.lit(".idx"))
        K.write_files(packed.select(name.alias("name"), F.unhex(F.concat(F.lit("00" * head), kind)).alias("content")), path, "name", "content")
    out = IM.read_idx(t.spark, f"{path}/pictures", f"{path}/labels", 64)
    out = checked_lookup(out.withColumnRenamed("file", "number"), _places(cut), ["number"], ["index"], how="inner")
    return out.select(F.col("file").cast("long").alias("file"), (F.col("first_index") + F.col("index")).alias("index"), "label", A.total(F.col("pixels")).alias("total"))


@query("colour_record_files", "S12", """
WITH e AS (SELECT vec_id % 3 AS file, row_number() OVER (PARTITION BY vec_id % 3 ORDER BY vec_id) - 1 AS index, label, [trunc(abs(x::DOUBLE) * 255) FOR x IN embedding] AS v FROM embeddings)
SELECT file, index, label, list_sum(v)::DOUBLE * 48 AS total, v[1]::DOUBLE AS first, v[64]::DOUBLE AS last FROM e""")
def colour_record_files(t):
    """Records of a label byte and 3,072 bytes in three files, in pieces of bounded size: each vector repeated to fill its planes."""
    path = scratch_path(t.spark, "colours")
    record = F.concat(F.lpad(F.hex("label"), 2, "0"), F.repeat(gray_bytes(), F.lit(48)))
    cut = _pieces(t.embeddings, 3)
    packed = cut.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("vec_id", record.alias("r")))).alias("r"))
    content = F.unhex(F.array_join(F.transform("r", lambda s: s["r"]), ""))
    K.write_files(packed.select(F.concat(F.lit("batch_"), "part", F.lit(".bin")).alias("name"), content.alias("content")), path, "name", "content")
    out = IM.read_colour_records(t.spark, path)
    out = out.withColumn("part", F.regexp_extract("path", r"batch_([^/]*)\.bin$", 1))
    # The pieces' side is the one to broadcast: a plan may take the records, read from rows of file ranges, for a few bytes.
    out = checked_lookup(out, _places(cut), ["part"], ["index"], how="inner")
    return out.select(F.col("file").cast("long").alias("file"), (F.col("first_index") + F.col("index")).alias("index"), "label", A.total(F.col("pixels")).alias("total"), F.get("pixels", F.lit(0)).alias("first"), F.element_at("pixels", -1).alias("last"))


@query("source_tree", "S17", r"""
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS raw FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, regexp_replace(raw, '[\s\x0B]+$', '') AS line FROM l)
SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM k WHERE line <> '' GROUP BY 1""")
def source_tree(t):
    """Documents as source files two folders deep, next to files of another kind, read as lines."""
    path = scratch_path(t.spark, "tree")
    where = F.concat("source", F.lit("/"), "lang", F.lit("/Doc"), "doc_id")
    docs = t.documents.select(where.alias("w"), F.encode("text", "UTF-8").alias("content"))
    K.write_files(spread(docs, "w").select(F.concat("w", F.lit(".java")).alias("name"), "content"), path, "name", "content")
    K.write_files(docs.limit(5).select(F.concat("w", F.lit(".txt")).alias("name"), "content"), path, "name", "content")
    read = TX.read_code(t.spark, path).withColumn("doc_id", F.regexp_extract("path", r"Doc(\d+)\.java$", 1).cast("long"))
    lines = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return read.where(F.size("lines") > 0).select("doc_id", F.size("lines").cast("long").alias("lines"), lines.alias("chars"))


@query("coco_annotations", "S13 J07", """
SELECT l_orderkey AS image_id, 'val/' || l_orderkey || '.jpg' AS file, l_partkey * 10000 + l_suppkey AS annotation_id, 19 - l_partkey % 20 AS class, l_tax AS x, l_quantity AS w
FROM lineitem WHERE l_discount > 0""")
def coco_annotations(t):
    """Orders as images, line items as their boxes, in twenty classes listed backwards; one document per 256 orders."""
    path = scratch_path(t.spark, "coco")
    note = F.struct(
        (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("image_id"),
        (F.col("l_partkey") % 20 * 3).alias("category_id"), F.col("l_discount").alias("area"),
        F.array("l_tax", "l_tax", "l_quantity", "l_quantity").alias("bbox"),
    )
    image = F.struct(F.col("l_orderkey").alias("id"), F.concat(F.lit("http://x/val/"), "l_orderkey", F.lit(".jpg")).alias("coco_url"))
    rows = t.lineitem.select(F.floor(F.col("l_orderkey") / 256).alias("b"), image.alias("image"), note.alias("note"))
    none = "array<struct<id: bigint>>"
    docs = rows.groupBy("b").agg(F.collect_set("image").alias("images"), F.collect_list("note").alias("annotations"))
    docs = docs.withColumn("categories", F.array().cast(none)).drop("b")
    classes = t.spark.createDataFrame([([{"id": 57 - 3 * i} for i in range(20)],)], f"categories {none}")
    docs.unionByName(classes, allowMissingColumns=True).write.json(path, compression="gzip")
    document = t.spark.read.schema(IM.COCO_SCHEMA).json(path)
    return IM.coco_boxes(document).select("image_id", "file", "annotation_id", F.col("class").cast("long").alias("class"), "x", "w")


@query("detection_index_files", "S14 S15", """
SELECT 'first' AS layout, 'img' || vec_id || '.jpg' AS image, label::BIGINT AS class, embedding[2]::DOUBLE AS x, embedding[5]::DOUBLE AS h FROM embeddings
UNION ALL SELECT 'second', 'img' || vec_id || '.jpg', label, embedding[2]::DOUBLE, embedding[5]::DOUBLE FROM embeddings""")
def detection_index_files(t):
    def index(prefix):
        parts = [F.lit(0.0).cast("float")] * prefix + [F.col("label").cast("float")]
        numbers = F.concat(F.array(*parts), F.slice("embedding", 2, 4))
        pair = F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("img"), "vec_id", F.lit(".jpg"))), F.array(numbers)))
        return t.embeddings.select(pair.alias("value"))

    out = []
    for layout, class_at in (("first", 4), ("second", 0)):
        path = scratch_path(t.spark, "index")
        index(class_at).write.text(path)
        read = t.spark.read.text(path)
        out.append(IM.detection_index(read, "value", class_at, class_at + 1).select(F.lit(layout).alias("layout"), "image", "class", "x", "h"))
    return out[0].unionByName(out[1])


@query("digits_in_names", "S16", """
WITH s AS (SELECT o_orderkey, (o_orderkey * 7)::VARCHAR AS s FROM orders)
SELECT o_orderkey, array_to_string([CASE WHEN i <= length(s) THEN s[i:i]::INT ELSE 11 END FOR i IN range(1, 7)], ',') AS digits FROM s""")
def digits_in_names(t):
    name = F.concat(F.lit("train/"), (F.col("o_orderkey") * 7).cast("string"), F.lit(".jpg"))
    return t.orders.select("o_orderkey", F.array_join(IM.digits_from_name(name).cast("array<string>"), ",").alias("digits"))


@query("token_list_file", "S19", """
SELECT p_brand AS token, row_number() OVER (ORDER BY p_brand) - 1 AS id FROM (SELECT DISTINCT p_brand FROM part)""")
def token_list_file(t):
    """Brand names as a vocabulary file of one token per line."""
    path = scratch_path(t.spark, "tokens")
    t.part.select(F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("value")).distinct().coalesce(1).sortWithinPartitions("value").write.text(path)
    return TX.read_token_list(t.spark, path)


@query("exported_matrix", "K01", """
SELECT vec_id, label::DOUBLE AS y, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, 65 AS width FROM embeddings""")
def exported_matrix(t):
    path = scratch_path(t.spark, "matrix")
    K.write_matrix(t.embeddings, path, ["embedding", "vec_id"], ["label"])
    out = t.spark.read.parquet(path)
    return out.select(
        F.element_at("data", -1).cast("long").alias("vec_id"), F.get("labels", F.lit(0)).alias("y"), F.get("data", F.lit(0)).alias("first"),
        F.element_at("data", -2).alias("last"), F.size("data").alias("width"),
    )


@query("prediction_files", "K02", """
WITH x AS (SELECT vec_id, unnest(embedding[1:10])::DOUBLE * 10 AS s, generate_subscripts(embedding[1:10], 1) - 1 AS k FROM embeddings),
z AS (SELECT vec_id, k, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS place FROM x)
SELECT vec_id, count(*) AS n, round(sum(p), 6) AS mass, string_agg('class_' || k, ' ' ORDER BY place) AS classes FROM z WHERE place <= 5 GROUP BY 1""")
def prediction_files(t):
    path = scratch_path(t.spark, "predictions")
    s = t.embeddings.select("vec_id", A.softmax(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10)).alias("p"))
    named = s.select("vec_id", A.top_k(F.array(*[F.lit(f"class_{k}") for k in range(10)]), F.col("p"), 8).alias("top"))
    K.write_predictions(named, path, "vec_id", "top")
    read = t.spark.read.schema("vec_id long, classes string").json(path)
    parsed = read.select("vec_id", F.from_json("classes", "array<struct<className: string, probability: double>>").alias("c"))
    return parsed.select(
        "vec_id", F.size("c").cast("long").alias("n"), r6(A.total(F.transform("c", lambda x: x["probability"]))).alias("mass"),
        F.array_join(F.transform("c", lambda x: x["className"]), " ").alias("classes"),
    )


@query("metric_log_files", "K03", "SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def metric_log_files(t):
    path = scratch_path(t.spark, "metrics")
    log = t.events.select(F.col("event_type").alias("name"), "value", F.lit("count").alias("unit"), "ts")
    half = F.pmod(F.xxhash64("ts", "value"), F.lit(2))
    for part in (0, 1):
        K.append_metrics(log.filter(half == part), path)
    return t.spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
