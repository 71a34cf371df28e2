"""Box, anchor, region, key-point and image queries on boxes and maps cut from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.functions import boxes as BX
from gridloom.operators import detection as D
from gridloom.operators import images as I
from gridloom.operators import ordering as O
from gridloom.operators import regions as R
from gridloom.operators import tensors as T
from gridloom.operators.lookup import checked_lookup
from gridloom.operators.tensors import explode_rows
from gridloom.plans.registry import query, r6, uniform_sql

# Ten boxes per vector, six entries each; twenty vectors make an image, the vector label is the class.
BOXES = """raw AS (SELECT vec_id, label, n, [embedding[n * 6 + k + 1]::DOUBLE FOR k IN range(6)] AS e FROM embeddings, (SELECT unnest(range(10)) AS n)),
    bx AS (SELECT vec_id * 10 + n AS box_id, vec_id // 20 AS image, label % 3 AS class, abs(e[5]) * 2 AS score,
        greatest(0.5 + e[1] - (0.15 + abs(e[3])) / 2, 0.0) AS x, greatest(0.5 + e[2] - (0.15 + abs(e[4])) / 2, 0.0) AS y, 0.15 + abs(e[3]) AS w, 0.15 + abs(e[4]) AS h FROM raw)"""
IOU = """greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"""


def iou_sql(a: str = "a", b: str = "b") -> str:
    common = IOU.replace("a.", f"{a}.").replace("b.", f"{b}.")
    return f"({common}) / ({a}.w * {a}.h + {b}.w * {b}.h - ({common}))"


def boxes(t):
    raw = t.embeddings.select(
        "vec_id", "label", F.posexplode(
            F.transform(F.sequence(F.lit(0), F.lit(9)), lambda n: F.transform(F.slice("embedding", n * 6 + 1, 6), lambda x: x.cast("double")))
        ).alias("n", "e"),
    )
    at = [F.element_at("e", k) for k in range(1, 7)]
    decoded = BX.from_centre(0.5 + at[0], 0.5 + at[1], 0.15 + F.abs(at[2]), 0.15 + F.abs(at[3]))
    out = raw.select(
        (F.col("vec_id") * 10 + F.col("n")).alias("box_id"), F.floor(F.col("vec_id") / 20).alias("image"),
        (F.col("label") % 3).alias("class"), (F.abs(at[4]) * 2).alias("score"), decoded.alias("b"),
    )
    return out.select("box_id", "image", "class", "score", "b.x", "b.y", "b.w", "b.h")


@query("box_overlap", "V01", f"""
WITH {BOXES} SELECT a.box_id, round({iou_sql()}, 6) + 0.0 AS iou FROM bx a JOIN bx b ON b.box_id = a.box_id + 1""")
def box_overlap(t):
    b = boxes(t).select("box_id", BX.box(*map(F.col, "xywh")).alias("a"))
    other = b.select((F.col("box_id") - 1).alias("box_id"), F.col("a").alias("b"))
    return b.join(other, "box_id").select("box_id", r6(BX.iou(F.col("a"), F.col("b"))).alias("iou"))


def nms_sql(boxes: str, threshold: float, rule: str, columns: str) -> str:
    return f"""
WITH RECURSIVE {boxes}, rk AS (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY score DESC, box_id) AS r FROM bx),
nb AS (SELECT b.image, b.class, b.r, b.box_id, list(a.r) FILTER ({iou_sql()} {rule} {threshold}) AS rivals FROM rk b LEFT JOIN rk a
    ON a.image = b.image AND a.class = b.class AND a.r < b.r GROUP BY ALL),
g AS (SELECT image, class, 0::BIGINT AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT image, class FROM rk)
    UNION ALL SELECT nb.image, nb.class, nb.r, CASE WHEN list_has_any(g.kept, coalesce(nb.rivals, [])) THEN g.kept ELSE list_append(g.kept, nb.r) END
    FROM g JOIN nb ON g.image = nb.image AND g.class = nb.class AND nb.r = g.r + 1)
SELECT {columns} FROM rk JOIN (SELECT image, class, arg_max(kept, r) AS kept FROM g GROUP BY 1, 2) k USING (image, class) WHERE list_contains(kept, rk.r)"""


@query("suppress_boxes", "V02", nms_sql(BOXES, 0.4, ">=", "image, class, box_id, round(score, 6) AS score"))
def suppress_boxes(t):
    kept = D.suppress(boxes(t), ["image", "class"], "box_id", "score", 0.4)
    return kept.select("image", "class", "box_id", r6("score").alias("score"))


@query("suppress_boxes_spread", "V02", nms_sql(BOXES, 0.4, ">=", "image, class, box_id, round(score, 6) AS score"))
def suppress_boxes_spread(t):
    """Same question with a group limit so low that the path for crowded images is taken."""
    kept = D.suppress(boxes(t), ["image", "class"], "box_id", "score", 0.4, max_group=60)
    return kept.select("image", "class", "box_id", r6("score").alias("score"))


@query("decode_objectness", "V03", """
WITH x AS (SELECT vec_id, [0.5 + embedding[1]::DOUBLE, 0.5 + embedding[2]::DOUBLE, abs(embedding[3]::DOUBLE), abs(embedding[4]::DOUBLE), abs(embedding[5]::DOUBLE) * 5] AS e,
[x::DOUBLE * 5 FOR x IN embedding[6:15]] AS c FROM embeddings), y AS (SELECT *, greatest(list_max(c), 0) AS best FROM x)
SELECT vec_id, CASE WHEN best > 0 THEN list_position(c, list_max(c)) - 1 ELSE 0 END AS class, round(best * e[5], 6) AS score, round(greatest(e[1] - e[3] / 2, 0), 6) + 0.0 AS x,
round(greatest(e[2] - e[4] / 2, 0), 6) + 0.0 AS y, round(e[3], 6) AS w, round(e[4], 6) AS h FROM y WHERE best * e[5] > 0.2""")
def decode_objectness(t):
    e = F.col("embedding")
    at = [F.element_at(e, k).cast("double") for k in range(1, 6)]
    head = F.array(0.5 + at[0], 0.5 + at[1], F.abs(at[2]), F.abs(at[3]), F.abs(at[4]) * 5)
    row = F.concat(head, F.transform(F.slice(e, 6, 10), lambda x: x.cast("double") * 5))
    parts = BX.objectness_row(F.col("row"))
    out = t.embeddings.select("vec_id", row.alias("row")).select("vec_id", *[c.alias(n) for n, c in parts.items()])
    out = out.filter(F.col("score") > 0.2)
    return out.select("vec_id", F.col("class").cast("int").alias("class"), r6("score").alias("score"), *[r6(f"box.{c}").alias(c) for c in "xywh"])


CORNERS = """co AS (SELECT box_id, image, class, score, (x - 0.1) * 400 AS x0, (y - 0.1) * 300 AS y0, (x + w) * 400 AS x1, (y + h) * 300 AS y1 FROM bx)"""


def corners(t):
    b = boxes(t)
    return b.select(
        "box_id", "image", "class", "score", ((F.col("x") - 0.1) * 400).alias("x0"), ((F.col("y") - 0.1) * 300).alias("y0"),
        ((F.col("x") + F.col("w")) * 400).alias("x1"), ((F.col("y") + F.col("h")) * 300).alias("y1"),
    )


@query("detector_corners", "V04 V20", f"""
WITH {BOXES}, {CORNERS} SELECT box_id, class, round(score, 6) AS score, round(x0 / 400, 6) + 0.0 AS x, round(y0 / 300, 6) + 0.0 AS y, round((x1 - x0) / 400, 6) AS w, round((y1 - y0) / 300, 6) AS h
FROM co WHERE class - 1 >= 0 AND score > 0.3""")
def detector_corners(t):
    c = corners(t).filter((F.col("class") - 1 >= 0) & (F.col("score") > 0.3))
    unit = BX.from_corners(F.col("x0") / 400, F.col("y0") / 300, F.col("x1") / 400, F.col("y1") / 300)
    out = c.select("box_id", "class", "score", unit.alias("b"))
    return out.select("box_id", "class", r6("score").alias("score"), *[r6(f"b.{k}").alias(k) for k in "xywh"])


@query("detector_clipped", "V05", f"""
WITH {BOXES}, {CORNERS} SELECT box_id, class, round(score, 6) AS score, round(greatest(least(x0, 400), 0) / 400, 6) + 0.0 AS x, round(greatest(least(y0, 300), 0) / 300, 6) + 0.0 AS y,
round((greatest(least(x1, 400), 0) - greatest(least(x0, 400), 0)) / 400, 6) + 0.0 AS w, round((greatest(least(y1, 300), 0) - greatest(least(y0, 300), 0)) / 300, 6) + 0.0 AS h
FROM co WHERE NOT score < 0.25""")
def detector_clipped(t):
    b = BX.clipped_unit(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], 400.0, 300.0)
    out = corners(t).filter(~(F.col("score") < 0.25)).select("box_id", "class", "score", b.alias("b"))
    return out.select("box_id", "class", r6("score").alias("score"), *[r6(f"b.{k}").alias(k) for k in "xywh"])


@query("detector_named_arrays", "V16", """
WITH x AS (SELECT vec_id, n, (label + n) % 4 AS class, abs(embedding[n + 1]::DOUBLE) AS score, embedding[n + 11]::DOUBLE AS ymin, embedding[n + 21]::DOUBLE AS xmin,
embedding[n + 31]::DOUBLE AS ymax, embedding[n + 41]::DOUBLE AS xmax FROM embeddings, (SELECT unnest(range(10)) AS n))
SELECT vec_id, n, class, score, xmin AS x, ymin AS y, round(xmax - xmin, 6) + 0.0 AS w, round(ymax - ymin, 6) + 0.0 AS h FROM x WHERE n < 6 AND class >= 1 AND score > 0.1""")
def detector_named_arrays(t):
    e = F.col("embedding")

    def part(start):
        return F.transform(F.slice(e, start, 10), lambda x: x.cast("double"))

    arrays = t.embeddings.select(
        "vec_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda n: (F.col("label") + n) % 4).alias("classes"),
        F.transform(part(1), F.abs).alias("scores"),
        *[part(s).alias(n) for n, s in (("ymin", 11), ("xmin", 21), ("ymax", 31), ("xmax", 41))],
    )
    rows = arrays.select("vec_id", F.posexplode(F.arrays_zip("classes", "scores", "ymin", "xmin", "ymax", "xmax")).alias("n", "r"))
    kept = rows.filter((F.col("n") < 6) & (F.col("r.classes") >= 1) & (F.col("r.scores") > 0.1))
    b = BX.from_corners(F.col("r.xmin"), F.col("r.ymin"), F.col("r.xmax"), F.col("r.ymax"))
    return kept.select("vec_id", F.col("n").cast("long").alias("n"), F.col("r.classes").cast("long").alias("class"), F.col("r.scores").alias("score"), b.alias("b")).select(
        "vec_id", "n", "class", "score", "b.x", "b.y", r6("b.w").alias("w"), r6("b.h").alias("h")
    )


GRID = D.PriorGrid.of(8, 8, [0.3, 0.5], [1.0, 2.0, 0.5])
ANCHORS = """shapes AS (SELECT * FROM (VALUES (0, 0.3, 1.0), (1, 0.5, 1.0), (2, 0.3, 2.0), (3, 0.3, 0.5)) s(k, s, r)),
    an AS (SELECT (i * 8 + j) * 4 + k AS anchor_id, (j + 0.5) / 8.0::DOUBLE AS cx, (i + 0.5) / 8.0::DOUBLE AS cy, s * sqrt(r)::DOUBLE AS w, s / sqrt(r)::DOUBLE AS h FROM
    (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j), shapes),
    anc AS (SELECT *, cx - w / 2 AS x, cy - h / 2 AS y FROM an)"""


@query("prior_boxes", "V07", f"""
WITH {ANCHORS}, n AS (SELECT vec_id // 20 AS image, count(*) AS vectors FROM embeddings GROUP BY 1)
SELECT image, vectors, anchor_id, round(greatest(x, 0), 6) + 0.0 AS x0, round(greatest(y, 0), 6) + 0.0 AS y0, round(least(x + w, 1), 6) AS x1, round(least(y + h, 1), 6) AS y1 FROM anc, n""")
def prior_boxes(t):
    """Anchors of every image."""
    table = GRID.table(t.spark, clip=True)
    images = t.embeddings.groupBy(F.floor(F.col("vec_id") / 20).alias("image")).agg(F.count("*").alias("vectors"))
    rows = images.withColumn("anchor_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID.size() - 1).cast("long"))))
    out = checked_lookup(rows, table, ["anchor_id"], ["image"], how="inner")
    return out.select("image", "vectors", "anchor_id", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


# All boxes as truth, five vectors per image.
TRUTHS = BOXES + """, tr AS (SELECT box_id, box_id // 50 AS image, class, x, y, w * 1.5 AS w, h * 1.5 AS h FROM bx)"""
MATCH = f"""pr AS (SELECT b.image, b.box_id, b.class, a.anchor_id, {iou_sql()} AS iou,
    pow(b.x + b.w / 2 - a.cx, 2) + pow(b.y + b.h / 2 - a.cy, 2) AS far FROM tr b, anc a),
    cl AS (SELECT image, box_id, arg_max(anchor_id, [round(iou, 9), -round(far, 9), -anchor_id]) AS anchor_id, arg_max(iou, [round(iou, 9), -round(far, 9), -anchor_id]) AS iou, 1 AS claimed FROM pr GROUP BY 1, 2),
    cand AS (SELECT image, box_id, anchor_id, iou, claimed FROM cl UNION ALL SELECT image, box_id, anchor_id, iou, 0 FROM pr WHERE iou >= 0.5),
    pos AS (SELECT image, anchor_id, arg_max(box_id, [claimed, iou, -box_id]) AS box_id, arg_max(iou, [claimed, iou, -box_id]) AS iou FROM cand GROUP BY 1, 2)"""


def truths(t):
    return boxes(t).select(
        "box_id", F.floor(F.col("box_id") / 50).alias("image"), "class", "x", "y", (F.col("w") * 1.5).alias("w"), (F.col("h") * 1.5).alias("h")
    )


@query("match_anchors", "J08", f"""
WITH {TRUTHS}, {ANCHORS}, {MATCH} SELECT image, anchor_id, box_id, round(iou, 6) AS iou FROM pos""")
def match_anchors(t):
    out = D.match_priors(truths(t), GRID, "image", "box_id")
    return out.withColumn("iou", r6("iou"))


@query("detection_losses", "E16 E17 J08", f"""
WITH {TRUTHS}, {ANCHORS}, {MATCH}, im AS (SELECT DISTINCT image FROM tr),
ev AS (SELECT im.image, anc.anchor_id, coalesce(tr.class + 1, 0) AS target, (im.image + anc.anchor_id) % 4 AS guess, tr.x AS tx, anc.*, tr.x AS bx, tr.y AS by_, tr.w AS bw, tr.h AS bh
FROM im, anc LEFT JOIN pos ON pos.image = im.image AND pos.anchor_id = anc.anchor_id LEFT JOIN tr ON tr.box_id = pos.box_id),
o AS (SELECT image, (target = guess)::INT AS right_class, CASE WHEN tx IS NULL THEN 0 ELSE abs((bx + bw / 2 - cx) / w / 0.1) + abs((by_ + bh / 2 - cy) / h / 0.1) + abs(ln(bw / w) / 0.2) + abs(ln(bh / h) / 0.2) END AS err,
CASE WHEN tx IS NULL THEN 0 ELSE 1 END AS positive FROM ev)
SELECT image, round(avg(right_class), 6) AS class_accuracy, round(sum(err) / (count(*) * 4), 6) AS box_error, sum(positive)::BIGINT AS positives FROM o GROUP BY 1""")
def detection_losses(t):
    boxes_ = truths(t)
    matched = D.match_priors(boxes_, GRID, "image", "box_id")
    every = D.all_anchor_targets(boxes_, matched, boxes_.select("image", "box_id", "class"), GRID, "image", "box_id")
    anchors = GRID.table(t.spark).select("anchor_id", F.struct("cx", "cy", "w", "h").alias("prior"))
    located = checked_lookup(every, anchors, ["anchor_id"], ["image"], how="inner").join(boxes_.select("image", "box_id", BX.box(*map(F.col, "xywh")).alias("b")), ["image", "box_id"], "left")
    offsets = BX.encode_offsets(F.col("b"), F.col("prior"))
    error = F.when(F.col("b").isNull(), 0.0).otherwise(A.norm(offsets, 1))
    guess = (F.col("image") + F.col("anchor_id")) % 4
    return located.groupBy("image").agg(
        r6(F.avg((F.col("target") == guess).cast("int"))).alias("class_accuracy"), r6(F.sum(error) / (F.count("*") * 4)).alias("box_error"),
        F.count("b").alias("positives"),
    )


@query("hard_negative_anchors", "J08", f"""
WITH {TRUTHS}, {ANCHORS}, {MATCH}, im AS (SELECT DISTINCT image FROM tr),
ev AS (SELECT im.image, anc.anchor_id, coalesce(tr.class + 1, 0) AS target, (im.image * 37 + anc.anchor_id * 11) % 100 / 100.0::DOUBLE AS conf
FROM im, anc LEFT JOIN pos ON pos.image = im.image AND pos.anchor_id = anc.anchor_id LEFT JOIN tr ON tr.box_id = pos.box_id),
r AS (SELECT *, count(*) FILTER (target > 0) OVER (PARTITION BY image) AS p,
row_number() OVER (PARTITION BY image ORDER BY (target = 0 AND conf < 0.5) DESC, conf, anchor_id) AS r FROM ev)
SELECT image, anchor_id, CASE WHEN target > 0 THEN target WHEN conf < 0.5 AND r <= p * 3 THEN 0 ELSE -1 END AS target FROM r""")
def hard_negative_anchors(t):
    boxes_ = truths(t)
    matched = D.match_priors(boxes_, GRID, "image", "box_id")
    every = D.all_anchor_targets(boxes_, matched, boxes_.select("image", "box_id", "class"), GRID, "image", "box_id")
    scored = every.withColumn("conf", (F.col("image") * 37 + F.col("anchor_id") * 11) % 100 / 100.0)
    return D.hard_negatives(scored, "image", "conf", ratio=3.0).select("image", "anchor_id", F.col("target").cast("int").alias("target"))


PRIORS8 = """pri AS (SELECT i * 8 + j AS prior_id, (j + 0.5) / 8.0::DOUBLE AS cx, (i + 0.5) / 8.0::DOUBLE AS cy, 0.25::DOUBLE AS w, 0.25::DOUBLE AS h FROM
    (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j))"""


def head_outputs(t):
    """One prior per vector: four box offsets and six class scores."""
    e = t.embeddings.select(
        "vec_id", F.floor(F.col("vec_id") / 64).alias("image"), (F.col("vec_id") % 64).alias("prior_id"),
        F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 10).alias("loc"),
        F.transform(F.slice("embedding", 5, 6), lambda x: x.cast("double") * 10).alias("scores"),
        F.transform(F.slice("embedding", 11, 10), lambda x: x.cast("double") * 10).alias("points"),
    )
    priors = D.PriorGrid(8, 8, ((0.25, 0.25),), (1 / 8, 1 / 8)).table(t.spark)
    priors = priors.select(F.col("anchor_id").alias("prior_id"), F.struct("cx", "cy", "w", "h").alias("prior"))
    return checked_lookup(e, priors, ["prior_id"], ["vec_id"], how="inner")


HEAD = f"""{PRIORS8}, hd AS (SELECT vec_id AS box_id, vec_id // 64 AS image, [x::DOUBLE * 10 FOR x IN embedding[1:4]] AS l, [x::DOUBLE * 10 FOR x IN embedding[5:10]] AS s, pri.* FROM embeddings JOIN pri ON prior_id = vec_id % 64),
    sm AS (SELECT *, [exp(x) FOR x IN s] AS ex FROM hd), pb AS (SELECT *, [x / list_sum(ex) FOR x IN ex][2:6] AS p FROM sm),
    bx AS (SELECT box_id, image, list_position(p, list_max(p)) - 1 AS class, list_max(p) AS score, l[1] * 0.1 * w + cx - exp(l[3] * 0.2) * w / 2 AS x, l[2] * 0.1 * h + cy - exp(l[4] * 0.2) * h / 2 AS y,
    exp(l[3] * 0.2) * w AS w, exp(l[4] * 0.2) * h AS h FROM pb WHERE list_max(p) >= 0.3)"""


@query("multi_scale_detector", "V19 V06", nms_sql(HEAD, 0.45, ">", "image, class, box_id, round(score, 6) AS score, round(x, 6) + 0.0 AS x, round(h, 6) AS h"))
def multi_scale_detector(t):
    probs = F.slice(A.softmax(F.col("scores")), 2, 5)
    head = head_outputs(t).select("vec_id", "image", "loc", "prior", probs.alias("p"))
    found = head.select(
        F.col("vec_id").alias("box_id"), "image", A.arg_max(F.col("p")).alias("class"), F.array_max("p").alias("score"),
        BX.decode_offsets(F.col("loc"), F.col("prior")).alias("b"),
    ).filter(F.col("score") >= 0.3)
    flat = found.select("box_id", "image", "class", "score", "b.x", "b.y", "b.w", "b.h")
    kept = D.suppress(flat, ["image", "class"], "box_id", "score", 0.45, keep_equal=True)
    return kept.select("image", "class", "box_id", r6("score").alias("score"), r6("x").alias("x"), r6("h").alias("h"))


@query("detection_decode", "V06 O04", f"""
WITH RECURSIVE {BOXES.replace("bx AS (", "b0 AS (")}, c0 AS (SELECT box_id, image, 0 AS class, score, least(x, 1) AS x, least(y, 1) AS y, least(x + w, 1) - least(x, 1) AS w, least(y + h, 1) - least(y, 1) AS h FROM b0 WHERE score > 0.01),
bx AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) <= 50),
{nms_sql("BX", 0.5, ">", "image, box_id, round(score, 6) AS score").split("WITH RECURSIVE BX,")[1]}""")
def detection_decode(t):
    """Clip, score cut, the best fifty per image, then suppression across classes."""
    unit = BX.from_corners(*[F.least(c, F.lit(1.0)) for c in (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))])
    clipped = boxes(t).filter("score > 0.01").select("box_id", "image", "score", unit.alias("b"))
    best = D.top_scores(clipped.select("box_id", "image", "score", "b.x", "b.y", "b.w", "b.h"), ["image"], "score", "box_id", 50)
    kept = D.suppress(best, ["image"], "box_id", "score", 0.5, keep_equal=True)
    return kept.select("image", "box_id", r6("score").alias("score"))


FACE = f"""{PRIORS8}, hd AS (SELECT vec_id AS box_id, vec_id // 64 AS image, [x::DOUBLE * 10 FOR x IN embedding[1:4]] AS l, [x::DOUBLE * 10 FOR x IN embedding[5:6]] AS s,
        [x::DOUBLE FOR x IN embedding[11:20]] AS pts, pri.* FROM embeddings JOIN pri ON prior_id = vec_id % 64),
    bx AS (SELECT box_id, image, 0 AS class, 1 / (1 + exp(s[1] - s[2])) AS score, l[1] * 0.1 * w + cx - exp(l[3] * 0.2) * w / 2 AS x, l[2] * 0.1 * h + cy - exp(l[4] * 0.2) * h / 2 AS y,
    exp(l[3] * 0.2) * w AS w, exp(l[4] * 0.2) * h AS h, [{{'x': pts[2 * k + 1] * hd.w + cx, 'y': pts[2 * k + 2] * hd.h + cy}} FOR k IN range(5)] AS marks FROM hd WHERE 1 / (1 + exp(s[1] - s[2])) > 0.5)"""


@query("face_landmarks", "V08 J06", "SELECT image, box_id, score, mark::INT AS mark, round(m.x * 640, 6) + 0.0 AS x, round(m.y * 480, 6) + 0.0 AS y FROM ("
       + nms_sql(FACE, 0.4, ">", "image, box_id, round(score, 6) AS score, unnest(marks) AS m, generate_subscripts(marks, 1) - 1 AS mark") + ")")
def face_landmarks(t):
    """Boxes and five landmarks per face, scaled to a 640 x 480 image."""
    probs = A.softmax(F.slice("scores", 1, 2))
    decoded = head_outputs(t).select(
        F.col("vec_id").alias("box_id"), "image", F.get(probs, F.lit(1)).alias("score"),
        BX.decode_offsets(F.col("loc"), F.col("prior")).alias("b"), BX.decode_points(F.col("points"), F.col("prior")).alias("marks"),
    ).filter(F.col("score") > 0.5)
    flat = decoded.select("box_id", "image", "score", "b.x", "b.y", "b.w", "b.h", "marks")
    best = D.top_scores(flat, ["image"], "score", "box_id", 5000)
    boxes_only = best.select("box_id", "image", "score", "x", "y", "w", "h")
    kept = D.suppress(boxes_only, ["image"], "box_id", "score", 0.4, keep_equal=True)
    out = kept.join(best.select("image", "box_id", "marks"), ["image", "box_id"])
    out = out.select("image", "box_id", r6("score").alias("score"), F.posexplode("marks").alias("mark", "m"))
    return out.select("image", "box_id", "score", "mark", r6(F.col("m.x") * 640).alias("x"), r6(F.col("m.y") * 480).alias("y"))


@query("key_points", "V09", """
WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
r AS (SELECT vec_id, p // 16 AS joint, p % 16 AS cell, v, row_number() OVER (PARTITION BY vec_id, p // 16 ORDER BY v DESC, p) AS r FROM c)
SELECT vec_id, joint, (cell % 4) / 4.0::DOUBLE AS x, (cell // 4) / 4.0::DOUBLE AS y, v AS confidence FROM r WHERE r = 1 AND v > 0.2""")
def key_points(t):
    cells = T.explode_cells(t.embeddings, "embedding", ["vec_id"])
    placed = cells.withColumn("joint", F.floor(F.col("pos") / 16)).withColumn("cell", F.col("pos") % 16)
    best = placed.groupBy("vec_id", "joint").agg(F.max(F.struct("v", (-F.col("cell")).alias("c"))).alias("m"))
    cell = -F.col("m.c")
    return best.filter(F.col("m.v") > 0.2).select(
        "vec_id", "joint", ((cell % 4) / 4.0).alias("x"), (F.floor(cell / 4) / 4.0).alias("y"), F.col("m.v").alias("confidence")
    )


@query("step_text", "V18", """
WITH c AS (SELECT vec_id, pos // 8 AS step, pos % 8 AS k, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)),
b AS (SELECT vec_id, step, k, row_number() OVER (PARTITION BY vec_id, step ORDER BY v DESC, k) AS r FROM c),
s AS (SELECT vec_id, step, k, lag(k) OVER (PARTITION BY vec_id ORDER BY step) AS before FROM b WHERE r = 1)
SELECT vec_id, coalesce(string_agg(chr((96 + k)::INT), '' ORDER BY step) FILTER (k <> 0 AND k IS DISTINCT FROM before), '') AS word FROM s GROUP BY 1""")
def step_text(t):
    best = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: A.arg_max(F.slice("embedding", s * 8 + 1, 8)))
    out = t.embeddings.select("vec_id", best.alias("b"))
    kept = A.let(F.col("b"), lambda b: F.filter(b, lambda k, i: (k != 0) & ((i == 0) | (F.get(b, F.greatest(i - 1, F.lit(0))) != k))))
    return out.select("vec_id", F.array_join(F.transform(kept, lambda k: F.chr(k + 96)), "").alias("word"))


# One map per label: its vectors are the rows in order, a cell is set when the value times 255 reaches 40.
MAPS = """vr AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding FROM embeddings),
    fg AS (SELECT label, i, j FROM (SELECT label, i, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM vr) WHERE trunc(v * 255) >= 40)"""


def maps(t):
    rows = O.ordered_prefix(t.embeddings.select("vec_id", "label", "embedding"), "vec_id", within=["label"], index="i")
    cells = rows.select("label", "i", F.posexplode("embedding").alias("j", "v"))
    return cells.filter(F.col("v").cast("double") * 255 >= 40).select("label", "i", F.col("j").cast("long").alias("j"))


@query("map_regions", "V17", f"""
WITH RECURSIVE {MAPS}, reach AS (SELECT label, i, j, i AS si, j AS sj FROM fg UNION
SELECT f.label, f.i, f.j, r.si, r.sj FROM reach r JOIN fg f ON f.label = r.label AND abs(f.i - r.i) + abs(f.j - r.j) = 1),
low AS (SELECT label, i, j, min(si * 4294967296 + sj) AS region FROM reach GROUP BY 1, 2, 3)
SELECT label, region, min(i) AS i0, min(j) AS j0, max(i) AS i1, max(j) AS j1, count(*) AS cells FROM low GROUP BY 1, 2 HAVING max(i) - min(i) > 1 AND max(j) - min(j) > 1""")
def map_regions(t):
    return R.region_boxes(R.regions(maps(t), "label", tile=8), "label", min_extent=1)


# Images of 4 x 4 pixels with four channels: all entries, absolute, times 255.
PIXELS = """px AS (SELECT vec_id, p // 16 AS i, p // 4 % 4 AS j, p % 4 AS c, p, abs(v) * 255 AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v,
    generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""


def pictures(t):
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 255).alias("pixels"))


def pixel_cells(t):
    cells = pictures(t).select("vec_id", F.posexplode("pixels").alias("p", "v"))
    p = F.col("p")
    return cells.select(
        "vec_id", F.floor(p / 16).alias("i"), (F.floor(p / 4) % 4).alias("j"), (p % 4).cast("long").alias("c"), "v"
    )


@query("image_to_tensor", "D05", f"""
WITH {PIXELS} SELECT vec_id, c * 16 + i * 4 + j AS pos, round(v / 255, 6) AS v FROM px""")
def image_to_tensor(t):
    out = pictures(t).select("vec_id", F.posexplode(I.to_tensor(F.col("pixels"), 4, 4, 4)).alias("pos", "v"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("v").alias("v"))


@query("image_normalised", "D04", f"""
WITH {PIXELS} SELECT vec_id, i, j, c, round((v - [10.0, 20.0, 30.0, 40.0][c + 1]) / [2.0, 4.0, 5.0, 8.0][c + 1], 6) + 0.0 AS v FROM px""")
def image_normalised(t):
    return I.normalize_cells(pixel_cells(t), "c", [10.0, 20.0, 30.0, 40.0], [2.0, 4.0, 5.0, 8.0]).withColumn("v", r6("v"))


@query("image_normalised_packed", "D04", f"""
WITH {PIXELS} SELECT vec_id, p AS pos, round((v - [10.0, 20.0, 30.0, 40.0][c + 1]) / [2.0, 4.0, 5.0, 8.0][c + 1], 6) + 0.0 AS v FROM px""")
def image_normalised_packed(t):
    out = pictures(t).select("vec_id", F.posexplode(I.normalize(F.col("pixels"), [10.0, 20.0, 30.0, 40.0], [2.0, 4.0, 5.0, 8.0])).alias("pos", "v"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("v").alias("v"))


@query("image_crops", "V11", f"""
WITH {PIXELS} SELECT 'crop' AS kind, vec_id, i - 1 AS i, j AS j, c, v FROM px WHERE i >= 1 AND i < 4 AND j < 2
UNION ALL SELECT 'centre', vec_id, i - 1, j - 1, c, v FROM px WHERE i BETWEEN 1 AND 2 AND j BETWEEN 1 AND 2""")
def image_crops(t):
    cells = pixel_cells(t)
    first = I.crop_cells(cells, 1, 0, 3, 2).select(F.lit("crop").alias("kind"), "*")
    return first.unionByName(I.centre_crop_cells(cells, 4, 4, 2, 2).select(F.lit("centre").alias("kind"), "*"))


@query("image_resize", "V12", f"""
WITH {PIXELS}, o AS (SELECT oi, oj FROM (SELECT unnest(range(6)) AS oi), (SELECT unnest(range(6)) AS oj)),
near AS (SELECT vec_id, oi * 24 + oj * 4 + c AS pos, v AS nearest FROM px JOIN o ON i = oi * 4 // 6 AND j = oj * 4 // 6),
ax AS (SELECT oi AS k, (oi + 0.5) * 4 / 6.0::DOUBLE - 0.5 AS z FROM (SELECT unnest(range(6)) AS oi)),
w AS (SELECT k, greatest(least(floor(z) + s, 3), 0) AS src, CASE WHEN s = 0 THEN 1 - (z - floor(z)) ELSE z - floor(z) END AS w FROM ax, (SELECT unnest([0, 1]) AS s)),
lin AS (SELECT vec_id, a.k * 24 + b.k * 4 + c AS pos, sum(v * a.w * b.w) AS bilinear FROM px JOIN w a ON a.src = i JOIN w b ON b.src = j GROUP BY 1, 2)
SELECT vec_id, pos, round(nearest, 6) AS nearest, round(bilinear, 6) AS bilinear FROM near JOIN lin USING (vec_id, pos)""")
def image_resize(t):
    four, six = F.lit(4), F.lit(6)
    p = F.col("pixels")
    both = pictures(t).select(
        "vec_id", I.resize(p, four, four, 4, six, six, "nearest").alias("nearest"), I.resize(p, four, four, 4, six, six).alias("bilinear")
    )
    out = both.select("vec_id", F.posexplode(F.arrays_zip("nearest", "bilinear")).alias("pos", "x"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("x.nearest").alias("nearest"), r6("x.bilinear").alias("bilinear"))


@query("random_crop_windows", "V12", f"""
WITH u AS (SELECT vec_id, 0.08 + 0.92 * {uniform_sql(21, "vec_id")} AS share, exp(ln(0.75) + ln((4 / 3.0::DOUBLE) / 0.75) * {uniform_sql(22, "vec_id")}) AS aspect, {uniform_sql(23, "vec_id")} AS y, {uniform_sql(24, "vec_id")} AS x FROM embeddings),
s AS (SELECT *, greatest(1, least(4, floor(sqrt(share * 16 * aspect) + 0.5)))::INT AS crop_width, greatest(1, least(4, floor(sqrt(share * 16 / aspect) + 0.5)))::INT AS crop_height FROM u)
SELECT vec_id, floor(y * (5 - crop_height))::INT AS top, floor(x * (5 - crop_width))::INT AS left, crop_height, crop_width FROM s""")
def random_crop_windows(t):
    window = I.random_crop_window(4, 4, 21, F.col("vec_id"))
    return t.embeddings.select("vec_id", *[c.alias(n) for n, c in window.items()])


@query("random_flips", "V14", f"""
WITH c AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS p, unnest(embedding)::DOUBLE AS v, {uniform_sql(31, "vec_id")} < 0.5 AS across, {uniform_sql(32, "vec_id")} < 0.5 AS down FROM embeddings),
q AS (SELECT *, CASE WHEN down THEN 3 - p // 16 ELSE p // 16 END AS i, CASE WHEN across THEN 3 - (p // 4) % 4 ELSE (p // 4) % 4 END AS j FROM c)
SELECT vec_id, (i * 16 + j * 4 + p % 4)::INT AS pos, v FROM q""")
def random_flips(t):
    pixels = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("pixels"))
    key = F.col("vec_id")
    flipped = I.random_flip(I.random_flip(F.col("pixels"), 4, 4, 4, 31, key), 4, 4, 4, 32, key, left_right=False)
    return explode_rows(pixels.select("vec_id", flipped.alias("pixels")), "pixels", ["vec_id"], value="v")


@query("image_random_crops", "V12")
def image_random_crops(t):
    window = I.random_crop_window(4, 4, 21, F.col("vec_id"))
    framed = pictures(t).select("vec_id", "pixels", *[c.alias(n) for n, c in window.items()])
    six, four = F.lit(6), F.lit(4)
    out = I.resize(F.col("pixels"), four, four, 4, six, six, "bilinear", *[F.col(c) for c in window])
    return framed.select("vec_id", *window, out.alias("pixels"))


@query("image_augmented", "V14")
def image_augmented(t):
    p, key = F.col("pixels"), F.col("vec_id")
    flipped = I.random_flip(I.random_flip(p, 4, 4, 4, 31, key), 4, 4, 4, 32, key, left_right=False)
    out = pictures(t).select("vec_id", flipped.alias("flipped"))
    # The fourth channel is no colour and stays out of the jitter.
    rgb = F.filter("flipped", lambda x, i: i % 4 < 3)
    return out.select("vec_id", "flipped", I.colour_jitter(rgb, 33, key, 0.2, 0.2, 0.2, 0.1).alias("jittered"))


@query("instance_masks", "V10", """
WITH x AS (SELECT vec_id, label, abs(embedding[1]::DOUBLE) * 3 AS score, 300 + label * 100 AS ow, 400 + label * 40 AS oh, abs(embedding[2]::DOUBLE) AS a, abs(embedding[3]::DOUBLE) AS b FROM embeddings),
s AS (SELECT *, CASE WHEN floor(600.0 / least(ow, oh) * greatest(ow, oh) + 0.5) > 1000 THEN 1000.0::DOUBLE / greatest(ow, oh) ELSE 600.0::DOUBLE / least(ow, oh) END AS scale FROM x),
z AS (SELECT *, floor(ow * scale + 0.5) AS rw, floor(oh * scale + 0.5) AS rh FROM s),
q AS (SELECT *, a * 100 / rw AS x, b * 100 / rh AS y, (a * 100 + 30) / rw - a * 100 / rw AS w, (b * 100 + 40) / rh - b * 100 / rh AS h FROM z WHERE label - 1 >= 0 AND score > 0.3)
SELECT vec_id, label - 1 AS class, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(w, 6) AS w, round(h, 6) AS h, trunc(w * ow)::INT * trunc(h * oh)::INT AS mask_cells FROM q""")
def instance_masks(t):
    v = [F.abs(F.element_at("embedding", k).cast("double")) for k in (1, 2, 3)]
    x = t.embeddings.select(
        "vec_id", (F.col("label") - 1).alias("class"), (v[0] * 3).alias("score"), (300 + F.col("label") * 100).alias("ow"),
        (400 + F.col("label") * 40).alias("oh"), (v[1] * 100).alias("x0"), (v[2] * 100).alias("y0"), "embedding",
    ).filter((F.col("class") >= 0) & (F.col("score") > 0.3))
    rh, rw = I.short_edge_size(F.col("oh"), F.col("ow"))
    b = BX.from_corners(F.col("x0") / F.col("rw"), F.col("y0") / F.col("rh"), (F.col("x0") + 30) / F.col("rw"), (F.col("y0") + 40) / F.col("rh"))
    boxed = x.withColumn("rw", rw).withColumn("rh", rh).withColumn("b", b)
    sized = boxed.withColumn("mw", (F.col("b.w") * F.col("ow")).cast("int")).withColumn("mh", (F.col("b.h") * F.col("oh")).cast("int"))
    mask = I.resize(F.col("embedding").cast("array<double>"), F.lit(8), F.lit(8), 1, F.col("mh"), F.col("mw"))
    out = sized.select("vec_id", "class", "b", mask.alias("mask"))
    return out.select("vec_id", "class", *[r6(f"b.{c}").alias(c) for c in "xywh"], F.size("mask").alias("mask_cells"))


@query("classified_images", "V15", """
WITH x AS (SELECT vec_id, unnest(embedding[1:10])::DOUBLE * 10 AS s, generate_subscripts(embedding[1:10], 1) - 1 AS k FROM embeddings),
z AS (SELECT vec_id, k, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS place FROM x)
SELECT vec_id, place, 'class_' || k AS class, round(p, 6) AS prob FROM z WHERE place <= 3""")
def classified_images(t):
    s = t.embeddings.select("vec_id", A.softmax(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10)).alias("p"))
    names = F.array(*[F.lit(f"class_{k}") for k in range(10)])
    out = s.select("vec_id", F.posexplode(A.top_k(names, F.col("p"), 3)).alias("place", "x"))
    return out.select("vec_id", (F.col("place") + 1).cast("long").alias("place"), "x.class", r6("x.prob").alias("prob"))
