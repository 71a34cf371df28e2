"""Losses, evaluators, the metric log and window-shaped queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.functions import losses as LO
from gridloom.operators import evaluation as E
from gridloom.operators import ordering as O
from gridloom.operators import series as SE
from gridloom.operators import tensors as T
from gridloom.plans.registry import draw_sql, query, r6

# Class scores: the first ten entries of an embedding, times ten; the label is the truth. Batches of 25
# vectors, two epochs, every fifth vector validates.
SCORES = """sc AS (SELECT vec_id, label, unnest(embedding[1:10])::DOUBLE * 10 AS s, generate_subscripts(embedding[1:10], 1) - 1 AS k FROM embeddings),
    mx AS (SELECT vec_id, max(s) AS m FROM sc GROUP BY 1),
    lse AS (SELECT vec_id, label, m + ln(sum(exp(s - m))) AS z, max(s) FILTER (k = label) AS hit, arg_max(k, s) AS guess FROM sc JOIN mx USING (vec_id) GROUP BY vec_id, label, m),
    rk AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS place FROM sc),
    ev AS (SELECT lse.vec_id, CASE WHEN lse.vec_id % 5 = 4 THEN 'validate' ELSE 'train' END AS stage, lse.vec_id // 25 % 2 AS epoch, lse.vec_id // 50 AS batch,
        z - hit AS loss, (guess = label)::INT AS acc, (place <= 3)::INT AS top3 FROM lse JOIN rk ON lse.vec_id = rk.vec_id AND rk.k = lse.label)"""


def scores(t):
    s = t.embeddings.select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10).alias("s"))
    v = F.col("vec_id")
    return s.select(
        "vec_id", "label", "s", F.when(v % 5 == 4, "validate").otherwise("train").alias("stage"),
        (F.floor(v / 25) % 2).alias("epoch"), F.floor(v / 50).alias("batch"),
    )


def evaluators():
    s, y = F.col("s"), F.col("label")
    return {"loss": LO.softmax_cross_entropy(s, y), "acc": LO.is_right(s, y), "top3": LO.in_top_k(s, y, 3)}


def levels(t):
    return E.accumulate(scores(t), evaluators())


@query("evaluator_levels", "A15 W05 E01 E03 E04 E10 X07", f"""
WITH {SCORES}, p AS (SELECT *, batch // 5 AS progress FROM ev)
SELECT CASE WHEN grouping(epoch) = 1 THEN 'all' WHEN grouping(progress) = 0 THEN 'progress' WHEN grouping(batch) = 0 THEN 'batch' ELSE 'epoch' END AS level, stage,
coalesce(epoch, -1) AS epoch, coalesce(progress, -1) AS progress, coalesce(batch, -1) AS batch, round(sum(loss), 6) AS loss_sum, count(*) AS n, sum(acc)::BIGINT AS acc_sum,
sum(top3)::BIGINT AS top3_sum, round(avg(loss), 6) AS loss, round(avg(acc), 6) AS acc, round(avg(top3), 6) AS top3
FROM p GROUP BY GROUPING SETS ((stage), (stage, epoch), (stage, epoch, progress), (stage, epoch, batch))""")
def evaluator_levels(t):
    none = F.lit(-1).cast("long")
    return levels(t).select(
        "level", "stage", *[F.coalesce(c, none).alias(c) for c in ("epoch", "progress", "batch")], r6("loss_sum").alias("loss_sum"),
        F.col("loss_total").alias("n"), F.col("acc_sum"), F.col("top3_sum"), r6("loss").alias("loss"), r6("acc").alias("acc"), r6("top3").alias("top3"),
    )


@query("training_report", "E18 K05", f"""
WITH {SCORES}, e AS (SELECT stage, epoch, avg(loss) AS loss, avg(acc) AS acc FROM ev GROUP BY 1, 2)
SELECT max(epoch) AS epoch, round(arg_max(loss, epoch) FILTER (stage = 'train'), 6) AS train_epoch_loss, round(arg_max(acc, epoch) FILTER (stage = 'train'), 6) AS train_epoch_acc,
round(arg_max(loss, epoch) FILTER (stage = 'validate'), 6) AS validate_epoch_loss, round(arg_max(acc, epoch) FILTER (stage = 'validate'), 6) AS validate_epoch_acc FROM e""")
def training_report(t):
    out = E.training_report(levels(t), ["loss", "acc"])
    return out.select("epoch", *[r6(c).alias(c) for c in out.columns if c != "epoch"])


@query("loss_of_batches", "E05 E10", f"""
WITH {SCORES}, b AS (SELECT batch, avg(loss) AS m, sum(loss) AS s, count(*) AS n FROM ev WHERE stage = 'train' GROUP BY 1)
SELECT round(avg(m), 6) AS loss, round(sum(s) / sum(n), 6) AS weighted_loss, count(*) AS batches FROM b""")
def loss_of_batches(t):
    out = E.mean_of_batches(scores(t).filter("stage = 'train'"), evaluators()["loss"], ["batch"])
    return out.select(r6("loss").alias("loss"), r6("weighted_loss").alias("weighted_loss"), "batches")


@query("regression_losses", "E06 E07 E08 E09 E13", """
WITH x AS (SELECT label, embedding[1]::DOUBLE * 5 AS p, embedding[2]::DOUBLE * 5 AS y, CASE WHEN embedding[3] > 0 THEN 1.0 ELSE -1.0 END AS side,
1 / (1 + exp(-embedding[1]::DOUBLE * 5)) AS prob FROM embeddings)
SELECT label, round(avg(abs(y - p)), 6) AS l1, round(avg(0.5 * (y - p) * (y - p)), 6) AS l2, round(avg(greatest(1 - side * p, 0)), 6) AS hinge,
round(avg(greatest(p, 0) - p * (side + 1) / 2 + ln(1 + exp(-abs(p)))), 6) AS bce,
round(avg(-((side + 1) / 2 * ln(prob + 1e-12) + (1 - side) / 2 * ln(1 - prob + 1e-12))), 6) AS bce_prob,
round(avg(abs(y - p)) + avg(0.5 * (y - p) * (y - p)), 6) AS composite FROM x GROUP BY 1""")
def regression_losses(t):
    p, y = (F.element_at("embedding", i).cast("double") * 5 for i in (1, 2))
    side = F.when(F.element_at("embedding", 3) > 0, 1.0).otherwise(-1.0)
    x = t.embeddings.select("label", p.alias("p"), y.alias("y"), side.alias("side"))
    p, y, side, yes = F.col("p"), F.col("y"), F.col("side"), (F.col("side") + 1) / 2
    prob = 1 / (1 + F.exp(-p))
    return x.groupBy("label").agg(
        r6(F.avg(LO.l1(p, y))).alias("l1"), r6(F.avg(LO.l2(p, y))).alias("l2"), r6(F.avg(LO.hinge(p, side))).alias("hinge"),
        r6(F.avg(LO.sigmoid_cross_entropy(p, yes))).alias("bce"),
        r6(F.avg(LO.sigmoid_cross_entropy(prob, yes, logits=False))).alias("bce_prob"),
        r6(F.avg(LO.l1(p, y)) + F.avg(LO.l2(p, y))).alias("composite"),
    )


@query("dense_label_loss", "E10", f"""
WITH {SCORES} SELECT label, round(avg(0.9 * (z - hit) + 0.1 * (z - first)), 6) AS loss FROM lse
JOIN (SELECT vec_id, s AS first FROM sc WHERE k = 0) USING (vec_id) GROUP BY 1""")
def dense_label_loss(t):
    target = F.zip_with(A.one_hot(F.col("label"), 10, 0.9), A.one_hot(F.lit(0), 10, 0.1), lambda a, b: a + b)
    return scores(t).groupBy("label").agg(r6(F.avg(LO.softmax_cross_entropy_dense(F.col("s"), target))).alias("loss"))


# Eight steps of eight class scores per vector; step labels and lengths derive from the label column.
STEPS = """st AS (SELECT vec_id, label, pos // 8 AS step, pos % 8 AS k, v * 10 AS s FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
    generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)),
    sl AS (SELECT vec_id, label, step, ln(sum(exp(s))) - max(s) FILTER (k = (label + step) % 8) AS loss, (arg_max(k, s) = (label + step) % 8)::INT AS hit FROM st GROUP BY 1, 2, 3)"""


def steps(t):
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("embedding", r * 8 + 1, 8), lambda x: x.cast("double") * 10))
    labels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: (F.col("label") + r) % 8)
    return t.embeddings.select("vec_id", "label", cut.alias("steps"), labels.alias("labels"), (F.col("label") % 9).alias("length"))


@query("masked_sequence_loss", "E11 P14", f"""
WITH {STEPS} SELECT vec_id, round(coalesce(sum(loss) FILTER (step < label % 9), 0) / 8, 6) + 0.0 AS loss FROM sl GROUP BY 1""")
def masked_sequence_loss(t):
    loss = LO.masked_softmax_cross_entropy(F.col("steps"), F.col("labels"), F.col("length"))
    return steps(t).select("vec_id", r6(loss).alias("loss"))


@query("masked_token_loss", "E14 E15", f"""
WITH {STEPS}, m AS (SELECT *, (step < label % 9)::INT AS mask FROM sl)
SELECT label, round(sum(mask * loss) / (sum(mask) + 1e-5), 6) + 0.0 AS loss, round(sum(mask * hit) / greatest(sum(mask), 1), 6) AS accuracy,
(SELECT round(avg(ln(exp(s0) + exp(s1)) - CASE WHEN label % 2 = 0 THEN s0 ELSE s1 END), 6) FROM (SELECT vec_id, label, max(s) FILTER (k = 0) AS s0, max(s) FILTER (k = 1) AS s1
FROM st WHERE step = 0 GROUP BY 1, 2)) AS next_loss FROM m GROUP BY 1""")
def masked_token_loss(t):
    rows = steps(t)
    cells = rows.select("label", "length", F.posexplode(F.arrays_zip("steps", "labels")).alias("step", "x"))
    mask = (F.col("step") < F.col("length")).cast("int")
    loss, hit = LO.softmax_cross_entropy(F.col("x.steps"), F.col("x.labels")), LO.is_right(F.col("x.steps"), F.col("x.labels"))
    first_two = F.slice(F.get("steps", F.lit(0)), 1, 2)
    next_loss = rows.agg(F.avg(LO.softmax_cross_entropy(first_two, F.col("label") % 2))).first()[0]
    return cells.groupBy("label").agg(
        r6(F.sum(mask * loss) / (F.sum(mask) + 1e-5)).alias("loss"),
        r6(F.sum(mask * hit) / F.greatest(F.sum(mask), F.lit(1))).alias("accuracy"), r6(F.lit(next_loss)).alias("next_loss"),
    )


@query("binary_accuracy", "E02 J09", """
SELECT lang, count(*) AS n, round(avg(((n_chars - 1500 >= 0)::INT = quality)::INT), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def binary_accuracy(t):
    joined = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    right = LO.is_right_binary((F.col("n_chars") - 1500).cast("double"), F.col("quality"))
    return joined.groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg(right)).alias("accuracy"))


@query("one_hot_accuracy", "E01 P05", """
WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
s AS (SELECT vec_id, label, pos % 10 AS k, max(v) AS m FROM c GROUP BY ALL),
b AS (SELECT vec_id, label, k FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY m DESC, k) = 1)
SELECT label, count(*) AS n, sum((k = label)::INT)::BIGINT AS hits, round(avg((k = label)::INT), 6) AS accuracy FROM b GROUP BY 1""")
def one_hot_accuracy(t):
    # Every entry counts: class k has the greatest of the entries k, k + 10, k + 20, ...
    folded = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.array_max(F.filter("embedding", lambda x, i: i % 10 == k)))
    right = LO.is_right_one_hot(folded, A.one_hot(F.col("label"), 10)).alias("hit")
    rows = t.embeddings.select("label", right)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), r6(F.avg("hit")).alias("accuracy"))


@query("weight_penalty", "E12", """
WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
w AS (SELECT label, pos, avg(v) AS w FROM c GROUP BY 1, 2)
SELECT round(0.5 * sum(abs(w)), 6) AS l1, round(0.25 * sum(w * w), 6) AS l2, round(0.5 * sum(abs(w)) + 0.25 * sum(w * w), 6) AS elastic FROM w""")
def weight_penalty(t):
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    w = cells.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("w"))
    p = F.col("w")
    return w.agg(
        r6(LO.weight_penalty(p, 0.5)).alias("l1"), r6(LO.weight_penalty(p, 0.0, 0.25)).alias("l2"), r6(LO.weight_penalty(p, 0.5, 0.25)).alias("elastic")
    )


@query("metric_means", "A12", """SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1""")
def metric_means(t):
    return t.events.groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), F.count("*").alias("n"))


@query("metric_percentiles", "A13 M08", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = n * 50 // 100) AS p50, max(value) FILTER (i = n * 90 // 100) AS p90, max(value) FILTER (i = n * 99 // 100) AS p99,
max(value) FILTER (i = n - 1) AS p100 FROM r GROUP BY 1""")
def metric_percentiles(t):
    return E.floor_rank_percentiles(t.events, "event_type", "value", "event_id", [50, 90, 99, 100])


@query("latest_metric", "W06", """
SELECT event_type, arg_max(value, ts) AS latest, max(ts) AS ts FROM events GROUP BY 1""")
def latest_metric(t):
    out = E.latest(t.events, "event_type", "value", "ts", "event_id")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("series_convolution", "W07", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY event_type) AS n FROM events),
k AS (SELECT * FROM (VALUES (0, 0.25), (1, 0.5), (2, -0.75)) k(o, w)),
x AS (SELECT r.event_type, (r.t + 2 - k.o * 2) AS s, r.value * k.w AS v, n FROM r, k)
SELECT event_type, s // 2 AS t, round(sum(v), 6) + 0.0 AS v FROM x WHERE s >= 0 AND s % 2 = 0 AND s // 2 <= (n + 4 - 5) // 2 GROUP BY 1, 2""")
def series_convolution(t):
    e = t.events.select("event_type", "ts", "event_id", "value")
    out = SE.convolve(e, "value", ["event_type"], "ts", "event_id", [0.25, 0.5, -0.75], stride=2, padding=2, dilation=2)
    return out.select("event_type", "t", r6("v").alias("v"))


@query("moving_average", "W07", """
SELECT event_id, round(0.5 * value + 0.3 * coalesce(lag(value, 1) OVER w, 0) + 0.2 * coalesce(lag(value, 2) OVER w, 0), 6) + 0.0 AS smooth
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def moving_average(t):
    e = t.events.select("event_type", "ts", "event_id", "value")
    placed = O.ordered_prefix(e, "ts", "event_id", within=["event_type"], index="i")
    weights = [0.5, 0.3, 0.2]

    def smooth(window):
        return sum((F.coalesce(F.lag("value", k).over(window), F.lit(0.0)) * w for k, w in enumerate(weights)), F.lit(0.0))

    out = O.chunked_neighbours(placed, "i", before=2, after=0, derive={"smooth": smooth}, within=["event_type"])
    return out.select("event_id", r6("smooth").alias("smooth"))


@query("recent_buffer", "W08", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""")
def recent_buffer(t):
    return SE.recent(t.events, "user_id", "ts", "event_id", 5).select("user_id", "event_id", "value")


@query("buffer_sample", "W08", f"""
WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {draw_sql(4, "event_id")}, event_id) AS d FROM n WHERE r <= 5)
SELECT user_id, event_id, value FROM d WHERE d <= 2""")
def buffer_sample(t):
    return SE.sample_recent(t.events, "user_id", "ts", "event_id", 5, 2, seed=4).select("user_id", "event_id", "value")


@query("class_top_k", "O03 V15 K02", f"""
WITH {SCORES}, p AS (SELECT vec_id, k, s, exp(s - z) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS place FROM sc JOIN lse USING (vec_id))
SELECT vec_id, place, 'class_' || k AS class, round(prob, 6) AS prob FROM p WHERE place <= 5""")
def class_top_k(t):
    names = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("class_"), k.cast("string")))
    best = A.top_k(names, A.softmax(F.col("s")), 5)
    out = scores(t).select("vec_id", F.posexplode(best).alias("place", "x"))
    return out.select("vec_id", (F.col("place") + 1).cast("long").alias("place"), "x.class", r6("x.prob").alias("prob"))


@query("class_lookup", "O03", f"""
WITH {SCORES} SELECT vec_id, guess AS best, round(exp(mx.m - z), 6) AS best_prob, round(exp(s3 - z), 6) AS prob_of_3 FROM lse JOIN mx USING (vec_id)
JOIN (SELECT vec_id, s AS s3 FROM sc WHERE k = 3) USING (vec_id)""")
def class_lookup(t):
    p = scores(t).select("vec_id", A.softmax(F.col("s")).alias("p"))
    return p.select(
        "vec_id", A.arg_max(F.col("p")).cast("long").alias("best"), r6(F.array_max("p")).alias("best_prob"), r6(F.get("p", F.lit(3))).alias("prob_of_3")
    )


@query("pair_similarity", "J10", """
WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
d AS (SELECT a.vec_id, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS cos FROM c a JOIN c b ON b.vec_id = a.vec_id + 1 AND a.pos = b.pos GROUP BY 1)
SELECT vec_id, vec_id + 1 AS other, round((cos + 1) / 2, 6) AS similarity FROM d""")
def pair_similarity(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    pairs = e.join(other, "vec_id")
    return pairs.select(
        "vec_id", (F.col("vec_id") + 1).alias("other"), r6((A.cosine(F.col("a"), F.col("b")) + 1) / 2).alias("similarity")
    )


@query("class_centre_similarity", "J10 O04", """
WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label AS other, pos, avg(v) AS w FROM c GROUP BY 1, 2),
d AS (SELECT vec_id, other, sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w))) AS cos FROM c JOIN m USING (pos) GROUP BY 1, 2),
r AS (SELECT vec_id, other, round((cos + 1) / 2, 6) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY round((cos + 1) / 2, 6) DESC, other) AS place FROM d)
SELECT vec_id, other, similarity, place FROM r WHERE place <= 3""")
def class_centre_similarity(t):
    cells = T.explode_cells(t.embeddings, "embedding", ["vec_id", "label"])
    centres = cells.groupBy(F.col("label").alias("other"), "pos").agg(F.avg("v").alias("v"))
    products = T.matmul(cells, centres, "vec_id", "pos", "other").withColumnRenamed("v", "dot")
    lengths = t.embeddings.select("vec_id", A.norm(F.col("embedding").cast("array<double>")).alias("n"))
    widths = centres.groupBy("other").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("w"))
    cosine = products.join(lengths, "vec_id").join(widths, "other")
    rated = cosine.select("vec_id", "other", r6((F.col("dot") / (F.col("n") * F.col("w")) + 1) / 2).alias("similarity"))
    order = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other")
    return rated.withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 3")
