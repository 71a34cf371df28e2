"""Scoring, tree ensembles, training and search queries."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.operators import evaluation as E
from gridloom.operators import features as FE
from gridloom.operators import optimizers as OP
from gridloom.operators import scoring as SC
from gridloom.operators import tensors as T
from gridloom.operators import text_models as TM
from gridloom.operators import training as TR
from gridloom.operators import trees as TX
from gridloom.operators import vocabulary as V
from gridloom.plans.registry import query, r6
from gridloom.plans.texts import TOKENS, VOCAB, tokens, vocabulary
from gridloom.session import cut_lineage, scratch_path, spread
from gridloom.sources import generators as G

CENTRES = """c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    w AS (SELECT label AS k, pos, avg(v) * 20 AS w FROM c GROUP BY 1, 2),
    lg AS (SELECT vec_id, k, sum(v * w) + k * 0.01 AS s FROM c JOIN w USING (pos) GROUP BY 1, 2),
    pr AS (SELECT vec_id, k, exp(s - max(s) OVER x) / sum(exp(s)) OVER x * exp(max(s) OVER x) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS place FROM lg WINDOW x AS (PARTITION BY vec_id))"""


def centre_scorer(t) -> SC.LinearScorer:
    """Class centres as weights; ten classes of 64 numbers, whatever the data size."""
    cells = T.explode_cells(t.embeddings, "embedding", ["label"])
    centres = cells.groupBy("label", "pos").agg((F.avg("v") * 20).alias("v")).toPandas()
    table = centres.pivot(index="label", columns="pos", values="v").sort_index()
    return SC.LinearScorer(table.to_numpy(), np.arange(len(table)) * 0.01, "embedding")


@query("batch_scores", "M01 M02 X04", f"WITH {CENTRES} SELECT vec_id, k::BIGINT AS class, round(p, 6) AS probability FROM pr WHERE place = 1")
def batch_scores(t):
    out = SC.score(t.embeddings, centre_scorer(t), ["vec_id"])
    return out.withColumn("probability", r6("probability"))


@query("scoring_times", "M03 M08")
def scoring_times(t):
    timed = SC.score(t.embeddings, centre_scorer(t), ["vec_id"], batch_size=50, timing=True)
    log = cut_lineage(timed.select(
        "vec_id", F.explode(F.map_from_arrays(
            F.array(*[F.lit(n) for n in ("Preprocess", "Inference", "Postprocess", "Total")]),
            F.array("pre_nanos", "score_nanos", "post_nanos", "total_nanos"),
        )).alias("name", "nanos"),
    ))
    return E.floor_rank_percentiles(log, "name", "nanos", "vec_id", [50, 90, 99])


class PropsScorer(SC.Scorer):
    """Doubles the number in a JSON text; multiples of ten are bad requests."""

    schema = "doubled long"

    def check(self, rows):
        numbers = rows["props"].map(lambda p: json.loads(p)["k"])
        return numbers.map(lambda n: "multiple of ten" if n % 10 == 0 else None)

    def score(self, batch):
        return np.array([json.loads(p)["k"] for p in batch["props"]], dtype=np.int64) * 2

    def post(self, output, rows):
        return pd.DataFrame({"doubled": output})


@query("guarded_scores", "R02 M01", """
SELECT event_id, CASE WHEN k % 10 = 0 THEN 'bad request' ELSE 'ok' END AS status, CASE WHEN k % 10 = 0 THEN -1 ELSE k * 2 END AS doubled
FROM (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)""")
def guarded_scores(t):
    out = SC.score(t.events.select("event_id", "props"), PropsScorer(), ["event_id"], guard=True)
    return out.select("event_id", "status", F.coalesce(F.col("doubled"), F.lit(-1)).alias("doubled"))


# A fixed softmax regression over four numbers and three class names.
CLASS_WEIGHTS = [[0.05, -0.3, 1.0, 0.2], [0.02, 0.1, -0.5, 0.7], [-0.04, 0.2, 0.4, -0.6]]
CLASS_BIAS = [0.1, 0.0, -0.1]
CLASS_NAMES = ["small", "medium", "large"]


@query("tabular_classes", "M09", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, l_extendedprice / 50000 AS b, l_discount * 10 AS c, l_tax * 10 AS d FROM lineitem),
s AS (SELECT *, [0.1 + 0.05 * a - 0.3 * b + c + 0.2 * d, 0.02 * a + 0.1 * b - 0.5 * c + 0.7 * d, -0.1 - 0.04 * a + 0.2 * b + 0.4 * c - 0.6 * d]::DOUBLE[] AS l FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['small', 'medium', 'large'][list_position(l, list_max(l))] AS class,
round(exp(list_max(l)) / (exp(l[1]) + exp(l[2]) + exp(l[3])), 6) AS prob FROM s""")
def tabular_classes(t):
    numbers = [F.col("l_quantity"), F.col("l_extendedprice") / 50000, F.col("l_discount") * 10, F.col("l_tax") * 10]
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    best = SC.best_class(CLASS_NAMES, SC.linear_probabilities(numbers, CLASS_WEIGHTS, CLASS_BIAS))
    out = t.lineitem.select(*keys, best.alias("x"))
    return out.select(*keys, "x.class", r6("x.prob").alias("prob"))


def split(node, feature, limit, yes, no, missing="yes"):
    return {"nodeid": node, "split": f"f{feature}", "split_condition": limit, "yes": yes["nodeid"], "no": no["nodeid"],
            "missing": (yes if missing == "yes" else no)["nodeid"], "cover": yes["cover"] + no["cover"], "children": [yes, no]}


def leaf(node, value, cover=1.0):
    return {"nodeid": node, "leaf": value, "cover": cover}


# A small ensemble over quantity, price and discount (a discount of zero counts as missing).
ENSEMBLE = json.dumps([
    split(0, 0, 20.5, split(1, 1, 30000.0, leaf(3, 0.5, 30.0), leaf(4, -0.25, 10.0)), leaf(2, 0.125, 60.0)),
    split(0, 2, 0.045, leaf(1, 0.75, 40.0), split(2, 0, 40.0, leaf(5, -0.5, 45.0), leaf(6, 1.0, 15.0)), missing="no"),
    split(0, 1, 60000.0, leaf(1, -1.0, 80.0), leaf(2, 2.0, 20.0)),
])


@query("tree_scores", "M04", """
WITH x AS (SELECT *, nullif(l_discount, 0) AS d FROM lineitem),
l AS (SELECT *, CASE WHEN l_quantity < 20.5 THEN CASE WHEN l_extendedprice < 30000 THEN 3 ELSE 4 END ELSE 2 END AS n1,
CASE WHEN d < 0.045 THEN 1 WHEN l_quantity < 40 THEN 5 ELSE 6 END AS n2, CASE WHEN l_extendedprice < 60000 THEN 1 ELSE 2 END AS n3 FROM x),
m AS (SELECT *, CASE n1 WHEN 3 THEN 0.5 WHEN 4 THEN -0.25 ELSE 0.125 END::DOUBLE AS v1, CASE n2 WHEN 1 THEN 0.75 WHEN 5 THEN -0.5 ELSE 1.0 END::DOUBLE AS v2, CASE n3 WHEN 1 THEN -1.0 ELSE 2.0 END::DOUBLE AS v3 FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v1 + v2 + v3 AS margin, v1 + v2 AS first_two, round(1 / (1 + exp(-(v1 + v2 + v3))), 6) AS probability,
n1 || '-' || n2 || '-' || n3 AS leaves FROM m""")
def tree_scores(t):
    nodes = TX.node_table(ENSEMBLE)
    indices = F.when(F.col("l_discount") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    x = TX.dense_from_sparse(indices, F.array("l_quantity", "l_extendedprice", "l_discount"), 3)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    items = spread(t.lineitem, *keys).select(*keys, x.alias("x"))
    score = lambda **o: TX.predict_trees(t.spark, F.col("x"), nodes, **o)
    return items.select(
        *keys, score(mode="margin").alias("margin"), score(mode="margin", tree_limit=2).alias("first_two"),
        r6(score()).alias("probability"), F.array_join(score(mode="leaf").cast("array<string>"), "-").alias("leaves"),
    )


@query("tree_contributions", "M04", """
WITH x AS (SELECT *, nullif(l_discount, 0) AS d FROM lineitem),
h AS (SELECT *, (l_quantity < 20.5)::INT::DOUBLE AS a, (l_extendedprice < 30000)::INT::DOUBLE AS b, coalesce(d < 0.045, false)::INT::DOUBLE AS c, (l_quantity < 40)::INT::DOUBLE AS e,
(l_extendedprice < 60000)::INT::DOUBLE AS f FROM x),
-- tree one over quantity q and price p, tree two over discount and quantity, tree three over price alone
v AS (SELECT *, a * (b * 0.5 + (1 - b) * -0.25) + (1 - a) * 0.125 AS qp, a * (0.75 * 0.5 + 0.25 * -0.25) + (1 - a) * 0.125 AS q_only,
0.4 * (b * 0.5 + (1 - b) * -0.25) + 0.6 * 0.125 AS p_only, 0.4 * (0.75 * 0.5 + 0.25 * -0.25) + 0.6 * 0.125 AS one,
c * 0.75 + (1 - c) * (e * -0.5 + (1 - e) * 1.0) AS dq, c * 0.75 + (1 - c) * (0.75 * -0.5 + 0.25) AS d_only, 0.4 * 0.75 + 0.6 * (e * -0.5 + (1 - e) * 1.0) AS q2_only,
0.4 * 0.75 + 0.6 * (0.75 * -0.5 + 0.25) AS two, f * -1.0 + (1 - f) * 2.0 AS p3, 0.8 * -1.0 + 0.2 * 2.0 AS three FROM h)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((q_only - one) + (qp - p_only)) / 2 + ((q2_only - two) + (dq - d_only)) / 2, 6) + 0.0 AS quantity,
round(((p_only - one) + (qp - q_only)) / 2 + p3 - three, 6) + 0.0 AS price, round(((d_only - two) + (dq - q2_only)) / 2, 6) + 0.0 AS discount,
round((one + two + three)::DOUBLE, 6) + 0.0 AS expected FROM v""")
def tree_contributions(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    discount = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    items = spread(t.lineitem, *keys).select(*keys, F.array("l_quantity", "l_extendedprice", discount).alias("x"))
    out = items.select(*keys, TX.predict_trees(t.spark, F.col("x"), TX.node_table(ENSEMBLE), "contribution").alias("c"))
    names = ["quantity", "price", "discount", "expected"]
    return out.select(*keys, *[r6(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(names)])


@query("answer_spans", "M07", """
WITH c AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
b AS (SELECT vec_id, arg_max(pos, v) FILTER (pos < 32) AS s, arg_max(pos - 32, v) FILTER (pos >= 32) AS e FROM c GROUP BY 1)
SELECT vec_id, CASE WHEN e >= s THEN array_to_string(['t' || i FOR i IN range(s, e + 1)], ' ') ELSE 'none' END AS answer FROM b""")
def answer_spans(t):
    words = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    span = SC.answer_span(words, F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return t.embeddings.select("vec_id", F.coalesce(F.array_join(span, " "), F.lit("none")).alias("answer"))


@query("document_sentiment", "M10 F36", f"""
WITH {TOKENS}, {VOCAB}, e AS (SELECT doc_id, coalesce(id, 3) AS id FROM tok LEFT JOIN vocab USING (token)),
s AS (SELECT d.doc_id, coalesce(sum(id % 7) / (7.0::DOUBLE * count(id)) * 4, 0) AS neg, coalesce(sum(id % 5) / (5.0::DOUBLE * count(id)) * 4, 0) AS pos
FROM documents d LEFT JOIN e USING (doc_id) GROUP BY 1)
SELECT doc_id, CASE WHEN neg >= pos THEN 'Negative' ELSE 'Positive' END AS class, round(1 / (1 + exp(-abs(pos - neg))), 6) AS prob FROM s""")
def document_sentiment(t):
    """Scores of every token of every text; a text without tokens scores zero both ways."""
    base = tokens(t)
    ids = V.encode(base, "tokens", vocabulary(base), "doc_id")

    def score(base_):
        whole = F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x % base_)
        return F.when(F.size("ids") > 0, whole / (float(base_) * F.size("ids")) * 4).otherwise(0.0)

    out = ids.select("doc_id", TM.sentiment(F.array(score(7), score(5))).alias("x"))
    return out.select("doc_id", "x.class", r6("x.prob").alias("prob"))


@query("first_gradient", "A16 T01 T03", """
WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), k AS (SELECT unnest(range(10)) AS k)
SELECT k, pos, round(avg((0.1 - (label = k)::INT) * v), 6) + 0.0 AS gradient FROM c, k GROUP BY 1, 2""")
def first_gradient(t):
    """Mean gradient of a softmax regression with zero weights, added up over all partitions."""
    model = TR.Linear(64, 10, "softmax", "constant")
    (rows, _, _, gradients), = TR.gradient_sums(t.embeddings, "embedding", "label", [(model, model.parameters(0))])
    cells = [(k, j, float(v)) for (k, j), v in np.ndenumerate(gradients["weight"] / rows)]
    return t.spark.createDataFrame(cells, "k long, pos long, gradient double").withColumn("gradient", r6("gradient"))


def scaled_prices(t):
    names = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    fitted = FE.fit_moments(t.lineitem, names)
    scaled = FE.z_score(t.lineitem.select("l_orderkey", "l_linenumber", *names), fitted)
    return scaled.select("l_orderkey", F.array(*names[:3]).alias("x"), F.col("l_extendedprice").alias("y"))


def history(t, trials):
    rows = [(i, r["epoch"], r["step"], float(r["loss"]), float(r["accuracy"]), float(r.get("validate_loss", float("nan")))) for i, tr in enumerate(trials) for r in tr.history]
    return t.spark.createDataFrame(rows, "trial int, epoch int, step int, loss double, accuracy double, validate_loss double")


@query("train_linear", "T01 T02 T03 T04", """
WITH s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS em, stddev_pop(l_extendedprice) AS es, avg(l_discount) AS dm, stddev_pop(l_discount) AS ds, avg(l_tax) AS tm, stddev_pop(l_tax) AS ts FROM lineitem),
z AS (SELECT (l_quantity - qm) / qs AS q, (l_discount - dm) / ds AS d, (l_tax - tm) / ts AS x, (l_extendedprice - em) / es AS y FROM lineitem, s),
g AS (SELECT avg(y * q) AS gq, avg(y * d) AS gd, avg(y * x) AS gx, avg(y * y) AS yy FROM z)
SELECT 0 AS epoch, round(0.5 * yy, 6) AS loss FROM g UNION ALL
SELECT 1, round(0.5 * avg(pow(y - 0.5 * (gq * q + gd * d + gx * x), 2)), 6) FROM z, g GROUP BY ALL""")
def train_linear(t):
    """Two full-batch steps of linear regression: losses before and after the first update."""
    data = scaled_prices(t)
    trial = TR.Trial(TR.Linear(3, 1, "squared", "constant"), OP.Sgd(0.5))
    done = TR.fit(data, "x", "y", [trial], epochs=2)
    return history(t, done).select("epoch", r6("loss").alias("loss"))


@query("train_flag_network", "T01 T02 T03 T06")
def train_flag_network(t):
    """A network over four numbers of every line item that tells its return flag."""
    names = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    scaled = FE.z_score(t.lineitem.select("l_returnflag", *names), FE.fit_moments(t.lineitem, names))
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = scaled.select(F.array(*names).alias("x"), flag.alias("y"))
    return history(t, TR.fit(rows, "x", "y", [TR.Trial(TR.Mlp(4, 32, 3), OP.Adam(0.01), seed=6)], epochs=3))


@query("train_classifiers", "T01 T02 T03 T05 T06 T07 T08 T09 T10 T12")
def train_classifiers(t):
    """One network per optimizer, all learning in the same passes over the data."""
    optimizers = [
        OP.Sgd(0.5, momentum=0.9), OP.Nag(0.5, momentum=0.9), OP.Adam(0.02), OP.Adagrad(0.1), OP.RmsProp(0.01), OP.RmsProp(0.01, centred=True),
        OP.Adadelta(epsilon=1e-4), OP.Sgd(0.5, clip=0.05, decay=1e-4),
    ]
    trials = [TR.Trial(TR.Mlp(64, 16, 10), o, seed=3) for o in optimizers]
    return history(t, TR.fit(t.embeddings, "embedding", "label", trials, epochs=4))


@query("train_slices", "T01 T02 K04 X09")
def train_slices(t):
    """Mini-batches from four written slices, a checkpoint per epoch, read back as a table."""
    path = scratch_path(t.spark, "parameters")
    trial = TR.Trial(TR.Linear(64, 10, "softmax"), OP.Adam(0.05), seed=2)
    TR.fit(t.embeddings, "embedding", "label", [trial], 2, "vec_id", slices=4, validate=t.embeddings, listeners=[TR.save_every_epoch(t.spark, path, trial)])
    return t.spark.read.parquet(path)


@query("hyper_parameter_search", "T15")
def hyper_parameter_search(t):
    space = {"rate": ("log", 0.01, 1.0), "hidden": ("int", 4, 16), "momentum": ("choice", [0.0, 0.9]), "decay": ("bool",)}
    part = G.usage(F.col("vec_id"), train=0.8, validation=0.2)
    build = lambda s: TR.Trial(TR.Mlp(64, s["hidden"], 10), OP.Sgd(s["rate"], momentum=s["momentum"], decay=1e-4 * s["decay"]), seed=1)
    e = t.embeddings
    best, report = TR.search(e.filter(part == "train"), e.filter(part == "validation"), "embedding", "label", space, build, trials=6, epochs=3, seed=5)
    return t.spark.createDataFrame(report[["trial", "rate", "hidden", "momentum", "decay", "loss", "accuracy"]])


@query("text_classifier", "T16 M05")
def text_classifier(t):
    """Learned from the labelled texts, applied to all; ``label`` is null where there is none."""
    data = tokens(t).join(t.labels, "doc_id", "left").withColumn("label", F.col("quality").cast("double"))
    model = TM.fit_classifier(data.where("label IS NOT NULL"), "tokens", "label", buckets=1 << 14, epochs=10)
    out = TM.classify(data.select("doc_id", "tokens", "label"), model, ["poor", "good"], 1)
    best = F.get("top", F.lit(0))
    return out.select("doc_id", "label", best["class"].alias("class"), r6(best["prob"]).alias("prob"))


@query("word_vectors", "T17")
def word_vectors(t):
    model = TM.fit_word_vectors(tokens(t), "tokens", size=8, min_count=50)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
