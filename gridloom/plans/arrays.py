"""Array operators on ``embeddings``, packed and long."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.functions import numeric as N
from gridloom.operators import evaluation as E
from gridloom.operators import ordering as O
from gridloom.operators import tensors as T
from gridloom.plans.registry import query, r6

CELLS = """cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
    generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""
GRID = CELLS + ", grid AS (SELECT *, pos // 8 AS i, pos % 8 AS j FROM cells)"


def vectors(t):
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def cells(t):
    return T.explode_cells(t.embeddings, "embedding", ["vec_id", "label"])


def grid(t):
    return T.to_grid(cells(t), 8)


@query("softmax_rows", "W09", f"""
WITH {CELLS}, m AS (SELECT vec_id, max(v) AS top FROM cells GROUP BY 1),
s AS (SELECT vec_id, top, sum(exp(v - top)) AS mass FROM cells JOIN m USING (vec_id) GROUP BY 1, 2)
SELECT vec_id, pos, round(exp(v - top) / mass, 6) AS p, round(v - top - ln(mass), 6) + 0.0 AS lp
FROM cells JOIN s USING (vec_id)""")
def softmax_rows(t):
    e = vectors(t).select("vec_id", A.softmax(F.col("e")).alias("p"), A.log_softmax(F.col("e")).alias("lp"))
    both = e.select("vec_id", F.posexplode(F.arrays_zip("p", "lp")).alias("pos", "x"))
    return both.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("x.p").alias("p"), r6("x.lp").alias("lp"))


@query("layer_norm_rows", "W10", f"""
WITH {CELLS}, s AS (SELECT vec_id, avg(v) AS m, var_pop(v) AS s FROM cells GROUP BY 1)
SELECT vec_id, pos, round((v - m) / sqrt(s + 1e-5), 6) + 0.0 AS n FROM cells JOIN s USING (vec_id)""")
def layer_norm_rows(t):
    e = vectors(t).select("vec_id", F.posexplode(A.layer_norm(F.col("e"))).alias("pos", "n"))
    return e.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("n").alias("n"))


@query("reduce_rows", "A01 A02 A03 A04 A06 A09", f"""
WITH {CELLS} SELECT vec_id, round(sum(v), 6) + 0.0 AS sum, round(avg(v), 6) + 0.0 AS mean, max(v) AS max, min(v) AS min,
round(product(v) * 1e60, 6) + 0.0 AS prod, round(sum(abs(v)), 6) AS norm1, round(sqrt(sum(v * v)), 6) AS norm2,
count(*) FILTER (v > 0) AS positive, bool_and(v < 0.9) AS all_small, bool_or(v > 0.3) AS any_big FROM cells GROUP BY 1""")
def reduce_rows(t):
    e = F.col("e")
    return vectors(t).select(
        "vec_id",
        r6(A.total(e)).alias("sum"),
        r6(A.mean(e)).alias("mean"),
        F.array_max(e).alias("max"),
        F.array_min(e).alias("min"),
        r6(A.product(e) * 1e60).alias("prod"),
        r6(A.norm(e, 1)).alias("norm1"),
        r6(A.norm(e)).alias("norm2"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.forall(e, lambda x: x < 0.9).alias("all_small"),
        F.exists(e, lambda x: x > 0.3).alias("any_big"),
    )


@query("reduce_columns", "A01 A02 A03 A04 A06 A09", f"""
WITH {CELLS} SELECT label, pos, round(sum(v), 6) + 0.0 AS sum, round(avg(v), 6) + 0.0 AS mean, max(v) AS max, min(v) AS min,
round(sum(abs(v)), 6) AS norm1, round(sqrt(sum(v * v)), 6) AS norm2, count(*) FILTER (v <> 0) AS nonzero,
bool_and(v <> 0) AS "all", bool_or(v <> 0) AS "any", NOT bool_or(v <> 0) AS "none" FROM cells GROUP BY 1, 2""")
def reduce_columns(t):
    out = T.reduce_axes(cells(t), ["label", "pos"]).drop("prod")
    for name in ("sum", "mean", "norm1", "norm2"):
        out = out.withColumn(name, r6(name))
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("arg_extremes_rows", "A05", f"""
WITH {CELLS} SELECT vec_id, arg_max(pos, v * 1.0 - pos * 0.0) AS arg_max, arg_min(pos, v) AS arg_min FROM cells GROUP BY 1""")
def arg_extremes_rows(t):
    e = F.col("e")
    return vectors(t).select(
        "vec_id", A.arg_max(e).cast("long").alias("arg_max"), A.arg_min(e).cast("long").alias("arg_min")
    )


@query("arg_extremes_columns", "A05", f"""
WITH {CELLS}, r AS (SELECT pos, vec_id, row_number() OVER (PARTITION BY pos ORDER BY v DESC, vec_id) AS hi,
row_number() OVER (PARTITION BY pos ORDER BY v, vec_id) AS lo FROM cells)
SELECT pos, max(vec_id) FILTER (hi = 1) AS arg_max, max(vec_id) FILTER (lo = 1) AS arg_min FROM r GROUP BY 1""")
def arg_extremes_columns(t):
    out = T.arg_extreme(cells(t), ["pos"], "vec_id")
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("trace_offsets", "A07", f"""
WITH {GRID} SELECT vec_id, round(sum(v) FILTER (j = i), 6) + 0.0 AS trace0,
round(sum(v) FILTER (j = i + 1), 6) + 0.0 AS trace1, round(sum(v) FILTER (j = i - 2), 6) + 0.0 AS trace_2
FROM grid GROUP BY 1""")
def trace_offsets(t):
    def trace(k):
        return r6(F.sum(F.when(F.col("j") == F.col("i") + k, F.col("v"))))

    return grid(t).groupBy("vec_id").agg(
        trace(0).alias("trace0"), trace(1).alias("trace1"), trace(-2).alias("trace_2")
    )


@query("median_percentile", "A08", f"""
WITH {CELLS} SELECT label, pos, round(median(v), 6) + 0.0 AS median, round(quantile_cont(v, 0.9), 6) + 0.0 AS p90
FROM cells GROUP BY 1, 2""")
def median_percentile(t):
    placed = cells(t).withColumn("pos", F.col("pos").cast("long"))
    out = E.percentiles(placed, ["label", "pos"], "v", "vec_id", {"median": 0.5, "p90": 0.9})
    return out.select("label", "pos", r6("median").alias("median"), r6("p90").alias("p90"))


@query("one_hot_arrays", "P05 P06", """
WITH k AS (SELECT unnest(range(10)) AS pos) SELECT vec_id, pos, CASE WHEN pos = label THEN 1.0 ELSE 0.0 END::DOUBLE AS hot,
CASE WHEN pos = label THEN 5.0 ELSE -1.0 END::DOUBLE AS on_off FROM embeddings, k""")
def one_hot_arrays(t):
    hot = F.arrays_zip(
        A.one_hot(F.col("label"), 10).alias("hot"), A.one_hot(F.col("label"), 10, 5.0, -1.0).alias("on_off")
    )
    out = t.embeddings.select("vec_id", F.posexplode(hot).alias("pos", "x"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), "x.hot", "x.on_off")


@query("index_slices", "P09", f"""
WITH {CELLS} SELECT vec_id, max(v) FILTER (pos = 3) AS fixed, max(v) FILTER (pos = 62) AS negative,
round(sum(v) FILTER (pos >= 5 AND pos < 20), 6) + 0.0 AS ranged, round(sum(v) FILTER (pos >= 2 AND pos < 60 AND (pos - 2) % 7 = 0), 6) + 0.0 AS stepped,
count(*) FILTER (pos >= 54) AS tail FROM cells GROUP BY 1""")
def index_slices(t):
    e = F.col("e")
    return vectors(t).select(
        "vec_id",
        F.get(e, F.lit(3)).alias("fixed"),
        F.element_at(e, -2).alias("negative"),
        r6(A.total(F.slice(e, 6, 15))).alias("ranged"),
        r6(A.total(A.stepped(e, 2, -4, 7))).alias("stepped"),
        F.size(A.stepped(e, -10)).cast("long").alias("tail"),
    )


@query("pick_by_column", "P10", """
SELECT vec_id, embedding[label + 1]::DOUBLE AS picked, embedding[64 - label]::DOUBLE AS from_end FROM embeddings""")
def pick_by_column(t):
    e = F.col("e")
    return vectors(t).select(
        "vec_id", A.pick(e, F.col("label")).alias("picked"), A.pick(e, -1 - F.col("label")).alias("from_end")
    )


@query("boolean_mask", "P11", f"""
WITH {CELLS} SELECT vec_id, count(*) FILTER (v > 0.1) AS kept, round(coalesce(sum(v) FILTER (v > 0.1), 0), 6) + 0.0 AS kept_sum
FROM cells GROUP BY 1""")
def boolean_mask(t):
    kept = A.masked(F.col("e"), F.transform("e", lambda x: x > 0.1))
    out = vectors(t).select("vec_id", kept.alias("k"))
    return out.select("vec_id", F.size("k").cast("long").alias("kept"), r6(A.total(F.col("k"))).alias("kept_sum"))


@query("set_and_where", "P12 P13 P14", f"""
WITH {CELLS} SELECT vec_id, pos, CASE WHEN pos = 0 THEN 9.0 WHEN v < 0 THEN 0.0 ELSE v END AS assigned,
CASE WHEN pos % 2 = 0 THEN v ELSE -v END AS chosen, CASE WHEN pos < label * 6 THEN v ELSE -1.0 END AS sequence_masked FROM cells""")
def set_and_where(t):
    e = F.col("e")
    assigned = A.set_where(A.set_where(e, lambda x, i: x < 0, F.lit(0.0)), lambda x, i: i == 0, F.lit(9.0))
    chosen = F.transform(e, lambda x, i: F.when(i % 2 == 0, x).otherwise(-x))
    out = vectors(t).select(
        "vec_id",
        F.posexplode(
            F.arrays_zip(
                assigned.alias("assigned"),
                chosen.alias("chosen"),
                A.sequence_mask(e, F.col("label") * 6, -1.0).alias("sequence_masked"),
            )
        ).alias("pos", "x"),
    )
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), "x.assigned", "x.chosen", "x.sequence_masked")


@query("comparisons_and_logic", "P15 P18 P19", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity = 25 AS eq, l_quantity <> 25 AS neq, l_quantity > 25 AS gt, l_quantity >= 25 AS gte,
l_quantity < l_extendedprice / 1000 AS lt, 25 <= l_quantity AS rev_lte, l_tax > 0 AND l_discount > 0 AS both_set,
l_tax > 0 OR l_discount > 0 AS any_set, (l_tax > 0) <> (l_discount > 0) AS one_set, NOT l_tax > 0 AS no_tax,
l_tax = 0 AND l_discount = 0 AS ratio_nan, l_tax = 0 AND l_discount <> 0 AS ratio_inf FROM lineitem""")
def comparisons_and_logic(t):
    q, tax, cut = F.col("l_quantity"), F.col("l_tax") > 0, F.col("l_discount") > 0
    ratio = N.divide(F.col("l_discount"), F.col("l_tax"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (q == 25).alias("eq"), (q != 25).alias("neq"), (q > 25).alias("gt"), (q >= 25).alias("gte"),
        (q < F.col("l_extendedprice") / 1000).alias("lt"), (F.lit(25) <= q).alias("rev_lte"),
        (tax & cut).alias("both_set"), (tax | cut).alias("any_set"), (tax != cut).alias("one_set"), (~tax).alias("no_tax"),
        F.isnan(ratio).alias("ratio_nan"), N.is_infinite(ratio).alias("ratio_inf"),
    )


@query("all_close", "P16", f"""
WITH {CELLS} SELECT vec_id, true AS content_equal, bool_and(abs(v - (v + 0.0005)) <= 0.0001 + 0.01 * abs(v + 0.0005)) AS close,
true AS same_shape FROM cells GROUP BY 1""")
def all_close(t):
    e = F.col("e")
    moved = F.transform(e, lambda x: x + 0.0005)
    return vectors(t).select(
        "vec_id", (e == e).alias("content_equal"), A.all_close(e, moved, 0.01, 0.0001).alias("close"),
        (F.size(e) == F.size(moved)).alias("same_shape"),
    )


@query("nonzero_coordinates", "P17 P28", f"""
WITH {GRID} SELECT vec_id, i, j, v FROM grid WHERE v > 0.15""")
def nonzero_coordinates(t):
    thinned = grid(t).withColumn("v", F.when(F.col("v") > 0.15, F.col("v")).otherwise(0.0))
    return T.to_sparse(thinned).select("vec_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")


@query("sparse_to_dense", "P28", f"""
WITH {CELLS} SELECT vec_id, pos, CASE WHEN v > 0.15 THEN v ELSE 0.0 END AS v FROM cells""")
def sparse_to_dense(t):
    sparse = T.to_sparse(cells(t).withColumn("v", F.when(F.col("v") > 0.15, F.col("v")).otherwise(0.0)))
    full = t.embeddings.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    dense = full.join(sparse.select("vec_id", "pos", "v"), ["vec_id", "pos"], "left")
    return dense.select("vec_id", F.col("pos").cast("long").alias("pos"), F.coalesce("v", F.lit(0.0)).alias("v"))


@query("cast_types", "P20", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc(l_extendedprice)::BIGINT AS as_long, trunc(l_quantity)::INTEGER AS as_int,
l_linenumber::DOUBLE AS as_double, l_tax <> 0 AS as_bool, l_linenumber::VARCHAR AS as_string FROM lineitem""")
def cast_types(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_extendedprice").cast("long").alias("as_long"), F.col("l_quantity").cast("int").alias("as_int"),
        F.col("l_linenumber").cast("double").alias("as_double"), F.col("l_tax").cast("boolean").alias("as_bool"),
        F.col("l_linenumber").cast("string").alias("as_string"),
    )


@query("reshape_transpose", "P21 P22", f"""
WITH {GRID} SELECT vec_id, j AS i, i AS j, j * 8 + i AS flat, v FROM grid""")
def reshape_transpose(t):
    turned = grid(t).select("vec_id", F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return turned.select(
        "vec_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
        (F.col("i") * 8 + F.col("j")).cast("long").alias("flat"), "v",
    )


@query("flatten_packed", "P21", f"""
WITH {CELLS} SELECT vec_id, pos, v FROM cells""")
def flatten_packed(t):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("e", r * 8 + 1, 8))
    out = vectors(t).select("vec_id", F.posexplode(F.flatten(rows)).alias("pos", "v"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), "v")


@query("flip_and_rotate", "P23 V13", f"""
WITH {GRID} SELECT vec_id, i, j, v, 7 - j AS flip_j, 7 - i AS flip_i, 7 - j AS rot_i, i AS rot_j FROM grid""")
def flip_and_rotate(t):
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    return grid(t).select(
        "vec_id", i.alias("i"), j.alias("j"), "v", (7 - j).alias("flip_j"), (7 - i).alias("flip_i"),
        (7 - j).alias("rot_i"), i.alias("rot_j"),
    )


@query("split_axis", "P24", f"""
WITH {CELLS} SELECT pos * 4 // 64 AS quarter, CASE WHEN pos >= 40 THEN 2 WHEN pos >= 10 THEN 1 ELSE 0 END AS section,
count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM cells GROUP BY 1, 2""")
def split_axis(t):
    return cells(t).groupBy(
        A.section_equal(F.col("pos"), F.lit(64), 4).cast("long").alias("quarter"),
        A.section_at(F.col("pos"), [10, 40]).alias("section"),
    ).agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))


@query("tile_and_repeat", "P25 P27", """
WITH x AS (SELECT vec_id, embedding AS h FROM embeddings), k AS (SELECT unnest(range(128)) AS pos)
SELECT vec_id, pos, h[pos % 64 + 1]::DOUBLE AS tiled, h[pos // 2 + 1]::DOUBLE AS repeated, 0.0::DOUBLE AS zeros, 1.0::DOUBLE AS ones FROM x, k""")
def tile_and_repeat(t):
    tiled = A.tile(F.col("e"), 2)
    out = vectors(t).select(
        "vec_id",
        F.posexplode(
            F.arrays_zip(
                tiled.alias("tiled"), A.repeat_each(F.col("e"), 2).alias("repeated"),
                A.like(tiled, 0).alias("zeros"), A.like(tiled, 1).alias("ones"),
            )
        ).alias("pos", "x"),
    )
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), "x.tiled", "x.repeated", "x.zeros", "x.ones")


@query("clip_and_bounds", "P26", """
SELECT c_custkey, greatest(least(c_acctbal, 5000.0), 0.0) AS clipped, greatest(c_acctbal, c_nationkey * 100.0) AS maximum,
least(c_acctbal, c_nationkey * 100.0) AS minimum FROM customer""")
def clip_and_bounds(t):
    other = F.col("c_nationkey") * 100.0
    return t.customer.select(
        "c_custkey", A.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped"),
        F.greatest("c_acctbal", other).alias("maximum"), F.least("c_acctbal", other).alias("minimum"),
    )


@query("matrix_product", "J04", f"""
WITH {CELLS}, w AS (SELECT label AS k, pos, avg(v) AS w FROM cells GROUP BY 1, 2)
SELECT vec_id, k, round(sum(v * w), 6) + 0.0 AS v FROM cells JOIN w USING (pos) GROUP BY 1, 2""")
def matrix_product(t):
    c = cells(t)
    centres = c.groupBy(F.col("label").alias("k"), "pos").agg(F.avg("v").alias("v"))
    return T.matmul(c, centres, "vec_id", "pos", "k").withColumn("v", r6("v"))


@query("gram_matrix", "J04", f"""
WITH {CELLS} SELECT a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 6) + 0.0 AS v
FROM cells a JOIN cells b USING (vec_id) GROUP BY 1, 2""")
def gram_matrix(t):
    out = T.gram(t.embeddings, "embedding")
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("v").alias("v"))


@query("batch_matrix_product", "J05", f"""
WITH {GRID} SELECT a.vec_id, a.i, b.i AS k, round(sum(a.v * b.v), 6) + 0.0 AS v
FROM grid a JOIN grid b ON a.vec_id = b.vec_id AND a.j = b.j GROUP BY 1, 2, 3""")
def batch_matrix_product(t):
    g = grid(t).select("vec_id", "i", "j", "v")
    out = T.matmul(g, g.withColumnRenamed("i", "k"), "i", "j", "k", batch=["vec_id"])
    return out.select("vec_id", F.col("i").cast("long").alias("i"), F.col("k").cast("long").alias("k"), r6("v").alias("v"))


@query("broadcast_arithmetic", "J06 F01", f"""
WITH {CELLS}, s AS (SELECT pos, avg(v) AS m, max(v) - min(v) AS r FROM cells GROUP BY 1)
SELECT vec_id, pos, round(v - m, 6) + 0.0 AS centred, round((v - m) / r, 6) + 0.0 AS scaled FROM cells JOIN s USING (pos)""")
def broadcast_arithmetic(t):
    c = cells(t)
    stats = c.groupBy("pos").agg(F.avg("v").alias("m"), (F.max("v") - F.min("v")).alias("r"))
    out = T.apply_stats(c, stats, ["pos"], ["vec_id"])
    return out.select(
        "vec_id", F.col("pos").cast("long").alias("pos"), r6(F.col("v") - F.col("m")).alias("centred"),
        r6(N.divide(F.col("v") - F.col("m"), F.col("r"))).alias("scaled"),
    )


@query("concat_rows", "U01", """
SELECT row_number() OVER (ORDER BY src, k) - 1 AS row_id, src, k, bal FROM
(SELECT 0 AS src, c_custkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier)""")
def concat_rows(t):
    first = t.customer.select(F.lit(0).alias("src"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    second = t.supplier.select(F.lit(1).alias("src"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return O.ordered_prefix(first.unionByName(second), "src", "k")


@query("concat_features", "U02 U03", f"""
WITH {CELLS}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM cells GROUP BY 1), k AS (SELECT unnest(range(128)) AS pos)
SELECT vec_id, pos, round(CASE WHEN pos < 64 THEN embedding[pos + 1] ELSE embedding[pos - 63] / n END, 6) + 0.0 AS joined,
pos // 64 AS part FROM embeddings JOIN n USING (vec_id), k""")
def concat_features(t):
    unit = A.let(A.norm(F.col("e")), lambda n: F.transform("e", lambda x: x / n))
    both = vectors(t).select("vec_id", F.concat("e", unit).alias("both"))
    joined = T.explode_rows(both, "both", ["vec_id"], value="x")
    return joined.select(
        "vec_id", F.col("pos").cast("long").alias("pos"), r6("x").alias("joined"),
        F.floor(F.col("pos") / 64).alias("part"),
    )


@query("stack_arrays", "U03", f"""
WITH {CELLS} SELECT vec_id, pos, 0 AS layer, v FROM cells UNION ALL SELECT vec_id, pos, 1, -v FROM cells""")
def stack_arrays(t):
    e = F.col("e")
    layers = F.array(e, F.transform(e, lambda x: -x))
    out = vectors(t).select("vec_id", F.posexplode(layers).alias("layer", "row"))
    out = out.select("vec_id", "layer", F.posexplode("row").alias("pos", "v"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), "layer", "v")


@query("cumulative_sum", "W01", """
SELECT o_orderkey, o_orderstatus, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS by_status FROM orders""")
def cumulative_sum(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = O.ordered_prefix(o, "o_orderkey", index=None, sums={"running": "o_totalprice"})
    out = O.ordered_prefix(out, "o_orderkey", within=["o_orderstatus"], index=None, sums={"by_status": "o_totalprice"})
    return out.select(
        "o_orderkey", "o_orderstatus", F.round("running", 2).alias("running"), F.round("by_status", 2).alias("by_status")
    )


@query("sort_rows", "O01 O02", f"""
WITH {CELLS} SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY v, pos) - 1 AS place, v, pos AS origin,
row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) - 1 AS place_desc FROM cells""")
def sort_rows(t):
    e = F.col("e")
    v = vectors(t).select("vec_id", F.sort_array("e").alias("s"), A.arg_sort(e).alias("up"), A.arg_sort(e, False).alias("down"))
    # The place in falling order is the inverse of that permutation.
    cells = v.select("vec_id", "down", F.arrays_zip("s", "up").alias("cells"))
    out = T.explode_rows(cells, "cells", ["vec_id", "down"], "place", "x")
    place_desc = F.array_position("down", F.col("x.up")) - 1
    out = out.select("vec_id", "place", F.col("x.up").alias("origin"), place_desc.alias("place_desc"), F.col("x.s").alias("v"))
    return out.select("vec_id", *[F.col(c).cast("long").alias(c) for c in ("place", "origin", "place_desc")], "v")


@query("sort_axis_global", "O01 O02", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 AS place FROM lineitem""")
def sort_axis_global(t):
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    keyed = items.withColumn("_tie", F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return O.ordered_prefix(keyed, "l_extendedprice", "_tie", index="place").drop("_tie")


@query("batch_normalise", "A17", f"""
WITH {CELLS}, s AS (SELECT label, avg(v) AS m, var_pop(v) AS s FROM cells GROUP BY 1)
SELECT vec_id, pos, round((v - m) / sqrt(s + 1e-5) * 2.0 + 0.5, 6) + 0.0 AS normal FROM cells JOIN s USING (label)""")
def batch_normalise(t):
    out = T.batch_norm(cells(t), "label", ["vec_id", "pos"], gamma=2.0, beta=0.5)
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("normal").alias("normal"))


@query("pool_disjoint", "A18", f"""
WITH {GRID} SELECT vec_id, i // 2 AS oi, j // 2 AS oj, max(v) AS max_pool, round(avg(v), 6) + 0.0 AS avg_pool,
round(sqrt(sum(v * v)), 6) AS lp_pool FROM grid GROUP BY 1, 2, 3""")
def pool_disjoint(t):
    return _pooled(T.pool(grid(t), ["vec_id"], (2, 2), (2, 2), (8, 8)))


@query("pool_overlapping", "A18", f"""
WITH {GRID}, o AS (SELECT a.oi, b.oj FROM (SELECT unnest(range(4)) AS oi) a, (SELECT unnest(range(4)) AS oj) b)
SELECT vec_id, oi, oj, max(v) AS max_pool, round(sum(v) / 9, 6) + 0.0 AS avg_pool, round(sqrt(sum(v * v)), 6) AS lp_pool
FROM grid JOIN o ON i + 1 BETWEEN oi * 2 AND oi * 2 + 2 AND j + 1 BETWEEN oj * 2 AND oj * 2 + 2 GROUP BY 1, 2, 3""")
def pool_overlapping(t):
    return _pooled(T.pool(grid(t), ["vec_id"], (3, 3), (2, 2), (8, 8), padding=(1, 1)))


def _pooled(df):
    return df.select(
        "vec_id", F.col("oi").cast("long").alias("oi"), F.col("oj").cast("long").alias("oj"), "max_pool",
        r6("avg_pool").alias("avg_pool"), r6("lp_pool").alias("lp_pool"),
    )


@query("pool_global", "A18", f"""
WITH {GRID} SELECT vec_id, max(v) AS max_pool, round(avg(v), 6) + 0.0 AS avg_pool, round(sqrt(sum(v * v)), 6) AS lp_pool
FROM grid GROUP BY 1""")
def pool_global(t):
    out = T.global_pool(cells(t), ["vec_id"])
    return out.select("vec_id", "max_pool", r6("avg_pool").alias("avg_pool"), r6("lp_pool").alias("lp_pool"))
