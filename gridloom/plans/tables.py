"""Feature, scaling, sampling, batching and generator queries on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import schedules as L
from gridloom.operators import batching as B
from gridloom.operators import features as FE
from gridloom.operators import ordering as O
from gridloom.operators import tensors as T
from gridloom.operators import transforms as ST
from gridloom.plans.registry import draw_sql, query, r6, uniform_sql
from gridloom.session import scratch_path
from gridloom.sources import generators as G
from gridloom.sources import tabular as TB

STATUS = {"F": 0, "O": 1, "P": 2}


def seen(column: str) -> str:
    return f"""(SELECT {column}, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS ix FROM orders GROUP BY 1)"""


@query("feature_vectors", "P01 P02 P03 P04 P05 K01 X01", f"""
WITH x AS (SELECT o_orderkey, [o_totalprice::FLOAT::DOUBLE, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END,
CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END, ix, length(o_orderpriority)] AS data FROM orders JOIN {seen('o_orderpriority')} p USING (o_orderpriority))
SELECT o_orderkey, unnest(data)::DOUBLE AS v, generate_subscripts(data, 1) - 1 AS pos, CASE WHEN data[2] = 1 THEN 0.0 WHEN data[3] = 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS label FROM x""")
def feature_vectors(t):
    features = [
        FE.Feature("o_totalprice"),
        FE.Feature("o_orderstatus", "one_hot", STATUS),
        FE.Feature("o_orderpriority", "indexed"),
        FE.Feature("o_orderpriority", "custom", function=lambda c: F.array(F.length(c).cast("double"))),
    ]
    out = FE.featurize(t.orders, features, [FE.Feature("o_orderstatus", "category", STATUS)], "o_orderkey")
    out = T.explode_rows(out.withColumn("label", F.get("labels", F.lit(0))), "data", ["o_orderkey", "label"])
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("first_seen_index", "P03", """
SELECT p_name AS value, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS index FROM part GROUP BY 1""")
def first_seen_index(t):
    return B.first_seen_index(t.part, "p_name", "p_partkey")


@query("limit_and_sub_range", "P07 P08 S18", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT 'limit' AS kind, o_orderkey, o_totalprice FROM r WHERE i < 700 UNION ALL
SELECT 'range', o_orderkey, o_totalprice FROM r WHERE i >= 100 AND i < 250""")
def limit_and_sub_range(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    first = o.orderBy("o_orderkey").limit(700).select(F.lit("limit").alias("kind"), "*")
    return first.unionByName(O.sub_range(o, 100, 250, "o_orderkey").select(F.lit("range").alias("kind"), "*"))


@query("random_split_sizes", "U04", """
WITH n AS (SELECT count(*) AS n FROM orders) SELECT unnest([0, 1, 2]) AS split, unnest([n * 5 // 10, n * 4 // 10, n - n * 5 // 10 - n * 4 // 10]) AS rows,
unnest([n * 5 // 10, n * 4 // 10, n - n * 5 // 10 - n * 4 // 10]) AS distinct_keys FROM n""")
def random_split_sizes(t):
    parts = O.random_split(t.orders.select("o_orderkey"), [5, 4, 1], 3, "o_orderkey")
    return parts.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("distinct_keys"))


@query("random_split_rows", "U04 D06", f"""
WITH p AS (SELECT *, row_number() OVER (ORDER BY {draw_sql(3, "o_orderkey")}, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, (pos >= trunc(0.5::DOUBLE * n))::INT + (pos >= trunc(0.5::DOUBLE * n) + trunc(0.4::DOUBLE * n))::INT AS split FROM p""")
def random_split_rows(t):
    return O.random_split(t.orders, [5, 4, 1], 3, "o_orderkey")


@query("random_order", "D06 X06", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {draw_sql(5, "o_orderkey")}, o_orderkey) - 1 AS position FROM orders""")
def random_order(t):
    return O.shuffled(t.orders.select("o_orderkey"), 5, "o_orderkey")


@query("sequential_batches", "W02 D06", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, i // 64 AS batch_id, i % 64 AS pos FROM r WHERE i // 64 < n // 64""")
def sequential_batches(t):
    return O.batches(t.orders.select("o_orderkey"), 64, "o_orderkey", drop_last=True)


@query("stack_and_unstack", "D07 D08 X05", """
WITH r AS (SELECT vec_id, embedding, (row_number() OVER (ORDER BY vec_id) - 1) AS i FROM embeddings)
SELECT i // 16 AS batch_id, i % 16 AS pos, len(embedding) AS width, embedding[1]::DOUBLE AS first FROM r""")
def stack_and_unstack(t):
    placed = O.batches(t.embeddings.select("vec_id", "embedding"), 16, "vec_id", wide=True)
    out = B.unstack(B.stack(placed, "embedding", "batch_id", "pos"), "stacked", "batch_id")
    return out.select(
        "batch_id", F.col("pos").cast("long").alias("pos"), F.size("record").cast("long").alias("width"),
        F.get("record", F.lit(0)).cast("double").alias("first"),
    )


@query("split_batches", "D09", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
b AS (SELECT *, i // 50 AS batch_id, i % 50 AS pos, count(*) OVER (PARTITION BY i // 50) AS n FROM r)
SELECT batch_id, pos // ((n + 3) // 4) AS slice, count(*) AS rows, min(o_orderkey) AS first FROM b GROUP BY 1, 2""")
def split_batches(t):
    placed = O.batches(t.orders.select("o_orderkey"), 50, "o_orderkey")
    sizes = placed.groupBy("batch_id").agg(F.count("*").alias("n"))
    cut = placed.join(sizes, "batch_id").withColumn("slice", B.split_slices(F.col("pos"), F.col("n"), 4).cast("long"))
    return cut.groupBy("batch_id", "slice").agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first"))


@query("min_max_scaled", "A10 D01 D02 J06", """
WITH s AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS e0, max(l_extendedprice) AS e1 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - q0) / (q1 - q0), 6) + 0.0 AS quantity, round((l_extendedprice - e0) / (e1 - e0) * 2 - 1, 6) + 0.0 AS price,
round(l_extendedprice, 4) AS restored FROM lineitem, s""")
def min_max_scaled(t):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    items = t.lineitem.select(*names, F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    fitted = FE.fit_min_max(items, ["quantity", "price"])
    out = FE.min_max_scale(items, {"quantity": fitted["quantity"]})
    out = FE.min_max_scale(out, {"price": fitted["price"]}, -1.0, 1.0).withColumn("restored", F.col("price"))
    out = FE.min_max_restore(out, {"restored": fitted["price"]}, -1.0, 1.0)
    return out.select(*names, r6("quantity").alias("quantity"), r6("price").alias("price"), F.round("restored", 4).alias("restored"))


@query("z_scores", "A11 D03", """
WITH f AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000), s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM f)
SELECT o_orderkey, round((o_totalprice - m) / s, 6) + 0.0 AS z FROM orders, s""")
def z_scores(t):
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("z"))
    fitted = FE.fit_moments(o, ["z"], limit=1000, order="o_orderkey")
    return FE.z_score(o, fitted).withColumn("z", r6("z"))


@query("one_hot_returnflag", "P05 D01 K01", """
WITH s AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS e0, max(l_extendedprice) AS e1 FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg((l_quantity - q0) / (q1 - q0)), 6) AS quantity, round(avg((l_extendedprice - e0) / (e1 - e0)), 6) AS price,
avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END)::DOUBLE AS is_a FROM lineitem, s GROUP BY 1""")
def one_hot_returnflag(t):
    names = ["l_quantity", "l_extendedprice"]
    scaled = FE.min_max_scale(t.lineitem.select("l_orderkey", "l_returnflag", *names), FE.fit_min_max(t.lineitem, names))
    hot = FE.Feature("l_returnflag", "one_hot", {"A": 0, "N": 1, "R": 2})
    data = FE.featurize(scaled, [hot, *map(FE.Feature, names)], [FE.Feature("l_quantity")], "l_orderkey")
    packed = B.export_matrix(data.select("l_returnflag", F.col("data").alias("d"), "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice", "d"], ["l_quantity"])
    return packed.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), r6(F.avg(F.get("data", F.lit(0)))).alias("quantity"),
        r6(F.avg(F.get("data", F.lit(1)))).alias("price"), F.avg(F.get("data", F.lit(2))).alias("is_a"),
    )


@query("binary_math", "F01 F02 F03", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice + l_tax, 4) AS added, round(l_extendedprice - l_quantity, 4) AS subtracted,
round(l_extendedprice * l_discount, 4) AS multiplied, l_extendedprice / l_quantity AS divided, l_tax = 0 AS zero_division,
round(l_extendedprice - 7 * floor(l_extendedprice / 7), 4) AS modulo, round(-l_quantity - 7 * floor(-l_quantity / 7), 4) AS negative_modulo, round(pow(l_quantity, 2), 4) AS powered,
round(1 - l_discount, 4) AS rsub, 100 / l_quantity AS rdiv, round(pow(2, l_tax), 6) AS rpow, round(100 - l_quantity * floor(100 / l_quantity), 4) AS rmod FROM lineitem""")
def binary_math(t):
    e, q, d, x = (F.col(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax"))
    r4 = lambda c: F.round(c, 4)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r4(e + x).alias("added"), r4(e - q).alias("subtracted"),
        r4(e * d).alias("multiplied"), N.divide(e, q).alias("divided"), N.is_infinite(N.divide(e, x)).alias("zero_division"),
        r4(N.remainder(e, F.lit(7))).alias("modulo"), r4(N.remainder(-q, F.lit(7))).alias("negative_modulo"),
        r4(F.pow(q, F.lit(2))).alias("powered"), r4(1 - d).alias("rsub"), N.divide(F.lit(100), q).alias("rdiv"),
        r6(F.pow(F.lit(2.0), x)).alias("rpow"), r4(N.remainder(F.lit(100), q)).alias("rmod"),
    )


UNARY_SQL = {
    "neg": "-v", "abs": "abs(v)", "sign": "sign(v)::DOUBLE", "square": "v * v", "sqrt": "sqrt(w)", "cbrt": "cbrt(v)", "floor": "floor(v * 10)",
    "ceil": "ceil(v * 10)", "round": "round_even(v * 10, 0)", "trunc": "trunc(v * 10)", "exp": "exp(v)", "log": "ln(w)", "log10": "log10(w)",
    "log2": "log2(w)", "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "asin": "asin(v)", "acos": "acos(v)", "atan": "atan(v)",
    "sinh": "sinh(v)", "cosh": "cosh(v)", "tanh": "tanh(v)", "asinh": "asinh(v)", "acosh": "acosh(w)", "atanh": "atanh(v)",
    "degrees": "degrees(v)", "radians": "radians(v)",
}
CELLS = """cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""


@query("unary_math", "F04 F05 F06 F07 F08", f"""
WITH {CELLS}, x AS (SELECT *, abs(v) + 1 AS w FROM cells)
SELECT vec_id, pos, {", ".join(f'round({e}, 6) + 0.0 AS f_{n}' for n, e in UNARY_SQL.items())} FROM x""")
def unary_math(t):
    c = T.explode_cells(t.embeddings, "embedding", ["vec_id"])
    by_input = {"v": N.unary(F.col("v")), "w": N.unary(F.abs("v") + 1), "v * 10": N.unary(F.col("v") * 10)}
    picked = []
    for name, sql in UNARY_SQL.items():
        source = "v * 10" if "v * 10" in sql else ("w" if "(w)" in sql else "v")
        picked.append(r6(by_input[source][name]).alias(f"f_{name}"))
    return c.select("vec_id", F.col("pos").cast("long").alias("pos"), *picked)


@query("activations", "F10 F11", f"""
WITH {CELLS}, x AS (SELECT vec_id, pos, v * 10 AS x FROM cells), s AS (SELECT *, greatest(x, 0) + ln(1 + exp(-abs(x))) AS sp,
CASE WHEN x > 0 THEN x ELSE exp(least(x, 0)) - 1 END AS elu FROM x)
SELECT vec_id, pos, round(greatest(x, 0.0), 6) + 0.0 AS relu, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(tanh(x), 6) + 0.0 AS tanh, round(sp, 6) + 0.0 AS softplus,
round(x / (1 + abs(x)), 6) + 0.0 AS softsign, round(CASE WHEN x > 0 THEN x ELSE 0.01 * x END, 6) + 0.0 AS leaky_relu, round(elu, 6) + 0.0 AS elu,
round(1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * elu END, 6) + 0.0 AS selu, round(x / (1 + exp(-x)), 6) + 0.0 AS swish,
round(x * tanh(sp), 6) + 0.0 AS mish, round(CASE WHEN x > 0 THEN x ELSE 0.25 * x END, 6) + 0.0 AS prelu FROM s""")
def activations(t):
    c = T.explode_cells(t.embeddings, "embedding", ["vec_id"])
    x = F.col("v") * 10
    named = {k: v for k, v in N.activations(x).items() if k != "gelu"}
    named["prelu"] = N.prelu(x, F.lit(0.25))
    return c.select("vec_id", F.col("pos").cast("long").alias("pos"), *[r6(v).alias(k) for k, v in named.items()])


def horner(coefficients, x):
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out}) * {x} + {c!r}::DOUBLE"
    return out


@query("gelu_and_erfinv", "F09 F10", f"""
WITH {CELLS}, x AS (SELECT vec_id, pos, v, v * 10 AS x, -ln(1 - v * v) AS w, 1 / (1 + 0.3275911 * abs(v * 10) / sqrt(2)) AS q FROM cells),
y AS (SELECT *, w - 2.5 AS c, sqrt(w) - 3 AS l FROM x)
SELECT vec_id, pos, round(x * 0.5 * (1 + sign(x) * (1 - ({horner([1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592], 'q')}) * q * exp(-x * x / 2))), 6) + 0.0 AS gelu,
round(CASE WHEN w < 5 THEN {horner(N.ERFINV_CENTRE, 'c')} ELSE {horner(N.ERFINV_TAIL, 'l')} END * v, 6) + 0.0 AS erfinv FROM y""")
def gelu_and_erfinv(t):
    c = T.explode_cells(t.embeddings, "embedding", ["vec_id"])
    return c.select(
        "vec_id", F.col("pos").cast("long").alias("pos"), r6(N.activations(F.col("v") * 10)["gelu"]).alias("gelu"), r6(N.erfinv(F.col("v"))).alias("erfinv")
    )


@query("dropout_cells", "F12", f"""
WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INT AS pos FROM embeddings)
SELECT vec_id, pos, CASE WHEN {uniform_sql(9, "vec_id", "pos")} < 0.25 THEN 0.0::DOUBLE ELSE v / 0.75::DOUBLE END AS v FROM c""")
def dropout_cells(t):
    c = T.explode_cells(t.embeddings, "embedding", ["vec_id"])
    return c.withColumn("v", N.dropout(F.col("v"), 0.25, 9, "vec_id", "pos"))


@query("number_ranges", "S22", """
WITH n AS (SELECT count(*) AS n, max(l_quantity) AS top FROM lineitem), s AS (SELECT count(*) AS s FROM supplier)
SELECT 'arange' AS kind, i, -1::BIGINT AS j, round(0.5 + i * 0.25, 6) AS v FROM (SELECT unnest(range(n)) AS i FROM n) UNION ALL
SELECT 'linspace', i, -1, round(i * top / (s - 1), 6) + 0.0 FROM n, s, LATERAL (SELECT unnest(range(s)) AS i) UNION ALL
SELECT 'eye', i, i + 2, 1.0 FROM s, LATERAL (SELECT unnest(range(s)) AS i) WHERE i + 2 < s UNION ALL
SELECT 'full', i // 5, i % 5, 7.0 FROM s, LATERAL (SELECT unnest(range(s * 5)) AS i)""")
def number_ranges(t):
    rows, top = t.lineitem.agg(F.count("*"), F.max("l_quantity")).first()
    size = t.supplier.count()
    none = F.lit(-1).cast("long")
    parts = [
        G.arange(t.spark, 0.5, 0.5 + rows * 0.25, 0.25).select(F.lit("arange").alias("kind"), "i", none.alias("j"), r6("v").alias("v")),
        G.linspace(t.spark, 0.0, top, size).select(F.lit("linspace").alias("kind"), "i", none.alias("j"), r6("v").alias("v")),
        G.eye(t.spark, size, k=2).select(F.lit("eye").alias("kind"), "i", "j", "v"),
        G.full(t.spark, size, 5, 7.0).select(F.lit("full").alias("kind"), "i", "j", "v"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("random_values", "S23", f"""
SELECT c_custkey, -1 + {uniform_sql(1, "c_custkey")} * 2 AS uniform, round(sqrt(-2 * ln(1 - {uniform_sql(2, "c_custkey")})) * cos(2 * pi() * {uniform_sql(3, "c_custkey")}), 6) + 0.0 AS normal,
floor({uniform_sql(3, "c_custkey")} * 6)::BIGINT AS integer FROM customer""")
def random_values(t):
    return t.customer.select(
        "c_custkey", G.random_uniform(1, "c_custkey", low=-1.0).alias("uniform"), r6(G.random_normal(2, "c_custkey")).alias("normal"),
        G.random_integer(3, "c_custkey", high=6).alias("integer"),
    )


@query("truncated_values", "S23")
def truncated_values(t):
    return G.truncated_normal(t.customer.select("c_custkey"), "c_custkey", 4, target="truncated")


@query("multinomial_draws", "S23", f"""
WITH u AS (SELECT {uniform_sql(6, "o_orderkey")} AS u FROM orders), o AS (SELECT CASE WHEN u < 0.2 THEN 0 WHEN u < 0.5 THEN 1 ELSE 2 END AS outcome FROM u)
SELECT k::INT AS outcome, (SELECT count(*) FROM o WHERE outcome = k) AS n FROM (SELECT unnest(range(3)) AS k)""")
def multinomial_draws(t):
    return G.multinomial(t.orders.select("o_orderkey"), "o_orderkey", [0.2, 0.3, 0.5], 6)


@query("usage_partitions", "S24", f"""
SELECT c_custkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS usage FROM (SELECT c_custkey, {uniform_sql(0, "c_custkey")} AS u FROM customer)""")
def usage_partitions(t):
    """Rows written by usage; each usage is read from its own folder."""
    path = scratch_path(t.spark, "usage")
    TB.write_with_usage(t.customer.select("c_custkey"), path, G.usage(F.col("c_custkey")))
    parts = [TB.read_usage(t.spark, path, u).withColumn("usage", F.lit(u)) for u in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("schedules", "T11 X08", """
WITH s AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS step FROM orders)
SELECT o_orderkey, step, 0.1::DOUBLE AS fixed, round(pow(0.99, least(step, 300)), 6) AS factor, round(pow(0.5, (step > 100)::INT + (step > 250)::INT + (step > 500)::INT), 6) AS multi_factor,
round(1 + least(step, 200) * -0.004::DOUBLE, 6) AS linear, round(CASE WHEN step > 200 THEN 0.01 ELSE 0.01 + 0.245 * (1 + cos(pi() * step / 200)) END, 6) AS cosine,
round(0.4 * pow(1 - least(step, 150) / 150.0::DOUBLE, 2) + 0.1, 6) AS polynomial,
round(CASE WHEN step < 20 THEN 0.01 + (1 - 0.01) * step / 20 ELSE pow(0.99, step - 20) END, 6) AS warm_up FROM s""")
def schedules(t):
    s = O.batches(t.orders.select("o_orderkey"), 32, "o_orderkey").select("o_orderkey", F.col("batch_id").alias("step"))
    step = F.col("step")
    return s.select(
        "o_orderkey", "step", L.fixed(step, 0.1).alias("fixed"), r6(L.factor(step, 1.0, 0.99, 300)).alias("factor"),
        r6(L.multi_factor(step, 1.0, 0.5, [100, 250, 500])).alias("multi_factor"), r6(L.linear(step, 1.0, -0.004, 200)).alias("linear"),
        r6(L.cosine(step, 0.5, 200)).alias("cosine"), r6(L.polynomial(step, 0.5, 0.1, 150, 2.0)).alias("polynomial"),
        r6(L.warm_up(step, 20, 0.01, lambda x: L.factor(x, 1.0, 0.99))).alias("warm_up"),
    )


@query("label_distribution", "A19", """
SELECT quality, toxic, count(*) AS n, (SELECT count(*) FROM labels) AS size FROM labels GROUP BY 1, 2""")
def label_distribution(t):
    counts = t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return counts.withColumn("size", F.lit(t.labels.count()).cast("long"))


@query("transform_steps", "D20 X03 X10", """
SELECT c_custkey, length(lower(c_name)) AS name, round(ln(1 + abs(c_acctbal)) * 2, 6) AS balance, upper(substr(c_mktsegment, 1, 3)) AS segment FROM customer""")
def transform_steps(t):
    """Steps on data columns by name and position and on the target column."""
    data = ST.Steps().add(lambda c: F.length(c), "c_name").add(lambda c: F.abs(c), 1).add(lambda c: F.log1p(c) * 2, "c_acctbal")
    data.insert(0, F.lower, "c_name")
    target = ST.Steps().add(lambda c: F.substring(c, 1, 3)).add(F.upper)
    out = ST.prepare(t.customer, ["c_name", "c_acctbal"], ["c_mktsegment"], data, target)
    return out.select(
        "c_custkey", F.col("c_name").cast("long").alias("name"), r6("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
