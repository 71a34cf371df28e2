"""Published reference values and textbook cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.functions import losses as LO
from gridloom.functions import numeric as N
from gridloom.functions import schedules as SC
from gridloom.functions import text as X
from gridloom.operators import evaluation as E
from gridloom.operators import features as FE
from gridloom.operators import optimizers as OP
from gridloom.operators import sentence_pairs as S
from gridloom.operators import training as TR
from gridloom.operators import vocabulary as V


def value(spark, column, **inputs):
    df = spark.range(1).select(*[v.alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def array(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_regression_losses(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "p double")
    p, one = F.col("p"), F.lit(1.0)
    row = df.agg(
        F.avg(LO.l1(p, one)), F.avg(LO.l2(p, one)), F.avg(LO.hinge(p, F.lit(-1.0))), F.avg(LO.sigmoid_cross_entropy(p, one)),
        F.avg(LO.l1(p, one, 0.5)),
    ).first()
    assert np.allclose(list(row), [2.0, 3.0, 4.0, 0.10272846, 1.0], rtol=1e-5)


def test_softmax_losses(spark):
    assert math.isclose(value(spark, LO.softmax_cross_entropy(array(1, 2, 3, 4, 5), F.lit(1))), 3.45191431, rel_tol=1e-6)
    two = spark.createDataFrame([([4.0, 2.0, 1.0], 0), ([0.0, 5.0, 1.0], 1)], "s array<double>, y int")
    assert math.isclose(two.agg(F.avg(LO.softmax_cross_entropy(F.col("s"), F.col("y")))).first()[0], 0.09729549, rel_tol=1e-5)


def test_masked_softmax_loss(spark):
    steps = [[1.0] * 10] * 4
    df = spark.createDataFrame([(i, steps, [0] * 4, n) for i, n in enumerate([4, 2, 0])], "i int, s array<array<double>>, y array<int>, n int")
    got = [r[0] for r in df.orderBy("i").select(LO.masked_softmax_cross_entropy(F.col("s"), F.col("y"), F.col("n"))).collect()]
    assert np.allclose(got, [2.3025851, 1.1512926, 0.0])


def test_accuracies(spark):
    df = spark.createDataFrame([([0.3, 0.7], 0), ([0.0, 1.0], 1), ([0.4, 0.6], 1)], "s array<double>, y int")
    assert math.isclose(df.agg(F.avg(LO.is_right(F.col("s"), F.col("y")))).first()[0], 2 / 3)
    top = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4], 0), ([0.3, 0.1, 0.5, 0.1], 1), ([0.2, 0.4, 0.3, 0.1], 2)], "s array<double>, y int")
    assert math.isclose(top.agg(F.avg(LO.in_top_k(F.col("s"), F.col("y"), 2))).first()[0], 1 / 3)
    assert top.agg(F.avg(LO.in_top_k(F.col("s"), F.col("y"), 9))).first()[0] == 1.0
    assert value(spark, LO.is_right_binary(F.lit(0.0), F.lit(1))) == 1


def test_min_max_scaling(spark):
    df = spark.createDataFrame([(-1.0, 2.0), (-0.5, 6.0), (0.0, 10.0), (1.0, 18.0)], "a double, b double")
    fitted = FE.fit_min_max(df, ["a", "b"])
    rows = FE.min_max_scale(df, fitted).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (0.25, 0.25), (0.5, 0.5), (1, 1)]
    other = spark.createDataFrame([(2.0, 2.0)], "a double, b double")
    scaled = FE.min_max_scale(other, fitted)
    assert tuple(scaled.first()) == (1.5, 0.0)
    assert tuple(FE.min_max_restore(scaled, fitted).first()) == (2.0, 2.0)
    flat = FE.fit_min_max(other, ["a"])
    assert FE.min_max_scale(other, flat).first()["a"] is None


def test_metric_log(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("a", 2.0, 3), ("b", 2.4, 4), ("b", 3.4, 5), ("b", -1.3, 6)], "name string, value double, id long")
    out = E.floor_rank_percentiles(df, "name", "value", "id", [50, 100]).toPandas().set_index("name")
    assert out.loc["a"].tolist() == [2.0, 3.0]
    means = df.groupBy("name").agg(F.avg("value").alias("m")).toPandas().set_index("name")["m"]
    assert math.isclose(means["b"], 1.5)
    assert E.latest(df, "name", "value", "id", "id").toPandas().set_index("name")["latest"].to_dict() == {"a": 2.0, "b": -1.3}


def test_schedules(spark):
    at = lambda build, *steps: [value(spark, build(F.lit(s))) for s in steps]
    assert at(lambda s: SC.factor(s, 1.0, 0.5), 0, 1, 3) == [1.0, 0.5, 0.125]
    assert at(lambda s: SC.multi_factor(s, 1.0, 0.5, [100, 250, 500]), 1, 100, 101, 250, 251, 500, 501) == [1, 1, 0.5, 0.5, 0.25, 0.25, 0.125]
    assert np.allclose(at(lambda s: SC.cosine(s, 0.5, 200), 0, 20, 50, 100, 150, 180, 200, 300), [0.5, 0.488, 0.428, 0.255, 0.082, 0.022, 0.01, 0.01], atol=1e-3)
    assert np.allclose(at(lambda s: SC.linear(s, 1.0, -0.1, bound=0.5), 0, 3, 9), [1.0, 0.7, 0.5])
    assert np.allclose(at(lambda s: SC.polynomial(s, 1.0, 0.2, 10, 2.0), 0, 5, 20), [1.0, 0.4, 0.2])
    assert np.allclose(at(lambda s: SC.warm_up(s, 4, 0.0, lambda x: SC.factor(x, 1.0, 0.5)), 0, 2, 4, 5), [0.0, 0.5, 1.0, 0.5])
    assert at(lambda s: SC.warm_up(s, 4, 0.3, lambda x: SC.factor(x, 1.0, 0.5), mode="constant"), 2) == [0.3]


# Mean weight after the steps given, learning rate 0.1, decay rates 0.9.
OPTIMIZERS = [
    (lambda: OP.Sgd(0.1), {1: 0.68, 2: 0.4912}),
    (lambda: OP.Sgd(0.1, momentum=0.9), {1: 0.68, 2: 0.2032, 12: 0.0463758}),
    (lambda: OP.Nag(0.1, momentum=0.9), {1: 0.392, 2: -0.001568}),
    (lambda: OP.Adam(0.1, 0.9, 0.999, 1e-8), {1: 0.9, 2: 0.800611}),
    (lambda: OP.Adagrad(0.1), {1: 0.9, 2: 0.8344}),
    (lambda: OP.RmsProp(0.1), {1: 0.68377, 2: 0.51780}),
    (lambda: OP.RmsProp(0.1, centred=True), {1: 0.66667, 2: 0.18901}),
    (lambda: OP.Adadelta(), {1: 0.999, 2: 0.999}),
]


@pytest.mark.parametrize("number", range(len(OPTIMIZERS)))
def test_optimizers(number):
    """A linear layer of ten ones, input 2, target 4; the squared error is averaged over all cells."""
    build, expected = OPTIMIZERS[number]
    optimizer = build()
    x, y = np.full((10, 10), 2.0), np.full((10, 10), 4.0)
    p = {"weight": np.ones((10, 10)), "bias": np.zeros(10)}
    for step in range(1, max(expected) + 1):
        # One output's gradient: every output cell is the same, so the layer behaves like a single unit.
        delta = (x @ p["weight"].T + p["bias"] - y) / 100
        gradients = {"weight": delta.T @ x, "bias": delta.sum(axis=0)}
        for name in p:
            p[name] = optimizer.step(name, p[name], gradients[name])
        if step in expected:
            assert np.isclose(p["weight"].mean(), expected[step], rtol=1e-5, atol=1e-3)


def test_optimizer_options():
    w = np.array([2.0])
    assert OP.Sgd(1.0, clip=0.5).step("w", w, np.array([3.0]))[0] == 1.5
    assert OP.Sgd(1.0, rescale=0.5, decay=0.25).step("w", w, np.array([1.0]))[0] == 1.0
    falling = OP.Sgd(lambda step: 1.0 / step)
    first = falling.step("w", w, np.array([1.0]))
    assert falling.step("w", first, np.array([1.0]))[0] == 0.5 and falling.counts["w"] == 2


def test_initial_values():
    assert (OP.initial("constant", (2, 3), 1, 0.5) == 0.5).all()
    assert np.abs(OP.initial("truncated", (1000,), 1, sigma=2.0)).max() <= 4.0
    assert np.abs(OP.initial("uniform", (1000,), 1)).max() <= 0.07
    assert np.abs(OP.initial("xavier", (10, 20), 1)).max() <= math.sqrt(3 / 15)
    assert (OP.initial("normal", (5,), 1) == OP.initial("normal", (5,), 1)).all()


def test_erfinv_and_activations(spark):
    points = [-0.99, -0.5, 0.0, 0.3, 0.9, 0.999]
    df = spark.createDataFrame([(p,) for p in points], "x double")
    got = [r[0] for r in df.select(N.erfinv(F.col("x"))).collect()]
    assert np.allclose([math.erf(g) for g in got], points, atol=1e-6)
    edge = spark.createDataFrame([(1.0,), (-1.0,), (2.0,)], "x double").select(N.erfinv(F.col("x")).alias("x")).toPandas()["x"]
    assert edge[0] == math.inf and edge[1] == -math.inf and math.isnan(edge[2])
    gelu = [r[0] for r in df.select(N.activations(F.col("x") * 4)["gelu"]).collect()]
    assert np.allclose(gelu, [4 * p * 0.5 * (1 + math.erf(4 * p / math.sqrt(2))) for p in points], atol=1e-6)


def test_division_and_logarithm(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(N.divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 2.0
    logs = [r[0] for r in df.select(N.logarithm(F.col("a"))).collect()]
    assert logs[0] == 0.0 and math.isnan(logs[1]) and logs[2] == -math.inf
    trunc = spark.createDataFrame([(1.5,), (-1.5,), (2.5,)], "a double").select(N.truncate(F.col("a")), F.rint("a")).collect()
    assert [tuple(r) for r in trunc] == [(1, 2), (-1, -2), (2, 2)]


def test_punctuation(spark):
    text = F.lit("Hello.. How are you?!  @my_alias")
    expected = ["Hello", ".", ".", "How", "are", "you", "?", "!", "@", "my", "_", "alias"]
    assert value(spark, X.separate_punctuation(F.array(text))) == expected
    assert value(spark, X.default_tokens(text)) == [t.lower() for t in expected]


def test_truncate_and_terminate(spark):
    tokens = X.split_spaces(F.lit("This is a great library!"))
    assert value(spark, X.truncate_tokens(tokens, 2)) == ["This", "is"]
    assert value(spark, X.terminate_tokens(X.truncate_tokens(tokens, 1))) == ["<bos>", "This", "<eos>"]


@pytest.mark.parametrize("text,tokens", [("", [""]), (" ", []), ("a  b ", ["a", "", "b"]), (" a", ["", "a"])])
def test_split_spaces(spark, text, tokens):
    assert value(spark, X.split_spaces(F.lit(text))) == tokens


def test_unicode_and_hyphens(spark):
    source = "Unicode ÄAＡ\U0001d400 1²₃ﬁ"
    assert value(spark, X.unicode_normal(F.lit(source))) == "Unicode ÄAAA 123fi"
    assert value(spark, X.normalize_hyphens(F.lit("a—b­c~d－e"))) == "a-bc-d-e"


def test_bert_tokens(spark):
    assert value(spark, X.simple_bert_tokens(F.lit("Hi there. Wait... what ? ok"))) == ["Hi", "there", ".", "Wait..", ".", "what", "?", "ok"]
    assert value(spark, X.bert_basic_tokens(F.lit("Café\u0000 déjà\tvu, OK!"))) == ["cafe", "deja", "vu", ",", "ok", "!"]
    pair = X.encode_pair(array_of("a", "b"), array_of("c"), 8)
    row = spark.range(1).select(*[c.alias(n) for n, c in pair.items()]).first()
    assert row["tokens"] == ["[CLS]", "a", "b", "[SEP]", "c", "[SEP]", "[PAD]", "[PAD]"]
    assert row["types"] == [0, 0, 0, 0, 1, 1, 0, 0] and row["mask"] == [1] * 6 + [0, 0] and row["valid_length"] == 3


def array_of(*words):
    return F.array(*[F.lit(w) for w in words])


def test_camel_case(spark):
    assert value(spark, X.camel_case_tokens(F.lit("  myVar = XMLReader(1);"))) == [
        " ", " ", "my", "var", " ", "=", " ", "x", "m", "l", "reader", "(", "1", ")", ";",
    ]
    assert value(spark, X.camel_case_tokens(F.lit("A"))) == ["A"]
    assert value(spark, X.code_lines(F.lit("a \n\n  b\t\r\n   \nc"))) == ["a", "  b", "c"]


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_word_pieces(spark, max_rows):
    vocab = spark.createDataFrame([(w,) for w in ["un", "##aff", "##able", "want", "##ed", "##e", "[UNK]"]], "token string")
    df = spark.createDataFrame([(1, ["unaffable", "wanted", "xyz", "wantx", "a" * 201]), (2, []), (3, ["un"])], "k int, t array<string>")
    got = {r["k"]: r["pieces"] for r in V.word_pieces(df, "t", vocab, "k", max_rows=max_rows).collect()}
    assert got == {1: ["un", "##aff", "##able", "want", "##ed", "[UNK]", "[UNK]", "[UNK]"], 2: [], 3: ["un"]}


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_encode_and_decode(spark, max_rows):
    df = spark.createDataFrame([(1, ["b", "a", "zz", "b"]), (2, []), (3, ["a", "<eos>", "b"])], "k int, t array<string>")
    vocab = V.build_vocabulary(df, "t", 1, ["<bos>", "<eos>"]).filter("token <> 'zz'").cache()
    assert [r["token"] for r in vocab.orderBy("id").collect()] == ["<bos>", "<eos>", "<unk>", "b", "a"]
    ids = V.encode(df, "t", vocab, "k", max_rows=max_rows)
    got = {r["k"]: r["ids"] for r in ids.collect()}
    assert got == {1: [3, 4, 2, 3], 2: [], 3: [4, 1, 3]}
    words = {r["k"]: r["tokens"] for r in V.decode(ids.select("k", "ids"), "ids", vocab, "k", stop="<eos>", max_rows=max_rows).collect()}
    assert words == {1: ["b", "a", "<unk>", "b"], 2: [], 3: ["a"]}


@pytest.mark.parametrize("a,b,limit", [(a, b, n) for a in (0, 1, 5, 9) for b in (0, 2, 7) for n in (0, 3, 8)])
def test_pair_truncation(spark, a, b, limit):
    left, right = list(range(a)), list(range(b))
    turn = 0
    while len(left) + len(right) > limit:
        if turn % 2 == 0 and left:
            left.pop()
        elif right:
            right.pop()
        turn += 1
    cut = S.truncate_pair(F.array(*[F.lit(i) for i in range(a)]), F.array(*[F.lit(i) for i in range(b)]), limit)
    got = spark.range(1).select(F.size(cut[0]), F.size(cut[1])).first()
    assert tuple(got) == (len(left), len(right))


def test_masking_shares(spark):
    df = spark.createDataFrame([(f"k{i}", list(range(10, 60)), list(range(60, 130))) for i in range(300)], "k string, a array<long>, b array<long>")
    rows = S.masked_instances(df, "a", "b", "k", 5, 1, 2, 3, 1000).toPandas()
    assert (rows["length"] == 123).all()
    changed = same = masked = 0
    for r in rows.itertuples():
        label = [1, *range(10, 60), 2, *range(60, 130), 2]
        assert sum(r.label_mask) == 20 and sorted(r.masked_positions) == list(r.masked_positions)
        assert [label[p] for p in r.masked_positions] == list(r.masked_ids)
        for p in r.masked_positions:
            masked += r.token_ids[p] == 3
            same += r.token_ids[p] == label[p]
            changed += r.token_ids[p] not in (3, label[p])
        assert [x for p, x in enumerate(r.token_ids[:123]) if p not in r.masked_positions] == [x for p, x in enumerate(label) if p not in r.masked_positions]
    assert abs(masked / 6000 - 0.8) < 0.03 and abs(same / 6000 - 0.1) < 0.02 and abs(changed / 6000 - 0.1) < 0.02
    kept = S.masked_instances(df, "a", "b", "k", 5, 1, 2, 3, 1000, protect_special=True).toPandas()
    assert all(not {0, 51, 122} & set(p) for p in kept["masked_positions"])


def test_sentence_swap(spark):
    df = spark.createDataFrame([(i, f"a{i}", f"b{i}") for i in range(401)], "k long, a string, b string")
    out = S.swap_half(df, "k", 3).toPandas()
    moved = out["a"].str[1:] != out["b"].str[1:]
    assert sorted(out["a"]) == sorted(f"a{i}" for i in range(401))
    assert (moved == (out["consecutive"] == 0)).all()
    assert 120 < moved.sum() < 280
    partner = dict(zip(out["b"].str[1:], out["a"].str[1:], strict=True))
    assert all(partner[partner[k]] == k for k in partner)
    again = S.swap_half(df.repartition(7), "k", 3).toPandas()
    assert (out.sort_values("k")["a"].tolist()) == again.sort_values("k")["a"].tolist()


def test_sequence_mask_and_index(spark):
    assert value(spark, A.sequence_mask(array(1, 2, 3), F.lit(1), -1.0)) == [1.0, -1.0, -1.0]
    assert value(spark, A.stepped(array(0, 1, 2, 3, 4, 5, 6), -5, -1, 2)) == [2.0, 4.0]
    assert value(spark, A.pick(array(1, 2, 3), F.lit(-1))) == 3.0
    assert value(spark, A.all_close(array(1, float("nan")), array(1, float("nan")))) is False
    assert value(spark, A.all_close(array(1, float("nan")), array(1, float("nan")), equal_nan=True)) is True
    assert value(spark, A.repeat_each(array(1, 2), 2)) == [1, 1, 2, 2] and value(spark, A.tile(array(1, 2), 2)) == [1, 2, 1, 2]


def test_weight_penalty(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,)], "w double")
    row = df.agg(LO.weight_penalty(F.col("w"), 1.0), LO.weight_penalty(F.col("w"), 0.0, 1.0), LO.weight_penalty(F.col("w"), 1.0, 1.0)).first()
    assert tuple(row) == (3.0, 5.0, 8.0)


def test_features_reject_bad_input(spark):
    df = spark.createDataFrame([(1, "x", "2"), (2, "q", "z")], "k long, c string, n string")
    strict = FE.featurize(df, [FE.Feature("c", "category", {"x": 0})], [FE.Feature("k")], "k")
    with pytest.raises(Exception, match="unmapped"):
        strict.collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        FE.featurize(df, [FE.Feature("n")], [FE.Feature("k")], "k").collect()
    with pytest.raises(ValueError):
        FE.featurize(df, [], [FE.Feature("k")], "k")


def test_linear_training_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3
    df = spark.createDataFrame(pd.DataFrame({"k": range(200), "x": list(x), "y": y})).repartition(5)
    trial = TR.fit(df, "x", "y", [TR.Trial(TR.Linear(3, 1, "squared", "constant"), OP.Sgd(0.5))], epochs=15)[0]
    w, b = np.zeros((1, 3)), np.zeros(1)
    for _ in range(15):
        delta = x @ w.T + b - y[:, None]
        w, b = w - 0.5 * delta.T @ x / 200, b - 0.5 * delta.mean(axis=0)
    assert np.allclose(trial.parameters["weight"], w) and np.allclose(trial.parameters["bias"], b)
    losses = [h["loss"] for h in trial.history]
    assert losses == sorted(losses, reverse=True)
    table = TR.parameter_table(spark, trial, 14)
    back = TR.load_parameters(table, 14, {"weight": (1, 3), "bias": (1,)})
    assert np.allclose(back["weight"], w)


def test_training_guards(spark):
    df = spark.createDataFrame([(1, [1.0], float("nan"))], "k long, x array<double>, y double")
    with pytest.raises(TR.Diverged):
        TR.fit(df, "x", "y", [TR.Trial(TR.Linear(1, 1), OP.Sgd(0.1))], 1)
    zero = spark.createDataFrame([(1, [0.0], 0.0)], "k long, x array<double>, y double")
    with pytest.raises(ValueError, match="zero"):
        TR.fit(zero, "x", "y", [TR.Trial(TR.Linear(1, 1), OP.Sgd(0.1))], 1)


def test_mlp_gradient_by_differences():
    rng = np.random.default_rng(2)
    model = TR.Mlp(4, 5, 3)
    p = model.parameters(1)
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 3, 7)
    _, _, gradients = model.gradients(p, x, y)
    for name, weight in p.items():
        place = tuple(0 for _ in weight.shape)
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][place] += 1e-6
        change = (model.gradients(moved, x, y)[0] - model.gradients(p, x, y)[0]) / 1e-6
        assert np.isclose(change, gradients[name][place], atol=1e-4)


def test_slices_cover_all_rows(spark):
    df = spark.createDataFrame([(i, [float(i)], float(i % 2)) for i in range(100)], "k long, x array<double>, y double")
    trial = TR.Trial(TR.Linear(1, 1, "sigmoid"), OP.Sgd(0.01), seed=4)
    TR.fit(df, "x", "y", [trial], 2, "k", slices=4)
    assert sum(h["rows"] for h in trial.history) == 200 and len(trial.history) == 8
