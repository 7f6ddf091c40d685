import json

import pytest
from pyspark.sql import functions as F

from trajecta.functions import answers as N
from trajecta.functions.text import last_boxed, parse_number
from trajecta.hooks import load_function, row_reward
from trajecta.operators import codefeatures as K
from trajecta.operators import container as C
from trajecta.operators import datasets as D
from trajecta.operators import retrieval as R
from trajecta.operators import rewards as W
from trajecta.operators import segments as G
from trajecta.sources import io as S


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).collect()[0]["y"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("so \\boxed{1} and \\boxed{\\frac{1}{2}} end", "\\boxed{\\frac{1}{2}}"),
        ("\\boxed{a{b}c}", "\\boxed{a{b}c}"),
        ("\\boxed{open", None),
        ("none", None),
    ],
)
def test_last_boxed(spark, text, want):
    assert one(spark, text, last_boxed("x")) == want


@pytest.mark.parametrize(
    "text, want", [("\\frac{1}{2}", 0.5), ("3 / 4 left", 0.75), ("-12.5 kg", -12.5), ("1/0", None), ("none", None)]
)
def test_parse_number(spark, text, want):
    assert one(spark, text, parse_number("x")) == want


@pytest.mark.parametrize(
    "text, want",
    [("x = 5", "5"), ("1,000 dollars", "1000"), ("$\\frac12$", "frac{1}{2}".replace("frac", "\\frac")), ("\\text{yes}", "yes"), ("sqrt2", "sqrt{2}")],
)
def test_competition_normal_form(spark, text, want):
    assert one(spark, text, N.normalize_final(F.col("x"))) == want


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("\\dfrac{1}{2}", "1/2", True),
        ("0.5", "\\frac12", True),
        ("\\sqrt3", "\\sqrt{3}", True),
        ("k = 7", "7", True),
        ("10 \\text{ cm}", "10", True),
        ("\\frac", "\\frac", True),
        ("2", "3", False),
    ],
)
def test_equivalence(spark, a, b, same):
    assert one(spark, a, N.equivalent(F.col("x"), F.lit(b))) is same


@pytest.mark.parametrize(
    "a, b, same",
    [("1,234", "1234", True), ("( 1 , 2 )", "(1,2)", True), ("[1,2)", "(1,2)", False), ("3 meters", "3", True), ("5.0", "5", True), ("1/2", "2/4", False),
        ("(( 1 cm , 2 ), 3)", "((1,2),3)", True), ("((1,2),3)", "((1,3),3)", False), ("[(1 cm,2),3]", "((1,2),3)", False),
        ("([0, 1 cm), (2,3])", "([0,1),(2,3])", True), ("((1 cm,2),3)", "((1,2),3,4)", False), ("(1 cm)(2)", "(1 cm)(2)", True),
        ("((𝑥 cm, 2), 3)", "((𝑥,2),3)", True), ("((1,2)", "((1,2)", True), ("((1 cm),)", "((1),2)", False)],
)
def test_rule_grade(spark, a, b, same):
    assert one(spark, a, N.rule_grade(F.col("x"), F.lit(b))) is same


@pytest.mark.parametrize(
    "text, gold, want",
    [
        ("<think>a</think>Final answer: 3", "3", 2.2),
        ("The answer is 3", "3", -0.5 - 15 * 0.05),
        ("Final answer: <think></think>Final answer: 1/2", "1/2", 2.3),
        ("<think>a</think>nothing", "3", 0.2),
        ("<think>a</think>Final answer: 3.0", "3", 0.2 + 1.5 - 0.1),
    ],
)
def test_final_answer_reward(spark, text, gold, want):
    assert abs(one(spark, text, W.final_answer_reward(F.col("x"), F.lit(gold))) - want) < 1e-9


def test_dispatch_rejects_unknown_source(spark):
    with pytest.raises(Exception, match="no reward"):
        one(spark, "a", W.dispatch(F.lit("unknown"), F.col("x"), F.lit("1")))


def test_code_features_by_hand():
    ins, outs = ["1"], ["2"]
    ok = "def solve(lines):\n    return 2\nassert str(solve(['1'])).strip() == '2'"
    assert K.describe(ok, ins, outs, None)["asserts"] == "unaltered"
    assert K.describe(ok.replace("'2'", "'3'"), ins, outs, K._reference(ok))["asserts"] == "changed"
    assert K.describe("def solve(:", ins, outs, None)["validity"] == "neither"
    assert K.describe("return 1", ins, outs, None)["validity"] == "ast"
    pure = "def solve(lines):\n    if lines[0] == '1': return 'a'\n    elif lines[0] == '2': return 'b'\n    elif lines == ['3']: return 'c'"
    assert K.describe(pure, ins, outs, None)["lookup"] == "pure"
    derived = "def solve(lines):\n    s = lines[0]\n    t = s.strip()\n" + "".join(f"    if t == '{i}': return {i}\n" for i in range(3))
    assert (K.describe(derived, ins, outs, None)["lookup"], K.describe(derived, ins, outs, None)["num_lookup_cases"]) == ("hybrid", 3)
    two = "\n".join(pure.split("\n")[:3])
    assert K.describe(two, ins, outs, None)["lookup"] == "none"
    assert K.describe("import sys\nsys.exit()\nassert 1", ins, outs, None)["has_early_exit"]
    assert K.describe("x = 1", None, None, K._reference("y = 2"))["asserts"] == "unaltered"
    assert K.describe("assert 1", None, None, K._reference("y = 2"))["asserts"] == "changed"
    assert K.describe("x = 1", None, None, K._reference("assert 1"))["asserts"] == "omitted"
    assert K.describe("x = (", None, None, K._reference("assert 1"))["asserts"] is None
    assert not K.describe("assert 1\nexit()", ins, outs, None)["has_early_exit"]


@pytest.mark.parametrize("x, want", [("yes", "No"), ("0", "-999"), ("7", "-7"), ("-3", "3"), ("0.0", "-999.0"), ("2.50", "-2.5"), ("abc", "INTERVENTION")])
def test_alternative_output(spark, x, want):
    assert one(spark, x, G.alternative_output(F.col("x"))) == want


def test_code_split_sizes(spark):
    rows = [("p", n, "def solve(lines): pass", [f"{i}\n2" for i in range(n)], [str(i) for i in range(n)], None) for n in (1, 2, 23, 24, 40)]
    df = spark.createDataFrame(
        rows, "name string, solution_index int, transformed_solution string, test_inputs array<string>, test_outputs array<string>, buggy_outputs array<string>"
    )
    got = {}
    for r in D.code_assertions(df).collect():
        gt = json.loads(r["reward_model"]["ground_truth"])
        got[r["extra_info"]["total_tests"]] = (len(gt["visible_inputs"]), len(gt["hidden_inputs"]))
        assert "assert str(solve(['0', '2'])).strip() == '0'" in r["messages"][0]["content"]
    assert got == {1: (1, 0), 2: (1, 1), 23: (11, 12), 24: (8, 16), 40: (8, 16)}


def test_unknown_role_and_placeholder_mismatch(spark):
    df = spark.createDataFrame([([("bot", "x")],)], "c array<struct<`from`:string,value:string>>")
    with pytest.raises(Exception, match="unknown role"):
        df.select(D.remap_roles("c")).collect()
    with pytest.raises(Exception, match="differ in number"):
        one(spark, "a<image>b", D.typed_content(F.col("x"), F.lit(2), F.lit(0)))


def test_dump_skips_short_extras(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 2, "c")], "step long, sample_id long, input string")
    extra = spark.createDataFrame([(1, 0, 0.5), (2, 2, 0.25)], "step long, sample_id long, value double")
    S.dump_rollouts(rows, str(tmp_path / "r"), {"acc": extra})
    back = spark.read.schema("step long, sample_id long, input string, acc double").json(str(tmp_path / "r"))
    assert {r["sample_id"]: r["acc"] for r in back.collect()} == {0: None, 1: None, 2: 0.25}


def test_eval_collector_reads_checkpoint_folders(spark, tmp_path):
    for model, step, acc in (("m1", 10, 0.5), ("m1", 200, 0.7), ("m2", 10, 0.1)):
        folder = tmp_path / model / f"checkpoint{step}"
        folder.mkdir(parents=True)
        (folder / "analysis.json").write_text(json.dumps({"statistics": {"acc": acc}, "per_sample_analyses": []}, indent=1))
    out = S.load_eval_statistics(spark, str(tmp_path), ["acc"], max_checkpoint=100).collect()
    assert [(r["model"], r["step"], r["acc"]) for r in out] == [("m1", 10, 0.5), ("m2", 10, 0.1)]


def test_unsupported_extension(spark):
    with pytest.raises(ValueError):
        S.read_datasets(spark, ["x.csv"])


def test_union_conflict_and_chunk_mismatch(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "row_idx long, v long")
    b = spark.createDataFrame([(0, 1), (1, 9)], "row_idx long, v long")
    with pytest.raises(Exception, match="conflicting"):
        C.union_columns(a, b, ["row_idx"]).collect()
    with pytest.raises(Exception, match="does not divide"):
        C.chunk(a, 3).collect()
    with pytest.raises(ValueError):
        C.pop(a, ["missing"])
    assert C.pad_to_divisor(a, 7).count() == 7 and C.unpad(C.pad_to_divisor(a, 7)).count() == 2


def test_retrieval_with_more_than_corpus_and_blocks(spark):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 3)}w{i}") for i in range(9)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "beta"), (1, "missing"), (2, "alpha w4")], "query_id long, text string")
    one_block = R.lexical_top_k(docs, queries, 20)
    many = R.lexical_top_k(docs.repartition(5), queries.repartition(3), 20)
    assert {r["query_id"] for r in one_block.collect()} == {0, 2}
    rounded = [x.select("query_id", "rank", "doc_id", F.round("score", 9).alias("s")) for x in (one_block, many)]
    assert rounded[0].exceptAll(rounded[1]).count() == 0 and one_block.count() == many.count() == 6 + 9
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "doc_id long, embedding array<double>")
    ask = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r["doc_id"] for r in R.dense_top_k(vec, ask, 9, query_bytes=8).orderBy("rank").collect()] == [4, 3, 2, 1, 0]


def test_user_reward_by_path(spark, tmp_path):
    path = tmp_path / "my_reward.py"
    path.write_text("def score(source, solution, truth, info, scale=1.0):\n    return (len(solution) * scale, 'x')\n")
    fn = load_function(str(path), "score")
    with pytest.raises(AttributeError):
        load_function(str(path), "nothing")
    column = row_reward(lambda *a, **k: len(a[1]) * 2.0)
    out = spark.createDataFrame([("abc",)], "x string").select(column(F.lit("s"), F.col("x"), F.lit("g"))["score"].alias("y"))
    assert out.collect()[0]["y"] == 6.0 and fn("s", "ab", "g", None, scale=2.0) == (4.0, "x")
