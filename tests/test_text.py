import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as t
from tallyspark.plans.planner import fingerprint, plan_inline, plan_offline


def run(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in df.withColumn("x", build(F.col("s"))).orderBy("i").collect()]


def steps(spark, values, plan):
    return [r.text for r in run(spark, values, lambda s: t.run_steps(s, *plan))]


def test_yes_no_is_one_label(spark):
    for plan in (plan_inline, plan_offline):
        assert steps(spark, ["Yes, there is a bird vocalizing in this recording.", "no", ""], plan(["Yes", "No"], "classification")) == ["Yes", "No", "No"]


def test_multiple_choice(spark):
    values = ["A: wind, B: rain. Final answer: B", "The correct description is:\n\n**D**", "A short guess: description in option C.", "a", " c ", "**d**", "(b)", "It is a B, I mean C", "the answer is a cat"]
    assert run(spark, values, lambda s: t.extract_choice(s, ["A", "B", "C", "D"])) == ["B", "D", "C", "A", "C", "D", "B", "C", "A"]


def test_buckets(spark):
    wide = ["3650 Hz", "4000 Hz", "4010 Hz", "4030 Hz"]
    assert run(spark, ["#0.00s - 10.00s#: 1,654.75"], lambda s: t.extract_bucket(s, wide)) == ["3650 Hz"]
    low = ["210 Hz", "300 Hz", "340 Hz", "440 Hz"]
    assert run(spark, ["2131-4440 Hz", "320", "none at all: 440 hz label", "zero"], lambda s: t.extract_bucket(s, low)) == ["340 Hz", "300 Hz", "440 Hz", "210 Hz"]


def test_scientific_names(spark):
    names = ["Jynx torquilla", "Turdus merula"]
    got = run(spark, ["#0.00s - 10.00s#: The focal species is *Jynx torquilla* here", " I think it's a Common Cuckoo (Cuculus canorus). "], lambda s: t.extract_scientific_name(s, names))
    assert got == ["Jynx torquilla", "I think it's a Common Cuckoo (Cuculus canorus)."]


def test_labels(spark):
    vocab = ["Dog", "dog barking", "Cat", "A", "the"]
    assert run(spark, [" DOG ", "some dog barking there", "caat", "plan A.", "banana"], lambda s: t.extract_label(s, vocab)) == ["Dog", "dog barking", "Cat", "A", "A"]
    assert run(spark, ["it sounds like a dog!", "the the", "catt", "elephant", "  "], lambda s: t.conservative_match(s, ["Dog", "Cat", "the"])) == ["Dog", "the", "Cat", None, None]
    assert run(spark, ["elephant"], lambda s: t.conservative_match(s, ["Dog"], drop_unmatched=False)) == ["elephant"]
    assert run(spark, ["Dg", "zzzzzzzzz", ""], lambda s: t.fuzzy_match(s, ["Dog", "Cat", "Do"], 5)) == ["Do", "None", "Do"]
    with pytest.raises(ValueError):
        t.fuzzy_match(F.lit("x"), [])


def test_commas_between_digits_do_not_part(spark):
    assert run(spark, ["a,1,654.75,b", " , ,", "x ,y"], t.parse_labels) == [["a", "1,654.75", "b"], [], ["x", "y"]]
    assert run(spark, ["a|b"], lambda s: t.parse_labels(s, "|")) == [["a", "b"]]


def test_white_space_and_end_marker(spark):
    assert run(spark, [" a  b\n", None], t.normalize_whitespace) == ["a b", None]
    assert run(spark, ["dog <|end_of_text|> cat<|end_of_text|>"], t.strip_eos) == ["dog "]


def test_detection_plans_differ_inline_and_offline(spark):
    vocab = ["dog", "cat", "bird"]
    assert steps(spark, ["Dog, elephant, catt"], plan_inline(vocab, "detection")) == ["dog, cat"]
    assert steps(spark, ["dog, catt"], plan_offline(vocab, "detection")) == ["dog, cat"]
    assert steps(spark, ["Free, text stays"], plan_inline(vocab, "captioning")) == ["Free, text stays"]
    assert [n for n, _ in plan_inline([], "open_ended", ["Turdus merula"])[1]][-1] == "extract_label_from_text"
    assert fingerprint(*plan_offline(["é"], "classification")).startswith('{"cleaners":[["normalize_whitespace",{}]')
    with pytest.raises(ValueError, match="unknown step"):
        t.run_steps(F.lit("x"), [("nope", {})])


def test_small_helpers(spark):
    assert run(spark, [" yes.", "Nope", "maybe"], t.parse_yes_no) == [1.0, 0.0, None]
    assert run(spark, ["Turdus merula", "Turdus", "a b1"], t.looks_scientific) == [True, False, False]
    assert run(spark, ["a b/c:d"], t.safe_name) == ["a_b_c_d"]
