import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.conditions import compile_program, condition_column, read_condition, unknown_fields, ways, well_formed

ROW = ("JE-1", 2024, "alipay tip", "OL", 1500.0, "2024-01-15", None, None)


def holds(spark, condition, row=ROW):
    df = spark.createDataFrame(
        [row], "entry_id string, year int, description string, old_type string, amount double, date string, quarter int, notes string")
    return df.select(condition_column(condition)).first()[0]


@pytest.mark.parametrize("condition, expected", [
    ('old_type == "OL"', True), ('old_type == "ol"', False), ('old_type != "CR"', True), ("amount > 1000", True),
    ('old_type == "OL" and year == 2024', True), ('old_type == "CR" or amount >= 1500', True),
    ('(old_type == "OL" or old_type == "CR") and year == 2023', False), ('not (year == 2023 and old_type == "CR")', True),
    ('"alipay" in description', True), ("'bank' in description", False), ('date == "2024-01-15"', True),
    ('date != "2024-01-16"', True), ('description == "a and b == c"', False),
    # A missing value equals nothing, differs from everything ...
    ("not (quarter == 1)", True), ("quarter == 1", False), ('notes != "x"', True),
    # ... and cannot be ordered or searched: the rule does not match, not even negated.
    ("quarter > 1", False), ("not (quarter > 1)", False), ('not ("x" in notes)', False),
    ('year == "2024"', False), ('year != "2024"', True), ("amount > 'x'", False), ("foo == 1", False), ("not (foo == 1)", False),
    ("quarter == null", True), ("quarter != null", False), ("old_type != null and year >= 2023", True), ("null == null", True), ("year == null", False),
    ("year > null", False), ("true == true", True), ("true == false or year == 2024", True), ("old_type == 'OL' and year == 2024 and amount > 1000", True),
    # A call is readable, but cannot be evaluated.
    ("description.contains('tip') and year == 2024", False), ("year == 2024 or description.contains('tip')", False),
])
def test_condition(spark, condition, expected):
    assert holds(spark, condition) is expected


@pytest.mark.parametrize("condition", ['old_type = "OL"', "(year == 2024", "year ==", "year == 2024 and", "", "year == 2024 year == 2023", "#", "old_type"])
def test_unreadable(spark, condition):
    assert not read_condition(condition)["readable"]
    assert spark.range(1).select(well_formed(F.lit(condition))).first()[0] is False
    with pytest.raises(ValueError):
        condition_column(condition)


pieces = st.sampled_from(["and", "or", "not", "(", ")", 'old_type == "a b"', "amount > 1", '"k" in description', "x", "year == 2024", "quarter != 2"])


@given(st.lists(st.lists(pieces, min_size=1, max_size=9).map(" ".join), min_size=20, max_size=20))
@settings(max_examples=8, deadline=None)
def test_spark_and_python_read_alike(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "c string").select("c", well_formed(F.col("c")).alias("ok"))
    for row in df.collect():
        assert row["ok"] == read_condition(row["c"])["readable"], row["c"]


def test_unknown_fields(spark):
    df = spark.createDataFrame([("foo == 1 and bar.x > 2 and foo < 3 and year == 1",), ('old_type == "baz qux"',)], "c string")
    assert [r[0] for r in df.select(unknown_fields(F.col("c"))).collect()] == [["foo", "bar"], []]


def test_keys_are_taken_out_wherever_they_stand():
    known = read_condition("amount > 1 and 'tip' in description and old_type == 'OL' and 2024 == year and old_type == 'B'")
    assert (known["match_type"], known["match_year"], known["match_keyword"]) == ("OL", 2024, "tip")
    assert [s["op"] for s in known["program"]] == [">", "==", "and"]
    assert read_condition('old_type == "OL"')["program"] is None


def test_calls_are_readable(spark):
    texts = ["description.contains('test') and quarter == 1", "old_type.x.y(1, 'a') == 2", "x.contains('a')"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert [r[0] for r in df.select(well_formed(F.col("c"))).collect()] == [True, True, True]
    assert [r[0] for r in df.select(unknown_fields(F.col("c"))).collect()] == [[], [], ["x"]]


def test_ways_are_found_by_an_interval():
    found = ways(compile_program(read_condition("(amount > 5 or quarter == 2) and entry_id != 'x' and old_type == 'T'")["program"]))
    assert [(w["place"], w["tests"], w["other"][0]) for w in found] == [(1, None, "x"), (2, None, "x")]
    assert found[1]["highs"][1] == 5.0 and found[1]["low"] == found[1]["high"] == 2.0
    many = " and ".join(f"(amount == {i} or quarter == {i})" for i in range(9))
    assert [(w["place"], len(w["tests"])) for w in ways(compile_program(read_condition(many)["program"]))] == [(None, 18)]


def test_large_rule_sets_match_alike(spark, make):
    from ledgerloom.operators.matching import matches
    tails = [
        "amount > 5", "amount >= 5 or quarter == 1", "not (amount > 5)", "amount != 5 and (amount < 7 or quarter != 2)", "year == 2024 and amount <= 5",
        "not (quarter == 1 or amount < 5)", "description == 'tip' or entry_id != 'b'", "'ti' in description", "'ti' in description and amount > 4 or quarter == 2",
        "date >= '2024-03-01' or amount == 5", "notes == null and quarter == null", "notes != 'x' and quarter != 1", "quarter > 1 or amount > 5", "amount == quarter",
        "entry_id == 'a' and entry_id != 'b' and entry_id != 'c'", "amount > 4 and amount < 6 or quarter >= 1 and not (amount == 5)", "true == true", "foo == 1 or amount > 5"]
    rules = make.rules(*[(f"R-{i}", f"({tail}) and old_type == '{t}'", "A", 1, "CR") for i, (tail, t) in enumerate((x, t) for x in tails for t in ("T", "U"))])
    rows = make.journal(*[(e, t, a, d, text, q) for e, t in (("a", "T"), ("b", "T"), ("c", "U")) for a in (4, 5, 6, 8) for d in ("2024-02-01", "2023-04-01")
                          for text in ("tip", "other") for q in (1, 2, None)])
    small, large = ({tuple(r) for r in df.collect()} for df in (matches(rows, rules), matches(rows, rules, max_rules=0)))
    assert small == large and len(small) > 100 and matches(rows, rules, max_rules=0).count() == len(large)
    narrow = matches(rows, rules, max_rules=0, wanted=("rule_ord",))
    assert {tuple(r) for r in narrow.collect()} == {(r[0], r[1]) for r in small}


def test_ways_beside_rows_are_plain_comparisons_with_the_same_result(spark, make):
    from ledgerloom.operators.matching import matches
    conditions = [
        "old_type == 'A' and amount > 5 or old_type == 'B' and amount < 3", "old_type != 'A' and (old_type == 'B' or old_type == 'C')",
        "(old_type == 'A' or old_type == 'B') and entry_id != 'e1' and year == 2024", "old_type == 'A' and (quarter == 1 or amount <= 3) and notes != 'x'",
        '"Test" in description and old_type == \'B\' and quarter != 2', "old_type == 'C' and description != 'Test Entry'", "old_type == 'A' and not (amount > 2 and entry_id == 'e3')"]
    rules = make.rules(*[(f"R{i}", c, "4301", 1, "CR") for i, c in enumerate(conditions * 20)])
    rows = make.journal(*[(f"e{i % 5}", "ABCD"[i % 4], i % 9, f"202{3 + i % 2}-0{1 + i % 9}-05", "" if i % 7 == 0 else "Test Entry") for i in range(60)])
    small, large = (df for df in (matches(rows, rules), matches(rows, rules, max_rules=0)))
    found = sorted(tuple(r) for r in small.collect())
    assert found == sorted(tuple(r) for r in large.collect()) and len(found) > 500 and len({r[1] % len(conditions) for r in found}) == len(conditions)
    plan = large._jdf.queryExecution().executedPlan().toString()
    beside = [line for line in plan.split("\n") if "Generate inline(_part" in line and "tests#" not in line]
    assert beside and not any("_entry#" in line or ".lows" in line for line in beside)  # neither the row's fields nor a way's lists are carried along
    assert ".lows[" not in plan.split("Generate inline(_part")[0]
