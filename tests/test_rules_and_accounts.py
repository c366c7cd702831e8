import json

import pytest

from ledgerloom.operators import accounts as acc
from ledgerloom.operators import quality_rules as qr
from ledgerloom.sources import accounts as source
from ledgerloom.sources import rules as rule_source


def test_rule_table(spark):
    df = spark.createDataFrame([
        (0, "R-1", 'old_type == "OL"', "A1", "10", "OL", "yes", "CR"), (1, "R-2", " ", "A1", "0", "OL", None, None),
        (2, None, 'year == 1', None, "x", " ", "no", "DR")],
        "rule_ord bigint, rule_id string, condition string, account_code string, priority string, old_type string, generates_multiple string, ledger_type string")
    good = rule_source.read_rules(df).collect()
    assert [(r.rule_id, r.priority, r.generates_multiple, r.ledger_type) for r in good] == [("R-1", 10, True, "CR")]
    bad = {(r.entry_id, r.field_name, r.issue_type) for r in rule_source.rule_issues(df).collect()}
    assert bad == {("R-2", "condition", "string_too_short"), ("R-2", "priority", "greater_than_equal"), ("ROW-4", "rule_id", "missing"),
                   ("ROW-4", "account_code", "missing"), ("ROW-4", "priority", "int_parsing"), ("ROW-4", "old_type", "value_error")}
    assert {r.field_name for r in rule_source.rule_issues(df.drop("condition")).collect()} == {"condition"}


def test_pairs(spark):
    df = spark.createDataFrame([
        (0, "2024", "OL", "N", "a", "b", None), (1, "2024.0", "OL", "N", "c", "d", " "), (2, "2024", "OL", "N", "e", "f", "tip"),
        (3, "2024", "X", "/", "a", "b", None), (4, "2024", "Y", None, "/", "b", None), (5, None, "Z", "N", "a", "b", None), (6, "2024", "W", "N", "a", " ", None)],
        "ord bigint, year string, old_type string, new_type string, cr string, dr string, keyword string")
    rows = rule_source.rules_from_pairs(df).orderBy("rule_ord").collect()
    assert [(r.rule_id, r.account_code, r.priority) for r in rows] == [("JTL-2-CR", "a", 10), ("JTL-2-DR", "b", 10), ("JTL-4-CR", "e", 20), ("JTL-4-DR", "f", 20)]
    assert rows[2].condition == 'old_type == "OL" and year == 2024 and "tip" in description'


def test_conflicts_and_gate(make):
    rules = make.rules(
        ("R-1", 'old_type == "OL"', "A1", 10, "CR"), ("R-2", ' OLD_TYPE == "OL" '.strip(), "A2", 10, "CR"), ("R-3", 'old_type == "OL"', "A2", 10, "DR"),
        ("R-4", 'old_type == "OL"', "A9", 5, "CR"), ("R-5", 'Old_type == "ol"', "A3", 10, "CR"), ("R-6", "year =", "A1", 1, None), ("R-7", 'old_type == "OL"', "A4", 10, "CR"))
    assert {r.rule_id for r in qr.valid_rules(rules).collect()} == {"R-1", "R-3", "R-4", "R-7"}
    found = qr.rule_table_issues(rules).collect()
    kinds = sorted((r.issue_type, r.entry_id) for r in found)
    assert kinds == [("invalid_field_reference", "R-2"), ("invalid_field_reference", "R-5"), ("rule_conflict", "2 rules"), ("syntax_error", "R-6")]
    assert qr.type_issues(make.rules(("R", "year == 1", "A", 1, None, None))).count() == 1


def test_large_conflict_is_not_packed(make):
    rules = make.rules(*[(f"R-{i}", "year == 2024", f"A{i}", 1, None) for i in range(8)])
    issue = qr.conflict_issues(rules).first()
    assert "8 rules" in issue.message and qr.conflict_members(rules).count() == 8


def test_levels_and_parents(spark):
    df = spark.createDataFrame([
        (0, "1000", "资产", "1", "资产", None, None), (1, "1100", "银行", "1", "资产", "2", "银行 "), (2, "4000", "收入", "1", "收入", None, None),
        (3, "4300", "收入OL", "1", "收入", "2", "收入OL"), (4, "9100", "other", "1", "x", "2", "y"), (5, None, "skip", "1", "x", None, None)],
        "ord bigint, ledger_id string, ledger_name string, n1 string, name1 string, n2 string, name2 string")
    rows = {r.code: r for r in source.accounts_from_levels(df).collect()}
    assert rows["1100"].full_path == "资产 > 银行" and rows["1100"].parent_code == "1000"
    assert rows["4250"].parent_code == "4000" and rows["4250"].ord == 5
    assert rows["9100"].parent_code == "1000" and rows["1000"].parent_code is None


def test_account_files(spark, tmp_path):
    data = [{"code": " A1", "name": "n", "level": 1, "full_path": "n"}, {"code": "A2", "name": "m", "level": "2", "parent_code": "A1", "full_path": "n/m"}]
    for name, body in (("list.json", data), ("dict.json", {"accounts": [dict(d, level=int(d["level"])) for d in data]})):
        path = tmp_path / name
        path.write_text(json.dumps(body), encoding="utf-8")
        assert {(r.code, r.level) for r in source.read_accounts(spark, str(path)).collect()} == {("A1", 1), ("A2", 2)}
    (tmp_path / "a.csv").write_text("code,name,level\nA,B,1\n")
    with pytest.raises(source.InvalidAccounts, match="full_path"):
        source.read_accounts(spark, str(tmp_path / "a.csv"))
    with pytest.raises(source.InvalidAccounts, match="Unknown file type"):
        source.read_accounts(spark, "a.xyz")


def test_accounts_keep_the_order_of_their_file(spark, tmp_path):
    """The same numbers whether a file is read whole or by many tasks; lists count from 0; `ord` in the file wins."""
    rows = [{"code": f"A{i}", "name": "n" * (i % 40), "level": 1, "full_path": "p"} for i in range(500)]
    (tmp_path / "a.csv").write_text("code,name,level,full_path\n" + "".join(f"{r['code']},{r['name']},1,p\n" for r in rows))
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "a.json").write_text(json.dumps({"accounts": rows}))
    (tmp_path / "b.json").write_text(json.dumps({"accounts": [dict(r, ord=7 - i) for i, r in enumerate(rows[:3])]}))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for name in ("a.csv", "a.jsonl", "a.json"):
                found = source.read_accounts(spark, str(tmp_path / name)).collect()
                assert sorted((r.ord, r.code) for r in found) == [(i, f"A{i}") for i in range(500)], (name, size)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.ord, r.code) for r in source.read_accounts(spark, str(tmp_path / "b.json")).collect()} == {(7, "A0"), (6, "A1"), (5, "A2")}


def test_lookup_prefers_code_then_first_name(make, spark):
    accounts = make.accounts(("1100", "银行存款", 2, "1000"), ("4301", "收入OL", 2, "4000"), ("4302", "收入OL", 2, "4000"), ("收入OL2", "x", 2, "4000"))
    keys = spark.createDataFrame([("1100",), ("收入OL",), ("none",)], "account_code string")
    assert {r.account_code: r.ledger_id for r in acc.lookup(keys, accounts).collect()} == {"1100": "1100", "收入OL": "4301", "none": None}
    assert {(r.account_code, r.level, r.account_path) for r in acc.lookup_by_code(keys, accounts).collect()} == {
        ("1100", 2, "path/银行存款"), ("收入OL", 0, "收入OL"), ("none", 0, "none")}


def test_hierarchy_issues(make):
    accounts = make.accounts(("A", "a", 1, None), ("B", "b", 2, "A"), ("B", "b2", 2, "A"), ("C", "c", 3, "A"), ("D", "d", 2, "Z"))
    assert {r.issue_type for r in acc.hierarchy_issues(accounts).collect()} == {"duplicate_code", "parent_level", "missing_parent"}


def test_type_map_last_wins(spark):
    df = spark.createDataFrame([(0, "2022", "a", "x"), (1, "2022.0", " a ", "y"), (2, "1999", "a", "z"), (3, "2022", " ", "z")],
                               "ord bigint, year string, old_type string, new_type string")
    assert [tuple(r) for r in source.read_type_map(df).collect()] == [(2022, "a", "y")]


def test_upsert(spark):
    schema = "ord bigint, year int, old_type string"
    base = spark.createDataFrame([(1, 2024, "a"), (2, 2024, "b"), (3, 2024, "b")], schema)
    new = spark.createDataFrame([(10, 2024, "a"), (11, 2024, "b"), (12, 2024, "c"), (13, 2024, "c")], schema)
    out = rule_source.upsert_rules(base, base.filter("old_type = 'b'"), new)
    assert sorted(r.ord for r in out.collect()) == [1, 11, 12]
    assert [tuple(r) for r in rule_source.duplicate_keys(base).collect()] == [(2024, "b", 2)]


def test_many_conditions_are_read_in_several_tasks(spark, monkeypatch):
    rules = spark.range(400, numPartitions=1).selectExpr("id AS rule_ord", "concat('amount > ', id) AS condition", "'T' AS old_type", "'' AS new_type")
    monkeypatch.setattr(qr, "fits", lambda df: False)
    assert qr.valid_rules(rules).selectExpr("spark_partition_id() AS part").distinct().count() > 1
