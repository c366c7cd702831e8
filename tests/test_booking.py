import pytest

from ledgerloom.operators import aggregate as agg
from ledgerloom.operators import ledger as booking
from ledgerloom.operators import ordering

ACCOUNTS = [("1100", "银行存款", 1, None), ("2301", "应付OL押金", 1, None), ("4300", "收入OL", 1, None), ("5301", "支出OL讲师", 1, None)]


def lines(booked, unmatched=False):
    rows = booking.ledger(booked, unmatched).orderBy("src_row", "line_no").collect()
    return [(r.entry_id, r.account_code, float(r.amount), r.ledger_type) for r in rows]


@pytest.fixture(params=[20_000, 0], ids=["broadcast", "shuffled"])
def max_rules(request):
    return request.param


def test_priority_then_file_order(make, max_rules):
    rules = make.rules(("R1", 'old_type == "OL"', "A2", 1, None), ("R2", 'old_type == "OL"', "A1", 2, None), ("R3", 'old_type == "OL"', "A3", 2, None))
    booked = booking.book(make.journal(("J", "OL", 5, "2024-01-01")), rules, max_rules=max_rules)
    # A rule without side is one debit line.
    assert lines(booked) == [("LE-J-R2", "A1", 5.0, "DR")]


def test_no_match_placeholders(make, max_rules):
    booked = booking.book(make.journal(("J", "OTHER", -5, "2024-01-01")), make.rules(("R1", 'old_type == "OL"', "A2", 1, "CR")), max_rules=max_rules)
    assert lines(booked) == []
    assert lines(booked, True) == [("LE-J-NO_MATCH-DR", "UNMATCHED", 5.0, "DR"), ("LE-J-NO_MATCH-CR", "UNMATCHED", 5.0, "CR")]
    assert booking.unmatched(booked).first().entry_id == "J"


def test_sides_are_picked_independently(make, max_rules):
    rules = make.rules(("R1", 'old_type == "OL"', "A", 1, "CR"), ("R2", "amount > 1", "B", 9, "DR"), ("R3", 'old_type == "OL" and "tip" in description', "C", 5, "CR"),
                       ("R4", 'old_type == "OL" and year == 2020', "D", 99, "CR"))
    booked = booking.book(make.journal(("J", "OL", 5, "2024-01-01", "a tip")), rules, max_rules=max_rules)
    assert lines(booked) == [("LE-J-R3", "C", 5.0, "CR"), ("LE-J-R2", "B", 5.0, "DR")]


def test_generic_rule_only_without_sides(make, max_rules):
    rules = make.rules(("R1", 'old_type == "OL"', "A", 1, "CR"), ("R2", 'old_type == "OL"', "B", 9, None))
    assert lines(booking.book(make.journal(("J", "OL", 5, "2024-01-01")), rules, max_rules=max_rules)) == [("LE-J-R1", "A", 5.0, "CR")]


@pytest.mark.parametrize("kind, amount, expected", [
    ("应付ol押金", 500, ["DR", "CR"]), ("应付ol押金", -500, ["CR", "DR"]), ("OL-D", 500, ["DR", "CR"]), ("x", -500, ["CR", "DR"]), ("x", 500, ["CR", "DR"])])
def test_deposit_swap(make, kind, amount, expected):
    rules = make.rules(("R1", f'old_type == "{kind}"', "2301", 1, "CR"), ("R2", f'old_type == "{kind}"', "1100", 1, "DR"))
    booked = booking.book(make.journal(("J", kind, amount, "2023-01-01")), rules, make.accounts(*ACCOUNTS))
    assert [(a, s) for _, a, _, s in lines(booked)] == [("2301", expected[0]), ("1100", expected[1])]


@pytest.mark.parametrize("account, expected", [("收入OL", "DR"), ("4300", "CR"), ("支出OL讲师", "CR")])
def test_income_reversal_by_name_only(make, account, expected):
    rules = make.rules(("R1", 'old_type == "x"', account, 1, "CR"), ("R2", 'old_type == "x"', "银行存款", 1, "DR"))
    booked = booking.book(make.journal(("J", "x", -5, "2024-01-01")), rules, make.accounts(*ACCOUNTS))
    assert lines(booked)[0][3] == expected


@pytest.mark.parametrize("amount, parts", [(500, [500.0, 350.0, 150.0]), (100, [100.0, 0.0, 100.0])])
def test_deposit_split(make, amount, parts):
    rules = make.rules(("R1", 'old_type == "OL"', "收入OL", 1, "CR"), ("R2", 'old_type == "OL"', "银行存款", 1, "DR"))
    accounts = make.accounts(*ACCOUNTS)
    journal = make.journal(("J", "OL", amount, "2024-03-01"), ("K", "OL", amount, "2023-03-01"), ("L", "OL", -amount, "2024-03-01"))
    out = lines(booking.book(journal, rules, accounts))
    assert out[:3] == [("LE-J-R2", "银行存款", parts[0], "DR"), ("LE-J-R1-OL", "收入OL", parts[1], "CR"), ("LE-J-R1-OL-D", "应付OL押金", parts[2], "CR")]
    assert len(out) == 7 and out[5][3] == "DR"
    assert len(lines(booking.book(journal, rules, make.accounts(*ACCOUNTS[:1], *ACCOUNTS[2:])))) == 6


def test_unknown_accounts_drop_lines_but_stay_matched(make):
    rules = make.rules(("R1", 'old_type == "x"', "nope", 1, "CR"), ("R2", 'old_type == "x"', "银行存款", 1, "DR"), ("R3", 'old_type == "y"', "nope", 1, "CR"))
    booked = booking.book(make.journal(("J", "x", 5, "2024-01-01"), ("K", "y", 5, "2024-01-01")), rules, make.accounts(*ACCOUNTS))
    assert lines(booked, True) == [("LE-J-R2", "银行存款", 5.0, "DR")]
    assert booking.unmatched(booked).count() == 0


def test_quarters(make):
    rules = make.rules(("R1", 'old_type == "x"', "A", 1, "CR"))
    journal = make.journal(*[(f"J{m}", "x", 1, f"2024-{m:02d}-01") for m in (1, 4, 7, 10)])
    assert [r.quarter for r in booking.ledger(booking.book(journal, rules)).orderBy("src_row").collect()] == [1, 2, 3, 4]


def test_balanced_books(make):
    rules = make.rules(("R1", 'old_type == "OL"', "收入OL", 1, "CR"), ("R2", 'old_type == "OL"', "银行存款", 1, "DR"))
    journal = make.journal(*[(f"J{i}", "OL", i - 5, f"202{i % 5}-0{i % 9 + 1}-01") for i in range(20)])
    ledger = booking.ledger(booking.book(journal, rules, make.accounts(*ACCOUNTS)))
    assert all(r.net_amount == 0 for r in agg.quarter_totals(agg.quarterly(ledger)).collect())


def test_quarterly_net(make):
    ledger = make.ledger(("J1", "A1", 1000, "2024-01-01", "CR"), ("J2", "A1", 2000, "2024-02-01", "CR"), ("J3", "A1", 10, "2024-02-01", None))
    row = agg.quarterly(ledger).first()
    assert (row.total_amount, row.cr_amount, row.dr_amount, row.entry_count, row.level) == (3000, 3000, 0, 3, 0)


def test_level_totals_and_tie_out(make):
    accounts = make.accounts(("A1", "a", 1, None), ("A1-1", "b", 2, "A1"), ("A1-2", "c", 2, "A1"))
    ledger = make.ledger(("J", "A1-1", 400, "2024-01-01", "CR"), ("J", "A1-2", 700, "2024-01-01", "CR"), ("J", "A1", 1000, "2024-01-01", "CR"),
                         ("J", "A1", 5, "2023-01-01", "CR"))
    quarterly = agg.quarterly(ledger, accounts)
    totals = {r.level: (r.year, float(r.total_amount), r.account_count) for r in agg.level_totals(quarterly).collect()}
    assert totals == {1: (2023, 1005.0, 2), 2: (2024, 1100.0, 2)}
    strict = {(r.year, float(r.children_total), float(r.total_amount)) for r in agg.tie_out(quarterly, accounts).collect()}
    # Strict: posted accounts without posted children are compared with 0 on levels 1 to 3.
    assert strict == {(2024, 1100.0, 1000.0), (2023, 0.0, 5.0), (2024, 0.0, 400.0), (2024, 0.0, 700.0)}
    assert agg.tie_out(quarterly, accounts, strict=False).count() == 1
    sums = {(r.account_code, r.year): float(r.subtree_amount) for r in agg.subtree_totals(quarterly, accounts).collect()}
    assert sums[("A1", 2024)] == 2100.0 and sums[("A1-1", 2024)] == 400.0


def test_categorization_order(make):
    ledger = make.ledger(("B-1-1", "A", 1, "2024-03-10", "DR"), ("A-1-2", "A", 1, "2024-03-10", "CR"), ("W-1-1", "A", 1, "2024-03-10", None),
                         ("I-1-1", "A", 1, "2024-03-10", "DR"), ("A-1-1", "A", 1, "2024-03-05", "DR"))
    rows = ordering.categorization(ledger).orderBy(*ordering.categorization_order()).collect()
    assert [r.source_entry_id for r in rows] == ["A-1-1", "A-1-2", "I-1-1", "B-1-1", "W-1-1"]
    assert [float(r.signed_amount) for r in rows] == [1.0, -1.0, 1.0, 1.0, -1.0]


def test_capped(make):
    rows = ordering.capped(make.ledger(*[(f"J{i}", "A", i, "2024-01-01", "DR") for i in range(7)]), ["src_row"], 5).collect()
    assert [r.n_more for r in rows] == [2] * 5
