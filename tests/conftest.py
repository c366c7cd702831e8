import datetime
import decimal
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    session = (
        SparkSession.builder.master("local[4]").appName("ledgerloom-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ui.retainedExecutions", "5").config("spark.sql.maxPlanStringLength", "100000")  # plans of a long session add up
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Make:
    """Small tables for tests."""

    def __init__(self, spark):
        self.spark = spark

    def journal(self, *rows):
        """(entry_id, old_type, amount, date[, description[, quarter]])"""
        out = []
        for i, r in enumerate(rows):
            entry_id, kind, amount, date, *rest = r
            date = datetime.datetime.fromisoformat(date)
            description = rest[0] if rest else "Test Entry"
            quarter = rest[1] if len(rest) > 1 else (date.month - 1) // 3 + 1
            out.append((i, str(date.year), entry_id, date.year, description, kind, decimal.Decimal(str(amount)), date, quarter, None))
        from ledgerloom.schemas import JOURNAL
        return self.spark.createDataFrame(out, JOURNAL)

    def rules(self, *rows):
        """(rule_id, condition, account_code, priority, ledger_type[, old_type])"""
        from ledgerloom.schemas import RULES
        out = [(i, r[0], r[1], r[2], r[3], r[5] if len(r) > 5 else "T", None, None, False, r[4]) for i, r in enumerate(rows)]
        return self.spark.createDataFrame(out, RULES)

    def accounts(self, *rows):
        """(code, name, level, parent_code)"""
        from ledgerloom.schemas import ACCOUNTS
        return self.spark.createDataFrame(
            [(i, c, n, lv, p, f"path/{n}") for i, (c, n, lv, p) in enumerate(rows)], ACCOUNTS)

    def ledger(self, *rows):
        """(source, account, amount, date, side)"""
        out = []
        for i, (source, account, amount, date, side) in enumerate(rows):
            d = datetime.datetime.fromisoformat(date)
            out.append((i, 1, f"LE-{i}", account, account, decimal.Decimal(str(amount)), d, "d", source, "R", (d.month - 1) // 3 + 1, d.year, side))
        return self.spark.createDataFrame(
            out, "src_row bigint, line_no int, entry_id string, account_code string, account_path string, amount decimal(18,2), "
                 "date timestamp, description string, source_entry_id string, rule_applied string, quarter int, year int, ledger_type string")


@pytest.fixture
def make(spark):
    return Make(spark)
