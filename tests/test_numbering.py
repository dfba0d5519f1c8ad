"""Document numbers YYYY + 5 digits (W-5)."""

from tillbook.operators.numbering import assign_doc_numbers


def numbers(spark, existing, n=2, year=2025):
    rows = spark.createDataFrame([(year, i) for i in range(n)], "y int, o int")
    ex = spark.createDataFrame([(e,) for e in existing], "invoice_no string") if existing is not None else None
    return [r["invoice_no"] for r in assign_doc_numbers(rows, ex, "y", ["o"]).orderBy("o").collect()]


def test_none_yet(spark):
    assert numbers(spark, None) == ["202500001", "202500002"]
    assert numbers(spark, []) == ["202500001", "202500002"]


def test_continue_after_last(spark):
    assert numbers(spark, ["202500007", "202500003"]) == ["202500008", "202500009"]


def test_other_year_only(spark):
    assert numbers(spark, ["202400099"]) == ["202500001", "202500002"]


def test_past_99999_goes_on(spark):
    assert numbers(spark, ["202599998"], n=3) == ["202599999", "2025100000", "2025100001"]
    assert numbers(spark, ["2025100000", "202599999"], n=1) == ["2025100001"]
    assert numbers(spark, ["2025abc", None], n=1) == ["202500001"]
