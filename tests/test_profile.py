import warnings

import pytest

from cleanloom.operators import infer, profile, schema


def test_types_of_fixture(guests):
    types = infer.infer_types(guests)
    assert {c: t for c, (t, _) in types.items()} == {
        "guest_id": "numeric", "guest_age": "numeric", "room_price": "numeric", "discount_pct": "numeric", "email": "text",
        "phone": "text", "order_date": "datetime", "ship_date": "datetime"}
    cast = infer.apply_types(guests, types)
    assert cast.filter("room_price is null").count() == 1  # the word
    assert dict(cast.dtypes)["ship_date"] == "timestamp"
    assert cast.schema["email"].metadata == {"logical_type": "text"}


def test_boolean_rules(spark):
    df = spark.createDataFrame([("True", 1, 1, 1.0, None), ("0", 0, None, 0.0, None)], "t string, i int, n int, f double, z string")
    assert [t for t, _ in infer.infer_types(df).values()] == ["boolean", "boolean", "numeric", "numeric", "boolean"]
    assert [tuple(r)[:2] for r in infer.apply_types(df, infer.infer_types(df)).collect()] == [(True, True), (False, False)]


def test_nulls_count_against_numbers_and_dates(spark):
    df = spark.createDataFrame([("1,000",)] * 18 + [(None,)] * 2, "n string")
    assert infer.infer_types(df)["n"][0] != "numeric"  # exactly 90 percent is not enough
    df = spark.createDataFrame([("1,000",)] * 19 + [(None,)], "n string")
    assert infer.infer_types(df)["n"][0] == "numeric"


def test_first_format_wins(spark):
    df = spark.createDataFrame([("01/02/2023",), ("03/04/2023",)], "d string")
    assert infer.infer_types(df)["d"] == ("datetime", "dd/MM/yyyy")
    assert str(infer.apply_types(df, infer.infer_types(df)).first().d.date()) == "2023-02-01"
    mixed = spark.createDataFrame([("2023-01-02",), ("03/04/2023",)] * 5, "d string")
    assert infer.infer_types(mixed)["d"] == ("datetime", None)


def test_categorical(spark):
    df = spark.createDataFrame([("ab"[i % 2], f"v{i}") for i in range(100)], "c string, t string")
    for approximate in (False, True):
        assert [t for t, _ in infer.infer_types(df, approximate_distinct=approximate).values()] == ["categorical", "text"]


def test_profile(guests):
    rows = {r.column: r for r in profile.profile(guests, "guests.csv", order_by=["order_date", "ship_date", "guest_id"]).collect()}
    age = rows["guest_age"]
    assert (age.rows, age.nulls, age.distinct, round(age.mean, 3), age.min, age.max) == (18, 3, 14, 48.6, -3.0, 130.0)
    assert rows["room_price"].top_values[0] == ("134", 2) and rows["room_price"].distinct == 17
    assert rows["order_date"].avg_length == 10.0 and rows["order_date"].source == "guests.csv"
    assert rows["ship_date"].sample[:3] == ["2024-03-02", "2024-03-04", "2024-03-01"]
    assert rows["guest_age"].top_values is None and rows["guest_age"].ingested_at is not None


def test_profile_variants(spark):
    df = spark.createDataFrame([(True, [1], 1.5), (None, None, float("nan"))], "b boolean, a array<int>, f double")
    rows = {r.column: r for r in profile.profile(df).collect()}
    assert rows["b"].mean == 1.0 and rows["f"].nulls == 1 and rows["a"].distinct == 1
    approx = {r.column: r.distinct for r in profile.profile(df, approximate_distinct=True).collect()}
    assert approx["b"] == 1


def test_negative_zero_is_zero(spark):
    row = profile.profile(spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")).first()
    assert row.distinct == 2


def test_schema_validation(spark, guests):
    with pytest.warns(UserWarning, match="missing columns"):
        report = schema.validate_schema(guests, expected=["guest_age", "gone"])
    assert report.missing_columns == ["gone"] and len(report.extra_columns) == 7 and report.missing_values["guest_age"] == 3
    with pytest.raises(schema.SchemaError):
        schema.validate_schema(guests, expected=["gone"], strict=True)
    with pytest.raises(schema.SchemaError, match="no rows"):
        schema.validate_schema(spark.createDataFrame([], "a int"), strict=True)
    with pytest.raises(schema.SchemaError, match="fewer"):
        schema.validate_schema(guests, min_columns=9, strict=True)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        report = schema.validate_schema(guests, header=["a", "b", "a", "A", "", "nan"])
    assert report.duplicate_columns == ["a"] and report.empty_columns == ["", "nan"]
    assert schema.repeated_names(["a", "A"], case_sensitive=False) == ["A"]
    assert report.frame(spark).count() == 8
