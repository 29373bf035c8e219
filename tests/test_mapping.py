"""Header and content matching, mapping, standardisation."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.text import indel_similarity, normalise_header, string_similarity, try_double
from ledgerlens.operators import mapping
from ledgerlens.plans.analysis import map_upload, screen_upload
from ledgerlens.schema import STANDARD_FIELDS
from ledgerlens.sources.readers import read_csv
from ledgerlens.sources.standardise import parse_failures, apply_mapping, mapping_of, standardise

UPPER = "LOAN_REF CUSTOMER_ID CUSTOMER_NAME PHONE_NUMBER PRINCIPAL_AMOUNT ISSUE_DATE APPROVAL_TIME EMPLOYEE_ID BRANCH_CODE"
EXACT = "loan_id borrower_id borrower_name phone amount loan_date approval_time officer_id branch status"


def match(spark, headers):
    rows = spark.createDataFrame([(h,) for h in headers], "column string")
    rows = rows.withColumn("h", normalise_header(F.col("column"))).withColumn("m", mapping.name_match(F.col("h")))
    return {r["column"]: (r["m"]["field"], round(r["m"]["score"], 3)) for r in rows.collect() if r["m"]}


def test_dictionary_covers_every_standard_field():
    known = mapping.name_variations()
    assert list(known) == STANDARD_FIELDS and sum(map(len, known.values())) == 212


def test_canonical_and_upper_headers_are_exact(spark):
    assert match(spark, EXACT.split()) == {h: (h, 1.0) for h in EXACT.split()}
    assert {s for _, s in match(spark, UPPER.split()).values()} == {1.0}
    assert match(spark, ["LOAN_STATE"]) == {"LOAN_STATE": ("status", 0.85)}


def test_mixed_headers(spark):
    found = match(spark, ["loanId", "Client Name", "Disbursement Date", "approvedBy", "branch location"])
    assert found == {
        "loanId": ("loan_id", 1.0),
        "Client Name": ("borrower_name", 1.0),
        "Disbursement Date": ("loan_date", 1.0),
        "approvedBy": ("officer_id", 0.909),
        "branch location": ("branch", 0.85),
    }


def test_short_headers_match_inside_longer_names(spark):
    found = match(spark, ["id", "name", "mob", "br", "mid", "st", "amt", "stf"])
    assert found["id"] == ("loan_id", 1.0) and found["name"] == ("borrower_name", 1.0)
    assert found["mob"] == ("phone", 0.85) and found["br"] == ("branch", 0.85)
    assert found["mid"] == ("loan_id", 0.85) and found["st"] == ("borrower_id", 0.85)
    assert found["amt"][1] == 0.5 and found["stf"] == ("officer_id", 0.429)


def test_indel_ratio_finds_abbreviations(spark):
    headers = spark.createDataFrame([(h,) for h in ["amt", "dt", "tm", "stf", "amount", "amt"]], "column string")
    found = {r["column"]: (r["field"], round(r["score"], 3)) for r in mapping.name_match_indel(headers).collect()}
    assert found == {
        "amt": ("amount", 0.667),
        "dt": ("loan_date", 0.667),
        "tm": ("approval_time", 0.667),
        "stf": ("officer_id", 0.6),
        "amount": ("amount", 1.0),
    }


def test_similarity_of_empty_texts(spark):
    rows = spark.createDataFrame([("", ""), ("", "abc"), ("kitten", "sitting"), ("é", "e")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = rows.select(string_similarity(a, b), string_similarity(a, b, "zero"), indel_similarity(a, b)).collect()
    assert got[0][0] == 1.0 and got[0][1] == 0.0
    assert got[1][0] == 0.0
    assert got[2][0] == pytest.approx(4 / 7) and got[2][2] == pytest.approx(2 * 4 / 13)
    assert got[3][0] == 0.0


@pytest.fixture(scope="module")
def odd_export(spark):
    """Columns whose headers say nothing, so that content decides."""
    rows = [
        (
            i,
            f"+2567{i:08d}",
            f"2024-01-{i % 28 + 1:02d}",
            f"{i % 24:02d}:15",
            str(20000 + i),
            "1,250" if i % 2 else "12,345",
            "Anna Maria",
            ["active", "closed"][i % 2],
            f"{i % 90}",
            f"0.{i:06d}7",
        )
        for i in range(150)
    ]
    names = ["row", "zq1", "zq2", "zq3", "zq4", "zq5", "zq6", "zq7", "zq8", "zq9"]
    ddl = ", ".join(f"{n} {'long' if n == 'row' else 'string'}" for n in names)
    return spark.createDataFrame(rows, ddl)


def test_content_decides_where_headers_do_not(odd_export):
    cells = mapping.long_values({"odd": odd_export}, "row")
    found = {r["column"]: r for r in mapping.detect(mapping.profile(cells)).collect()}
    assert found["zq1"]["standard"] == "phone" and found["zq1"]["method"] == "pattern_detection"
    assert found["zq2"]["standard"] == "loan_date"
    assert found["zq3"]["standard"] == "approval_time"
    assert found["zq4"]["standard"] == "amount"
    assert found["zq6"]["standard"] == "borrower_name" and found["zq6"]["method"] == "statistical_analysis"
    assert found["zq7"]["standard"] == "status" and found["zq7"]["confidence"] == 0.8


def test_engine_content_confidences(odd_export):
    profiles = mapping.profile(mapping.long_values({"odd": odd_export}, "row"))
    found = {r["column"]: (r["standard"], r["confidence"]) for r in mapping.detect_engine(profiles).collect()}
    assert found["zq1"] == ("phone", 90) and found["zq2"] == ("loan_date", 85) and found["zq3"] == ("approval_time", 80)
    assert found["zq5"] == ("amount", 85) and found["zq6"] == ("borrower_name", 70) and found["zq7"] == ("status", 80)


def test_a_sample_sorts_no_whole_column(spark):
    rows = [(s, p, f"c{p}", r, f"{s}{p}-{r}") for s in "ab" for p in range(3) for r in range(6000, 0, -1) if p < 2 or r % 1500 == 0]
    rows += [("a", 0, "c0", None, "no row"), ("b", 7, "c0", 5, "one")]
    cells = spark.createDataFrame(rows, "source string, position int, column string, row long, value string").repartition(3)
    found = mapping.column_sample(cells, 10)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0)):
        want.setdefault(r[:3], []).append(r)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str(r) for k in want.values() for r in k[:10])
    (part,) = mapping._first_rows(10)(iter(cells.coalesce(1).toArrow().to_batches(max_chunksize=500)))
    assert sorted(map(str, (tuple(r.values()) for r in part.to_pylist()))) == sorted(str(r) for k in want.values() for r in k[:10])


def test_number_shape_leaves_out_no_number(spark):
    texts = ["1", " -2.5 ", "+.5", "5.", "1e5", "1E-3", "2d", "3.F", "inf", "-Infinity", "NaN", "+nan", "0x1p3", "0x1.8P-1d", "\t7\n", "\x017"]
    texts += ["", " ", ".", "-", "1,000", "1998-02-06", "12:30", "Infinite", "GDM12", "1 2", "e5", "0x12", "--1", "1e", "\u00a01", "\u0663", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").try_cast("double").cast("string").alias("want"), try_double(F.col("t")).cast("string").alias("got"))
    rows = got.collect()
    assert [r for r in rows if r["want"] != r["got"]] == [] and sum(r["want"] is not None for r in rows) >= 12


def test_sample_and_whole_profile_agree_on_a_short_export(odd_export):
    cells = mapping.long_values({"odd": odd_export}, "row")
    assert mapping.column_sample(cells, 100).groupBy("column").count().filter("count <> 100").count() == 0
    whole = mapping.resolve(mapping.detect(mapping.profile(cells)))
    again = mapping.resolve(mapping.detect(mapping.profile(mapping.column_sample(cells, 1000))))
    assert sorted(whole.collect()) == sorted(again.collect())


def test_conflicts_keep_the_most_confident_column(spark):
    candidates = spark.createDataFrame(
        [("s", 0, "a", "phone", 0.85, "m"), ("s", 1, "b", "phone", 1.0, "m"), ("s", 2, "c", "phone", 1.0, "m")],
        "source string, position int, column string, standard string, confidence double, method string",
    )
    won = [r["column"] for r in mapping.resolve(candidates).filter("standard is not null").collect()]
    assert won == ["b"]


def test_pooled_assignment_is_greedy_by_confidence(spark):
    rows = [
        ("s", 0, "a", 0, "phone", 90, "x"),
        ("s", 0, "a", 1, "amount", 95, "x"),
        ("s", 1, "b", 0, "amount", 100, "x"),
        ("s", 2, "c", 0, "amount", 99, "x"),
        ("t", 0, "a", 0, "amount", 50, "x"),
    ]
    candidates = spark.createDataFrame(
        rows, "source string, position int, column string, place int, standard string, confidence int, method string"
    )
    found = {(r["source"], r["column"]): r["standard"] for r in mapping.assign_pooled(candidates).collect()}
    assert found == {("s", "b"): "amount", ("s", "a"): "phone", ("t", "a"): "amount"}


def test_filled_columns_are_those_with_a_cell(spark):
    schema = "row long, `a.b` string, `A b` double, c string, d string"
    one = spark.createDataFrame([(1, None, None, "", "x"), (2, " ", 2.0, None, None), (3, "v", None, "  ", "")], schema)
    sources = {"s": one, "t": one.limit(0), "u": one.filter("row = 1").drop("A b")}
    found = mapping.filled_columns(sources, order="row")
    assert sorted(found.collect()) == [("s", 0, "a.b"), ("s", 1, "A b"), ("s", 3, "d"), ("u", 2, "d")]
    assert sorted(mapping.long_values(sources, order="row").select(*mapping.COLUMN_KEY).distinct().collect()) == sorted(found.collect())


def test_page_assignment_takes_the_first_free_field(spark):
    headers = spark.createDataFrame(
        [("s", i, c) for i, c in enumerate(["loan_id", "Other ID", "phone no", "xyz"])],
        "source string, position int, column string",
    )
    found = {r["column"]: (r["standard"], r["confidence"]) for r in mapping.assign_first(headers).collect()}
    assert found == {"loan_id": ("loan_id", 100), "Other ID": (None, 0), "phone no": ("phone", 85), "xyz": (None, 0)}


def test_override_frees_the_field(spark):
    found = spark.createDataFrame(
        [("s", 0, "mid", "loan_id", 0.85, "n"), ("s", 1, "x", "borrower_id", 0.9, "n")],
        "source string, position int, column string, standard string, confidence double, method string",
    )
    rows = {r["column"]: (r["standard"], r["method"]) for r in mapping.override(found, {"mid": "borrower_id"}).collect()}
    assert rows == {"mid": ("borrower_id", "manual"), "x": (None, None)}


SHORT_CSV = """id,mid,name,mob,amt,dt,tm,stf,br,st
W1,M1,Ann Lee,0750000000,"1,500,000",2024-11-18,09:15,S01,WK1,A
W2,M2,Bob Ray,0750000000,900000,2024-11-18,23:15,S01,WK1,C
W3,M3,Cid Fox, 0750000000 ,800000,2024-11-19,10:00,S02,WK2,A
W4,M8,Dan Ode,0761111111,1800000,2024-11-20,11:00,S02,WK2,D
W5,M8,Dan Ode,0761111111,2000000,2024-11-20,11:30,S02,WK2,A
W6,S01,Eve Oja,0762222222,700000,2024-11-21,12:00,S01,WK1,P

W7,M9,Fay Ulm,,bad,,,,,
"""
SHORT = {
    "id": "loan_id",
    "mid": "borrower_id",
    "amt": "amount",
    "dt": "loan_date",
    "tm": "approval_time",
    "stf": "officer_id",
    "st": "status",
}


def test_abbreviated_upload_end_to_end(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text(SHORT_CSV)
    export = read_csv(spark, str(path))
    assert export.count() == 7
    analysis, mapped = screen_upload(export, overrides=SHORT, ruleset="engine")
    fields = mapping_of(mapped, "upload")
    assert {k: fields[k] for k in SHORT} == SHORT and fields["mob"] == "phone" and fields["br"] == "branch"
    alerts = {(r["alert_type"], r["entity_key"]): r for r in analysis.alerts.collect()}
    assert alerts["GHOST_LOAN", "0750000000"]["amount_at_risk"] == 3200000.0
    assert alerts["GHOST_LOAN", "0761111111"]["severity"] == "HIGH"
    assert alerts["LOAN_STACKING", "M8|2024-11-20"]["amount_at_risk"] == 3800000.0
    assert ("TIMING_ANOMALY", "W2") in alerts
    demo, _ = screen_upload(export, overrides=SHORT, ruleset="demo")
    assert ("SELF_LENDING", "W6") in {(r["alert_type"], r["entity_key"]) for r in demo.alerts.collect()}


def test_standardise_cleans_values(spark):
    export = spark.createDataFrame(
        [("070-500-9303", "22-Nov-24", "A", "1,250.50"), (None, "31/12/2023", "paid", "x")],
        "tel string, d string, s string, a string",
    )
    book = standardise(apply_mapping(export, {"tel": "phone", "d": "loan_date", "s": "status", "a": "amount"}))
    first, second = book.collect()
    assert first["phone_number"] == "0705009303" and str(first["loan_date"]) == "2024-11-22"
    assert first["status"] == "active" and first["amount"] == 1250.5
    assert second["amount"] == 0.0 and str(second["loan_date"]) == "2023-12-31" and second["status"] == "paid"
    assert second["officer_name"] == "Unknown" and second["created_at"] is None


def test_upload_without_amount_is_refused(spark):
    export = spark.createDataFrame([("a", "b")], "borrower_id string, zzz string")
    with pytest.raises(ValueError, match="amount"):
        screen_upload(export)


def test_map_upload_covers_several_exports(spark):
    a = spark.createDataFrame([("1", "2")], "loan_id string, amount string")
    b = spark.createDataFrame([("1",)], "CUSTOMER_ID string")
    rows = {(r["source"], r["column"]): r["standard"] for r in map_upload({"a": a, "b": b}).collect()}
    assert rows == {("a", "loan_id"): "loan_id", ("a", "amount"): "amount", ("b", "CUSTOMER_ID"): "borrower_id"}


def test_nearest_by_cosine(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 2.0]), (3, [-1.0, -1.0])], "id int, vector array<double>")
    references = F.array(
        *[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, v)).alias("vector")) for n, v in [("x", [1.0, 0.0]), ("y", [0.0, 1.0])]]
    )
    found = {r["id"]: r["match"] for r in mapping.nearest_by_cosine(vectors, references).collect()}
    assert found == {1: "x", 2: "y", 3: None}


ODD_EXPORT = "clientId string, loan_amount string, `Disbursement Date` string, telephone string, approvedBy string, time string"


def _odd_rows(n=30):
    rows = [(f"C{i % 7}", str(100000 + 1000 * i), "2024-11-14 09:30:00", f"07000000{i % 4:02d}", f"O{i % 3}", "23:10") for i in range(n)]
    return [*rows, ("C9", "nan", "1/2/2024", None, None, None), ("C9", "inf", "2024-11-14T09:30", None, None, None), ("C8", "90000000", "x", None, None, None)]


@pytest.mark.parametrize("mode", ["rule_only", "full", "ml_only"])
@pytest.mark.parametrize("ruleset", ["backend", "engine"])
def test_upload_without_ids_in_every_mode(spark, mode, ruleset):
    analysis, _ = screen_upload(spark.createDataFrame(_odd_rows(), ODD_EXPORT), mode=mode, ruleset=ruleset)
    alerts = analysis.alerts.collect()
    assert len({r["alert_id"] for r in alerts}) == len(alerts) and all(r["entity_key"] for r in alerts)
    members = analysis.members().select("alert_id", "loan_id").collect()
    assert len(set(members)) == len(members) and {m["alert_id"] for m in members} <= {r["alert_id"] for r in alerts}
    if mode == "rule_only" and ruleset == "engine":
        late = [r for r in alerts if r["alert_type"] == "TIMING_ANOMALY"]
        assert len(late) == 30 and sum(m["alert_id"] in {r["alert_id"] for r in late} for m in members) == 30
        assert any(r["alert_type"] == "AMOUNT_ANOMALY" for r in alerts)  # the nan cell does not silence it


def test_dates_with_clock_times_and_failures_are_counted(spark):
    mapped = spark.createDataFrame(
        [("2024-11-14 09:30:00", "1"), ("2024-11-14T09:30", "nan"), ("1/2/2024", "x"), ("soon", None), (None, "")], "loan_date string, amount string"
    )
    book = standardise(mapped).select("loan_date", "amount").collect()
    assert [str(r["loan_date"]) for r in book] == ["2024-11-14", "2024-11-14", "2024-02-01", "None", "None"]
    assert [r["amount"] for r in book] == [1.0, 0.0, 0.0, 0.0, 0.0]
    counts = {r["field"]: (r["filled"], r["failed"]) for r in parse_failures(mapped).collect()}
    assert counts == {"loan_date": (4, 1), "amount": (3, 2)}


def test_meaning_of_headers(spark):
    headers = ["disbursed_principal_money", "client_membership_identifier", "monthly_installments", "witness_referee", "zzqx", "--", None]
    rows = spark.createDataFrame([(h,) for h in headers], "h string").select("h", mapping.semantic_match(F.col("h")).alias("m")).collect()
    got = {r["h"]: r["m"] for r in rows}
    assert got["disbursed_principal_money"]["field"] == "amount" and got["disbursed_principal_money"]["score"] > 0.55
    assert got["client_membership_identifier"]["field"] == "borrower_id"
    assert got["monthly_installments"]["field"] == "repayment_amount" and got["zzqx"]["score"] == 0
    assert got["--"] is None and got[None] is None
