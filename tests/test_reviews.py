from pyspark.sql import functions as F

from tallyloom.operators import audit, decisions, reviews

MATCHED = "row_index int, normalized_phone string, match_type string, candidates string, candidate_count int, matched_customer_id int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_resolutions_are_applied_and_revoked(spark):
    m = spark.createDataFrame([(1, "0311112222", "multi_match", "1;2", 2, None), (2, "0311112222", "multi_match", "1;2", 2, None), (3, "0311112222", "exact", "1", 1, 1), (4, None, "invalid", "", 0, None)], MATCHED)
    a = spark.createDataFrame([("R2", "0311112222", "resolved", "assign_all", "2"), ("R1", "0311112222", "resolved", "assign_all", " 1 "), ("R0", "0311112222", "defer", "assign_all", "9"), ("R3", None, "resolved", "assign_all", "5")], "review_id string, normalized_phone string, decision_status string, chosen_strategy string, chosen_customer_id string")
    done = reviews.apply_resolutions(m, a, F.col("row_index") < 2)
    assert rows(done.select("row_index", "match_type", "matched_customer_id", "candidate_count")) == [(1, "manual_resolved", "1", 1), (2, "multi_match", None, 2), (3, "exact", "1", 1), (4, "invalid", None, 0)]
    assert rows(reviews.revoke_resolutions(done).select("row_index", "match_type", "matched_customer_id", "candidate_count")) == [(1, "multi_match", None, 2), (2, "multi_match", None, 2), (3, "exact", "1", 1), (4, "invalid", None, 0)]


def test_lists_keep_their_order_and_unknown_ids_show(spark):
    lists = spark.createDataFrame([(1, "3;1;9"), (2, ""), (3, None), (4, "3;1;9")], "n int, ids string")
    names = spark.createDataFrame([(1, "one"), (3, "three"), (4, "")], "id int, name string")
    assert rows(reviews.enriched(lists, "ids", names, "id", F.col("name"), "names").select("n", "names")) == [(1, "three / one / ?"), (2, None), (3, None), (4, "three / one / ?")]


def test_issues_of_null_answers(spark):
    sheet = spark.createDataFrame([("a", None, None, None, None), ("b", "resolved", None, "C9", "C1;C2"), ("c", "resolved", "assign_by_date", "　", None)], "review_id string, decision_status string, chosen_strategy string, chosen_customer_id string, candidate_customer_ids string").withColumn("note", F.lit(None).cast("string"))
    assert rows(reviews.packet_issues(sheet)) == [("a", "info", "decision_status", "open"), ("b", "warning", "chosen_customer_id", "not_a_candidate"), ("c", "error", "chosen_customer_id", "resolved_without_customer")]
    assert rows(reviews.template_issues(sheet)) == [("b", "warning", "chosen_strategy", "resolved_without_strategy"), ("c", "warning", "note", "dates_missing")]
    empty = sheet.limit(0)
    hearing = spark.createDataFrame([("x", None)], "status_value string, confirmed_stage string")
    assert rows(reviews.packet_issues(empty)) == []
    assert reviews.verdict(empty, sheet, hearing).first()["verdict"] == "NO-GO"
    assert reviews.verdict(sheet, empty, hearing).first()["reason"] == "input_missing"
    assert reviews.verdict(sheet, sheet.limit(1), hearing).first()["reason"] in ("no_answers", "some_answers")


def test_profiles_score_names_columns_and_families(spark):
    files = spark.createDataFrame([(1, "Visit_2024.CSV", ["id", " 名前 "], 2, False, None), (2, "x.csv", None, 0, True, "f"), (3, "x.csv", [], 9, False, None)], "n int, file string, columns array<string>, column_count int, headerless boolean, family string")
    known = [decisions.Profile("visit", ("visit_*.csv",), (("id",), ("名前", "name"))), decisions.Profile("deal", family="f", headerless_suitable=True)]
    got = decisions.match_profile(files, known).select("n", "profile", "score", "confidence")
    assert rows(got) == [(1, "visit", 175, "high"), (2, "deal", 100, "high"), (3, None, 0, "none")]


def test_runs_against_the_latest_completed(spark):
    runs = spark.createDataFrame([(1, "s", "completed", 1, "f", "c", 3), (2, "s", "failed", 2, "g", "d", 4), (3, "s", "completed", 3, "f", "d", 3), (4, "s", "completed", 4, "h", "d", None), (5, "s", "completed", 5, "i", None, 3)], "run_id int, source string, status string, started_at int, file_fp string, schema_fp string, column_count int")
    got = decisions.pre_run_diff(runs).select("run_id", "previous_run", "change")
    assert rows(got) == [(1, None, "first_import"), (2, 1, "column_changed"), (3, 1, "same_file"), (4, 3, "row_changed"), (5, 4, "row_changed")]


def test_ids_of_one_side(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "id int") for v in ([1, 1, 2, None], [2, 3, 3]))
    assert rows(audit.id_differences(a, b, "id")) == [(1, "a"), (3, "b")]
