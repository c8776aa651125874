import json

from pyspark.sql import functions as F

from leadloom.operators import directory
from leadloom.plans.seed import seed
from leadloom import storage
from leadloom.schemas import LEAD
from leadloom.sources.leads import create_tables, crm_to_leads, drop_tables, import_counts, read_crm_csv, read_jdbc, read_submissions, rejected, write_csv
from leadloom.streaming.ingest import in_order, start, stream_submissions
from tests.test_resolve import leads, person

CSV = "﻿" + '''Record ID,First Name,Last Name,Full Name,Job Title,Company Name,Email,Phone Number,Country/Region,Lead Status,Lifecycle Stage,Original Source,Original Source Drill-Down 1,Contact Owner,Lead Score,Notes,Create Date,Last Modified Date
1,Ada,Berg,,,One, Ada@One.com ,+1 555-123-4567 ext 2,uk,New,mql,Direct,,Cy , 12 ,"two
lines, ""quoted""",2026-05-18,bad
x,,,Bo Lee,,,bo@two.com,,,,,,,,n/a,,,
3,No,Mail,,,Three,  ,,,,,,,,,,,
'''


def test_csv_import(spark, tmp_path):
    path = tmp_path / "crm.csv"
    path.write_text(CSV, encoding="utf-8")
    got = {r.email: r for r in crm_to_leads(read_crm_csv(spark, str(path))).collect()}
    assert set(got) == {"ada@one.com", "bo@two.com"}
    ada, bo = got["ada@one.com"], got["bo@two.com"]
    assert ada.record_id == 1 and ada.notes == 'two\nlines, "quoted"' and ada.country == "United Kingdom" and ada.lead_score == 12
    assert ada.phone_normalized == "15551234567" and ada.original_modified_date is None and ada.lifecycle_stage == "Marketing Qualified Lead"
    assert bo.record_id is None and bo.company_name == "Unknown" and bo.last_name == "Lee" and bo.lead_score is None and bo.lead_status == "new"


def test_seed_and_export(spark, tmp_path):
    path = tmp_path / "crm.csv"
    path.write_text(CSV, encoding="utf-8")
    done = seed(spark, str(path), str(tmp_path / "out"))
    out = done.leads
    assert done.imported and out.count() == 2 and out.filter("ai_source_channel IS NULL").count() == 0
    assert {(r.step, r.value): r.n for r in done.tallies.collect()} == {("import", "leads"): 2, ("sources", "Other"): 2, ("dedup", "candidates"): 0, ("dedup", "clusters"): 0}
    write_csv(directory.export_rows(out), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text.startswith("id,record_id,first_name") and "2026-05-18 00:00:00+00:00" in text
    write_csv(directory.export_rows(out.limit(0)), str(tmp_path / "none"))
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")) == ""
    # what is there stays, unless it is reset
    path.write_text(CSV.replace("bo@two.com", "bob@two.com"), encoding="utf-8")
    again = seed(spark, str(path), str(tmp_path / "out"), extract_sources=False, run_dedup=False)
    assert not again.imported and again.leads.filter("email = 'bo@two.com'").count() == 1
    assert seed(spark, str(path), str(tmp_path / "out"), run_dedup=False, reset=True).leads.filter("email = 'bob@two.com'").count() == 1


def test_rows_without_email_are_counted(spark, tmp_path):
    path = tmp_path / "crm.csv"
    path.write_text(CSV, encoding="utf-8")
    rows = read_crm_csv(spark, str(path))
    assert import_counts(rows).first()[:] == (2, 1) and [r["Record ID"] for r in rejected(rows).collect()] == ["3"]
    assert import_counts(rows.limit(0)).first()[:] == (0, 0)


def test_tables_and_jdbc(spark, tmp_path):
    create_tables(spark, "crm_test")
    create_tables(spark, "crm_test")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN crm_test").collect()} == {"leads", "dedupe_candidates", "form_submissions"}
    assert spark.table("crm_test.leads").columns == LEAD.names and spark.table("crm_test.leads").count() == 0
    drop_tables(spark, "crm_test")
    spark.sql("DROP DATABASE crm_test")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).withColumn("email", F.concat(F.lit("a"), "id")).write.jdbc(url, "leads", properties=driver)
    whole = read_jdbc(spark, url, "leads", **driver)
    parts = read_jdbc(spark, url, "leads", "id", 0, 100, 4, **driver)
    assert whole.count() == 100 and parts.rdd.getNumPartitions() == 4 and sorted(parts.toDF("id", "email").collect()) == sorted(whole.toDF("id", "email").collect())


def test_shared_folder(spark):
    since = storage.mark(spark)
    made = storage.written(spark.range(3))
    path = made.inputFiles()[0].rsplit("/", 1)[0]
    assert storage.exists(spark, path) and storage.cleared(spark, since) == 1 and not storage.exists(spark, path)
    assert storage.mark(spark) == since


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in ({"email": "ada@one.com", "name": "Ada Berg", "company": "One", "message": "hello"}, {"email": "n@n.com"})))
    assert read_submissions(spark, str(tmp_path / "in")).count() == 2
    leads(spark, [person(7, "Ada", "Berg", "One", "ada@one.com", "5551234567")]).write.parquet(str(tmp_path / "leads" / "batch=-1"))
    q = start(stream_submissions(spark, str(tmp_path / "in")), str(tmp_path / "leads"), str(tmp_path / "log"), str(tmp_path / "state"))
    q.awaitTermination(120)
    after = spark.read.parquet(str(tmp_path / "leads" / "batch=0"))
    assert after.count() == 2 and spark.read.parquet(str(tmp_path / "log" / "batch=0")).count() == 2


def test_order_of_arrival(spark):
    rows = [("b", 5, "y"), ("b", 5, "x"), ("c", 5, "z"), ("a", 9, "w")]
    batch = spark.createDataFrame(rows, "__file string, __arrived int, form_id string").coalesce(1)
    got = in_order(batch)
    assert [r.form_id for r in got.orderBy("pos").collect()] == ["y", "x", "z", "w"] and got.columns == ["form_id", "pos"]


def test_outcomes(spark):
    df = leads(spark, [person(1, "Ada", "Berg", "One", "a@x.com"), person(2, "Bo", "Lee", "Two", "b@x.com")])
    patches = spark.createDataFrame([(1, "new", None), (2, None, None), (3, "new", None), (4, None, None), (2, None, "")], "id long, lead_status string, notes string")
    assert [r.outcome for r in directory.patch_outcomes(df, patches.coalesce(1)).sort("id", "outcome").collect()] == ["updated", "empty", "updated", "not_found", "empty"]
    # the name in full, the life cycle and the score are not for patches
    wide = spark.createDataFrame([(1, "X Y", "Lead", 3)], "id long, full_name string, lifecycle_stage string, lead_score int")
    assert directory.patch_outcomes(df, wide).first().outcome == "empty" and directory.patched(df, wide).filter("full_name = 'X Y'").count() == 0
    found = spark.createDataFrame([(1, 2, "pending")], "lead_id_1 long, lead_id_2 long, status string")
    said = spark.createDataFrame([(1, 2, "confirmed"), (1, 2, "sure"), (1, 3, "rejected"), (1, 3, None)], "lead_id_1 long, lead_id_2 long, status string")
    assert sorted((r.lead_id_2, r.outcome) for r in directory.review_outcomes(found, said).collect()) == [(2, "bad_status"), (2, "updated"), (3, "bad_status"), (3, "not_found")]


def test_directory(spark):
    df = leads(spark, [person(i, "Ada", f"Berg{i}", "One_x" if i % 2 else "Two", f"a{i}@x.com") for i in range(1, 31)]).withColumn("created_at", F.timestamp_seconds(F.col("id"))).withColumn("lead_score", F.when(F.col("id") > 3, F.col("id").cast("int")))
    page = [r.id for r in directory.page(df, 1, 5, "lead_score", "desc").collect()]
    assert page == [1, 2, 3, 30, 29]
    assert [r.id for r in directory.page(df, 1, 3, "lead_score", "asc").collect()] == [4, 5, 6]
    assert [r.id for r in directory.page(df, 2, 2, "nonsense").collect()] == [28, 27]
    assert directory.filtered(df, q="one_X").count() == 15 and directory.filtered(df, status_is="whatever").count() == 0
    assert tuple(directory.totals(df, 25).first()) == (30, 2)
    assert directory.distinct_values(df, "company_name").count() == 2 and directory.distinct_values(df, "nope").count() == 0
    try:
        directory.page(df, 0)
        raise AssertionError("page 0 was accepted")
    except ValueError:
        pass
