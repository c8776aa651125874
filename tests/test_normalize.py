from datetime import datetime

from pyspark.sql import functions as F

from leadloom.functions import normalize as N


def apply(spark, use, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", use(F.col("x")).alias("y")).orderBy("i").collect()]


def test_status(spark):
    raw = ["New", "NEW ", None, "unknown_status", " Qualified", "Closed Won", "closed lost", '"Contacted"', ""]
    assert apply(spark, N.status, raw) == ["new", "new", "new", "new", "qualified", "closed_won", "closed_lost", "contacted", "new"]


def test_country(spark):
    raw = ["italy", "UAE", "USA", "UK", "Germany ", None, " ", "côte d'ivoire", "US", "bosnia-herzegovina"]
    assert apply(spark, N.country, raw) == ["Italy", "UAE", "USA", "United Kingdom", "Germany", None, None, "Côte D'Ivoire", "Us", "Bosnia-Herzegovina"]


def test_phone(spark):
    raw = ["+82 10-2476-5835", "46704602383", "+1 (323) 555-0192", "123", None, "+1 555-123-4567 ext 102", "+1 555-123-4567 x45", "+1 555-123-4567 ext. 9"]
    assert apply(spark, N.phone, raw) == ["821024765835", "46704602383", "13235550192", None, None, "15551234567", "15551234567", "15551234567"]


def test_email_owner_lifecycle(spark):
    assert apply(spark, N.email, [" TEST@Example.com ", "  ", None]) == ["test@example.com", None, None]
    assert apply(spark, N.owner, [" Ada ", " ", None]) == ["Ada", None, None]
    assert apply(spark, N.lifecycle, ["MQL", " Lead ", "Subscriber ", " ", "", None]) == ["Marketing Qualified Lead", "Lead", "Subscriber", "", None, None]


def test_name(spark):
    rows = [
        ("Joon", "Diallo", None), (None, None, "Joon Diallo"), (None, None, "Cher"), (None, None, "Dr. John Smith"), (None, None, "Mary Jane Watson"),
        (" Alan ", " Turing ", " "), ("Ann", None, None), (None, "Lee", None), (None, None, None), ("A", "B", "Full Name"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, l string, n string")
    got = [tuple(r.w) for r in df.select("i", N.name(F.col("f"), F.col("l"), F.col("n")).alias("w")).orderBy("i").collect()]
    assert got == [
        ("Joon", "Diallo", "Joon Diallo"), ("Joon", "Diallo", "Joon Diallo"), ("Cher", None, "Cher"), ("John", "Smith", "Dr. John Smith"),
        ("Mary Jane", "Watson", "Mary Jane Watson"), ("Alan", "Turing", "Alan Turing"), ("Ann", None, "Ann"), (None, "Lee", "Lee"), (None, None, ""), ("A", "B", "Full Name"),
    ]


def test_date(spark):
    raw = ["2026-05-18", "5/27/2026", "2026-04-05T00:00:00Z", "2026-04-05T00:00:00+07:00", "27/05/2026", "27-05-2026", "2026-02-31", "not-a-date", " ", None, "2026", "20260518", "2026-04-05 10:20:30", "2026-04-05T10:20"]
    got = apply(spark, lambda x: F.date_format(N.date(x), "yyyy-MM-dd HH:mm"), raw)
    assert got == ["2026-05-18 00:00", "2026-05-27 00:00", "2026-04-05 00:00", "2026-04-04 17:00", "2026-05-27 00:00", "2026-05-27 00:00", None, None, None, None, None, "2026-05-18 00:00", "2026-04-05 10:20", "2026-04-05 10:20"]
    assert datetime.fromisoformat("2026-04-05T00:00:00+07:00").utctimetuple()[:5] == (2026, 4, 4, 17, 0)


def test_company(spark):
    raw = ["Huang Analytics Pte. Ltd.", "Singh Logistics & Co", "Singh Logistics Ltd", "Solutions Group Pte Ltd", None, " "]
    assert apply(spark, N.company, raw) == ["huang", "logistics singh", "logistics singh", "group ltd pte solutions", "", ""]


def test_numbers_and_json(spark):
    assert apply(spark, lambda x: N.whole_number(x, "int"), [" 12 ", "12.0", "n/a", "+5", None]) == [12, None, None, 5, None]
    got = apply(spark, lambda x: N.fenced_json(x, "channel string")["channel"], ['```json\n{"channel": "Event"}\n```', '{"channel": "Other"}', "no"])
    assert got == ["Event", "Other", None]
