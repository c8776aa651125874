from pyspark.sql import functions as F

from leadloom.operators import attribution as A
from leadloom.operators import model as M

CASES = [
    ("Scanned the QR code at our TechCrunch Disrupt booth.", "Event", "TechCrunch Disrupt — Booth QR Code"),
    ("Spoke with them at our SaaStr Annual booth about pricing", "Event", "SaaStr Annual — Booth Visit"),
    ("Came via book-a-demo page after clicking a Google ad", "Website", "Paid Search — Google Ads"),
    ("Googled us and landed on the pricing page", "Organic Search", "Organic Search → pricing"),
    ("Saw our post about AI sales workflows and commented", "LinkedIn", "LinkedIn — Post about AI sales workflows"),
    ("Referred by Maria Santos", "Referral", "Referred by Maria Santos"),
    ("referred by Min-jun Colombo, asked for info", "Referral", "Referred by Min-jun Colombo"),
    ("Manual — added after inbound phone call", "Manual/Sales", "Inbound Phone Call"),
    ("", "Other", A.NO_NOTES),
    (None, "Other", A.NO_NOTES),
    ("Met him at the booth during Mobile World Congress, wants a call", "Event", "Mobile World Congress — Booth Visit"),
    ("organic google search, landed on the homepage. Connected, later", "Organic Search", "Organic Search → homepage"),
    ("Filled out the form on the contact page. Thanks", "Website", "Form Submission — contact page"),
    ("clicking an ad", "Other", A.NO_SOURCE),
    ("nothing to see", "Other", A.NO_SOURCE),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(CASES)], "i int, n string")
    got = [tuple(r.s) for r in df.select("i", A.source(F.col("n")).alias("s")).orderBy("i").collect()]
    assert got == [(c, d) for _, c, d in CASES]


def test_only_missing_channels_are_filled(spark):
    df = spark.createDataFrame([(1, "Walked into our office", None, None), (2, "x", "Event", "kept"), (3, "x", None, None), (4, None, None, None)], "id long, notes string, ai_source_channel string, ai_source_detail string")
    got = {r.id: (r.ai_source_channel, r.ai_source_detail) for r in A.attribute_missing(df).collect()}
    assert got == {1: ("Manual/Sales", "Walk-in"), 2: ("Event", "kept"), 3: ("Other", A.NO_RULE), 4: ("Other", A.NO_NOTES)}


def test_saved_sources(spark):
    df = spark.createDataFrame([(1, "Walked into our office", None, None), (2, "cold outreach list", "Event", "old"), (3, " ", "Event", "old")], "id long, notes string, ai_source_channel string, ai_source_detail string")
    asked = spark.createDataFrame([(1, None), (2, "Referred by Bo Lee"), (3, None)], "lead_id long, notes string")
    got = {r.id: r.ai_source_detail for r in A.save_source(df, asked).collect()}
    assert got == {1: "Walk-in", 2: "Referred by Bo Lee", 3: "old"}


def said(prompt):
    if "breaks" in prompt:
        raise RuntimeError("no service")
    for word, reply in {"radio": '```json\n{"channel": "Event", "detail": "Radio"}\n```', "rumour": '{"channel": "Gossip", "detail": "told"}', "bare": '{"detail": "x"}', "list": "[1]", "short": '{"channel": "Website"}'}.items():
        if word in prompt:
            return reply
    return None


def test_a_model_is_asked_where_no_rule_fits(spark):
    notes = ["heard us on the radio", "a rumour", "bare", "list", "breaks", "silence", "short", "Walked into our office, radio", None, "", "a rumour"]
    df = spark.createDataFrame(list(enumerate(notes)), "id long, notes string")
    got = [(r.channel, r.detail) for r in A.extracted(df, M.CalledModel(said, 1)).orderBy("id").collect()]
    unknown = ("Other", A.NO_SOURCE)
    assert got == [("Event", "Radio"), ("Other", "told"), unknown, unknown, unknown, unknown, ("Website", ""), ("Manual/Sales", "Walk-in"), ("Other", A.NO_NOTES), ("Other", A.NO_NOTES), ("Other", "told")]

    class Broken:
        def reply(self, prompts):
            raise RuntimeError("no model")

    assert [r.detail for r in A.extracted(df, Broken()).orderBy("id").collect()][:2] == [A.NO_SOURCE] * 2
    assert [r.channel for r in A.extracted(df).orderBy("id").collect()][0] == "Other"


def test_extraction_outcomes(spark):
    df = spark.createDataFrame([(1, "Walked into our office"), (2, " ")], "id long, notes string")
    asked = spark.createDataFrame([(1, None, True), (1, "Referred by Bo Lee", False), (2, "", True), (3, "x", True), (None, "cold outreach list", True), (None, None, False)], "lead_id long, notes string, save_to_lead boolean")
    got = {(r.lead_id, r.notes): (r.outcome, r.detail, r.saved) for r in A.extraction_outcomes(df, asked).collect()}
    assert got == {
        (1, None): ("ok", "Walk-in", True), (1, "Referred by Bo Lee"): ("ok", "Referred by Bo Lee", False), (2, ""): ("no_notes", None, False),
        (3, "x"): ("not_found", None, False), (None, "cold outreach list"): ("ok", "Cold Outreach List", False), (None, None): ("no_notes", None, False),
    }
