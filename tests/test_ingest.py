import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leadloom import queries, storage
from leadloom.functions import normalize as N
from leadloom.operators.attribution import source
from leadloom.operators.blocking import keys
from leadloom.operators.ingest import best_matches, ingest, totals, transient
from leadloom.operators.scoring import features
from leadloom.schemas import SUBMISSION
from tests.test_resolve import leads, person
from tests.test_similarity import brute


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def subs(spark, rows):
    names = SUBMISSION.names
    return spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(rows)], "pos long, " + ", ".join(f"{n} string" for n in names))


def test_create_then_enrich_and_order(spark):
    base = leads(spark, [person(7, "Ada", "Berg", "One", "ada@one.com")])
    rows = [
        {"email": "new@two.com", "name": "Bo Lee", "company": "Two", "form_name": "demo", "message": "Referred by Maria Santos"},
        {"email": " NEW@two.com", "name": "Bo Lee", "company": "Two", "message": "again", "phone": "+1 555 123 4567"},
        {"email": " ", "name": "Nobody"},
        {"email": "ada@one.com", "name": "Ada Berg", "company": "One", "phone": "+1 555 999 0000", "country": "italy", "message": "hi ", "form_name": "f"},
        {"email": "other@else.com", "name": "Ada Berg", "company": "One", "phone": "15559990000", "message": None, "submitted_at": "2026-02-03"},
        {"email": "last@three.com", "name": "Cy Dow"},
    ]
    out = ingest(subs(spark, rows), base, now())
    got = {r.pos: (r.action, r.lead_id) for r in out.details.collect()}
    # the fifth meets the phone number that the fourth filled in: 0.25 + 0.20 + 0.15 is a match
    assert got == {0: ("created", 8), 1: ("updated", 8), 2: ("skipped", None), 3: ("updated", 7), 4: ("updated", 7), 5: ("created", 9)}
    after = {r.id: r for r in out.leads.collect()}
    assert after[8].notes == "[Form: demo] Referred by Maria Santos\n---\n[Form: None] again" and after[8].ai_source_channel == "Referral"
    assert after[8].phone_normalized == "15551234567" and after[8].lead_status == "new"
    assert after[7].notes == "---\n[Form: f] hi" and after[7].country == "Italy" and after[7].phone_normalized == "15559990000"
    assert after[9].notes is None and after[9].company_name == "Unknown" and len(after) == 3
    log = out.log.orderBy("lead_id", "submitted_at").collect()
    assert len(log) == 5 and '"email":"new@two.com"' in "".join(r.raw_payload for r in log)


def test_empty_batch(spark):
    out = ingest(subs(spark, []), leads(spark, [person(7, "Ada", "Berg", "One", "ada@one.com")]), now())
    assert out.details.count() == 0 and out.leads.count() == 1


def jaro_winkler(a, b):
    j = brute(a, b) if a and b else float(a == b)
    same = next((k for k in range(4, 0, -1) if len(a) >= k and len(b) >= k and a[:k] == b[:k]), 0)
    return j if j < 0.7 else j + same * 0.1 * (1 - j)


def score(x, y):
    """The five signals of two leads, in plain Python."""
    at = lambda e, k: (e.split("@") + [""])[k]
    email = phone = name = company = 0.0
    if x["email"] and y["email"]:
        near = at(x["email"], 1) == at(y["email"], 1)
        email = 1.0 if x["email"] == y["email"] else (0.7 if jaro_winkler(at(x["email"], 0), at(y["email"], 0)) >= 0.8 else 0.3) if near else 0.0
    if x["phone"] and y["phone"]:
        phone = 1.0 if x["phone"] == y["phone"] else 0.8 if min(len(x["phone"]), len(y["phone"])) >= 10 and x["phone"][-10:] == y["phone"][-10:] else 0.0
    if x["name"] and y["name"]:
        s = 1.0 if x["name"] == y["name"] else jaro_winkler(x["name"], y["name"])
        like = x["last"] and x["last"] == y["last"] and x["first"] and y["first"] and x["first"][0] == y["first"][0]
        name = 0.6 if s < 0.85 and like else s
    if x["company"] and y["company"]:
        s = 1.0 if x["company"] == y["company"] else jaro_winkler(x["company"], y["company"])
        a, b = set(x["company"].split(" ")), set(y["company"].split(" "))
        share = len(a & b) / max(len(a), len(b))
        company = s if s >= 0.85 else max(share, s) if share >= 0.6 else max(s - 0.3, 0.0)
    return email * 0.35 + phone * 0.25 + name * 0.2 + company * 0.15 + (x["hint"] or y["hint"]) * 0.05


def prepared(df):
    f = {r.id: r.f.asDict() for r in features(df).collect()}
    for r in keys(df).collect():
        if r.key_type not in ("phone_normalized", "phone_suffix_10"):
            f[r.id].setdefault("keys", set()).add((r.key_type, r.key))
    return f


def phone_keys(d):
    return {(0, d)} | ({(1, d[-10:])} if len(d) >= 10 else set()) if len(d) >= 7 else set()


def one_by_one(spark, batch, base):
    """The batch in order, each submission against all leads there are by then."""
    leads_of, subs_of = prepared(base), prepared(transient(batch))
    for r in base.select("id", "phone_number", "notes", "country", "ai_source_channel").collect():
        leads_of[r.id] |= r.asDict()
    extra = batch.select("pos", "message", "phone", "form_name", N.email(F.col("email")).alias("clean"), N.country(F.col("country")).alias("land"), source(F.col("message")).alias("s"))
    top, out = max(leads_of, default=0), {}
    for r in extra.orderBy("pos").collect():
        if not r.clean:
            out[r.pos] = "skipped", None, None
            continue
        me = subs_of[r.pos]
        mine = me.get("keys", set()) | phone_keys(me["phone"])
        best = None
        for i, x in sorted(leads_of.items()):
            if mine & (x.get("keys", set()) | phone_keys(x["phone"])):
                s = score(me, x)
                if s >= 0.6 and (best is None or s > best[0]):
                    best = s, i
        note = f"[Form: {r.form_name}] {r.message}"
        if best is None:
            top += 1
            out[r.pos] = "created", top, None
            leads_of[top] = me | {"phone_number": r.phone, "country": r.land, "notes": note if r.message else None, "ai_source_channel": r.s.channel, "hint": "possible duplicate" in note.lower() if r.message else False}
            continue
        x = leads_of[best[1]]
        out[r.pos] = "updated", best[1], round(best[0], 4)
        if r.message and r.message.strip():
            x["notes"] = f"{x['notes'] or ''}\n---\n{note}".strip()
            x["hint"] = "possible duplicate" in x["notes"].lower()
        if r.phone and not x["phone_number"]:
            x["phone_number"], x["phone"] = r.phone, me["phone"]
        if r.land and not x["country"]:
            x["country"] = r.land
        if r.message and r.s.channel != "Other":
            x["ai_source_channel"] = r.s.channel
    return out, {i: tuple(x[c] for c in ("phone_number", "notes", "country", "ai_source_channel")) for i, x in leads_of.items()}


def same(spark, batch, base):
    out = ingest(batch, base, now())
    acts, after = one_by_one(spark, batch, base)
    assert {r.pos: (r.action, r.lead_id, r.match_confidence) for r in out.details.collect()} == acts
    assert {r.id: (r.phone_number, r.notes, r.country, r.ai_source_channel) for r in out.leads.collect()} == after
    changed = {i for a, i, _ in acts.values() if a != "skipped"}
    assert {r.id for r in out.changed.collect()} == changed
    assert totals(out.details).first()[:2] == (sum(a == "created" for a, *_ in acts.values()), sum(a == "updated" for a, *_ in acts.values()))
    return acts


def test_query_against_one_by_one(spark, sf):
    acts = same(spark, queries.fixture.submissions(spark, sf), queries.fixture.attributed(spark, sf))
    assert len(acts) > 150 and {a for a, *_ in acts.values()} >= {"created", "updated"}


def test_hostile_batch_against_one_by_one(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    base = [
        person(k, pick("Ada", "Adah", "Bo", None), pick("Berg", "Bergh", "Lee"), pick("One", "One Ltd", "Two", ""), f"{pick('ada', 'adah', 'bo')}{pick('', '1')}@{pick('one', 'two')}.com", pick(None, "", "+1 555 123 4567", "5551234567"))
        for k in range(1, 25)
    ]
    rows = [
        {
            "email": pick(" ", f"{pick('ada', 'adah', 'bo', 'cy')}{pick('', '1', '2')}@{pick('one', 'two', 'six')}.com"),
            "name": pick("Ada Berg", "Adah Bergh", "Bo Lee", "Cy Dow"),
            "company": pick("One", "Two", "Six GmbH", None),
            "phone": pick(None, "", " ", "1", "+1 555 123 4567", "555 123 4567", "555 765 4321", "15557654321"),
            "message": pick(None, "", "  ", "hi ", "Possible duplicate!", "Referred by Maria Santos"),
            "form_name": pick(None, "demo", "possible duplicate"),
            "country": pick(None, " ", "italy", "uk"),
        }
        for _ in range(150)
    ]
    same(spark, subs(spark, rows), leads(spark, base))


def shuffled(spark, run):
    """What ``run`` returns, and how many rows its stages have shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for k, n in stages().items() if k not in before)


def copies(spark, n):
    """n leads that read alike, of which every tenth has a hint, and n submissions of the same person."""
    base = [person(k, "Ada", "Berg", "One", "ada@one.com", f"+1 555 {k:07}", notes="possible duplicate" if k % 10 == 0 else None) for k in range(1, n + 1)]
    rows = [{"email": "ada@one.com", "name": "Ada Berg", "company": "One", "phone": f"555 {k:07}" if k % 3 == 0 else None} for k in range(n)]
    return leads(spark, base), subs(spark, rows)


def test_best_match_of_copies_without_their_pairs(spark):
    base, batch = copies(spark, 500)
    found, rows = shuffled(spark, lambda: best_matches(transient(batch), base).collect())
    # the lead with the number: 0.35 + 0.8 * 0.25 + 0.20 + 0.15, and 0.05 with a hint; else the first with a hint
    want = {k: (k, 0.95 if k % 10 == 0 else 0.9) if k % 3 == 0 and k else (10, 0.75) for k in range(500)}
    assert {r.probe: (r.lead_id, round(r.confidence, 6)) for r in found} == want
    assert rows < 20_000  # of 250,000 pairs


def test_ingest_of_copies_without_their_pairs(spark):
    base, batch = copies(spark, 500)
    out, rows = shuffled(spark, lambda: ingest(batch, base, now()).details.collect())
    want = {k: (k, 0.95 if k % 10 == 0 else 0.9) if k % 3 == 0 and k else (10, 0.75) for k in range(500)}
    assert {r.pos: (r.lead_id, r.match_confidence) for r in out} == want
    assert rows < 60_000  # of 375,000 pairs


def test_totals_without_texts_of_leads_that_meet_nobody(spark):
    base = leads(spark, [person(k, f"Ada{k}", "Berg", f"One{k}", f"a{k}@one{k}.com", f"+1 555 {k:07}") for k in range(1, 2001)])
    rows = [{"email": f"b{k}@two{k}.com", "name": f"Bo{k} Lee", "company": f"Two{k}", "phone": f"+44 20 {k:08}"} for k in range(2000)]
    rows += [{"email": "a7@one7.com", "name": "Ada7 Berg", "company": "One7", "phone": "+1 555 0000007"}]
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        got, n = shuffled(spark, lambda: totals(ingest(subs(spark, rows), base, now()).details).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    assert [r[:2] for r in got] == [(2000, 1)]
    assert n < 70_000  # 82,058 with the texts of all


def test_leads_after_without_columns_that_no_lead_has(spark):
    base, batch = copies(spark, 200)
    batch = batch.withColumn("page_url", F.expr("array_join(transform(sequence(1, 200), i -> md5(pos || '-' || i)), '')"))
    out = ingest(batch, base, now())
    assert out.leads.count() == 200
    table = Path(storage._made[spark.sparkContext.applicationId][-1])
    got = sum(x.stat().st_size for x in table.glob("*.parquet"))
    assert 0 < got < 100_000  # of 640,000 at least


@pytest.mark.parametrize("name", ["audit", "after", "totals"])
def test_outputs_of_copies_without_their_pairs(spark, name):
    base, batch = copies(spark, 400)
    use = {"audit": lambda out: out.log, "after": lambda out: out.leads, "totals": lambda out: totals(out.details)}[name]
    got, rows = shuffled(spark, lambda: use(ingest(batch, base, now())).collect())
    if name == "audit":
        assert sorted(r.lead_id for r in got) == sorted(k if k % 3 == 0 and k else 10 for k in range(400))
    elif name == "after":
        assert {r.id: r.phone_number for r in got} == {r.id: r.phone_number for r in base.collect()}
    else:
        assert [r[:2] for r in got] == [(0, 400)]
    assert rows < 50_000  # of 240,000 pairs


def tables_left(spark, name):
    """How many tables an ingest and one of its outputs leave."""
    base, batch = copies(spark, 20)
    since = storage.mark(spark)
    out = ingest(batch, base, now())
    {"audit": lambda: out.log, "after": lambda: out.leads, "totals": lambda: totals(out.details)}[name]().collect()
    return storage.mark(spark) - since


def test_audit_leaves_no_tables_of_its_way(spark):
    assert tables_left(spark, "audit") == 2  # submissions, and what became of each


def test_leads_after_leave_no_tables_of_their_way(spark):
    assert tables_left(spark, "after") == 3  # and the submissions with what became of them


def test_totals_leave_no_tables_of_their_way(spark):
    assert tables_left(spark, "totals") == 2


def test_written_leaves_no_shuffles(spark):
    files = lambda: {f for f in (x.getName() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())) if f.startswith("shuffle_")}
    before = files()
    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    table = storage.written(rows)
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 100
