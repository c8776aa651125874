from pyspark.sql import functions as F

from leadloom.operators import model as M
from leadloom.operators import blocking, components, directory, scoring
from leadloom.plans import dedupe
from leadloom.schemas import LEAD

FIELDS = ("first_name", "last_name", "full_name", "company_name", "email", "phone_number", "phone_normalized", "notes")


def leads(spark, rows):
    plain = [{"id": r["id"], **{f: r.get(f) for f in FIELDS}} for r in rows]
    schema = "id long, " + ", ".join(f"{f} string" for f in FIELDS)
    df = spark.createDataFrame([(p["id"], *(p[f] for f in FIELDS)) for p in plain], schema)
    rest = [f for f in LEAD if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])


def person(i, first, last, company, email, phone=None, notes=None):
    return {"id": i, "first_name": first, "last_name": last, "full_name": f"{first} {last}", "company_name": company, "email": email, "phone_number": phone, "notes": notes}


def score(spark, a, b):
    df = leads(spark, [a | {"id": 1}, b | {"id": 2}])
    pairs = spark.createDataFrame([(1, 2)], "lead_id_1 long, lead_id_2 long")
    return scoring.scored(pairs, df, df, at_least=None).first()


def test_keys(spark):
    got = {(r.key_type, r.key) for r in blocking.keys(leads(spark, [person(1, "Joon", "Diallo", "Acme Ltd", " Joon@Acme.com ", "+82 10-2476-5835")])).collect()}
    assert got == {("email_exact", "joon@acme.com"), ("phone_normalized", "821024765835"), ("phone_suffix_10", "1024765835"), ("domain_lastname", "acme.com |dia"), ("company_firstname", "acme|joo")}


def test_scores(spark):
    joon = person(1, "Joon", "Diallo", "Kanda Robotics", "joon@kanda.com", "+82 10-2476-5835")
    same = score(spark, joon, joon)
    assert same.confidence >= 0.9 and same.email == same.name == same.phone == 1
    variant = score(spark, joon, person(2, "J.", "Diallo", "Kanda Robotics & Co", "joon@kanda.com", "821024765835"))
    assert variant.confidence >= 0.7 and variant.email == variant.phone == variant.company == 1
    assert score(spark, joon, person(2, "Mara", "Olsen", "Fjord Foods", "mara@fjord.no", "+47 22 33 44 55")).confidence < 0.2
    near = score(spark, person(1, "Arun", "Kapoor", "Same Works", "arun.kapoor@same.io", "+91 1111111111"), person(2, "Arjun", "Kapoor", "Same Works", "arjun.kapoor@same.io", "+91 2222222222"))
    assert 0.58 < near.confidence < 0.6
    family = score(spark, person(1, "Ada", "Berg", "One", "ada@one.com", "+1 5551234567"), person(2, "Carl", "Stone", "Two", "carl@two.com", "+1 5551234567"))
    assert family.confidence < 0.6
    sparse = score(spark, {"id": 1, "email": "a@x.com"}, {"id": 2, "email": "b@x.com"})
    assert sparse.confidence < 0.6
    # equal empty domains
    assert score(spark, {"id": 1, "email": "anna"}, {"id": 2, "email": "annas"}).email == 0.7


def test_threshold_holds_equal_signals(spark):
    a, b = {"id": 1, "email": "a@x.com", "phone_number": "5551234567"}, {"id": 2, "email": "a@x.com", "phone_number": "5551234567"}
    df = leads(spark, [a, b])
    assert scoring.scored(blocking.candidate_pairs(df), df, df).count() == 1


def test_bucket_cap(spark):
    rows = [{"id": i, "email": "fifty@x.com"} for i in range(50)] + [{"id": 100 + i, "email": "more@x.com"} for i in range(51)]
    df = leads(spark, rows)
    got = blocking.candidate_pairs(df).agg(F.count("*"), F.max("lead_id_2")).first()
    assert tuple(got) == (50 * 49 // 2, 49)


def test_pairs_plan_has_no_nested_loop(spark):
    df = leads(spark, [person(1, "A", "Bee", "C", "a@b.c")])
    plan = blocking.candidate_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def clusters_of(spark, pairs):
    df = spark.createDataFrame(pairs, "lead_id_1 long, lead_id_2 long")
    out = {}
    for r in components.components(df).collect():
        out.setdefault(r.component, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_components(spark):
    assert clusters_of(spark, [(1, 2), (2, 3), (3, 4)]) == [[1, 2, 3, 4]]
    assert clusters_of(spark, [(10, 20), (30, 40)]) == [[10, 20], [30, 40]]
    assert clusters_of(spark, [(1, 2), (2, 3), (1, 3)]) == [[1, 2, 3]]
    assert clusters_of(spark, [(i, i + 1) for i in range(1, 60)]) == [list(range(1, 61))]
    assert clusters_of(spark, []) == []


class Fake:
    def remarks(self, pairs):
        return pairs.select("lead_id_1", "lead_id_2", F.concat(F.lit("seen "), F.col("lead_1.email")).alias("remark"))


def test_resolution_with_remarks_and_reviews(spark):
    rows = [person(1, "Ada", "Berg", "One", "ada@one.com", "5551234567"), person(2, "Ada", "Berg", "One", "ada@one.com", "5551234567"), person(3, "A.", "Berg", "One Ltd", "ada@one.com", None), person(9, "Zed", "Null", "Q", "z@q.com")]
    first = dedupe.resolve(leads(spark, rows), Fake())
    found = {(r.lead_id_1, r.lead_id_2): r for r in first.candidates.collect()}
    assert set(found) >= {(1, 2)} and found[1, 2].explanation.endswith(" | LLM: seen ada@one.com") and found[1, 2].status == "pending"
    grouped = {r.id: r.dedup_group_id for r in first.leads.collect()}
    assert grouped[1] == grouped[2] and grouped[9] is None
    said = directory.reviewed(first.candidates, spark.createDataFrame([(1, 2, "confirmed")], "lead_id_1 long, lead_id_2 long, status string"))
    again = dedupe.resolve(leads(spark, rows), earlier=said, keep_reviews=True).candidates
    assert {(r.lead_id_1, r.lead_id_2): r.status for r in again.collect()}[1, 2] == "confirmed"
    whole = components.clusters_with_leads(first.candidates, leads(spark, rows)).first()
    assert [x.id for x in whole.leads] == whole.lead_ids


def test_model_remarks(spark):
    note = "n" * 300
    rows = [person(1, "Ada", "Berg", "One", "ada@one.com", "5551234567", note), person(2, "Ada", "Berg", "One", "ada@one.com", "5551234567"), person(3, "Ada", "Berg", "One Ltd", "ada@one.com", "5551234567")]
    df = leads(spark, rows)
    found = dedupe.find_candidates(df)
    seen = spark.sparkContext.accumulator(0)

    def call(prompt):
        seen.add(1)
        shown = max(len(line) for line in prompt.split("\n") if line.startswith("- Notes: ")) - len("- Notes: ")
        assert prompt.count("- Name: Ada Berg") == 2
        return f'```json\n{{"is_duplicate": true, "confidence": 0.9, "explanation": "notes {shown}"}}\n```'

    first = {(r.lead_id_1, r.lead_id_2): r.explanation for r in dedupe.remarked(found, df, M.ModelVerifier(M.CalledModel(call))).collect()}
    assert len(first) == 3 and first[1, 2].endswith(" | LLM: notes 200") and first[2, 3].endswith(" | LLM: notes 0") and seen.value == 3
    # known remarks are used again; only what is new is asked
    earlier = found.filter("lead_id_1 = 1").withColumn("explanation", F.lit("x | LLM: known"))
    again = {(r.lead_id_1, r.lead_id_2): r.explanation for r in dedupe.remarked(found, df, M.ModelVerifier(M.CalledModel(call)), earlier).collect()}
    assert again[1, 2].endswith(" | LLM: known") and again[2, 3].endswith(" | LLM: notes 0") and seen.value == 4

    class Broken:
        def remarks(self, pairs):
            raise RuntimeError("no model")

    for verifier in (Broken(), M.ModelVerifier(M.CalledModel(lambda p: "not json")), M.ModelVerifier(M.CalledModel(lambda p: 1 / 0))):
        assert all(" | LLM: " not in r.explanation for r in dedupe.remarked(found, df, verifier).collect())
