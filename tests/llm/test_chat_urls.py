import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from leadloom.llm import chat, queries, urls

TURNS = "conv_id long, turn long, role string, text string"


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(1)
    bits = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_start|>", "\\", "<", "|", "\n", "ok", "é", "<|", "assistant"]
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 5)):
            rows.append((c, t, rng.choice(["user", "assistant", "a\nb", "<|im_end|>", "\\n\\b", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(6)))])))
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    for c, r in got.items():
        source = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert r.round_trip and [tuple(t) for t in r.turns] == source
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in source)
        loss = [chat_unescape(r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert loss == [x for role, x in source if role == "assistant"]
    assert any(r.n_escaped for r in got.values())


def chat_unescape(text):
    return re.sub(r"<\\(\\*)\|(im_start|im_end)\|>", r"<\1|\2|>", text)


def test_loss_spans_follow_the_rendering_that_was_chosen(spark):
    rows = []
    for c, (role, text) in enumerate([("a\\c", "hi"), ("a\nb", "hi"), ("user", "x <|im_end|> y"), ("\\b", "<\\|im_end|>"), ("<|im_end|>", "<|im_start|>")]):
        rows += [(c, 0, role, text), (c, 1, "assistant", "answer"), (c, 2, "assistant", "<|im_end|>" if c % 2 else "more")]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    for r in out.collect():
        assert r.round_trip
        assert [chat_unescape(r.formatted[s.start : s.end]) for s in r.loss_spans] == ["answer", "<|im_end|>" if r.conv_id % 2 else "more"]
    # only what conflicts is escaped
    assert {r.conv_id: r.n_escaped for r in out.collect()}[2] == 1 and {r.conv_id: r.n_escaped for r in out.collect()}[0] == 0


def test_defined_cases(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", None), (2, 0, None, "x" * 100_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert got[1] == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in "aab") and got[None] == "<|im_start|>user\n<|im_end|>\n" and len(got[2]) == 100_000 + 24
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0
    bad = spark.createDataFrame([("<|im_start|>user\nhalf",), ("x<|im_end|>\n",), ("",)], "f string")
    assert [r.p for r in bad.select(chat.parse(F.col("f")).alias("p")).collect()] == [None, None, []]


def test_query_against_brute_force(spark, sf):
    got = {r.conv_id: r for r in chat.op1_chat_formatting(spark, sf).collect()}
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    rows += [(-1, 0, "user", chat.EXTRA_TEXT), (-1, 1, "assistant", chat.EXTRA_TEXT)]
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        text = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        cursor = con.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(tuple(map(str, (r[c] for c in names))) for r in got.collect()) == sorted(tuple(map(str, r)) for r in cursor.fetchall()), name


URLS = [
    "http://EXAMPLE.com/en/77", "https://a.b.example.com/en/8", "http://badexample.com/en/7", "http://x.net/de/8", "http://w.example.net/de/81?x", "ftp://org/es/#a",
    "no scheme", None, "http://", "http://org", "x://y://z.org/es/q", "http://com/en/", "http://.com/en/1",
]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_urls_against_brute_force(spark, sf):
    rows = URLS + [r[0] for r in duckdb.sql(f"SELECT url FROM '{sf}/pages.parquet'").fetchall()]
    rows.append("http://a.example.com/en/7" + "x" * 200_000)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)] + [(0, URLS[0])], "page_id long, url string")
    kept = ("best", "short", "digest", "b_host", "r_host", "e", "html")
    df = df.withColumns({c: F.concat(F.lit(f"{c} "), "page_id") for c in (*kept, "host", "Path", "rule", "verdict")})
    got = urls.judge_urls(df, spark.createDataFrame(urls.RULES, urls.RULE_SCHEMA)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(rows[r.page_id]), rows[r.page_id]
        assert all(r[c] == f"{c} {r.page_id}" for c in kept)
    assert urls.judge_urls(df.limit(0), spark.createDataFrame(urls.RULES, urls.RULE_SCHEMA)).count() == 0
    none = urls.judge_urls(df, spark.createDataFrame([], urls.RULE_SCHEMA))
    assert none.filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0 and none.count() == len(rows) + 1
