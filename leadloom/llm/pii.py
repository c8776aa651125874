"""Personal data: base patterns and bootstrapped contexts (DataFrame functions only).

Base spans are found in the row: the text is split at the matches of a
pattern, and lengths of pieces and matches are summed up to code point
positions. Each pattern is written so that it is linear in the length of the
text (possessive parts, and starts only where the leftmost match can start)
and finds just what the plain pattern in its comment finds.

Contexts: base spans are the seeds. The two words to the left of a seed are a
lexical pattern, words with digits left out. Other identifier-like tokens (a
digit, five characters or more) with a context are instances to be judged.
Patterns and distinct instances form a bipartite graph that is scored in turns:
a pattern by the mean score of its instances (one unknown is added, so that
few instances never suffice), an instance by the chance that any of its
patterns is right. Patterns of ``min_seeds`` distinct seeds and a score of
``min_score`` discover the instances beside them: these are seeds of their kind
in the next turn, with their own score, so that contexts beside them can be
patterns too. After ``rounds`` turns (so many generations of patterns at most)
all that was discovered are further spans of their kind. Edges are counted once however often they occur,
so copies of a document give no weight, and hot patterns or instances are
summed up before the shuffle.

Cases: a null text counts as empty; texts are searched whole; repeated rows
stay, each with its spans; a null id is kept; an empty table gives an empty
result. Columns of the input are kept, but base and added take the place of
columns with their names; the stage returns all columns as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import other_names, small_side, table, written
from .quality import _bound

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ that has 14 to 19 digits: a whole run of digits, as the greedy pattern takes no part of one
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![0-9]|[ -][0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of the gate has no match of the pattern.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<![^\s])[^\s0-9]*+[0-9][^\s]*+"
_EDGE = "[^A-Za-z0-9]+"


def _running(values: Column, plus=lambda x, y: x + y) -> Column:
    """Running sums (or other totals by ``plus``, from 0 on) of an array of bigint, in about n * sqrt(n) steps; no array is copied for each element."""

    def sums(a: Column) -> Column:
        n = F.size(a)
        block = F.ceil(F.sqrt(n)).cast("int")
        add = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, y: plus(s, y))
        part = lambda i: F.floor(i / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), part(n - 1)), lambda b: add(F.slice(a, b * block + 1, block)))
        before = lambda bs: F.transform(F.sequence(F.lit(0), F.size(bs) - 1), lambda b: add(F.slice(bs, F.lit(1), b)))

        def within(pre: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), n - 1), lambda i: plus(F.get(pre, part(i)), add(F.slice(a, part(i) * block + 1, i - part(i) * block + 1))))

        return F.when(n > 0, _bound(blocks, lambda bs: _bound(before(bs), within))).otherwise(F.array().cast("array<bigint>"))

    return _bound(values, sums)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, context>> of all matches."""

    def built(pair: Column) -> Column:
        found, pieces = pair["found"], pair["pieces"]
        ends = _running(F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("bigint")))

        def spans(e: Column) -> Column:
            return F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("value"), _context(F.get(pieces, i), i == 0).alias("context")
                ),
            )

        return _bound(ends, spans)

    return _bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces")), built)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
            doubled = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return s + F.when(i % 2 == 1, doubled).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)

    return _bound(F.regexp_replace(value, "[^0-9]", ""), total) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # the parts without leading zeros have at most three digits, before they are numbers
        return F.forall(F.split(value, r"\."), lambda p: _bound(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (F.lpad(q, 3, "0") <= "255")))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


#: Two words and the white space up to the end; what is taken is never given back, so that each start costs its two words only.
_WORDS = r"[^\s0-9@]++\s++[^\s0-9@]++\s++$"


def _context(piece: Column, first: Column) -> Column:
    """The two words that end ``piece``, without edges and in lower case; null unless both are free of digits.

    ``piece`` is all the text since the match before. Only that of the ``first``
    match begins with a word; any other goes on with the word of a match.
    """
    words = F.when(first, F.regexp_extract(piece, r"(?:^|\s)" + _WORDS, 0)).otherwise(F.regexp_extract(piece, r"\s" + _WORDS, 0))
    return _bound(words, lambda w: F.when(w != "", F.btrim(F.lower(F.regexp_replace(w, r"\s+", " ")))))


_SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string,context:string>>"


def base_spans(text: Column) -> Column:
    """All valid base spans by start, then kind."""
    found = []
    for k, kind in enumerate(KINDS):
        one = F.transform(
            F.filter(_matches(text, PATTERNS[kind]), _test(kind)),
            _as_span(k),
        )
        found.append(F.when(text.rlike(GATES[kind]), one).otherwise(F.array().cast(_SPAN)))
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*found), _by_place)).otherwise(F.array().cast(_SPAN))


def _check(kind: str):
    return lambda v: _valid(kind, v)


def _test(kind: str):
    return lambda m: _valid(kind, m["value"])


def _as_span(k: int):
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(k).alias("kind"), m["value"].alias("value"), m["context"].alias("context"))


def _by_place(a: Column, b: Column) -> Column:
    x, y = (F.struct(s["start"], s["kind"], s["end"]) for s in (a, b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def candidates(text: Column) -> Column:
    """Identifier-like tokens that hold no valid base match, with a context."""

    def cut(m: Column) -> Column:
        # without the edges of the token
        head = F.length(F.regexp_extract(m["value"], "^" + _EDGE, 0))
        core = F.regexp_replace(m["value"], f"^{_EDGE}|{_EDGE}$", "")
        start = m["start"] + head
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), F.lit(-1).alias("kind"), core.alias("value"), m["context"].alias("context"))

    def wanted(s: Column) -> Column:
        known = F.lit(False)
        for kind in KINDS:
            known = known | F.exists(F.regexp_extract_all(s["value"], F.lit(PATTERNS[kind]), F.lit(0)), _check(kind))
        return s["context"].isNotNull() & (F.length(s["value"]) >= 5) & ~known

    found = F.filter(F.transform(_matches(text, CANDIDATE), cut), wanted)
    return F.when(text.rlike("[0-9]"), found).otherwise(F.array().cast(_SPAN))


def scored_patterns(edges: DataFrame, rounds: int = 3, min_seeds: int = 3, min_score: float = 0.7) -> DataFrame:
    """context, kind, score of the patterns that discover.

    ``edges``: context, value, kind (0 to 3 for seeds, -1 for others), distinct.
    """
    pairs = edges.select("context", "value").distinct()
    base = edges.filter("kind >= 0").select("value", "kind").distinct()
    scores = base.withColumns({"score": F.lit(1.0), "is_seed": F.lit(True)})
    for step in range(rounds):
        # contexts beside the seeds of now: those of a later round can be beside discovered values only
        kinds = pairs.join(scores.filter("is_seed"), "value").select("context", "kind").distinct()
        links = pairs.join(kinds, "context")
        patterns = (
            links.join(scores.withColumnRenamed("score", "s"), ["value", "kind"], "left")
            .groupBy("context", "kind")
            .agg((F.sum(F.coalesce("s", F.lit(0.0))) / (F.count("*") + 1)).alias("score"), F.count_if("is_seed").alias("n_seeds"))
        )
        patterns = written(patterns.filter(F.col("n_seeds") >= min_seeds))
        if step < rounds - 1:
            chance = 1 - F.exp(F.sum(F.ln(1 - F.col("score"))))
            others = links.join(patterns, ["context", "kind"]).groupBy("value", "kind").agg(chance.alias("score"), (F.max("score") >= min_score).alias("sure"))
            others = others.join(base, ["value", "kind"], "left_anti").join(base.select("value", F.lit(True).alias("known")).distinct(), "value", "left")
            # what a confident pattern has discovered is a seed from now on; base seeds are none of another kind
            others = others.select("value", "kind", "score", (F.col("sure") & F.col("known").isNull()).alias("is_seed"))
            scores = written(base.withColumns({"score": F.lit(1.0), "is_seed": F.lit(True)}).unionByName(others))
    return patterns.filter(F.col("score") >= min_score).select("context", "kind", "score")


def find(docs: DataFrame, text: str = "text", rounds: int = 3, min_seeds: int = 3, min_score: float = 0.7, keep_text: bool = True) -> DataFrame:
    """``docs`` with base and added, both array<struct<start, end, kind>> (code points, end exclusive; kind: place in KINDS).

    The rows with their spans are written to the shared folder, so that the
    text is scanned once; the number that marks a row is part of that table.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = other_names([c for c in docs.columns if keep_text or c != text], ("base", "added"))
    new = {"__row": F.monotonically_increasing_id(), "__base": base_spans(t), "__other": candidates(t)}
    rows = written(docs.select(*[F.col(f"`{c}`") for c in names], *[v.alias(k) for k, v in new.items()]))
    both = rows.select("__row", F.explode(F.concat("__base", "__other")).alias("s")).select("__row", "s.*").filter("context IS NOT NULL")
    edges = written(both.select("context", F.lower("value").alias("value"), "kind").distinct())
    patterns = scored_patterns(edges, rounds, min_seeds, min_score)
    best = patterns.groupBy("context").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("as_kind"))
    found = both.filter("kind = -1").join(best, "context")
    found = found.groupBy(F.col("__row").alias("__r")).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("as_kind").alias("kind")))).alias("__new"))
    out = rows.join(small_side(found), F.col("__row") == F.col("__r"), "left")
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    none = F.array().cast(_PLACES)
    added = F.when(F.size("__base") == 0, F.col("__new")).otherwise(_clear(F.col("__base"), F.col("__new")))
    return out.select(
        *[F.col(f"`{c}`") for c in names], F.transform("__base", place).alias("base"), F.when(F.col("__new").isNull(), none).otherwise(added).alias("added")
    )


_PLACES = "array<struct<start:bigint,end:bigint,kind:int>>"
#: A place beyond all texts.
_FAR = 1 << 40


def _clear(base: Column, new: Column) -> Column:
    """Those of ``new`` that overlap none of ``base``: not the furthest end before them, nor the next start after."""
    one = lambda is_new: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(is_new).alias("new"))
    spans = F.array_sort(F.concat(F.transform(base, one(False)), F.transform(new, one(True))))

    def apart(a: Column) -> Column:
        ends = _running(F.transform(a, lambda s: F.when(s["new"], F.lit(0).cast("bigint")).otherwise(s["end"])), F.greatest)
        # from the right, as distances from a place beyond all texts, so that the nearest start is the greatest
        starts = _running(F.reverse(F.transform(a, lambda s: F.when(s["new"], F.lit(0).cast("bigint")).otherwise(F.lit(_FAR) - s["start"]))), F.greatest)

        def fits(x: Column) -> Column:
            before = lambda i: F.coalesce(F.get(x["ends"], i - 1), F.lit(0).cast("bigint"))
            after = lambda i: F.lit(_FAR) - F.coalesce(F.get(x["starts"], F.size(a) - 2 - i), F.lit(0).cast("bigint"))
            return F.filter(a, lambda s, i: s["new"] & (before(i) <= s["start"]) & (after(i) >= s["end"]))

        return _bound(F.struct(ends.alias("ends"), starts.alias("starts")), fits)

    return F.transform(_bound(spans, apart), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def written_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, keep_text=False)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"),
        written_spans(F.array_sort(F.concat("base", "added"), _by_place)).alias("spans"),
    )


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (of ``find``) with every span, and every run of spans that overlap, replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.array_sort(F.concat("base", "added"), _by_place)

    def merged(s: Column) -> Column:
        def runs(ends: Column) -> Column:
            # a span that starts where all before it have ended begins a run, which ends before the next one
            first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(ends, i - 1) <= F.get(s, i)["start"]))
            run = lambda f: F.transform(
                f,
                lambda i, k: F.struct(
                    F.get(s, i)["start"].alias("start"), F.get(ends, F.coalesce(F.get(f, k + 1), F.size(s)) - 1).alias("end"), F.get(s, i)["kind"].alias("kind")
                ),
            )
            return _bound(first, run)

        return _bound(_running(F.transform(s, lambda x: x["end"]), F.greatest), runs)

    def pieces(m: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(m, i - 1)["end"], F.lit(0).cast("bigint")).cast("int")
            return F.concat(F.substr(F.col(text), at + 1, s["start"].cast("int") - at), F.get(names, s["kind"]))

        return F.concat(F.array_join(F.transform(m, piece), ""), F.substr(F.col(text), F.element_at(m, -1)["end"].cast("int") + 1))

    return found.withColumn(text, F.when(F.size("base") + F.size("added") > 0, _bound(_bound(spans, merged), pieces)).otherwise(F.col(text)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their personal data replaced and n_chars, if they have it, counted anew; other columns as they came."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("__none"))
    out = redact(find(docs.select("text", others.alias("__doc"))))
    count = F.length(F.coalesce("text", F.lit("")))
    return out.select(
        *[
            F.col("text") if c == "text" else count.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"__doc.`{c}`").alias(c)
            for c in docs.columns
        ]
    )


#: Base spans by the plain patterns. It has no contexts: in the tables of the tests they discover nothing, and a brute-force version covers what they do.
OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), p(kind, name, pattern) AS (
  VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
    (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')
), cut AS (
  SELECT rid, kind, name, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS pieces FROM d, p WHERE regexp_matches(text, pattern)
), one AS (
  SELECT rid, kind, name, unnest(found) AS m, unnest(list_slice(pieces, 1, len(found))) AS piece, unnest(range(len(found))) AS k FROM cut
), placed AS (
  SELECT rid, kind, name, m, regexp_replace(m, '[^0-9]', '', 'g') AS digits, CAST(sum(length(piece) + length(m)) OVER (PARTITION BY rid, kind ORDER BY k) AS BIGINT) AS stop FROM one
), good AS (
  SELECT rid, kind, name, stop - length(m) AS start, stop FROM placed
  WHERE CASE kind WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(right(x, 3) AS INTEGER), 0) > 255)) = 0
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i:
      CASE WHEN i % 2 = 0 THEN CAST(substr(digits, length(digits) - i, 1) AS INTEGER)
        ELSE (2 * CAST(substr(digits, length(digits) - i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(digits, length(digits) - i, 1) AS INTEGER)) % 10 END)) % 10 = 0
    ELSE length(digits) BETWEEN 10 AND 15 END
), told AS (
  SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM good GROUP BY rid
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (rid)
"""
