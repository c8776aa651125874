"""Form submissions against the population of leads: update the best match or create a lead.

Submissions count in the order of ``pos``: one sees what earlier ones created
or filled in. What one can change for another is little: a created lead, a
phone number that was missing, or the hint in the notes. So everything else is
computed once for the whole batch:

1. Submissions and leads that read alike in all but number and hint are a class;
   a lead that comes to be belongs to that of its submission. Pairs of classes
   with a common key, or a number in common, each with the scores that never
   change. Pairs that could not reach the threshold with any change are dropped.
2. Pairs that come to share a number only: a lead without one may get it from
   one submission and be found by it by another.
3. Components of these pairs. Submissions of different components can't affect
   each other; those of one are gone through in order, as a stream of sorted
   rows. Of leads that differ in nothing that counts only the first can be
   chosen, so what is kept meanwhile is the first by class, number and hint.
4. What became of each submission is kept as numbers; outputs are made of that
   when they are asked for. Tables that led to it are deleted on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..schemas import SUBMISSION
from ..storage import discarded, written
from . import classes
from .attribution import source
from .blocking import plain_kinds
from .components import components
from .scoring import THRESHOLD, WEIGHTS, phone_score

#: Positions in a block when new ids are dealt in order.
_BLOCK = 100_000


#: What a pair without a common domain or number can reach at most.
_WITHOUT_CONTACT = WEIGHTS["name"] + WEIGHTS["company"] + WEIGHTS["notes_hint"] + 1e-9


def transient(subs: DataFrame, *more: Column | str) -> DataFrame:
    """Submissions with the columns of leads that blocking and scoring read, and ``more``; ``id`` is pos."""
    who = N.name(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("name"))
    return subs.withColumn("__who", who).select(
        F.col("pos").alias("id"),
        F.col("__who.first").alias("first_name"),
        F.col("__who.last").alias("last_name"),
        F.col("__who.full").alias("full_name"),
        F.coalesce(F.nullif("company", F.lit("")), F.lit("Unknown")).alias("company_name"),
        N.email(F.col("email")).alias("email"),
        F.col("phone").alias("phone_number"),
        N.phone(F.col("phone")).alias("phone_normalized"),
        F.col("message").alias("notes"),
        *more,
    )


def best_matches(probes: DataFrame, leads: DataFrame, threshold: float = THRESHOLD, order: str = "id") -> DataFrame:
    """probe, lead_id, confidence of the best lead for each probe that has one; the least ``order`` among equals.

    Of a class of leads only the first can be best, so probes and leads meet by
    class, and by class and number where they share one. Pairs by class count
    no number: where there is one, the other pairs say more of the same leads.
    """
    kinds = plain_kinds(threshold > _WITHOUT_CONTACT)
    x = written(classes.members(probes, kinds, hint=True))
    y = written(classes.members(leads, kinds, F.col(order).alias("rank"), hint=True))
    first = F.min(F.struct("rank", "id")).alias("first")
    of_class = lambda df, *more: df.groupBy("class").agg(F.first("f").alias("f"), F.first("k").alias("k"), *more)
    left, right = of_class(x), of_class(y, first)
    hint = F.when(F.col("a.hint") | F.col("b.hint"), 1.0).otherwise(0.0)

    def best(pairs: DataFrame, phone: Column, *by: str) -> DataFrame:
        found = classes.with_scores(pairs.withColumns({"phone": phone, "notes_hint": hint}))
        found = found.withColumn("confidence", sum((F.col(k) * WEIGHTS[k] for k in list(WEIGHTS)[1:]), F.col("email") * WEIGHTS["email"])).filter(F.col("confidence") >= threshold)
        return found.groupBy(*by).agg(F.max(F.struct("confidence", (-F.col("first.rank")).alias("rank"), F.col("first.id").alias("lead_id"))).alias("b"))

    none = F.lit(0.0)
    plain = best(classes.keyed_pairs(left, right, classes.reach(none, hint) >= threshold - 1e-9), none, "class")
    number = lambda df, *more: df.filter("number <> ''").groupBy("class", "number").agg(F.first("f").alias("f"), F.first("k").alias("k"), *more).withColumn("tail", classes.tail(F.col("number")))
    mine = number(x).select("class", "number", "tail", F.col("f").alias("a"), F.col("k").alias("ka"))
    theirs = number(y, first).select(F.col("number").alias("their"), "tail", F.col("f").alias("b"), F.col("k").alias("kb"), "first")
    phone = phone_score(F.struct(F.col("number").alias("phone")), F.struct(F.col("their").alias("phone")))
    pairs = mine.join(theirs, "tail")
    pairs = pairs.filter((phone > 0) & (classes.plain(pairs) | (F.length("number") >= 7)) & (classes.reach(phone, hint) >= threshold - 1e-9))
    numbered = best(pairs, phone, "class", "number")
    found = x.select("id", "class").join(plain, "class").select("id", "b").unionByName(x.select("id", "class", "number").join(numbered, ["class", "number"]).select("id", "b"))
    found = found.groupBy(F.col("id").alias("probe")).agg(F.max("b").alias("b"))
    return found.select("probe", F.col("b.lead_id").alias("lead_id"), F.col("b.confidence").alias("confidence"))


def _form(text: Column) -> Column:
    return F.concat(F.lit("[Form: "), F.coalesce("form_name", F.lit("None")), F.lit("] "), text)


def _prepared(valid: DataFrame) -> DataFrame:
    """Members of classes (``id`` is pos, ``hint`` that of the message) and what a submission can change: once for each."""
    form = _form(F.col("message"))
    flags = (
        (F.coalesce("phone", F.lit("")) != "").alias("gives_phone"),
        ((F.coalesce("message", F.lit("")) != "") & _hint(form)).alias("hint_new"),
        ((N.strip(F.coalesce("message", F.lit(""))) != "") & _hint(form)).alias("hint_add"),
    )
    return classes.members(transient(valid, *flags), plain_kinds(True), "gives_phone", "hint_new", "hint_add")


def _reaching(pairs: DataFrame, phone: float, threshold: float) -> DataFrame:
    """Pairs of classes that may come to reach the threshold with ``phone``, with the scores that stay."""
    may = F.lit(phone)
    out = classes.with_scores(pairs.filter(classes.reach(may, F.lit(1.0)) >= threshold - 1e-9).withColumn("plain", classes.plain(pairs)))
    total = F.col("email") * WEIGHTS["email"] + may * WEIGHTS["phone"] + F.col("name") * WEIGHTS["name"] + F.col("company") * WEIGHTS["company"] + WEIGHTS["notes_hint"]
    return out.filter(total >= threshold - 1e-9).select("class", "target", "email", "name", "company", "plain")


def _texts(probes: DataFrame, known: DataFrame) -> DataFrame:
    """class, f, k, n, own of each class: ``n`` is over 1 if it has leads or more than one submission, ``own`` says whether it has submissions."""
    of = lambda df, n, own: df.select("class", "f", "k", F.lit(n).alias("n"), F.lit(own).alias("own"))
    both = of(probes, 1, True).unionByName(of(known, 2, False))
    return both.groupBy("class").agg(F.first("f").alias("f"), F.first("k").alias("k"), F.sum("n").alias("n"), F.bool_or("own").alias("own"))


def _ends(probes: DataFrame, known: DataFrame) -> DataFrame:
    """class, tail, n (as in ``_texts``), mine (submissions only): ends of numbers that a submission has in common with a lead or another submission."""
    of = lambda df, n, mine: df.filter("number <> ''").select("class", classes.tail(F.col("number")).alias("tail"), F.lit(n).alias("n"), F.lit(mine).alias("mine"))
    both = of(probes, 1, 1).unionByName(of(known, 2, 0))
    shared = both.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("mine").alias("mine")).filter("n > 1 AND mine > 0").select("tail")
    return both.join(shared, "tail", "left_semi").groupBy("class", "tail").agg(F.sum("n").alias("n"), F.sum("mine").alias("mine"))


def _meeting(texts: DataFrame, numbered: DataFrame, fillable: DataFrame) -> DataFrame:
    """Those of ``texts`` by which a submission may meet a lead; ``keyed`` and ``numbered`` say by what, ``fillable`` whether a member may get a number.

    Keys are told by hashes alone (what has none in truth does no harm); the
    texts of all other classes go no further.
    """
    keys = F.array_compact(F.array(*[F.when(F.col("k")[c].isNotNull(), F.xxhash64(F.lit(i), F.col("k")[c])) for i, c in enumerate(texts.schema["k"].dataType.names)]))
    each = texts.select("class", "n", "own", F.explode(keys).alias("h"))
    useful = each.groupBy("h").agg(F.bool_or("own").alias("own"), F.count("*").alias("m"), F.max("n").alias("n")).filter("own AND (m > 1 OR n > 1)").select("h")
    keyed = each.select("class", "h").join(useful, "h", "left_semi")
    parts = {"keyed": keyed, "numbered": numbered, "fillable": fillable}
    each = [df.select("class", *[F.lit(flag == f).alias(f) for f in parts]) for flag, df in parts.items()]
    some = written(each[0].unionByName(each[1]).unionByName(each[2]).groupBy("class").agg(*[F.bool_or(f).alias(f) for f in parts]).filter("keyed OR numbered"))
    out = written(texts.join(some, "class"))
    discarded(some)
    return out


def _links(probes: DataFrame, known: DataFrame, both: DataFrame, threshold: float) -> DataFrame:
    """class, target, email, name, company, plain: the classes where submissions of a class may find a lead. ``both``: ``_texts`` of them, deleted on the way."""
    # a class by itself counts if it has leads or more than one submission
    met = (F.col("class") != F.col("target")) | (F.col("n") > 1)
    fillable = known.filter("fillable").select("class").unionByName(probes.filter("NOT gives_phone").select("class")).distinct()
    ends = written(_ends(probes, known))
    meeting = _meeting(both, ends, fillable)
    discarded(both)
    mine = lambda flag: meeting.filter(f"own AND {flag}").select("class", "f", "k")
    theirs = lambda flag: meeting.filter(flag).select("class", "f", "k", "n")
    linked = written(_reaching(classes.keyed_pairs(mine("keyed"), theirs("keyed"), met & (classes.reach(F.lit(0.0), F.lit(1.0)) >= threshold - 1e-9)), 0.0, threshold))

    pair = ["class", "target"]
    numbers = ends.filter("mine > 0").select("class", "tail", F.col("mine").alias("n"))
    their = ends.select(F.col("class").alias("target"), "tail", "n")
    sharing = numbers.drop("n").join(their, "tail").filter(met).select(*pair).distinct().join(linked.select(*pair), pair, "left_anti")
    direct = written(linked.unionByName(_reaching(classes.told(sharing, mine("numbered"), theirs("numbered")), 1.0, threshold)))
    discarded(linked)
    # a number that a lead may get from one submission leads others to it
    again = numbers.groupBy("tail").agg(F.sum("n").alias("n")).filter("n > 1").select("tail")
    numbers = numbers.select("class", "tail").join(again, "tail", "left_semi")
    given = direct.select(*pair).join(meeting.filter("fillable").select(F.col("class").alias("target")), "target", "left_semi").join(numbers, "class").select("tail", "target").distinct()
    moved = given.join(numbers, "tail").select(*pair).distinct().join(direct.select(*pair), pair, "left_anti")
    out = written(direct.unionByName(_reaching(classes.told(moved, mine("numbered"), theirs("fillable")), 1.0, threshold)))
    discarded(direct, ends, meeting)
    return out


def _rows(probes: DataFrame, known: DataFrame, links: DataFrame, part: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What ``_in_order`` reads, by component: its links, then the leads that can be chosen first, then its submissions; and the tables that it is made of.

    Leads and submissions are placed one after the other, so that the shuffles of one are gone before the next; ``probes`` and ``known`` are deleted.
    """
    part = part.withColumnRenamed("id", "c_id")
    placed = lambda df: df.join(part, F.col("class") == F.col("c_id")).drop("c_id")
    leads = placed(known.select("id", "class", "number", "fillable", "hint"))
    lead = F.struct("id", "number", "fillable", "hint")
    # of leads that differ in nothing that counts, the first one is met first
    first = leads.groupBy("component", "class").agg(F.min(lead).alias("one"), F.min(F.when(F.col("hint"), lead)).alias("two"))
    first = first.select("component", "class", F.explode(F.array("one", "two")).alias("lead")).filter("lead IS NOT NULL")
    tails = probes.filter("number <> ''").select(classes.tail(F.col("number")).alias("tail")).distinct()
    met = leads.filter("number <> ''").withColumn("tail", classes.tail(F.col("number"))).join(tails, "tail", "left_semi")
    met = met.groupBy("component", "class", "number", "hint", F.when(F.col("fillable"), F.col("id")).alias("own")).agg(F.min(lead).alias("lead"))
    leads = written(first.unionByName(met.select("component", "class", "lead")))
    discarded(known)
    asking = written(placed(probes))
    discarded(probes)

    def rows(df: DataFrame, kind: int, **values: Column) -> DataFrame:
        return df.select("component", F.lit(kind).alias("kind"), *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in _ROW.items()])

    col = lambda *names: {c: F.col(c) for c in names}
    out = (
        rows(placed(links), 0, **col("class", "target", "email", "name", "company", "plain"))
        .unionByName(rows(leads, 1, pos=F.col("lead.id"), number=F.col("lead.number"), phone=F.col("lead.fillable"), hint=F.col("lead.hint"), **col("class")))
        .unionByName(rows(asking, 2, pos=F.col("id"), phone=F.col("gives_phone"), **col("class", "number", "hint", "hint_new", "hint_add")))
    )
    return out, [leads, asking]


def _actions(valid: DataFrame, leads: DataFrame, top: int, threshold: float) -> DataFrame:
    """pos, target, confidence of the submissions that meet a lead (of the batch: -pos - 1); all others create one."""
    if threshold <= _WITHOUT_CONTACT:
        raise ValueError("names and companies alone must not make a match")
    whole = written(_prepared(valid))
    empty = F.coalesce("phone_number", F.lit("")) == ""
    whole_known = written(classes.members(leads, plain_kinds(True), empty.alias("fillable")))
    both = written(_texts(whole, whole_known))
    # from here on texts and keys are those of classes
    probes = written(whole.drop("f", "k"))
    discarded(whole)
    known = written(whole_known.drop("f", "k"))
    discarded(whole_known)
    links = _links(probes, known, both, threshold)
    part = components(links, "class", "target")
    rows, placed = _rows(probes, known, links, part)
    rows = rows.repartition("component").sortWithinPartitions("component", "kind", "pos").select("component", "kind", *_ROW)
    out = written(rows.mapInArrow(_in_order(threshold, top), "pos bigint, target bigint, confidence double"))
    discarded(*placed, links, part)
    return out


#: Columns after component and kind; ``phone``: whether a lead lacks a number, or a submission gives one.
_ROW = {
    "pos": "bigint", "class": "binary", "target": "binary", "email": "double", "name": "double", "company": "double", "plain": "boolean", "number": "string",
    "phone": "boolean", "hint": "boolean", "hint_new": "boolean", "hint_add": "boolean",
}


def _numbers_score(x: str, y: str) -> float:
    if not x or not y:
        return 0.0
    return 1.0 if x == y else 0.8 if len(x) >= 10 and len(y) >= 10 and x[-10:] == y[-10:] else 0.0


class _Lead:
    """A lead that a submission may choose."""

    __slots__ = ("rank", "id", "class_", "number", "fillable", "hint")

    def __init__(self, rank: int, id: int, class_: bytes, number: str, fillable: bool, hint: bool) -> None:
        self.rank, self.id, self.class_, self.number, self.fillable, self.hint = rank, id, class_, number, fillable, hint


class _Leads:
    """Of leads by class, and by class and number: the first, and the first with a hint. One with a number that can still change is kept by itself."""

    def __init__(self) -> None:
        self.first: dict[bytes, list[_Lead | None]] = {}
        self.numbered: dict[str, dict[bytes, dict[str, tuple[list[_Lead | None], list[_Lead]]]]] = {}

    @staticmethod
    def _least(two: list[_Lead | None], lead: _Lead) -> None:
        if two[0] is None or lead.rank < two[0].rank:
            two[0] = lead
        if lead.hint and (two[1] is None or lead.rank < two[1].rank):
            two[1] = lead

    def add(self, lead: _Lead) -> None:
        """Takes in a new lead, or one with a new hint or number."""
        self._least(self.first.setdefault(lead.class_, [None, None]), lead)
        if lead.number:
            two, apart = self.numbered.setdefault(lead.number[-10:], {}).setdefault(lead.class_, {}).setdefault(lead.number, ([None, None], []))
            if not lead.fillable:
                self._least(two, lead)
            elif lead not in apart:
                apart.append(lead)

    def fill(self, lead: _Lead, number: str) -> None:
        if lead.number:
            self.numbered[lead.number[-10:]][lead.class_][lead.number][1].remove(lead)
        lead.number, lead.fillable = number, False
        self.add(lead)

    def choices(self, class_: bytes, number: str, plain: bool) -> Iterator[tuple[float, _Lead]]:
        """Phone score and lead, of all that may be best; a score of 0 may fall short where a choice with a number follows."""
        if plain:
            for lead in self.first.get(class_, ()):
                if lead is not None:
                    yield 0.0, lead
        if number:
            for theirs, (two, apart) in self.numbered.get(number[-10:], {}).get(class_, {}).items():
                phone = _numbers_score(number, theirs)
                if phone:
                    for lead in (*two, *apart):
                        if lead is not None:
                            yield phone, lead


def _in_order(threshold: float, top: int):
    """Goes through sorted rows; keeps of each component its links and the leads that can be chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = tuple(WEIGHTS[k] for k in ("email", "phone", "name", "company", "notes_hint"))
        component = None
        links: dict[bytes, list[tuple]] = {}
        there, seen = _Leads(), set()
        out: list[tuple[int, int, float]] = []

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.float64())
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["pos", "target", "confidence"])
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "kind", *_ROW)]
            for c, kind, pos, class_, target, email, name, company, plain, number, phone_flag, hint, hint_new, hint_add in zip(*columns):
                if c != component:
                    component, links, there, seen = c, {}, _Leads(), set()
                if kind == 0:
                    links.setdefault(class_, []).append((target, email, name, company, plain))
                    continue
                if kind == 1:
                    if pos not in seen:
                        seen.add(pos)
                        there.add(_Lead(pos, pos, class_, number, phone_flag, hint))
                    continue
                best, score = None, 0.0
                for target, email, name, company, plain in links.get(class_, ()):
                    for phone, lead in there.choices(target, number, plain):
                        hints = 1.0 if hint or lead.hint else 0.0
                        confidence = email * weight[0] + phone * weight[1] + name * weight[2] + company * weight[3] + hints * weight[4]
                        if confidence >= threshold and (best is None or confidence > score or confidence == score and lead.rank < best.rank):
                            best, score = lead, confidence
                if best is None:
                    there.add(_Lead(top + 1 + pos, -pos - 1, class_, number, not phone_flag, hint_new))
                    continue
                if hint_add and not best.hint:
                    best.hint = True
                    there.add(best)
                if phone_flag and best.fillable:
                    there.fill(best, number)
                out.append((pos, best.id, score))
            if len(out) >= 10_000:
                yield flush()
        yield flush()

    return run


#: Columns of a submission that leads are made of.
_OF_LEADS = ("form_name", "submitted_at", "name", "email", "phone", "company", "country", "message")


class Ingested:
    """What a batch did; an output is made when it is asked for, so what others need isn't made for it."""

    def __init__(self, subs: DataFrame, before: DataFrame, now: Column, decided: DataFrame) -> None:
        self._subs, self._before, self._now, self._decided = subs, before, now, decided

    @cached_property
    def details(self) -> DataFrame:
        """pos, email, action, lead_id, match_confidence of each submission."""
        action = F.when(F.col("skipped"), "skipped").when(F.col("created"), "created").otherwise("updated")
        subs = self._subs.select("pos", F.coalesce("clean_email", "email").alias("email"), F.col("clean_email").isNull().alias("skipped"))
        return subs.join(self._decided, "pos", "left").select("pos", "email", action.alias("action"), "lead_id", F.round("confidence", 4).alias("match_confidence"))

    @cached_property
    def log(self) -> DataFrame:
        """The submissions as they came in, with the lead of each."""
        return self._subs.join(self._decided.select("pos", "lead_id"), "pos").select(
            "form_id", "form_name", "page_url", N.date(F.col("submitted_at")).alias("submitted_at"), F.to_json(F.struct(*SUBMISSION.names), {"ignoreNullFields": "false"}).alias("raw_payload"), "lead_id"
        )

    @cached_property
    def _step(self) -> DataFrame:
        return written(self._subs.select("pos", *_OF_LEADS).join(self._decided.select("pos", "lead_id", "created"), "pos"))

    def _with_step(self, before: DataFrame) -> DataFrame:
        new = _created(self._step.filter("created"), before, self._now)
        return _enriched(before.unionByName(new), self._step.filter("NOT created"))

    @cached_property
    def leads(self) -> DataFrame:
        """The leads after, which are shuffled once."""
        return self._with_step(self._before)

    @cached_property
    def changed(self) -> DataFrame:
        """The leads that changed or are new."""
        touched = self._decided.filter("NOT created").select(F.col("lead_id").alias("t_id")).distinct()
        return self._with_step(self._before.join(touched, F.col("id") == F.col("t_id"), "left_semi"))


def ingest(subs: DataFrame, leads: DataFrame, now: Column, threshold: float = THRESHOLD) -> Ingested:
    """``details``, the ``leads`` after, the form ``log``, and the leads that ``changed`` or are new.

    ``subs``: pos and the columns of a submission. ``now``: creation time of
    leads whose submission has none. Ids of new leads follow the greatest id,
    in the order of ``pos``.
    """
    subs = written(subs.withColumn("clean_email", N.email(F.col("email"))))
    valid = subs.filter(F.col("clean_email").isNotNull())
    top = leads.agg(F.max("id")).first()[0] or 0
    acts = _actions(valid, leads, top, threshold)
    step = written(valid.select("pos").join(acts, "pos", "left"))
    discarded(acts)
    ids = written(_dealt(step.filter("target IS NULL").select("pos"), top))
    # a target of the batch is negative until its id is dealt
    made_by = F.when(F.col("target").isNull(), F.col("pos")).when(F.col("target") < 0, -F.col("target") - 1)
    decided = step.withColumn("made_by", made_by).join(ids.withColumnRenamed("pos", "n_pos"), F.col("made_by") == F.col("n_pos"), "left")
    decided = written(decided.select("pos", F.col("target").isNull().alias("created"), F.coalesce("final", "target").alias("lead_id"), "confidence"))
    discarded(step, ids)
    return Ingested(subs, leads, now, decided)


def totals(details: DataFrame) -> DataFrame:
    """created, updated and potential_duplicates (none are told here) of a batch, one row."""
    return details.agg(F.count_if(F.col("action") == "created").alias("created"), F.count_if(F.col("action") == "updated").alias("updated"), F.lit(0).cast("long").alias("potential_duplicates"))


def _dealt(created: DataFrame, top: int) -> DataFrame:
    """pos, final: ids after ``top`` in the order of pos; blocks are counted first, then numbered within."""
    blocks = created.withColumn("block", F.floor(F.col("pos") / _BLOCK))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("block", "start")
    place = F.row_number().over(Window.partitionBy("block").orderBy("pos"))
    return blocks.withColumn("place", place).join(starts, "block").select("pos", (F.lit(top) + F.col("start") + F.col("place")).cast("long").alias("final"))


def _hint(notes: Column) -> Column:
    return F.coalesce(F.lower(notes).contains("possible duplicate"), F.lit(False))


def _enriched(population: DataFrame, step: DataFrame) -> DataFrame:
    """``population`` with the submissions of each lead added to it, in the order of pos."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    s = step.withColumn("__s", F.when(given("message"), source(F.col("message"))))
    note = F.when(N.strip(F.coalesce("message", F.lit(""))) != "", F.concat(F.lit("\n---\n"), F.regexp_replace(_form(F.col("message")), r"(?U)\s+$", "")))
    known = F.when(F.col("__s.channel") != "Other", F.col("__s"))
    each = F.struct("pos", note.alias("note"), F.when(given("phone"), F.col("phone")).alias("phone"), F.nullif(N.country(F.col("country")), F.lit("")).alias("country"), known.alias("source"))
    s = s.groupBy(F.col("lead_id").alias("__id")).agg(F.array_sort(F.collect_list(each)).alias("__each"))
    all_of = lambda c: F.filter(F.transform("__each", lambda x: x[c]), lambda v: v.isNotNull())
    out = population.join(s, F.col("id") == F.col("__id"), "left")
    out = out.withColumns({
        "__note": F.array_join(all_of("note"), ""), "__phone": F.get(all_of("phone"), F.lit(0)), "__country": F.get(all_of("country"), F.lit(0)),
        "__source": F.try_element_at(all_of("source"), F.lit(-1)),
    })
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fill_phone = F.col("__phone").isNotNull() & empty("phone_number")
    new = {
        "notes": F.when(F.col("__note") != "", N.strip(F.concat(F.coalesce("notes", F.lit("")), F.col("__note")))).otherwise(F.col("notes")),
        "phone_normalized": F.when(fill_phone, N.phone(F.col("__phone"))).otherwise(F.col("phone_normalized")),
        "phone_number": F.when(fill_phone, F.col("__phone")).otherwise(F.col("phone_number")),
        "country": F.when(F.col("__country").isNotNull() & empty("country"), F.col("__country")).otherwise(F.col("country")),
        "ai_source_channel": F.coalesce("__source.channel", "ai_source_channel"),
        "ai_source_detail": F.when(F.col("__source").isNotNull(), F.col("__source.detail")).otherwise(F.col("ai_source_detail")),
    }
    return out.withColumns(new).select(*population.columns)


def _created(step: DataFrame, population: DataFrame, now: Column) -> DataFrame:
    rows = transient(step, *[c for c in step.columns if c != "email"])
    found = source(F.col("message"))
    given = F.coalesce(F.col("message"), F.lit("")) != ""
    values = {
        "id": F.col("lead_id"),
        "first_name": F.col("first_name"),
        "last_name": F.col("last_name"),
        "full_name": F.col("full_name"),
        "company_name": F.col("company_name"),
        "email": F.col("email"),
        "phone_number": F.col("phone"),
        "phone_normalized": F.col("phone_normalized"),
        "country": N.country(F.col("country")),
        "lead_status": F.lit("new"),
        "lifecycle_stage": F.lit("Lead"),
        "notes": F.when(given, _form(F.col("message"))),
        "ai_source_channel": found["channel"],
        "ai_source_detail": found["detail"],
        "original_create_date": F.when(F.coalesce("submitted_at", F.lit("")) != "", N.date(F.col("submitted_at"))).otherwise(now),
        "created_at": now,
        "updated_at": now,
    }
    kinds = {f.name: f.dataType for f in population.schema}
    return rows.select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in population.columns])
