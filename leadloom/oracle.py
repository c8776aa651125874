"""SQL for DuckDB with the rows of the library's queries. It shares the fixture's recipe and the tables of fixed values, nothing else."""

from __future__ import annotations

from .functions.normalize import COMPANY_WORDS, COUNTRIES, LIFECYCLES, STATUS_ALIASES
from .operators.attribution import LANDING_PAGE, NO_NOTES, NO_RULE, NO_SOURCE, RULES
from .operators.dashboard import AXES
from .queries import AS_OF_ORDERS, LEADS, SHORT
from .schemas import EXPORT_COLUMNS, LEAD_RESPONSE, SIGNALS, STATUSES, SUBMISSION
from .sources.fixture import CRM_SQL, SUBS_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def null_if_blank(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def case(key: str, values: dict[str, str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {other} END"


def status(x: str) -> str:
    clean = f"lower({strip(f'trim({strip(x)}, {q(chr(34))})')})"
    known = f"CASE WHEN {clean} IN ({', '.join(map(q, STATUSES))}) THEN {clean} ELSE 'new' END"
    return f"coalesce({case(clean, STATUS_ALIASES, known)}, 'new')"


def phone(x: str) -> str:
    digits = f"regexp_replace(regexp_replace({strip(x)}, '(?i)\\s*(?:ext\\.|ext|x)\\s*\\d+$', ''), '[^0-9]', '', 'g')"
    return f"CASE WHEN length({digits}) >= 7 THEN {digits} END"


def country(x: str) -> str:
    runs = f"regexp_extract_all(lower({null_if_blank(x)}), '\\p{{L}}+|[^\\p{{L}}]+')"
    title = f"array_to_string(list_transform({runs}, lambda r: upper(substr(r, 1, 1)) || substr(r, 2)), '')"
    return case(f"lower({null_if_blank(x)})", COUNTRIES, f"CASE WHEN {null_if_blank(x)} IS NOT NULL THEN {title} END")


def company(x: str) -> str:
    words = f"list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    kept = f"list_filter({words}, lambda w: w NOT IN ({', '.join(map(q, COMPANY_WORDS))}))"
    return f"array_to_string(list_sort(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END), ' ')"


def lifecycle(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN {case(f'lower({strip(x)})', LIFECYCLES, strip(x))} END"


def stamp(x: str) -> str:
    t = strip(x)
    zone = f"CASE WHEN {t} LIKE '%+07:00' THEN INTERVAL 7 HOUR ELSE INTERVAL 0 HOUR END"
    iso = f"try_strptime(replace(substr({t}, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S') - {zone}"
    return f"coalesce({iso}, try_strptime({t}, '%Y-%m-%d'), try_strptime({t}, '%m/%d/%Y'), try_strptime({t}, '%d/%m/%Y'))"


def stamp_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


_BARE = strip("regexp_replace(full_, '(?i)^(?:dr|mr|mrs|ms|prof)\\.?\\s+', '')")
_TWO = "'(?s)^(.*\\S)\\s+(\\S+)$'"
WHO = f"""
who0 AS (SELECT crm.*, {null_if_blank('first_name')} AS first_, {null_if_blank('last_name')} AS last_, {null_if_blank('full_name')} AS full_ FROM crm),
who1 AS (SELECT *, {_BARE} AS bare, full_ IS NOT NULL AND first_ IS NULL AND last_ IS NULL AS lone FROM who0),
who AS (
  SELECT *, CASE WHEN lone THEN CASE WHEN regexp_matches(bare, {_TWO}) THEN regexp_extract(bare, {_TWO}, 1) ELSE bare END ELSE first_ END AS n_first,
    CASE WHEN lone THEN CASE WHEN regexp_matches(bare, {_TWO}) THEN regexp_extract(bare, {_TWO}, 2) END ELSE last_ END AS n_last,
    coalesce(full_, CASE WHEN first_ IS NOT NULL AND last_ IS NOT NULL THEN first_ || ' ' || last_ END, first_, last_, '') AS n_full
  FROM who1
)"""
_LEADS = f"""{CRM_SQL},{WHO},
leads AS (
  SELECT id, created_s, TRY_CAST({strip('record_id')} AS BIGINT) AS record_id, n_first AS first_name, n_last AS last_name, n_full AS full_name,
    {null_if_blank('job_title')} AS job_title, coalesce({null_if_blank('company_name')}, 'Unknown') AS company_name, lower({strip('email')}) AS email,
    {null_if_blank('phone_number')} AS phone_number, {phone('phone_number')} AS phone_normalized, {country('country')} AS country,
    {status('lead_status')} AS lead_status, {lifecycle('lifecycle_stage')} AS lifecycle_stage, {null_if_blank('original_source')} AS original_source,
    {null_if_blank('source_drill_down')} AS source_drill_down, {null_if_blank('contact_owner')} AS contact_owner,
    TRY_CAST({strip('lead_score')} AS INTEGER) AS lead_score, {null_if_blank('notes')} AS notes, {stamp('create_date')} AS original_create_date,
    {stamp('modified_date')} AS original_modified_date
  FROM who WHERE {strip('email')} <> ''
)"""


def _rule_case(notes: str, part: str) -> str:
    def group(pattern: str) -> str:
        return f"regexp_replace({strip(f'regexp_extract({notes}, {q(pattern)}, 1)')}, '[.,]+$', '')"

    out = []
    for r in RULES:
        pattern = ("(?i)" if r.any_case else "(?s)") + r.pattern
        if part == "channel":
            value = q(r.channel)
        elif r.detail is None:
            page = "(?i)" + LANDING_PAGE
            value = f"'Organic Search → ' || CASE WHEN regexp_matches({notes}, {q(page)}) THEN {group(page)} ELSE 'Unknown page' END"
        elif "{0}" in r.detail:
            value = f"replace({q(r.detail)}, '{{0}}', {group(pattern)})"
        else:
            value = q(r.detail)
        out.append(f"WHEN regexp_matches({notes}, {q(pattern)}) THEN {value}")
    return "CASE " + " ".join(out) + " END"


def source(notes: str, part: str, otherwise: str = NO_SOURCE) -> str:
    blank, other = ("'Other'", "'Other'") if part == "channel" else (q(NO_NOTES), q(otherwise))
    return f"CASE WHEN coalesce({notes}, '') = '' THEN {blank} ELSE coalesce({_rule_case(notes, part)}, {other}) END"


_ATTRIBUTED = f"""{_LEADS},
attributed AS (SELECT *, {source('notes', 'channel')} AS ai_source_channel, {source('notes', 'detail', NO_RULE)} AS ai_source_detail FROM leads)"""


def _keys(table: str) -> str:
    digits = f"coalesce(nullif(phone_normalized, ''), {phone('phone_number')})"
    head = lambda x: f"substr(lower({strip(x)}), 1, 3)"
    return f"""
  SELECT id, 'email_exact' AS key_type, lower({strip('email')}) AS key FROM {table} WHERE email <> ''
  UNION ALL SELECT id, 'phone_normalized', {digits} FROM {table} WHERE length({digits}) >= 7
  UNION ALL SELECT id, 'phone_suffix_10', right({digits}, 10) FROM {table} WHERE length({digits}) >= 10
  UNION ALL SELECT id, 'domain_lastname', lower(split_part(email, '@', 2)) || '|' || {head('last_name')} FROM {table} WHERE contains(email, '@') AND length({head('last_name')}) >= 2
  UNION ALL SELECT id, 'company_firstname', {company('company_name')} || '|' || {head('first_name')} FROM {table} WHERE {company('company_name')} <> '' AND length({head('first_name')}) >= 2"""


def _features(table: str) -> str:
    low = lambda c: f"lower({strip(f'coalesce({c}, {q(str())})')})"
    return f"""SELECT id, {low('email')} AS e, coalesce(nullif(phone_normalized, ''), {phone('phone_number')}, '') AS p, {low('full_name')} AS n, {low('first_name')} AS f,
    {low('last_name')} AS l, {company('company_name')} AS c, coalesce(contains(lower(notes), 'possible duplicate'), false) AS h, email AS re, full_name AS rn, company_name AS rc FROM {table}"""


#: Jaro-Winkler of the pairs (s, t) of ``jp``, by a recursive walk over s.
_JARO = """
jr AS (
  SELECT s, t, 1 AS i, t AS rest, '' AS m, greatest(greatest(length(s), length(t)) // 2 - 1, 0) AS d FROM jp
  UNION ALL
  SELECT s, t, i + 1, CASE WHEN p > 0 THEN substr(rest, 1, lo + p - 2) || chr(1) || substr(rest, lo + p) ELSE rest END, CASE WHEN p > 0 THEN m || substr(s, i, 1) ELSE m END, d
  FROM (
    SELECT *, greatest(i - d, 1) AS lo,
      CASE WHEN greatest(i - d, 1) <= length(t) THEN instr(substr(rest, greatest(i - d, 1), least(i + d, length(t)) - greatest(i - d, 1) + 1), substr(s, i, 1)) ELSE 0 END AS p
    FROM jr WHERE i <= length(s)
  )
),
jm AS (
  SELECT s, t, m, length(m) AS h, array_to_string(list_transform(list_filter(range(1, length(t) + 1), lambda j: substr(rest, j, 1) = chr(1)), lambda j: substr(t, j, 1)), '') AS o
  FROM jr WHERE i = length(s) + 1
),
jj AS (
  SELECT s, t, CASE WHEN h = 0 THEN 0e0 ELSE (h / length(s) + h / length(t) + (h - len(list_filter(range(1, h + 1), lambda k: substr(m, k, 1) <> substr(o, k, 1))) / 2) / h) / 3 END AS j,
    CASE WHEN length(s) >= 4 AND length(t) >= 4 AND substr(s, 1, 4) = substr(t, 1, 4) THEN 4 WHEN length(s) >= 3 AND length(t) >= 3 AND substr(s, 1, 3) = substr(t, 1, 3) THEN 3
      WHEN length(s) >= 2 AND length(t) >= 2 AND substr(s, 1, 2) = substr(t, 1, 2) THEN 2 WHEN substr(s, 1, 1) = substr(t, 1, 1) THEN 1 ELSE 0 END AS l
  FROM jm
),
jw AS (SELECT s, t, CASE WHEN j < 0.7 THEN j ELSE j + l * 1e-1 * (1 - j) END AS w FROM jj)"""

_LOCAL = lambda a: f"split_part({a}.e, '@', 1)"
_DOMAIN = lambda a: f"split_part({a}.e, '@', 2)"


def _scored(pairs: str, left: str, right: str) -> str:
    """CTEs from ``pairs`` (lead_id_1, lead_id_2) to ``scored`` with five signals and confidence."""
    shared = "len(list_intersect(string_split(a.c, ' '), string_split(b.c, ' '))) / greatest(len(list_distinct(string_split(a.c, ' '))), len(list_distinct(string_split(b.c, ' '))))"
    return f"""
fl AS ({_features(left)}), fr AS ({_features(right)}),
duo AS (SELECT lead_id_1, lead_id_2, a, b FROM {pairs} JOIN fl a ON a.id = lead_id_1 JOIN fr b ON b.id = lead_id_2),
jp AS (
  SELECT DISTINCT s, t FROM (
    SELECT a.n AS s, b.n AS t FROM duo UNION ALL SELECT a.c, b.c FROM duo UNION ALL SELECT {_LOCAL('a')}, {_LOCAL('b')} FROM duo
  ) WHERE s <> t AND s <> '' AND t <> ''
),{_JARO},
sims AS (
  SELECT duo.*, CASE WHEN {_LOCAL('a')} = {_LOCAL('b')} THEN 1 ELSE coalesce(je.w, 0) END AS we, coalesce(jn.w, 0) AS wn, coalesce(jc.w, 0) AS wc
  FROM duo LEFT JOIN jw je ON je.s = {_LOCAL('a')} AND je.t = {_LOCAL('b')} LEFT JOIN jw jn ON jn.s = a.n AND jn.t = b.n LEFT JOIN jw jc ON jc.s = a.c AND jc.t = b.c
),
signals AS (
  SELECT lead_id_1, lead_id_2, a, b,
    CASE WHEN a.e = '' OR b.e = '' THEN 0e0 WHEN a.e = b.e THEN 1e0 WHEN {_DOMAIN('a')} = {_DOMAIN('b')} THEN CASE WHEN we >= 0.8 THEN 7e-1 ELSE 3e-1 END ELSE 0e0 END AS email,
    CASE WHEN a.p = '' OR b.p = '' THEN 0e0 WHEN a.p = b.p THEN 1e0 WHEN length(a.p) >= 10 AND length(b.p) >= 10 AND right(a.p, 10) = right(b.p, 10) THEN 8e-1 ELSE 0e0 END AS phone,
    CASE WHEN a.n = '' OR b.n = '' THEN 0e0 WHEN a.n = b.n THEN 1e0 WHEN wn >= 0.85 THEN wn
      WHEN a.l <> '' AND a.l = b.l AND a.f <> '' AND b.f <> '' AND substr(a.f, 1, 1) = substr(b.f, 1, 1) THEN 6e-1 ELSE wn END AS name,
    CASE WHEN a.c = '' OR b.c = '' THEN 0e0 WHEN a.c = b.c THEN 1e0 WHEN wc >= 0.85 THEN wc WHEN {shared} >= 0.6 THEN greatest({shared}, wc) ELSE greatest(wc - 3e-1, 0e0) END AS company,
    CASE WHEN a.h OR b.h THEN 1e0 ELSE 0e0 END AS notes_hint
  FROM sims
),
scored AS (SELECT *, email * 35e-2 + phone * 25e-2 + name * 2e-1 + company * 15e-2 + notes_hint * 5e-2 AS confidence FROM signals)"""


_PAIRS = f"""{_LEADS},
keys AS ({_keys('leads')}),
useful AS (SELECT key_type, key FROM keys GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50),
kept AS (SELECT keys.* FROM keys JOIN useful USING (key_type, key)),
pairs AS (SELECT DISTINCT x.id AS lead_id_1, y.id AS lead_id_2 FROM kept x JOIN kept y USING (key_type, key) WHERE x.id < y.id)"""
_EXPLAIN = """concat_ws('; ',
  CASE WHEN email >= 1 THEN 'Exact email match (' || coalesce(a.re, 'None') || ')' WHEN email >= 0.5 THEN 'Similar email (same domain)' END,
  CASE WHEN phone >= 1 THEN 'Exact phone match' WHEN phone >= 0.7 THEN 'Phone digits match (format difference)' END,
  CASE WHEN name >= 0.85 THEN 'Name very similar (' || coalesce(a.rn, 'None') || ' ↔ ' || coalesce(b.rn, 'None') || ')'
    WHEN name >= 0.5 THEN 'Name partially matches (' || coalesce(a.rn, 'None') || ' ↔ ' || coalesce(b.rn, 'None') || ')' END,
  CASE WHEN company >= 0.85 THEN 'Same company (' || coalesce(a.rc, 'None') || ' ≈ ' || coalesce(b.rc, 'None') || ')' END,
  CASE WHEN notes_hint >= 1 THEN 'Notes contain ''possible duplicate'' flag' END)"""
_FOUND = f"""{_PAIRS},{_scored('pairs', 'leads', 'leads')},
found AS (
  SELECT lead_id_1, lead_id_2, round(confidence, 4) AS confidence, {', '.join(f'round({s}, 4) AS reason_{s}' for s in SIGNALS)},
    CASE WHEN {_EXPLAIN} = '' THEN 'Multiple weak signals' ELSE {_EXPLAIN} END AS explanation
  FROM scored WHERE confidence >= 0.6
)"""
_COMPONENTS = f"""{_FOUND},
edges AS (SELECT lead_id_1 AS x, lead_id_2 AS y FROM found UNION SELECT lead_id_2, lead_id_1 FROM found),
reach AS (SELECT x AS id, x AS other FROM edges UNION SELECT reach.id, edges.y FROM reach JOIN edges ON edges.x = reach.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
named AS (SELECT id, component, md5('lead-cluster-' || component) AS hex FROM comp),
grp AS (SELECT id, component, substr(hex, 1, 8) || '-' || substr(hex, 9, 4) || '-' || substr(hex, 13, 4) || '-' || substr(hex, 17, 4) || '-' || substr(hex, 21, 12) AS group_id FROM named)"""
_CLUSTERS = """SELECT group_id, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT explanation)), '; ') AS explanation,
  array_to_string(list_sort(list_distinct(flatten(list([lead_id_1, lead_id_2])))), ',') AS lead_ids FROM found JOIN grp ON id = lead_id_1 GROUP BY group_id"""
_SUBS = f"""{SUBS_SQL},
who_s AS (SELECT *, {null_if_blank('name')} AS full_, {strip("regexp_replace(" + null_if_blank('name') + ", '(?i)^(?:dr|mr|mrs|ms|prof)\\.?\\s+', '')")} AS bare FROM subs),
probes AS (
  SELECT pos AS id, CASE WHEN regexp_matches(bare, {_TWO}) THEN regexp_extract(bare, {_TWO}, 1) ELSE bare END AS first_name,
    CASE WHEN regexp_matches(bare, {_TWO}) THEN regexp_extract(bare, {_TWO}, 2) END AS last_name, coalesce(full_, '') AS full_name,
    coalesce(nullif(company, ''), 'Unknown') AS company_name, lower({strip('email')}) AS email, phone AS phone_number, {phone('phone')} AS phone_normalized, message AS notes
  FROM who_s WHERE {strip('email')} <> ''
)"""


#: The best five from 0.8 on get a remark.
_REMARKED = """SELECT lead_id_1, lead_id_2, explanation || CASE WHEN r <= 5 THEN ' | LLM: {}' ELSE '' END AS explanation
FROM (SELECT *, CASE WHEN confidence >= 0.8 THEN row_number() OVER (ORDER BY confidence DESC, lead_id_1, lead_id_2) ELSE 6 END AS r FROM found)
JOIN leads x ON x.id = lead_id_1 JOIN leads y ON y.id = lead_id_2"""


def _with(ctes: str, tail: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{tail}"


def _ingest() -> str:
    """CTEs up to ``acts``: the submissions of each component one after the other, with what was created, filled in and hinted at before as lists."""
    hint = lambda x: f"coalesce(contains(lower({x}), 'possible duplicate'), false)"
    form = "'[Form: ' || coalesce(form_name, 'None') || '] ' || message"
    known = "coalesce(filled_numbers[list_position(filled, c.target)], c.number)"
    phone_score = f"CASE WHEN own = '' OR {known} = '' THEN 0e0 WHEN own = {known} THEN 1e0 WHEN length(own) >= 10 AND length({known}) >= 10 AND right(own, 10) = right({known}, 10) THEN 8e-1 ELSE 0e0 END"
    hints = "CASE WHEN c.hint OR list_contains(hinted, c.target) THEN 1e0 ELSE 0e0 END"
    total = f"c.email * 35e-2 + ({phone_score}) * 25e-2 + c.name * 2e-1 + c.company * 15e-2 + {hints} * 5e-2"
    met = f"list_filter(list_transform(list_filter(cands, lambda c: (c.target >= 0 OR list_contains(made, c.target)) AND (c.plain OR ({phone_score}) > 0)), lambda c: {{'s': {total}, 'r': -c.rank, 'target': c.target, 'fillable': c.fillable}}), lambda x: x.s >= 0.6)"
    return f"""{CRM_SQL},{WHO},leads AS ({_LEADS.split('leads AS (', 1)[1]},{_SUBS},
top AS (SELECT max(id) AS top FROM leads),
targets AS (
  SELECT id, id AS rank, first_name, last_name, full_name, company_name, email, phone_number, phone_normalized, notes FROM leads
  UNION ALL SELECT -id - 1, top + 1 + id, first_name, last_name, full_name, company_name, probes.email, phone_number, phone_normalized, CASE WHEN message <> '' THEN {form} END
  FROM probes JOIN subs ON pos = id, top
),
pk AS ({_keys('probes')}), tk AS ({_keys('targets')}),
met AS (
  SELECT pk.id AS lead_id_1, tk.id AS lead_id_2, max(key_type NOT IN ('phone_normalized', 'phone_suffix_10')) AS plain, max(key_type IN ('phone_normalized', 'phone_suffix_10')) AS by_phone
  FROM pk JOIN tk USING (key_type, key) WHERE tk.id >= 0 OR -tk.id - 1 < pk.id GROUP BY ALL
),
shared AS ( -- without a common number or domain no pair gets over 0.4
  SELECT lead_id_1, lead_id_2, plain FROM met JOIN probes p ON p.id = lead_id_1 JOIN targets t ON t.id = lead_id_2
  WHERE by_phone OR split_part(p.email, '@', 2) = split_part(t.email, '@', 2)
),
tails AS (SELECT id, right(phone_normalized, 10) AS tail FROM probes WHERE phone_normalized <> ''),
given AS (SELECT DISTINCT tail, lead_id_2 FROM shared JOIN tails ON id = lead_id_1 JOIN targets ON targets.id = lead_id_2 WHERE coalesce(phone_number, '') = ''),
moved AS (SELECT DISTINCT tails.id AS lead_id_1, lead_id_2 FROM given JOIN tails USING (tail) WHERE lead_id_2 >= 0 OR -lead_id_2 - 1 < tails.id),
pairs AS (SELECT lead_id_1, lead_id_2, plain FROM shared UNION ALL SELECT lead_id_1, lead_id_2, false FROM moved ANTI JOIN shared USING (lead_id_1, lead_id_2)),
{_scored('pairs', 'probes', 'targets')},
able AS (SELECT * FROM scored WHERE email * 35e-2 + name * 2e-1 + company * 15e-2 + 3e-1 >= 0.6 - 1e-9),
cand AS (
  SELECT lead_id_1 AS pos, list({{'target': lead_id_2, 'rank': rank, 'plain': plain, 'fillable': coalesce(phone_number, '') = '', 'email': scored.email, 'name': name, 'company': company, 'number': b.p, 'hint': a.h OR b.h}}) AS cands
  FROM able AS scored JOIN pairs USING (lead_id_1, lead_id_2) JOIN targets ON targets.id = lead_id_2 GROUP BY lead_id_1
),
edge AS (SELECT -lead_id_1 - 1 AS x, lead_id_2 AS y FROM able UNION SELECT lead_id_2, -lead_id_1 - 1 FROM able),
reach AS (SELECT x AS node, x AS other FROM edge UNION SELECT reach.node, edge.y FROM reach JOIN edge ON edge.x = reach.other),
part AS (SELECT node, min(other) AS g FROM reach GROUP BY node),
todo AS (
  SELECT coalesce(g, -id - 1) AS g, row_number() OVER (PARTITION BY coalesce(g, -id - 1) ORDER BY id) AS n, id AS pos, fp.p AS own, coalesce(phone, '') <> '' AS gives, {strip("coalesce(message, '')")} <> '' AND {hint(form)} AS adds, coalesce(cands, []) AS cands
  FROM probes JOIN subs ON subs.pos = id JOIN fl fp USING (id) LEFT JOIN cand ON cand.pos = id LEFT JOIN part ON node = -id - 1
),
walk AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS made, CAST([] AS BIGINT[]) AS filled, CAST([] AS VARCHAR[]) AS filled_numbers, CAST([] AS BIGINT[]) AS hinted, CAST(NULL AS BIGINT) AS target, CAST(NULL AS DOUBLE) AS confidence FROM todo
  UNION ALL
  SELECT g, n, pos, CASE WHEN best IS NULL THEN list_append(made, -pos - 1) ELSE made END,
    CASE WHEN fills THEN list_append(filled, best.target) ELSE filled END, CASE WHEN fills THEN list_append(filled_numbers, own) ELSE filled_numbers END,
    CASE WHEN best IS NOT NULL AND adds THEN list_append(hinted, best.target) ELSE hinted END, best.target, best.s
  FROM (
    SELECT *, coalesce(gives AND best.fillable AND NOT list_contains(filled, best.target), false) AS fills FROM (
      SELECT todo.g, todo.n, todo.pos, made, filled, filled_numbers, hinted, own, gives, adds, list_sort({met}, 'DESC')[1] AS best FROM walk JOIN todo ON todo.g = walk.g AND todo.n = walk.n + 1
    )
  )
),
born AS (SELECT pos, top + row_number() OVER (ORDER BY pos) AS id FROM walk, top WHERE n > 0 AND target IS NULL),
acts AS (
  SELECT walk.pos, target IS NULL AS created, coalesce(born.id, older.id, target) AS lead_id, confidence
  FROM walk LEFT JOIN born ON born.pos = walk.pos LEFT JOIN born older ON older.pos = -target - 1 WHERE n > 0
)"""


def _norm(column: str, value: str) -> str:
    return _with(CRM_SQL, f"SELECT id, {column} AS raw, {value} AS value FROM crm")


def oracle_sql() -> dict[str, str]:
    times = ("original_create_date", "original_modified_date")
    cols = lambda names: ", ".join(f"{stamp_text(c)} AS {c}" if c in times else c for c in names)
    short = ", ".join(SHORT)
    made = "strftime(make_timestamp(created_s * 1000000), '%Y-%m-%d %H:%M:%S')"
    own = {"dedup_group_id": "CAST(NULL AS VARCHAR) AS dedup_group_id", "created_at": f"{made} AS created_at", "updated_at": f"{made} AS updated_at"}
    response = ", ".join(own.get(c) or cols([c]) for c in LEAD_RESPONSE)
    blank_to_null = lambda axis: f"SELECT {axis} AS value, count(*) AS n FROM attributed WHERE {axis} <> '' GROUP BY 1"
    search = " OR ".join(f"{c} ILIKE '%müller%'" for c in ("full_name", "first_name", "last_name", "company_name", "email"))
    comp1 = " OR ".join(f"{c} ILIKE '%comp1%'" for c in ("full_name", "first_name", "last_name", "company_name", "email"))
    values = {"statuses": "lead_status", "owners": "contact_owner", "countries": "country", "channels": "ai_source_channel"}
    best = f"""{CRM_SQL},{WHO},leads AS ({_LEADS.split('leads AS (', 1)[1]},{_SUBS},
pk AS ({_keys('probes')}), lk AS ({_keys('leads')}), pairs AS (SELECT DISTINCT pk.id AS lead_id_1, lk.id AS lead_id_2 FROM pk JOIN lk USING (key_type, key)),
{_scored('pairs', 'probes', 'leads')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY lead_id_1 ORDER BY confidence DESC, lead_id_2) AS r FROM scored WHERE confidence >= 0.6)"""
    out = {
        "leads_import_normalized": _with(_LEADS, f"SELECT {cols(LEADS)} FROM leads"),
        "norm_name": _with(f"{CRM_SQL},{WHO}", "SELECT id, n_first AS first, n_last AS last, n_full AS full FROM who"),
        "norm_date": _with(CRM_SQL, f"SELECT id, {stamp_text(stamp('create_date'))} AS created, {stamp_text(stamp('modified_date'))} AS modified FROM crm"),
        "norm_status": _norm("lead_status", status("lead_status")),
        "norm_phone": _norm("phone_number", phone("phone_number")),
        "norm_country": _norm("country", country("country")),
        "norm_company": _norm("company_name", company("company_name")),
        "norm_lifecycle": _norm("lifecycle_stage", lifecycle("lifecycle_stage")),
        "norm_email": _norm("email", f"nullif(lower({strip('email')}), '')"),
        "norm_owner": _norm("contact_owner", null_if_blank("contact_owner")),
        "lead_list_page": _with(_LEADS, f"SELECT {short}, lead_score FROM leads ORDER BY lead_score DESC NULLS FIRST, id LIMIT 25 OFFSET 25"),
        "lead_search_q": _with(_LEADS, f"SELECT {short} FROM leads WHERE {search}"),
        "lead_filter_status": _with(_LEADS, f"SELECT {short} FROM leads WHERE lead_status = 'closed_won'"),
        "lead_filter_owner": _with(_LEADS, f"SELECT {short} FROM leads WHERE contact_owner ILIKE '%ben o%'"),
        "lead_filter_country": _with(_LEADS, f"SELECT {short} FROM leads WHERE country ILIKE '%u_a%'"),
        "lead_filter_all": _with(_LEADS, f"SELECT {short} FROM leads WHERE lead_status = 'new' AND contact_owner ILIKE '%a%' AND country ILIKE '%a%' AND ({search.replace('müller', 'comp')})"),
        "lead_responses": _with(_ATTRIBUTED, f"SELECT {response} FROM attributed"),
        "import_counts": _with(CRM_SQL, f"SELECT count(*) FILTER (WHERE {strip('email')} <> '') AS accepted, count(*) FILTER (WHERE coalesce({strip('email')}, '') = '') AS dropped FROM crm"),
        "import_rejected": _with(CRM_SQL, f"SELECT id, 'no email' AS reason FROM crm WHERE coalesce({strip('email')}, '') = ''"),
        "lead_totals": _with(_LEADS, f"SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages FROM leads WHERE {comp1}"),
        "lead_by_id": _with(_LEADS, f"SELECT {short} FROM leads WHERE id = 17"),
        "lead_by_email": _with(_LEADS, f"SELECT {short} FROM leads WHERE email = 'anna.alvarez0@comp0.example' ORDER BY id LIMIT 1"),
        "lead_by_phone": _with(_LEADS, f"SELECT {short} FROM leads WHERE phone_normalized = '15550100000'"),
        "filter_values": _with(_ATTRIBUTED, "SELECT " + ", ".join(f"array_to_string(list_sort(list(DISTINCT {c}) FILTER (WHERE {c} <> '')), '|') AS {k}" for k, c in values.items()) + " FROM attributed"),
        "distinct_owners": _with(_LEADS, "SELECT DISTINCT contact_owner AS value FROM leads WHERE contact_owner <> ''"),
        "export_rows": _with(_ATTRIBUTED, f"SELECT {cols(EXPORT_COLUMNS)} FROM attributed ORDER BY created_s DESC, id LIMIT 10000"),
        "dashboard_totals": _with(_LEADS, f"SELECT count(*) AS total, count(*) FILTER (WHERE original_create_date >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 30 DAY) AS recent FROM leads"),
        "dashboard_all": _with(_ATTRIBUTED, " UNION ALL ".join(f"SELECT '{a}' AS axis, {c} AS value, count(*) AS n FROM attributed WHERE {c} <> '' GROUP BY ALL" for a, c in AXES.items())),
        "dashboard_row": _with(
            _ATTRIBUTED,
            f"SELECT count(*) AS total, count(*) FILTER (WHERE original_create_date >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 30 DAY) AS recent, "
            + ", ".join(f"(SELECT string_agg(v || '=' || n, '|' ORDER BY v) FROM (SELECT {c} AS v, count(*) AS n FROM attributed WHERE {c} <> '' GROUP BY 1)) AS by_{a}" for a, c in AXES.items())
            + " FROM attributed",
        ),
        "source_model": _with(
            _LEADS,
            f"SELECT id, CASE WHEN contains(notes, 'nobody could place') THEN 'Event' ELSE {source('notes', 'channel')} END AS channel, "
            f"CASE WHEN contains(notes, 'nobody could place') THEN 'asked around' WHEN contains(notes, 'older record') THEN '' ELSE {source('notes', 'detail')} END AS detail FROM leads",
        ),
        "reply_json": _with(_LEADS, "SELECT id, CASE WHEN id % 4 < 3 THEN 'Event' END AS channel, CASE WHEN id % 4 < 3 THEN id END AS n FROM leads"),
        "source_rules": _with(_LEADS, f"SELECT id, {source('notes', 'channel')} AS channel, {source('notes', 'detail')} AS detail FROM leads"),
        "attribute_missing": _with(_ATTRIBUTED, "SELECT id, ai_source_channel, ai_source_detail FROM attributed"),
        "source_channel_counts": _with(_ATTRIBUTED, f"SELECT ai_source_channel, count(*) AS n, count(*) FILTER (WHERE ai_source_detail NOT IN ({q(NO_NOTES)}, {q(NO_RULE)})) AS n_by_rule FROM attributed GROUP BY 1"),
        "blocking_keys": _with(f"{_LEADS}, keys AS ({_keys('leads')})", "SELECT * FROM keys"),
        "block_sizes": _with(f"{_LEADS}, keys AS ({_keys('leads')})", "SELECT key_type, key, count(*) AS n FROM keys GROUP BY ALL"),
        "candidate_pairs": _with(_PAIRS, "SELECT * FROM pairs"),
        "jaro_winkler_names": _with(
            f"{_PAIRS}, f AS ({_features('leads')}), np AS (SELECT DISTINCT x.n AS s, y.n AS t FROM pairs JOIN f x ON x.id = lead_id_1 JOIN f y ON y.id = lead_id_2), jp AS (SELECT * FROM np WHERE s <> t AND s <> '' AND t <> ''),{_JARO}",
            "SELECT s, t, round(CASE WHEN s = t THEN 1 ELSE coalesce(w, 0) END, 9) AS similarity FROM np LEFT JOIN jw USING (s, t)",
        ),
        "score_pairs": _with(f"{_PAIRS},{_scored('pairs', 'leads', 'leads')}", f"SELECT lead_id_1, lead_id_2, {', '.join(f'round({s}, 6) AS {s}' for s in (*SIGNALS, 'confidence'))} FROM scored"),
        "dedupe_candidates": _with(_FOUND, "SELECT * FROM found"),
        "candidate_filter": _with(_FOUND, "SELECT lead_id_1, lead_id_2, confidence FROM found WHERE confidence >= 0.8"),
        "candidate_with_leads": _with(_FOUND, "SELECT lead_id_1, lead_id_2, confidence, x.email AS email_1, y.email AS email_2 FROM found LEFT JOIN leads x ON x.id = lead_id_1 LEFT JOIN leads y ON y.id = lead_id_2"),
        "llm_shortlist": _with(_FOUND, "SELECT lead_id_1, lead_id_2, confidence FROM found WHERE confidence >= 0.8 ORDER BY confidence DESC, lead_id_1, lead_id_2 LIMIT 5"),
        "llm_remarks": _with(_FOUND, _REMARKED.format(" / ".join(["' || x.full_name || '", "' || y.full_name || '"]))),
        "remark_cache": _with(_FOUND, _REMARKED.format("' || CASE WHEN lead_id_1 % 2 = 0 THEN 'seen before' ELSE x.full_name || ' / ' || y.full_name END || '")),
        "cluster_leads": _with(
            _COMPONENTS,
            "SELECT group_id, (SELECT max(confidence) FROM found JOIN grp k ON k.id = lead_id_1 WHERE k.group_id = grp.group_id) AS confidence, string_agg(email, ',' ORDER BY leads.id) AS emails FROM grp JOIN leads ON leads.id = grp.id GROUP BY group_id",
        ),
        "dedupe_components": _with(_COMPONENTS, "SELECT id, component FROM comp"),
        "dedupe_clusters": _with(_COMPONENTS, _CLUSTERS),
        "resolve_leads": _with(_COMPONENTS, _CLUSTERS),
        "leads_with_group": _with(_COMPONENTS, "SELECT leads.id, group_id AS dedup_group_id FROM leads LEFT JOIN grp ON grp.id = leads.id"),
        "review_update": _with(_FOUND, "SELECT lead_id_1, lead_id_2, confidence, CASE lead_id_1 % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM found"),
        "review_outcomes": _with(
            _FOUND,
            "SELECT lead_id_1, lead_id_2 + off AS lead_id_2, CASE WHEN lead_id_1 % 3 = 1 THEN 'bad_status' WHEN off > 0 THEN 'not_found' ELSE 'updated' END AS outcome FROM found, (VALUES (0), (10000000)) o(off)",
        ),
        "patch_outcomes": _with(
            _LEADS,
            "SELECT id + off AS id, CASE WHEN (id + off) % 3 > 0 AND (id + off) % 5 > 0 THEN 'empty' WHEN off > 0 THEN 'not_found' ELSE 'updated' END AS outcome FROM leads, (VALUES (0), (10000000)) o(off)",
        ),
        "extraction_outcomes": _with(
            f"""{_LEADS}, asked AS (
  SELECT id + off AS lead_id, CASE (id + off) % 5 WHEN 0 THEN 'Walked into our office' WHEN 1 THEN ' ' ELSE notes END AS n, off FROM leads, (VALUES (0), (10000000)) o(off)
), told AS (SELECT *, CASE WHEN off > 0 THEN 'not_found' WHEN coalesce({strip('n')}, '') = '' THEN 'no_notes' ELSE 'ok' END AS outcome FROM asked)""",
            f"SELECT lead_id, outcome, CASE WHEN outcome = 'ok' THEN {source('n', 'channel')} END AS channel, CASE WHEN outcome = 'ok' THEN {source('n', 'detail')} END AS detail, outcome = 'ok' AND lead_id % 2 = 0 AS saved FROM told",
        ),
        "patch_leads": _with(
            _LEADS,
            "SELECT id, CASE WHEN id % 6 = 0 THEN 'qualified' ELSE lead_status END AS lead_status, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN '+44 20 ' || lpad(CAST(id AS VARCHAR), 8, '0') ELSE phone_number END AS phone_number, "
            "CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN '4420' || lpad(CAST(id AS VARCHAR), 8, '0') ELSE phone_normalized END AS phone_normalized, CASE WHEN id % 6 = 0 THEN 'Zoë Reed' ELSE contact_owner END AS contact_owner, full_name FROM leads",
        ),
        "save_extraction": _with(
            f"{_LEADS}, asked AS (SELECT id, CASE WHEN id % 2 = 1 THEN CASE WHEN id % 5 = 0 THEN 'Walked into our office' ELSE notes END END AS n FROM leads)",
            f"SELECT id, CASE WHEN n <> '' THEN {source('n', 'channel')} END AS ai_source_channel, CASE WHEN n <> '' THEN {source('n', 'detail')} END AS ai_source_detail FROM asked",
        ),
        "best_match": _with(best, "SELECT lead_id_1 AS probe, lead_id_2 AS lead_id, round(confidence, 6) AS confidence FROM ranked WHERE r = 1"),
    }
    sent = "CASE WHEN created THEN 'created' ELSE 'updated' END"
    payload = ", ".join(f"{c} := subs.{c}" for c in SUBMISSION.names)
    out["ingest_result"] = _with(
        _ingest(),
        f"SELECT subs.pos, CASE WHEN acts.pos IS NULL THEN email ELSE lower({strip('email')}) END AS email, CASE WHEN acts.pos IS NULL THEN 'skipped' ELSE {sent} END AS action, lead_id, round(confidence, 4) AS match_confidence "
        "FROM subs LEFT JOIN acts USING (pos)",
    )
    out["ingest_totals"] = _with(_ingest(), "SELECT count(*) FILTER (WHERE created) AS created, count(*) FILTER (WHERE NOT created) AS updated, CAST(0 AS BIGINT) AS potential_duplicates FROM acts")
    out["ingest_audit"] = _with(
        _ingest(),
        f"SELECT form_id, form_name, page_url, {stamp_text(stamp('submitted_at'))} AS submitted_at, CAST(to_json(struct_pack({payload})) AS VARCHAR) AS raw_payload, lead_id FROM acts JOIN subs USING (pos)",
    )
    return out | {f"dashboard_by_{a}": _with(_ATTRIBUTED, blank_to_null(c)) for a, c in AXES.items()}
