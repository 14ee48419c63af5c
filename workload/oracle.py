"""SQL twins of the registered queries (DuckDB dialect), over the same whole tables."""

from __future__ import annotations

from longfeat.operators.labels import SETUPS
from longfeat.sources.schemas import FOLDERS, PERSON_FILES, VOCABULARY_FILES
from workload import views as vw
from longfeat.plans.defaults import MEASURE_BOUNDS
from workload.views import BOUNDS, CUSTOM_REGISTRY, CUSTOM_SETS, INDICATORS, RESULTS, ROLE_SETS, ROUTES, TESTS

ORACLE: dict[str, str] = {}
TRUE_TEXT = "lower(trim(CAST({c} AS VARCHAR))) IN ('true', 't', '1')"


def values(rows) -> str:
    def lit(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


# The views of ``workload.views``, in order of dependence.
VIEWS: dict[str, str] = {
    "occ": """SELECT user_id AS person_id, CAST(ts AS DATE) AS day, event_type AS domain,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS concept_id, value, event_id FROM events""",
    "users": "SELECT DISTINCT user_id AS person_id FROM events",
    "cohort": "SELECT c_custkey AS person_id FROM customer",
    "members": f"""SELECT c // 10 + 100 AS codeset_id, c AS concept_id, 'set' || (c // 10) AS set_name,
        CASE WHEN c % 10 = 9 THEN 'false' WHEN c % 10 = 8 THEN 'T' ELSE 'true' END AS is_current, 1 AS version,
        'concept ' || c AS concept_name, 'false' AS archived FROM (SELECT DISTINCT p_partkey % 100 AS c FROM part)""",
    "registry": f"""SELECT 'set' || n AS set_name, 'ind' || n AS indicator, concat_ws(', ', {", ".join(
        f"CASE WHEN n IN ({', '.join(map(str, s))}) THEN '{d}' END" for d, s in ROUTES.items())}) AS domain
        FROM (SELECT DISTINCT p_partkey % 10 AS n FROM part)""",
    "resolved": f"""SELECT DISTINCT d.domain, m.concept_id, r.indicator FROM registry r
        JOIN (VALUES {values([(d,) for d in ROUTES])}) d(domain) ON contains(r.domain, d.domain)
        JOIN members m ON m.set_name = r.set_name
        WHERE {TRUE_TEXT.format(c="m.is_current")} OR (d.domain = 'click' AND m.set_name = 'set3')""",
    "hits": """SELECT o.person_id, o.day, o.domain, r.indicator FROM occ o
        JOIN resolved r ON r.domain = o.domain AND r.concept_id = o.concept_id
        WHERE o.person_id IN (SELECT person_id FROM cohort)""",
    "measure_members": """SELECT concept_id, set_name FROM (
        SELECT concept_id, unnest([CASE concept_id WHEN 23 THEN 'set_bmi' WHEN 22 THEN 'set_weight'
            WHEN 21 THEN 'set_height' WHEN 0 THEN 'set_test_a' WHEN 1 THEN 'set_test_a' WHEN 2 THEN 'set_test_b'
            WHEN 3 THEN 'set_test_b' END, CASE concept_id WHEN 1 THEN 'set_pos' WHEN 2 THEN 'set_neg' END]) AS set_name
        FROM (SELECT DISTINCT p_partkey % 24 AS concept_id FROM part)) WHERE set_name IS NOT NULL""",
    "roles": f"""SELECT DISTINCT m.concept_id, r.role FROM measure_members m
        JOIN (VALUES {values((s, r) for r, s in ROLE_SETS.items())}) r(set_name, role) ON r.set_name = m.set_name""",
    "person": """SELECT c_custkey AS person_id, CAST(1930 + c_custkey % 90 AS INTEGER) AS year_of_birth,
        CAST(c_custkey % 14 AS INTEGER) AS month_of_birth, CAST(c_custkey % 31 AS INTEGER) AS day_of_birth,
        c_mktsegment AS segment FROM customer""",
    "enc": """SELECT o_custkey AS person_id, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS day,
        o_orderkey AS encounter_id FROM orders""",
    "meas": """SELECT o_custkey AS person_id, CAST(l_shipdate AS DATE) AS day, l_partkey % 24 AS concept_id,
        CASE WHEN l_linenumber < 7 THEN CASE WHEN l_partkey % 24 = 21 THEN l_quantity / 20.0 ELSE l_quantity END END
            AS value,
        CAST(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS result_concept_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "labels_": f"""SELECT person_id, prior, CASE WHEN person_id % 10 <> 0 THEN after END AS after FROM (
        SELECT person_id, max({flag("domain = 'purchase' AND value > 100")}) AS prior,
            max({flag("domain = 'error' AND value > 150")}) AS after FROM occ GROUP BY person_id)""",
    "outcome": "SELECT person_id, greatest(after, prior) AS outcome FROM labels_",
    "demo": """SELECT person_id, segment, CASE WHEN d BETWEEN DATE '1902-01-01' AND DATE '2024-06-30' THEN d END
        AS birth_date FROM (SELECT person_id, segment, try_cast(concat_ws('-', coalesce(year_of_birth, 1),
            coalesce(nullif(month_of_birth, 0), 7), coalesce(nullif(day_of_birth, 0), 1)) AS DATE) AS d FROM person)""",
    "aged": """SELECT person_id, CAST(floor(datesub('month', birth_date, DATE '2024-06-30') / 12.0) AS INTEGER) AS age
        FROM demo""",
    "visits": """SELECT person_id, count(*) AS encounters, CAST(max(day) - min(day) AS INTEGER) AS span
        FROM (SELECT DISTINCT person_id, day FROM enc) GROUP BY person_id""",
    "base": "SELECT person_id, encounters, span, age FROM aged LEFT JOIN visits USING (person_id)",
    "scaled_age": """SELECT person_id, age, round(coalesce((age - min(age) OVER ()) /
        CAST(nullif(max(age) OVER () - min(age) OVER (), 0) AS DOUBLE), 0), 6) AS age_scaled FROM base""",
}


def gate(ids, lo, hi) -> str:
    cond = f"concept_id IN ({', '.join(map(str, ids))}) AND value BETWEEN {lo} AND {hi}"
    return f"max(CASE WHEN value IS NOT NULL THEN CASE WHEN {cond} THEN value ELSE 0 END END)"


def in_role(role: str, column: str = "concept_id") -> str:
    return f"{column} IN (SELECT concept_id FROM roles WHERE role = '{role}')"


BODY = {"bmi": (10, 100), "weight": (5, 300), "height": (0.6, 2.43)}
LABS = [f"{gate(b.concept_ids, b.lo, b.hi)} AS {b.name}" for b in BOUNDS]
BODY_COLUMNS = [
    f"max(CASE WHEN value IS NOT NULL THEN CASE WHEN {in_role(r)} AND value BETWEEN {lo} AND {hi} "
    f"THEN value ELSE 0 END END) AS {r}"
    for r, (lo, hi) in BODY.items()
]
RESULT_FLAGS = [
    f"max({flag(in_role(t) + ' AND ' + in_role(r, 'result_concept_id'))}) AS {t}_{r}" for t in TESTS for r in RESULTS
]
BEST = "CASE WHEN bmi > 0 THEN bmi ELSE weight / nullif(height * height, 0) END"


def pivot(names=INDICATORS) -> str:
    return ", ".join(f"max({flag(f'indicator = {chr(39)}{n}{chr(39)}')}) AS {n}" for n in names)


def days_of(domain: str) -> str:
    return f"SELECT person_id, day, {pivot()} FROM hits WHERE domain = '{domain}' GROUP BY person_id, day"


product = "CASE WHEN concept_id < 30 THEN 'a' WHEN concept_id < 60 THEN 'b' WHEN concept_id < 80 THEN 'c' END"
EXPOSURES = f"""SELECT person_id, day, {product} AS product, concept_id,
    CASE WHEN event_id % 11 <> 0 THEN event_id % 7 END AS type_id FROM occ WHERE domain = 'signup'
    AND day > DATE '2024-01-02'"""
DAY_AGGREGATES = [*LABS, *BODY_COLUMNS, *RESULT_FLAGS]
DOSE_COLUMNS = ["dose1", "dose2", "dose3", "dose4", "gap_1_2", "dose1_a", "dose1_b", "had_dose"]
DOSE_TAIL = ["dose_before_index", "dose_days_since_index"]
LAB_NAMES = [b.name for b in BOUNDS]
FLAG_NAMES = [f"{t}_{r}" for t in TESTS for r in RESULTS]
BODY_NAMES = ["bmi_rounded", "obese"]
SETS = [f"broad-{i}" for i in range(4)]
SYMPTOMS = [f"sympt_broad_{i}" for i in range(4)]

VIEWS |= {
    "measured": f"""SELECT person_id, day, {", ".join(DAY_AGGREGATES)} FROM meas WHERE day IS NOT NULL
        AND person_id IN (SELECT person_id FROM cohort) GROUP BY person_id, day""",
    "measured_days": f"""SELECT * EXCLUDE (bmi, weight, height), CASE WHEN rounded IS NOT NULL
        THEN {flag("rounded >= 30")} END AS obese FROM (SELECT *, round(CASE WHEN {BEST} BETWEEN 10 AND 100
        THEN {BEST} END) AS rounded FROM measured)""",
    "raw_doses": f"""SELECT DISTINCT person_id, day, product FROM ({EXPOSURES}) WHERE type_id NOT IN (3, 5)
        AND concept_id IN (SELECT concept_id FROM members)
        UNION SELECT person_id, day, CASE concept_id WHEN 10 THEN 'a' WHEN 40 THEN 'b' ELSE 'c' END FROM occ
        WHERE domain = 'error' AND day > DATE '2024-01-02' AND concept_id IN (10, 40, 70)""",
    "doses": """SELECT person_id, day, CASE WHEN count(DISTINCT product) = 1 THEN max(product) END AS product
        FROM raw_doses GROUP BY person_id, day""",
    "gaps": """SELECT * FROM (SELECT *, CAST(day - coalesce(lag(day) OVER (PARTITION BY person_id ORDER BY day),
        DATE '2000-01-01') AS INTEGER) AS gap FROM doses) WHERE gap >= 5""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY day) AS nth FROM gaps",
    "wide": f"""SELECT person_id, count(day) AS doses, {", ".join(
        f"max(day) FILTER (nth = {i}) AS dose{i}_date, max(product) FILTER (nth = {i}) AS dose{i}_product"
        for i in range(1, 5))} FROM numbered GROUP BY person_id""",
    "dose_facts": f"""SELECT person_id, doses, CAST(dose1_date - DATE '2020-01-01' AS INTEGER) AS days_to_dose1,
        {", ".join(f"CAST(dose{i + 1}_date - dose{i}_date AS INTEGER) AS gap_{i}_{i + 1}" for i in (1, 2, 3))},
        {", ".join(flag(f"dose{i}_product <> dose{i + 1}_product AND dose{i}_date <> dose{i + 1}_date")
                   + f" AS switch_{i}_{i + 1}" for i in (1, 2, 3))},
        {", ".join(f"dose{i}_date, dose{i}_product" for i in (1, 2, 3, 4))} FROM wide WHERE doses <= 3""",
    "first_click": "SELECT person_id, min(day) AS index_date FROM hits WHERE domain = 'click' GROUP BY person_id",
    "dose_rows": " UNION ALL ".join(
        f"SELECT person_id, dose{i}_date AS day, {i} AS nth, gap_1_2, dose1_product FROM dose_facts "
        f"WHERE dose{i}_date IS NOT NULL" for i in range(1, 5)
    ),
    "dose_days": f"""SELECT d.*, {flag("d.day < i.index_date")} AS dose_before_index,
        CAST(d.day - i.index_date AS INTEGER) AS dose_days_since_index FROM (
        SELECT person_id, day, {", ".join(f"max(1) FILTER (nth = {i}) AS dose{i}" for i in range(1, 5))},
            max(gap_1_2) AS gap_1_2, max({flag("dose1_product = 'a'")}) AS dose1_a,
            max({flag("dose1_product = 'b'")}) AS dose1_b, 1 AS had_dose FROM dose_rows
        WHERE person_id IN (SELECT person_id FROM cohort) GROUP BY person_id, day) d
        LEFT JOIN first_click i ON i.person_id = d.person_id""",
    "episodes": """SELECT person_id, day AS start_day, CASE WHEN event_id % 13 <> 0 THEN day + 2 END AS end_day
        FROM occ WHERE domain = 'purchase' AND value > 40""",
    "four": f"SELECT person_id, day, {pivot()} FROM hits WHERE domain <> 'signup' GROUP BY person_id, day",
    "keys": """SELECT person_id, day FROM enc UNION SELECT person_id, day FROM four
        UNION SELECT person_id, day FROM measured UNION SELECT person_id, day FROM dose_days""",
    "facts": f"""SELECT k.person_id, k.day,
        {", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in INDICATORS)},
        {", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in LAB_NAMES + FLAG_NAMES)},
        m.rounded AS bmi_rounded, coalesce(m.obese, 0) AS obese,
        {", ".join(f"coalesce(d.{c}, 0) AS {c}" for c in DOSE_COLUMNS + DOSE_TAIL)},
        {flag('''EXISTS (SELECT 1 FROM episodes e WHERE e.person_id = k.person_id
            AND k.day BETWEEN e.start_day AND e.end_day)''')} AS in_episode
        FROM keys k LEFT JOIN four f ON f.person_id = k.person_id AND f.day = k.day
        LEFT JOIN measured_days m ON m.person_id = k.person_id AND m.day = k.day
        LEFT JOIN dose_days d ON d.person_id = k.person_id AND d.day = k.day""",
    "rollup": f"""SELECT person_id, max(bmi_rounded) AS bmi_max, avg(m8) AS m8_mean, {", ".join(
        f"max({c}) AS {c}_indicator" for c in [*INDICATORS, *[n for n in LAB_NAMES if n not in ("m4", "m5", "m8")],
        *FLAG_NAMES, "obese", *[c for c in DOSE_COLUMNS if c != "had_dose"], *DOSE_TAIL])},
        CAST(sum(had_dose) AS BIGINT) AS total_doses FROM facts GROUP BY person_id""",
    "tagged": """SELECT person_id, day, left(domain, 3) AS domain, concept_id FROM occ
        UNION ALL SELECT person_id, day, 'mea', concept_id FROM meas""",
    "last_day": "SELECT person_id, max(day) AS last_day FROM tagged GROUP BY person_id",
    "recent_tagged": """SELECT t.* FROM tagged t JOIN last_day l ON l.person_id = t.person_id
        WHERE t.day > l.last_day - 10""",
    "recent_facts": """SELECT *, min(day) OVER (PARTITION BY person_id) AS first_day FROM (
        SELECT *, max(day) OVER (PARTITION BY person_id) AS last_day FROM facts WHERE day IS NOT NULL)
        WHERE day > last_day - 180""",
    "notes": """SELECT event_id // 10 AS note_id, min(person_id) AS person_id, min(day) AS day,
        (event_id // 10) % 7 AS visit_id FROM occ GROUP BY event_id // 10
        UNION ALL SELECT -encounter_id, person_id, day, (-encounter_id) % 7 FROM enc""",
    "mentions": """SELECT event_id AS mention_id, event_id // 10 AS note_id,
        CASE WHEN domain IN ('click', 'view') THEN 'Positive' WHEN domain = 'error' THEN 'Negated' ELSE 'Unknown' END
            AS certainty, CASE WHEN event_id % 17 <> 0 THEN concept_id // 5 END AS concept_id
        FROM occ""",
    "noted": """SELECT n.note_id, n.person_id, n.day, n.visit_id, m.mention_id, m.certainty, m.concept_id
        FROM notes n LEFT JOIN mentions m ON m.note_id = n.note_id""",
    "consistent": """SELECT DISTINCT a.* FROM noted a WHERE certainty IN ('Positive', 'Negated') AND NOT EXISTS (
        SELECT 1 FROM noted b WHERE b.note_id = a.note_id AND b.concept_id = a.concept_id
        AND b.certainty IN ('Positive', 'Negated') AND b.certainty <> a.certainty)""",
    "mention_members": """SELECT c // 5 + 100 AS codeset_id, c AS concept_id,
        CASE WHEN c = 0 THEN 'No matching concept' ELSE 'concept, ' || c END AS concept_name
        FROM (SELECT DISTINCT p_partkey % 20 AS c FROM part)""",
    "broad_sets": """SELECT CASE WHEN n = 4 THEN 999 ELSE n + 100 END AS codeset_id, 'broad-' || n AS set_name
        FROM (SELECT DISTINCT p_partkey % 10 AS n FROM part) WHERE n < 5""",
    "related": """SELECT b.codeset_id, m.concept_id, m.concept_name, b.set_name FROM mention_members m
        RIGHT JOIN broad_sets b ON b.codeset_id = m.codeset_id""",
    "matched": """SELECT c.*, r.concept_name, r.codeset_id, r.set_name FROM consistent c
        JOIN related r ON r.concept_id = c.concept_id""",
    "rates": """SELECT *, 1 - pos AS neg, greatest(pos, 1 - pos) AS max FROM (
        SELECT concept_name, count(*) AS count, sum(CASE WHEN outcome = 1 THEN 1 ELSE 0 END) / count(*) AS pos
        FROM matched JOIN outcome USING (person_id)
        WHERE certainty = 'Positive' AND concept_name <> 'No matching concept'
        GROUP BY concept_name ORDER BY count DESC, concept_name LIMIT 15)""",
    "scored_rates": "SELECT *, CASE WHEN max > 0.65 THEN max * count ELSE 0 END AS score FROM rates",
    "recent_steps": """SELECT *, CAST(day - min(day) OVER (PARTITION BY person_id) AS INTEGER) AS day_offset FROM (
        SELECT person_id, day, m4, m5, m6, max(day) OVER (PARTITION BY person_id) AS last_day FROM measured)
        WHERE day > last_day - 180""",
    "steps": """SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY day_offset) - 1 AS step,
        coalesce(day_offset / CAST(nullif(max(day_offset) OVER (), 0) AS DOUBLE), 0) AS time FROM recent_steps""",
    "scored": f"""SELECT {flag("l_returnflag = 'R'")} AS label, l_discount * 10 AS score, l_tax * 10 AS other,
        {flag("l_linestatus = 'F'")} AS mask FROM lineitem""",
    "placed": """SELECT person_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('7:' || person_id), 1, 8)
        AS BIGINT), person_id) AS place, count(*) OVER () AS n FROM cohort""",
    "split": """SELECT person_id, CASE WHEN place <= floor(0.9 * n) THEN 'train' ELSE 'valid' END AS split
        FROM placed""",
}


def needed(text: str) -> list[str]:
    """Views a text mentions, with what they mention, in order of definition."""
    import re

    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in VIEWS:
            if name in words and name not in found:
                found.add(name)
                todo.append(VIEWS[name])
    return [n for n in VIEWS if n in found]


def oracle(name: str, body: str) -> None:
    views = needed(body)
    head = "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + "\n" if views else ""
    ORACLE[name] = head + body


STATS = " UNION ALL ".join(
    "SELECT '{c}' AS feature, min({c}) AS lo, max({c}) AS hi, count({c}) AS observed FROM {{t}}".format(c=c)
    for c in ("m4", "m5", "m6")
)

oracle("source_subset", "SELECT * FROM enc ORDER BY person_id, encounter_id LIMIT 500")
oracle(
    "source_subset_persons",
    """SELECT e.person_id, e.encounter_id, e.day, m.measures FROM enc e LEFT JOIN
    (SELECT person_id, count(*) AS measures FROM meas GROUP BY person_id) m ON m.person_id = e.person_id
    WHERE e.person_id IN (SELECT DISTINCT person_id FROM enc ORDER BY person_id LIMIT 100)""",
)
oracle(
    "source_conform",
    """SELECT o_orderkey AS id, try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank,
    try_cast(o_orderstatus AS INTEGER) AS bad, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day FROM orders""",
)
oracle("sink_roundtrip", "SELECT * FROM enc")
LAYOUT = {
    "condition": "SELECT person_id AS k FROM occ WHERE domain = 'click'",
    "observation": "SELECT person_id AS k FROM occ WHERE domain = 'view'",
    "procedure": "SELECT person_id AS k FROM occ WHERE domain = 'error'",
    "drug": "SELECT person_id AS k FROM occ WHERE domain = 'purchase'",
    "measurement": "SELECT person_id AS k FROM meas",
    "person": "SELECT person_id AS k FROM person",
    "encounter": "SELECT person_id AS k FROM enc",
    "label": "SELECT person_id AS k FROM labels_",
    "members": "SELECT codeset_id AS k FROM members",
    "registry": "SELECT set_name AS k FROM registry",
}
ABSENT = "SELECT NULL AS k WHERE false"
oracle(
    "layout_roundtrip",
    " UNION ALL ".join(
        f"SELECT '{part}' AS part, '{name}' AS name, count(*) AS rows, count(DISTINCT k) AS keys FROM ({LAYOUT.get(name, ABSENT)})"
        for part in FOLDERS
        for name in (VOCABULARY_FILES if part == "vocabulary" else PERSON_FILES)
    ),
)
oracle("stats_roundtrip", STATS.format(t="measured"))

NUMBERS = {name: i for i, name in enumerate(dict.fromkeys(r[2] for r in CUSTOM_SETS), 1)}
CUSTOM_VALUES = values((NUMBERS[s], c, s, n) for c, n, s in CUSTOM_SETS)
ALL_MEMBERS = f"""SELECT * FROM members UNION ALL SELECT (SELECT max(codeset_id) FROM members) + number, concept_id,
    set_name, 'true', 1, concept_name, 'false' FROM (VALUES {CUSTOM_VALUES}) c(number, concept_id, set_name, concept_name)"""
ALL_REGISTRY = f"SELECT * FROM registry UNION SELECT * FROM (VALUES {values(CUSTOM_REGISTRY)})"
oracle("vocab_custom_sets", ALL_MEMBERS)
oracle("vocab_registry_merge", ALL_REGISTRY)
oracle("vocab_resolve", "SELECT * FROM resolved")
oracle("vocab_roles", "SELECT * FROM roles")
oracle(
    "vocab_expand",
    """SELECT b.codeset_id, m.concept_id, m.concept_name, b.set_name FROM members m
    RIGHT JOIN broad_sets b ON b.codeset_id = m.codeset_id""",
)
oracle(
    "vocab_unmatched",
    f"""SELECT set_name, CASE WHEN m.set_name IS NULL THEN 'members' ELSE 'registry' END AS missing_from FROM
    (SELECT DISTINCT set_name FROM ({ALL_REGISTRY})) r FULL JOIN (SELECT DISTINCT set_name FROM ({ALL_MEMBERS})) m
    USING (set_name) WHERE m.set_name IS NULL OR r.set_name IS NULL""",
)

oracle(
    "cohort_demographics",
    f"""SELECT d.person_id, segment, birth_date, age, {flag("segment = 'BUILDING'")} AS is_building,
    {flag("segment = 'MACHINERY'")} AS is_machinery,
    CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 1 END AS is_other,
    CASE WHEN segment IN ('FURNITURE', 'HOUSEHOLD') THEN 'goods' WHEN segment = 'BUILDING' THEN 'works'
        ELSE 'Unknown' END AS segment_group FROM demo d JOIN aged a ON a.person_id = d.person_id""",
)
oracle(
    "cohort_sample",
    """SELECT person_id FROM cohort
    WHERE CAST('0x' || substr(md5('111:' || person_id), 1, 8) AS BIGINT) < 0.25 * 4294967296""",
)
oracle("cohort_encounters", "SELECT * FROM base")
oracle("cohort_scaled", "SELECT * FROM scaled_age")

for query, domain in {
    "condition": "click", "observation": "view", "procedure": "error", "drug": "purchase", "device": "signup"
}.items():
    oracle(f"indicator_days_{query}", days_of(domain))
oracle(
    "indicator_days_indexed",
    f"""SELECT d.*, {flag("d.day < i.index_date")} AS before_index, CAST(d.day - i.index_date AS INTEGER) AS days_since
    FROM ({days_of("purchase")}) d LEFT JOIN (SELECT person_id, min(day) AS index_date FROM hits
    WHERE domain = 'click' AND indicator = 'ind0' GROUP BY person_id) i ON i.person_id = d.person_id""",
)
oracle("index_date", "SELECT * FROM first_click")

oracle("measure_days", f"SELECT person_id, day, {', '.join(LAB_NAMES)} FROM measured")
oracle("measure_bmi", "SELECT person_id, day, rounded AS bmi_rounded, obese FROM measured_days")
oracle(
    "measure_flags",
    f"""SELECT m.person_id, day, {", ".join(FLAG_NAMES)}, {flag("segment = 'BUILDING'")} AS is_building
    FROM measured m JOIN person p ON p.person_id = m.person_id""",
)

oracle("dose_resolved", "SELECT * FROM doses")
oracle(
    "dose_codeset",
    f"""SELECT DISTINCT person_id, day, product FROM ({EXPOSURES}) WHERE type_id NOT IN (3, 5)
    AND day < DATE '2024-01-20' AND concept_id IN (SELECT concept_id FROM members WHERE codeset_id = 104)""",
)
oracle("dose_gaps", "SELECT * FROM gaps")
oracle("dose_counts", "SELECT person_id, count(day) AS doses FROM gaps GROUP BY person_id")
oracle("dose_wide", "SELECT * FROM wide")
oracle("dose_facts", "SELECT * FROM dose_facts")
oracle("dose_days", "SELECT * FROM dose_days")

oracle("day_facts", "SELECT * FROM facts")
NOTE_SIGNS = f"""SELECT note_id, person_id, day, visit_id, {", ".join(
    f"CASE WHEN min(s) FILTER (set_name = '{s}') = max(s) FILTER (set_name = '{s}') "
    f"THEN max(s) FILTER (set_name = '{s}') END AS {c}" for s, c in zip(SETS, SYMPTOMS))}
    FROM (SELECT *, CASE certainty WHEN 'Positive' THEN 1 WHEN 'Negated' THEN -1 END AS s FROM matched)
    GROUP BY note_id, person_id, day, visit_id"""
oracle(
    "day_facts_parts",
    f"""SELECT person_id, day, {", ".join(f"coalesce(max({c}), 0) AS {c}" for c in INDICATORS)},
    {", ".join(f"coalesce(max({c}), 0) AS {c}" for c in ("sympt_broad_0", "sympt_broad_3"))},
    max(sympt_broad_2) AS sympt_broad_2 FROM (SELECT person_id, day FROM enc
    UNION ALL BY NAME {days_of("click")} UNION ALL BY NAME {days_of("view")}
    UNION ALL BY NAME SELECT person_id, day, sympt_broad_0, sympt_broad_1 AS ind1, sympt_broad_2, sympt_broad_3
    FROM ({NOTE_SIGNS})) GROUP BY person_id, day""",
)
oracle(
    "episode_flag",
    f"""SELECT DISTINCT o.person_id, o.day, {flag('''EXISTS (SELECT 1 FROM episodes e
    WHERE e.person_id = o.person_id AND o.day BETWEEN e.start_day AND e.end_day)''')} AS in_episode FROM occ o""",
)

oracle(
    "person_summary",
    """SELECT b.*, r.* EXCLUDE (person_id) REPLACE (round(m8_mean, 6) AS m8_mean)
    FROM base b LEFT JOIN rollup r ON r.person_id = b.person_id""",
)
oracle(
    "summary_positive_stats",
    """SELECT person_id, min(m4) FILTER (m4 > 0) AS min_m4, min(m8) FILTER (m8 > 0) AS min_m8,
    max_by(m5, day) FILTER (m5 > 0) AS last_m5, max_by(m6, day) FILTER (m6 > 0) AS last_m6
    FROM measured GROUP BY person_id""",
)
oracle(
    "column_variance",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(var_samp({c}), 4) AS variance FROM measured_days"
        for c in ("m4", "m5", "m6", "obese")
    ),
)


def ranked(source: str, lo: int, hi: int) -> str:
    return f"""SELECT domain, concept_id FROM (SELECT domain, concept_id, row_number() OVER (PARTITION BY domain
        ORDER BY count(*) DESC, concept_id) AS r FROM {source} GROUP BY domain, concept_id)
        WHERE r > {lo} AND r <= {hi}"""


FEATURES = [(d[:3], c) for d in ROUTES for c in range(100)] + [("mea", c) for c in range(24)]
oracle(
    "topk_cells",
    f"""SELECT DISTINCT person_id, domain || concept_id AS feature FROM tagged
    JOIN ({ranked("tagged", 0, 10)}) USING (domain, concept_id) WHERE person_id IN (SELECT person_id FROM cohort)""",
)
CELLS = ", ".join(f"coalesce(max({flag(f'domain = {chr(39)}{d}{chr(39)} AND concept_id = {c}')}), 0) AS {d}{c}"
                  for d, c in FEATURES)
oracle(
    "topk_matrix",
    f"SELECT c.person_id, {CELLS} FROM cohort c LEFT JOIN tagged t ON t.person_id = c.person_id GROUP BY c.person_id",
)
oracle(
    "topk_matrix_sparse",
    f"""SELECT DISTINCT person_id, domain || concept_id AS feature FROM tagged
    JOIN ({ranked("tagged", 0, 100)}) USING (domain, concept_id) WHERE person_id IN (SELECT person_id FROM cohort)""",
)
oracle(
    "topk_page_days",
    f"""SELECT DISTINCT t.person_id, t.day, t.domain || t.concept_id AS feature, outcome FROM recent_tagged t
    JOIN ({ranked("recent_tagged", 20, 40)}) r ON r.domain = t.domain AND r.concept_id = t.concept_id
    JOIN outcome o ON o.person_id = t.person_id""",
)
oracle(
    "topk_page_days_dense",
    f"""SELECT t.person_id, t.day, {CELLS}, max(outcome) AS outcome FROM recent_tagged t
    JOIN outcome o ON o.person_id = t.person_id GROUP BY t.person_id, t.day""",
)
oracle(
    "topk_persons_dated",
    """SELECT c.person_id, coalesce(outcome, 0) AS outcome FROM cohort c LEFT JOIN outcome o
    ON o.person_id = c.person_id WHERE c.person_id IN (SELECT person_id FROM enc UNION SELECT person_id FROM occ)
    AND c.person_id NOT IN (SELECT person_id FROM enc WHERE day IS NULL)""",
)

oracle(
    "lookback_rows",
    """SELECT *, last_day - 180 AS cutoff_day, CAST(day - first_day AS INTEGER) AS day_offset FROM recent_facts""",
)
oracle(
    "lookback_counts",
    "SELECT person_id, count(DISTINCT day) AS recent_days FROM recent_facts GROUP BY person_id",
)
oracle(
    "lookback_notes",
    f"""SELECT r.*, min(r.day) OVER (PARTITION BY r.person_id) AS first_day, r.last_day - 180 AS cutoff_day,
    CAST(r.day - min(r.day) OVER (PARTITION BY r.person_id) AS INTEGER) AS day_offset,
    {", ".join(SYMPTOMS)}, CASE WHEN n.note_id IS NOT NULL THEN 1.0::DOUBLE END AS has_note FROM (
    SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY person_id) AS last_day FROM (
        SELECT person_id, day, {", ".join(f"coalesce(max({c}), 0) AS {c}" for c in INDICATORS)} FROM (
            SELECT person_id, day FROM enc UNION ALL BY NAME {days_of("click")}
            UNION ALL BY NAME {days_of("view")}) WHERE day IS NOT NULL GROUP BY person_id, day))
    WHERE day > last_day - 180) r LEFT JOIN ({NOTE_SIGNS}) n ON n.person_id = r.person_id AND n.day = r.day""",
)

oracle("mention_notes", "SELECT * FROM noted")
oracle("mention_consistent", "SELECT * FROM consistent")
oracle("mention_matched", "SELECT * FROM matched WHERE certainty = 'Positive'")
oracle(
    "mention_concept_rates",
    """SELECT concept_name, round(pos, 6) AS pos, round(neg, 6) AS neg, round(max, 6) AS max, count,
    round(score, 6) AS score FROM scored_rates""",
)
oracle(
    "mention_selected",
    """SELECT DISTINCT s.concept_name, count, round(score, 6) AS score, concept_id FROM scored_rates s
    JOIN matched m ON m.concept_name = s.concept_name AND certainty = 'Positive' WHERE score > 0 AND count > 100""",
)
oracle("mention_pivot", NOTE_SIGNS)
oracle(
    "mention_pivot_names",
    f"""SELECT note_id, person_id, day, visit_id, {", ".join(
    f"CASE WHEN min(s) FILTER (concept_name = 'concept, {i}') = max(s) FILTER (concept_name = 'concept, {i}') "
    f"THEN max(s) FILTER (concept_name = 'concept, {i}') END AS concept_{i}" for i in range(1, 20))}
    FROM (SELECT *, CASE certainty WHEN 'Positive' THEN 1 WHEN 'Negated' THEN -1 END AS s FROM matched)
    GROUP BY note_id, person_id, day, visit_id""",
)
SIGNED = "(SELECT DISTINCT note_id, set_name, CASE certainty WHEN 'Positive' THEN 1 ELSE -1 END AS s FROM matched)"
oracle(
    "mention_pivot_fanout",
    f"""SELECT n.note_id, n.person_id, n.day, n.visit_id, {", ".join(f"x{i}.s AS {c}" for i, c in enumerate(SYMPTOMS))}
    FROM (SELECT DISTINCT note_id, person_id, day, visit_id FROM matched) n {" ".join(
    f"LEFT JOIN {SIGNED} x{i} ON x{i}.note_id = n.note_id AND x{i}.set_name = '{s}'" for i, s in enumerate(SETS))}""",
)

oracle(
    "outcome_labels",
    "SELECT c.person_id, coalesce(outcome, 0) AS outcome FROM cohort c LEFT JOIN outcome o ON o.person_id = c.person_id",
)
SETUP_COLUMN = {"prior": "prior", "after": "after", "both": "greatest(after, prior)"}
oracle(
    "outcome_setups",
    " UNION ALL ".join(f"SELECT person_id, {SETUP_COLUMN[s]} AS outcome, '{s}' AS setup FROM labels_" for s in SETUPS),
)
oracle("split_exact", "SELECT * FROM split")
oracle("split_restrict", "SELECT * FROM enc WHERE person_id IN (SELECT person_id FROM split WHERE split = 'valid')")

SEEN = ", ".join(f"{flag(f'{c} IS NOT NULL')} AS {c}_seen" for c in ("m4", "m5", "m6"))
FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("m4", "m5", "m6"))
oracle(
    "seq_build",
    f"""SELECT s.person_id, age_scaled, outcome, CAST(step AS INTEGER) AS step, day_offset AS t, {FILLED}, {SEEN}
    FROM steps s LEFT JOIN scaled_age a ON a.person_id = s.person_id LEFT JOIN outcome o ON o.person_id = s.person_id""",
)
oracle("seq_stats", STATS.format(t="recent_steps"))
oracle(
    "seq_observed",
    """SELECT person_id, day, last_day, last_day - 180 AS cutoff_day, day - day_offset AS first_day, day_offset, m4, m5, m6
    FROM recent_steps""",
)
oracle(
    "seq_scaled",
    "SELECT person_id, day, "
    + ", ".join(
        f"round(coalesce(({c} - min({c}) OVER ()) / coalesce(nullif(max({c}) OVER (), 0), 1), 0), 6) AS {c}"
        for c in ("m4", "m5", "m6")
    )
    + " FROM recent_steps",
)
oracle(
    "seq_padded",
    f"""SELECT g.person_id, CAST(g.step AS INTEGER) AS step, round(coalesce(time, 0), 6) AS t, {FILLED}, {SEEN}
    FROM (SELECT person_id, unnest(range((SELECT max(step) + 1 FROM steps))) AS step
          FROM (SELECT DISTINCT person_id FROM steps)) g
    LEFT JOIN steps s ON s.person_id = g.person_id AND s.step = g.step""",
)
WAVES = " + ".join(f"cos(48.0 * exp(-{2 * j} * ln(10.0) / 32) * (point / 127.0::DOUBLE - time))" for j in range(16))
oracle(
    "seq_resampled",
    f"""SELECT person_id, CAST(point AS INTEGER) AS point, round(point / 127.0::DOUBLE, 5) AS time,
    {", ".join(f"round(coalesce(sum(w * {c}) / sum(w) FILTER ({c} IS NOT NULL), 0), 5) AS {c}" for c in ("m4", "m5", "m6"))}
    FROM (SELECT *, exp(({WAVES}) / sqrt(32)) AS w FROM (SELECT *, unnest(range(128)) AS point FROM steps))
    GROUP BY person_id, point""",
)

# The outcome of the model queries is either of two indicators, or the most frequent concept of a domain.
RULE = """SELECT b.person_id, greatest(coalesce(ind3_indicator, 0), coalesce(ind5_indicator, 0)) AS predicted
    FROM base b LEFT JOIN rollup r ON r.person_id = b.person_id"""
for kind in ("lr", "lr_balanced", "rf", "gbt", "gbt_exponential"):
    oracle(f"model_{kind}", RULE)
TOP_CLICK = "SELECT concept_id FROM tagged WHERE domain = 'cli' AND concept_id IS NOT NULL GROUP BY concept_id ORDER BY count(*) DESC, concept_id LIMIT 1"
for kind in ("lr", "lr_balanced", "rf", "gbt", "mlp"):
    oracle(
        f"matrix_{kind}",
        f"""SELECT person_id, {flag(f"person_id IN (SELECT person_id FROM tagged WHERE domain = 'cli' AND concept_id = ({TOP_CLICK}))")}
        AS predicted FROM cohort""",
    )
oracle("model_roundtrip", "SELECT person_id, 1 AS same FROM base")
oracle(
    "aligned_columns",
    """SELECT c.person_id, CAST(coalesce(ind0_indicator, 0) AS DOUBLE) AS ind0_indicator, 0.0::DOUBLE AS ind1_indicator,
    CAST(coalesce(ind2_indicator, 0) AS DOUBLE) AS ind2_indicator FROM base c LEFT JOIN rollup r ON r.person_id = c.person_id""",
)
oracle("model_best", "SELECT unnest(['lr', 'lr_balanced']) AS candidate, true AS unseen, true AS least")
SUMMARY_FEATURES = ["age", "encounters"] + [
    f"{c}_indicator" for c in (*INDICATORS, "m6", "m9", "m10", "obese", *FLAG_NAMES, *DOSE_COLUMNS[:-1], *DOSE_TAIL)
]
oracle(
    "feature_ranks",
    f"""SELECT model, list, CAST(rank AS INTEGER) AS rank, CASE WHEN model = 'rf' THEN list = 'top' AND rank < 3 END AS of_rule,
    rank > {len(SUMMARY_FEATURES) - 20} AS in_both, true AS ordered
    FROM (SELECT unnest(['lr', 'rf']) AS model), (SELECT unnest(['top', 'least']) AS list), (SELECT unnest(range(1, 21)) AS rank)""",
)
oracle(
    "model_gradient",
    f"""SELECT model, weight, true AS flat FROM (SELECT unnest(['lr', 'lr_balanced']) AS model),
    (SELECT unnest(['intercept', {", ".join(f"'{c}'" for c in SUMMARY_FEATURES)}]) AS weight)""",
)
oracle(
    "model_grid",
    """SELECT candidate, fold, rows, true AS winner_is_least FROM (SELECT unnest(['c0', 'c2', 'c4']) AS candidate),
    (SELECT CAST(CAST('0x' || substr(md5('5:' || person_id), 1, 8) AS BIGINT) % 3 AS INTEGER) AS fold, count(*) AS rows FROM base GROUP BY fold)""",
)
# A leaf moves its margin f by a quarter of (p exp(-f) - q exp(f)) / (p exp(-f) + q exp(f)), p and q its persons of each outcome.
oracle(
    "boost_rounds",
    """SELECT round, rows, loss FROM (WITH RECURSIVE leaves AS (
        SELECT coalesce(ind3_indicator, 0) AS a, coalesce(ind5_indicator, 0) AS b,
            count(*) FILTER (coalesce(outcome, 0) = 1) AS p, count(*) FILTER (coalesce(outcome, 0) <> 1) AS q
        FROM base c LEFT JOIN rollup r ON r.person_id = c.person_id LEFT JOIN outcome o ON o.person_id = c.person_id GROUP BY 1, 2),
    turns AS (
        SELECT 0 AS round, a, b, p, q, 0.5::DOUBLE * ln(sum(p) OVER () / sum(q) OVER ()) AS f FROM leaves
        UNION ALL
        SELECT round + 1, a, b, p, q, f + 0.25::DOUBLE * (p * exp(-f) - q * exp(f)) / (p * exp(-f) + q * exp(f)) FROM turns WHERE round < 8)
    SELECT round, CAST(sum(p + q) AS BIGINT) AS rows, round(sum(p * exp(-f) + q * exp(f)) / sum(p + q), 6) AS loss
    FROM turns GROUP BY round)""",
)
oracle(
    "ensemble_scores",
    """SELECT person_id, score_a, score_b, score_c,
    round((coalesce(score_a, 0) + coalesce(score_b, 0) + score_c) / n, 6) AS probability,
    CASE WHEN (coalesce(score_a, 0) + coalesce(score_b, 0) + score_c) / n > 0.5 THEN 1 ELSE 0 END AS outcome
    FROM (SELECT c.person_id, score_a, score_b, coalesce(score_c, 0.5) AS score_c,
        1 + (score_a IS NOT NULL)::INT + (score_b IS NOT NULL)::INT AS n
    FROM cohort c LEFT JOIN (SELECT o_custkey, count(*) % 10 / 10.0::DOUBLE AS score_a,
        max(o_orderkey) % 100 / 100.0::DOUBLE AS score_b FROM orders GROUP BY o_custkey) o ON o_custkey = c.person_id
    LEFT JOIN (SELECT person_id, max(concept_id) / 100.0::DOUBLE AS score_c FROM occ GROUP BY person_id) u
        ON u.person_id = c.person_id)""",
)
LOSS = "-avg(label * ln(greatest(least({s}, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least({s}, 1 - 1e-15), 1e-15)))"
COUNTS = """SELECT count(*) FILTER (label = 1 AND score > 0.5) AS tp, count(*) FILTER (label = 0 AND score > 0.5) AS fp,
    count(*) FILTER (label = 1 AND score <= 0.5) AS fn, count(*) FILTER (label = 0 AND score <= 0.5) AS tn"""
oracle(
    "binary_metrics",
    f"""SELECT c.*, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall,
    round(tp / (tp + fp), 6) AS precision, round(auc, 6) AS auc FROM ({COUNTS},
    round({LOSS.format(s="score")}, 6) AS log_loss FROM scored) c,
    (SELECT (sum(rank_sum) - (sum(pos) * (sum(pos) + 1)) / 2.0) / (sum(pos) * sum(neg)::DOUBLE) AS auc FROM (
        SELECT pos, neg, pos * (sum(pos + neg) OVER (ORDER BY score) - (pos + neg) + (pos + neg + 1) / 2.0) AS rank_sum
        FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score)))""",
)
oracle(
    "class_report",
    f"""SELECT 0 AS class, round(tn / (tn + fn), 6) AS precision, round(tn / (tn + fp), 6) AS recall,
    round(2 * tn / (2 * tn + fn + fp), 6) AS f1, tn + fp AS support FROM ({COUNTS} FROM scored)
    UNION ALL SELECT 1, round(tp / (tp + fp), 6), round(tp / (tp + fn), 6), round(2 * tp / (2 * tp + fp + fn), 6),
    tp + fn FROM ({COUNTS} FROM scored)""",
)
oracle(
    "candidate_losses",
    f"""SELECT 'discount' AS candidate, round({LOSS.format(s="score")}, 6) AS loss FROM scored
    UNION ALL SELECT 'tax', round({LOSS.format(s="other")}, 6) FROM scored""",
)
oracle(
    "masked_mse",
    "SELECT round(sum(mask * (score - other) * (score - other)) / sum(mask), 6) AS mse FROM scored",
)

# The same rows by the way beyond the broadcast bound.
ORACLE["indicator_days_salted"] = ORACLE["indicator_days_condition"]
ORACLE["measure_flags_salted"] = ORACLE["measure_flags"]
ORACLE["mention_matched_salted"] = ORACLE["mention_matched"]
ORACLE["product_person_days"] = ORACLE["day_facts"]
ORACLE["product_summary"] = ORACLE["person_summary"]
ORACLE["product_lookback"] = ORACLE["lookback_rows"]
oracle(
    "product_sequences",
    f"SELECT person_id, CAST(step AS INTEGER) AS step, day_offset AS t, {FILLED}, {SEEN} FROM steps",
)
oracle(
    "lookback_ordered",
    """SELECT person_id, day, last_day, first_day, CAST(day - first_day AS INTEGER) AS day_offset FROM (
    SELECT *, min(day) OVER (PARTITION BY person_id) AS first_day FROM (
        SELECT *, max(day) OVER (PARTITION BY person_id) AS last_day FROM (
            SELECT person_id, day FROM enc UNION SELECT person_id, day FROM hits WHERE domain IN ('click', 'view'))
        WHERE day IS NOT NULL) WHERE day > last_day - 180)""",
)

# Orders as text, with values that do not parse.
WRITTEN = """(SELECT o_orderkey AS id, o_orderkey % 7 = 0 AS bad_rank, o_orderkey % 11 = 0 AS bad_price, o_orderkey % 5 = 0 AS bad_day,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, CASE WHEN o_orderkey % 13 > 0 THEN o_totalprice END AS price,
    CAST(o_orderdate AS DATE) AS day FROM orders)"""
oracle(
    "source_refused",
    " UNION ALL ".join(
        f"SELECT 'orders' AS table_name, '{c}' AS column_name, count(*) AS rows, {bad} AS refused FROM {WRITTEN}"
        for c, bad in (("id", "0"), ("rank", "count_if(bad_rank)"), ("price", "count_if(bad_price)"), ("day", "count_if(bad_day)"))
    ),
)
oracle(
    "source_strict",
    f"""SELECT id, CASE WHEN bad THEN NULL ELSE rank END AS rank, CASE WHEN bad THEN NULL ELSE price END AS price,
    CASE WHEN bad THEN NULL ELSE day END AS day, CASE WHEN bad THEN 1 ELSE 0 END AS refused
    FROM (SELECT *, bad_rank OR bad_price OR bad_day AS bad FROM {WRITTEN})""",
)

BOUND_ROWS = ", ".join(f"({i}, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (_, _, lo, hi) in enumerate(MEASURE_BOUNDS))
GATED = ", ".join(
    f"""round(CASE WHEN count(value) > 0 THEN coalesce(max(scaled) FILTER (concept_id = {i} AND scaled BETWEEN lo AND hi), 0) END, 6) AS {name}"""
    for i, (name, *_) in enumerate(MEASURE_BOUNDS)
)
oracle(
    "measure_days_default",
    f"""SELECT person_id, day, {GATED} FROM (SELECT person_id, day, concept_id, value, lo, hi,
    lo + (hi - lo) * (value - 5) / 40.0::DOUBLE AS scaled
    FROM meas JOIN (VALUES {BOUND_ROWS}) b(i, lo, hi) ON i = concept_id) WHERE day IS NOT NULL
    AND person_id IN (SELECT person_id FROM cohort) GROUP BY person_id, day""",
)

BATCHED = """(SELECT *, max(length) OVER (PARTITION BY batch) AS batch_length FROM (SELECT *, (row_number() OVER (ORDER BY length,
    CAST('0x' || substr(md5('3:' || person_id), 1, 8) AS BIGINT), person_id) - 1) // 64 AS batch
    FROM (SELECT person_id, CAST(count(*) AS INTEGER) AS length FROM steps GROUP BY person_id)))"""
oracle("seq_batches", f"SELECT * FROM {BATCHED}")
oracle(
    "seq_batch_padded",
    f"""SELECT g.person_id, g.batch, CAST(g.step AS INTEGER) AS step,
    round(coalesce(day_offset / nullif(max(day_offset) OVER (PARTITION BY g.batch), 0)::DOUBLE, 0), 6) AS t, {FILLED}, {SEEN}
    FROM (SELECT person_id, batch, unnest(range(batch_length)) AS step FROM {BATCHED}) g
    LEFT JOIN steps s ON s.person_id = g.person_id AND s.step = g.step""",
)
FITTED = ", ".join(
    f"round(coalesce((r.{c} - f.{c}_lo) / coalesce(nullif(f.{c}_hi, 0), 1), 0), 6) AS {c}" for c in ("m4", "m5", "m6")
)
LIMITS = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in ("m4", "m5", "m6"))
oracle(
    "seq_scaled_fitted",
    f"""SELECT r.person_id, r.day, {FITTED} FROM recent_steps r JOIN split p ON p.person_id = r.person_id AND p.split = 'valid',
    (SELECT {LIMITS} FROM recent_steps JOIN split USING (person_id) WHERE split = 'train') f""",
)

oracle(
    "roc_by_group",
    """SELECT l_linestatus, part, round((sum(rank_sum) - sum(pos) * (sum(pos) + 1) / 2.0) / nullif(sum(pos) * sum(neg)::DOUBLE, 0), 6) AS auc
    FROM (SELECT *, pos * (sum(pos + neg) OVER (PARTITION BY l_linestatus, part ORDER BY score) - (pos + neg) + (pos + neg + 1) / 2.0) AS rank_sum
        FROM (SELECT l_linestatus, CASE WHEN l_linenumber > 5 THEN 'late' END AS part,
            l_extendedprice * (1 - l_discount) / 10000 - 3 AS score,
            count_if(l_returnflag = 'R' AND l_linenumber <> 7) AS pos, count_if(NOT (l_returnflag = 'R' AND l_linenumber <> 7)) AS neg
            FROM lineitem GROUP BY ALL)) GROUP BY l_linestatus, part""",
)
FOLDED = """(SELECT l_returnflag = 'R' AS hit, CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount * 10 AS discount, l_tax * 10 AS tax,
    CAST(CAST('0x' || substr(md5('5:' || l_orderkey), 1, 8) AS BIGINT) % 3 AS INTEGER) AS fold FROM lineitem)"""
oracle(
    "grid_losses",
    f"""SELECT candidate, fold, rows, round(loss, 6) AS loss, round(mean, 6) AS mean, CAST(dense_rank() OVER (ORDER BY mean, candidate) AS INTEGER) AS rank
    FROM (SELECT *, sum(loss * rows) OVER (PARTITION BY candidate) / sum(rows) OVER (PARTITION BY candidate) AS mean FROM (
        {" UNION ALL ".join(f"SELECT '{c}' AS candidate, fold, count(*) AS rows, {LOSS.format(s=c)} AS loss FROM {FOLDED} GROUP BY fold" for c in ("discount", "tax"))}))""",
)
