"""DuckDB twins of the queries, written independently of the Spark operators.

They share only the input mapping of ``visitflow.sources.fixtures`` with them. Every statement reads the whole tables.
"""

from __future__ import annotations

from visitflow.sources import fixtures as X

S = X.STUDY
KEYS = "patid, admincat, apptdate, atentype, attended, dnadate, firstatt, outcome, priority, refsourc, reqdate, " \
       "servtype, stafftyp, wait_ind, waiting, hes_yr, tretspef, mainspef"
STATUS = {"attended": "Attended", "cancelled": "Cancelled", "did_not_attend": "Did Not Attend"}
KIND = {"new": "New", "follow_up": "Follow up"}
BANDS = {"1_week": "1 week", "1_month": "1 month", "3_months": "3 months", "6_months": "6 months",
         "9_months": "9 months", "12_months": "12 months"}
LAST = BANDS | {"new_referral": "New referral", "unknown": "Unknown"}
NEXT = BANDS | {"discharged": "Discharged", "unknown": "Unknown"}
TYPES = {"type1": "type1", "type2": "type2"}
SUMMARY = ["ethnos", "admincat", "attended", "firstatt", "outcome", "priority", "refsourc", "servtype", "stafftyp",
           "tretspef_name", "discharged"]
WEEKS = 53


def _rules(rules: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in rules.items())


def _day(value) -> str:
    return f"DATE '{value}'"


def _weeks(days: str) -> str:
    return f"CAST(ceil(({days}) / 7.0) AS INT)"


def _band(weeks: str) -> str:
    return f"""CASE WHEN {weeks} < 0 THEN NULL WHEN {weeks} <= 1 THEN '1 week' WHEN {weeks} <= 6 THEN '1 month'
        WHEN {weeks} <= 17 THEN '3 months' WHEN {weeks} <= 30 THEN '6 months' WHEN {weeks} <= 41 THEN '9 months'
        WHEN {weeks} > 41 THEN '12 months' END"""


GAPS = f"""
    CAST(datediff('day', last_appt_date, apptdate) AS INT) AS last_appt_int_days,
    CAST(datediff('day', apptdate, next_appt_date) AS INT) AS next_appt_int_days,
    {_weeks("datediff('day', last_appt_date, apptdate)")} AS last_appt_int_weeks,
    {_weeks("datediff('day', apptdate, next_appt_date)")} AS next_appt_int_weeks"""
WEEK_OF_YEAR = "CAST((dayofyear(apptdate) - 1) // 7 + 1 AS INT)"
ORDER = "ORDER BY apptdate NULLS LAST, attendkey"

CTES = {
    "raw": f"SELECT {_rules(X.APPOINTMENT_RULES)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "patients": f"SELECT {_rules(X.PATIENT_RULES)} FROM customer WHERE c_nationkey <> 0",
    "kinds": f"SELECT {_rules(X.TYPE_RULES)} FROM customer WHERE c_mktsegment <> 'MACHINERY'",
    "lookup": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in X.SPECIALTY_NAMES.items())
              + ") AS t(tretspef, tretspef_name)",
    "rec": """SELECT * REPLACE (
        nullif(admincat, 99) AS admincat, CASE WHEN apptage BETWEEN 7001 AND 7007 THEN 0 ELSE apptage END AS apptage,
        nullif(atentype, 13) AS atentype, nullif(attended, 9) AS attended,
        CASE WHEN firstatt IN ('X', '9') THEN NULL ELSE TRY_CAST(firstatt AS INT) END AS firstatt,
        nullif(outcome, 9) AS outcome, nullif(priority, 9) AS priority, nullif(refsourc, 99) AS refsourc,
        nullif(servtype, 9) AS servtype, CASE WHEN stafftyp IN (9, 99) THEN NULL ELSE stafftyp END AS stafftyp)
        FROM raw""",
    "cleaned": f"""SELECT d.* EXCLUDE (apptage, atentype), tretspef_name, ons_dod, diabetes_type
        FROM (SELECT * FROM rec WHERE patid IN (SELECT patid FROM patients)
              QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY attendkey) = 1) d
        LEFT JOIN lookup USING (tretspef) LEFT JOIN patients USING (patid) LEFT JOIN kinds USING (patid)
        WHERE d.tretspef IS NOT NULL AND firstatt IS NOT NULL AND attended IS NOT NULL
          AND (apptdate < ons_dod OR ons_dod IS NULL)""",
    "coded": """SELECT *,
        CASE WHEN firstatt IN (1, 3) THEN 'New' WHEN firstatt IN (2, 4) THEN 'Follow up' END AS firstatt_agg,
        CASE WHEN attended IN (5, 6) THEN 'Attended' WHEN attended IN (2, 4) THEN 'Cancelled'
             ELSE 'Did Not Attend' END AS attended_agg,
        CASE WHEN outcome = 1 THEN 1 WHEN outcome IN (2, 3) THEN 0 END AS discharged FROM cleaned""",
    "period": f"""SELECT * FROM coded WHERE tretspef = '307' AND diabetes_type IN ('type1', 'type2')
        AND apptdate >= {_day(S.study_start)}""",
    "lagged": f"""SELECT *,
        CASE WHEN firstatt_agg <> 'New' THEN lag(apptdate) OVER w END AS last_appt_date,
        CASE WHEN outcome <> 1 THEN lead(apptdate) OVER w END AS next_appt_date,
        lead(firstatt) OVER w AS lead_firstatt,
        min(CASE WHEN apptdate >= {_day(S.study_start)} THEN apptdate END)
            OVER (PARTITION BY patid, tretspef) AS index_appt_study,
        CASE WHEN apptdate >= {_day(S.study_start)} AND row_number() OVER
            (PARTITION BY patid, tretspef, apptdate >= {_day(S.study_start)} {ORDER}) = 1 THEN 1 END AS flag_index_study
        FROM coded WINDOW w AS (PARTITION BY patid, tretspef {ORDER})""",
    "derived": f"""SELECT * EXCLUDE (discharged), discharged AS discharged_coded,
        CASE WHEN outcome IS NULL AND lead_firstatt IN (1, 3) THEN 1
             WHEN outcome IS NULL AND lead_firstatt IN (2, 4) THEN 0 ELSE discharged END AS discharged, {GAPS}
        FROM lagged""",
    "study_lagged": f"""SELECT *,
        CASE WHEN firstatt_agg <> 'New' THEN lag(apptdate) OVER w END AS last_appt_date,
        CASE WHEN outcome <> 1 THEN lead(apptdate) OVER w END AS next_appt_date
        FROM period WHERE apptdate > {_day(S.study_start)} WINDOW w AS (PARTITION BY patid {ORDER})""",
    "study_gaps": f"SELECT *, {GAPS} FROM study_lagged",
    "study": f"""SELECT *,
        CASE WHEN firstatt_agg IS NULL THEN 'Unknown' WHEN firstatt_agg = 'New' THEN 'New referral'
             ELSE coalesce({_band('last_appt_int_weeks')}, 'Unknown') END AS appt_int_last_binned,
        CASE WHEN next_appt_int_weeks IS NOT NULL THEN {_band('next_appt_int_weeks')}
             WHEN outcome = 1 THEN 'Discharged' ELSE 'Unknown' END AS appt_int_next_binned FROM study_gaps""",
    "cohort": f"""SELECT *, {_weeks(f"datediff('day', {_day(S.sim_start)}, apptdate) + 1")} AS sim_week FROM study
        WHERE apptdate BETWEEN {_day(S.sim_start)} AND {_day(S.sim_end)}""",
    "indexed": f"""SELECT *,
        CASE WHEN row_number() OVER (PARTITION BY patid {ORDER}) = 1 THEN 1 ELSE 0 END AS flag_first_appt_sim,
        min(apptdate) OVER (PARTITION BY patid) AS date_first_appt_sim,
        CAST(datediff('day', min(apptdate) OVER (PARTITION BY patid), apptdate) + 1 AS INT) AS time_since_first_d1
        FROM cohort""",
    "checked": f"""SELECT * EXCLUDE (firstatt_agg), CAST(year(apptdate) AS INT) AS year, {WEEK_OF_YEAR} AS week,
        CASE WHEN firstatt IN (1, 3) THEN 1 WHEN firstatt IN (2, 4) THEN 2 END AS firstatt_agg
        FROM coded WHERE tretspef = '307' AND diabetes_type IN ('type1', 'type2')""",
    "checked_window": f"""SELECT * FROM checked
        WHERE apptdate BETWEEN {_day(S.check_start)} AND {_day(S.check_end)}""",
    "checked_cohort": f"""SELECT *, CAST(year(apptdate) AS INT) AS year, {WEEK_OF_YEAR} AS week FROM study
        WHERE apptdate BETWEEN {_day(S.check_start)} AND {_day(S.check_end)}""",
    "regions": """SELECT c_custkey AS patid, r_name AS ethnos FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "described": f"""SELECT * FROM derived LEFT JOIN regions USING (patid)
        WHERE diabetes_type IN ('type1', 'type2') AND apptdate >= {_day(S.study_start)}""",
}
DEPENDS = {
    "rec": ["raw"], "cleaned": ["rec", "patients", "kinds", "lookup"], "coded": ["cleaned"], "period": ["coded"],
    "lagged": ["coded"], "derived": ["lagged"], "study_lagged": ["period"], "study_gaps": ["study_lagged"],
    "study": ["study_gaps"], "cohort": ["study"], "indexed": ["cohort"], "checked": ["coded"],
    "checked_window": ["checked"], "checked_cohort": ["study"], "described": ["derived", "regions"],
}


def _on(body: str, *needed: str, extra: dict[str, str] | None = None) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for parent in DEPENDS.get(name, []):
            add(parent)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    parts = [f"{name} AS ({CTES[name]})" for name in order]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}"


def _steps(part: str, whole: str, digits: int) -> str:
    """``part / whole`` in units of ``10 ** -digits``, rounded half to even with integers only."""
    scaled = f"(({part}) * {10 ** digits})"
    rest = f"(2 * ({scaled} % ({whole})))"
    return (f"({scaled} // ({whole}) + CASE WHEN {rest} > ({whole}) OR ({rest} = ({whole}) "
            f"AND ({scaled} // ({whole})) % 2 = 1) THEN 1 ELSE 0 END)")


def _rounded(part: str, whole: str, digits: int) -> str:
    return f"CAST({_steps(part, whole, digits)} AS DOUBLE) / {10 ** digits}"


def _share(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / CAST(nullif({whole}, 0) AS DOUBLE)"


def _percent(part: str, whole: str, digits: int, with_n: bool) -> str:
    steps = _steps(f"({part}) * 100", whole, digits)
    text = f"CAST({steps} AS VARCHAR)" if digits == 0 else (
        f"CAST({steps} // 10 AS VARCHAR) || '.' || CAST({steps} % 10 AS VARCHAR)")
    tail = f" || ' (' || CAST({part} AS VARCHAR) || ')'" if with_n else ""
    return f"CASE WHEN ({whole}) = 0 THEN '-' ELSE {text} || '%' END{tail}"


def _cells(column: str, levels: dict[str, str], wrap: str = "{}") -> str:
    return ", ".join(
        f'CAST({wrap.format(f"count(*) FILTER (WHERE {column} = {_literal(v)})")} AS BIGINT) AS "{name}"'
        for name, v in levels.items()
    )


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def _tabulate(source: str, row: str, column: str, levels: dict, na: bool = True, where: str = "true") -> str:
    na_cell = f", CAST(count(*) FILTER (WHERE {column} IS NULL) AS BIGINT) AS na_" if na else ""
    return f"SELECT {row}, {_cells(column, levels)}{na_cell} FROM {source} WHERE {where} GROUP BY {row}"


def _total(levels: dict) -> str:
    return "(" + " + ".join(f'"{n}"' for n in levels) + ")"


def _percent_table(table: str, row: str, levels: dict, digits: int, with_n: bool = True) -> str:
    cells = ", ".join(
        _percent(f'"{n}"', _total(levels), digits, with_n) + f' AS "{n}", "{n}" AS "n_{n}"' for n in levels
    )
    return f"SELECT {row}, {cells} FROM ({table})"


def _share_within(source: str, outer: list[str], inner: list[str], where: str = "true", digits: int = 2) -> str:
    keys, whole = ", ".join(outer + inner), f"sum(n) OVER (PARTITION BY {', '.join(outer)})"
    return f"""SELECT {keys}, n, {_share('n', whole)} AS prop, {_rounded('n', whole, digits)} AS prop_{digits}dp
        FROM (SELECT {keys}, CAST(count(*) AS BIGINT) AS n FROM {source} WHERE {where} GROUP BY {keys})"""


def _spread(table: str, ids: str, key: str, value: str, levels: dict, rounded: str = "") -> str:
    pairs = [("", value), (f"_{rounded[-3:]}", rounded)] if rounded else [("", value)]
    cells = ", ".join(
        f'max({v}) FILTER (WHERE {key} = {_literal(level)}) AS "{n}{end}"' for end, v in pairs for n, level in levels.items())
    return f"SELECT {ids}, {cells} FROM ({table}) GROUP BY {ids}"


def _complete(source: str, keys: list[str], where: str = "true") -> str:
    same = " AND ".join(f"g.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)
    grid = " CROSS JOIN ".join(f"(SELECT DISTINCT {k} FROM tally) AS g{i}" for i, k in enumerate(keys))
    return f"""(WITH tally AS (SELECT {', '.join(keys)}, CAST(count(*) AS BIGINT) AS n FROM {source} WHERE {where}
        GROUP BY {', '.join(keys)}) SELECT {', '.join('g.' + k for k in keys)}, CAST(coalesce(t.n, 0) AS BIGINT) AS n
        FROM (SELECT * FROM {grid}) g LEFT JOIN tally t ON {same})"""


def _by_kind(diabetes_type: str) -> str:
    table = f"""SELECT k.firstatt_agg, {', '.join(
        f"CAST(count(*) FILTER (WHERE p.attended_agg = '{v}') AS BIGINT) AS {n}" for n, v in STATUS.items())}
        FROM (SELECT firstatt_agg FROM p UNION SELECT 'New' UNION SELECT 'Follow up') k
        LEFT JOIN p ON k.firstatt_agg IS NOT DISTINCT FROM p.firstatt_agg GROUP BY k.firstatt_agg"""
    return _on(_percent_table(table, "firstatt_agg", STATUS, 0), "period",
               extra={"p": f"SELECT * FROM period WHERE diabetes_type = '{diabetes_type}'"})


def _ratio(where: str = "true") -> str:
    table = _tabulate("period", "diabetes_type", "firstatt_agg", KIND, where=where)
    return _on(f"""SELECT *, {_share('follow_up', 'new')} AS new_fu_ratio,
        {_rounded('follow_up', 'nullif("new", 0)', 1)} AS new_fu_ratio_1dp FROM ({table})""".replace(
        "CAST(nullif(new, 0)", 'CAST(nullif("new", 0)'), "period")


def _margins(row: str, column: str, levels: dict) -> str:
    cells = f"{_cells(column, levels)}, CAST(count(*) AS BIGINT) AS sum"
    source = f"FROM period WHERE {row} IS NOT NULL AND {column} IS NOT NULL"
    return _on(f"SELECT {row}, {cells} {source} GROUP BY {row} UNION ALL SELECT 'Sum', {cells} {source}", "period")


L, N = "appt_int_last_binned", "appt_int_next_binned"
RAISED_ROW = f"sum(n) OVER (PARTITION BY {L})"


def _protected(body: str) -> str:
    """``body`` over counts by last and next interval in which no count is from 1 to 9."""
    return _on(body, "cohort", extra={"raised": f"""SELECT {L}, {N}, CAST(greatest(count(*), 10) AS BIGINT) AS n
        FROM cohort GROUP BY {L}, {N}"""})


def _raised(levels: dict) -> str:
    return ", ".join(
        f'CAST(coalesce(sum(n) FILTER (WHERE {N} = {_literal(v)}), 0) AS BIGINT) AS "{name}"' for name, v in levels.items())


def _crosstab_share(row: str, column: str) -> str:
    return f"""SELECT {row}, {column}, n, {_share('n', 'sum(n) OVER ()')} AS prop,
        {_rounded('n', 'sum(n) OVER ()', 3)} AS prop_3dp
        FROM (SELECT {row}, {column}, CAST(count(*) AS BIGINT) AS n FROM period
              WHERE {row} IS NOT NULL AND {column} IS NOT NULL GROUP BY ALL)"""


def _summary(source: str, variables: list[str], stratum: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {stratum}, '{v}' AS variable, coalesce(CAST({v} AS VARCHAR), 'NA') AS level FROM {source}"
        for v in variables
    )
    whole = f"sum(n) OVER (PARTITION BY variable, {stratum})"
    steps = _steps("n * 100", whole, 1)
    return f"""SELECT variable, level, {stratum}, n, {_share('n * 100', whole)} AS percent,
        CAST(n AS VARCHAR) || ' (' || CAST({steps} // 10 AS VARCHAR) || '.' || CAST({steps} % 10 AS VARCHAR) || ')'
            AS text
        FROM (SELECT l.variable, l.level, s.{stratum}, CAST(count(r.variable) AS BIGINT) AS n
              FROM (SELECT DISTINCT variable, level FROM rows_) l
              CROSS JOIN (VALUES ('type1'), ('type2')) AS s({stratum})
              LEFT JOIN rows_ r ON r.variable = l.variable AND r.level = l.level AND r.{stratum} = s.{stratum}
              GROUP BY ALL)""".replace("rows_", f"({rows})")


def _imputed(source: str, chained: bool = False) -> str:
    lagged = f"""SELECT *, lag(apptdate) OVER w AS prev, lead(apptdate) OVER w AS nxt,
        lead(firstatt) OVER w AS lead_firstatt
        FROM {source} WINDOW w AS (PARTITION BY patid, tretspef {ORDER})"""
    gaps = f"""SELECT *,
        CASE WHEN firstatt_agg <> 1 THEN {_weeks("datediff('day', prev, apptdate)")} END AS before_weeks,
        CASE WHEN outcome <> 1 THEN {_weeks("datediff('day', apptdate, nxt)")} END AS after_weeks FROM ({lagged})"""
    threshold = S.gap_threshold_weeks
    if chained:
        outcome = f"WHEN outcome IS NULL AND lead_firstatt IN (1, 3) THEN 1 WHEN after_weeks > {threshold} THEN 1"
        kind = f"WHEN prev IS NULL OR before_weeks > {threshold} THEN 1 ELSE firstatt_agg"
    else:
        outcome = f"WHEN after_weeks > {threshold} THEN 1"
        kind = f"WHEN prev IS NULL THEN 1 WHEN before_weeks IS NULL THEN NULL WHEN before_weeks > {threshold} THEN 1 " \
               "ELSE firstatt_agg"
    return f"""SELECT * REPLACE (CASE {kind} END AS firstatt_agg), CASE {outcome} ELSE outcome END AS outcome2
        FROM ({gaps})"""


def _missed(source: str) -> str:
    return f"""SELECT *, CASE WHEN attended_agg <> 'Attended' THEN nxt END AS cancel_dna_next_apptdate,
        CASE WHEN attended_agg <> 'Attended' THEN {_weeks("datediff('day', apptdate, nxt)")} END AS cancel_dna_interval
        FROM (SELECT *, lead(apptdate) OVER (PARTITION BY patid, diabetes_type {ORDER}) AS nxt FROM {source})"""


def _grid(running: bool, value: str) -> str:
    test = "c.sim_week <= w.sim_week" if running else "c.sim_week = w.sim_week"
    return _on(f"""SELECT p.patid, p.diabetes_type, CAST(w.sim_week AS INT) AS sim_week,
        CAST(count(c.patid) AS BIGINT) AS {value}
        FROM (SELECT DISTINCT patid, diabetes_type FROM cohort) p CROSS JOIN range(1, {WEEKS + 1}) AS w(sim_week)
        LEFT JOIN cohort c ON c.patid = p.patid AND c.diabetes_type = p.diabetes_type AND {test} GROUP BY ALL""",
               "cohort")


def _profile(source: str, dataset: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, "
        f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null FROM {source}" for c in columns
    )


def _stage(step: int, name: str, source: str, condition: str = "true") -> str:
    return f"""SELECT {step} AS step, '{name}' AS stage, CAST(count(*) AS BIGINT) AS n_rows,
        CAST(count(DISTINCT patid) AS BIGINT) AS n_entities FROM {source} WHERE {condition}"""


def _attrition() -> str:
    known = "tretspef IS NOT NULL AND firstatt IS NOT NULL AND attended IS NOT NULL"
    specialty, kind = "tretspef = '307'", "diabetes_type IN ('type1', 'type2')"
    window = f"apptdate BETWEEN {_day(S.sim_start)} AND {_day(S.sim_end)}"
    return _on(" UNION ALL ".join([
        _stage(1, "loaded", "rec"),
        _stage(2, "population", "rec", "patid IN (SELECT patid FROM patients)"),
        _stage(3, "without_copies", "distinct_rec"),
        _stage(4, "required_fields", "distinct_rec", known),
        _stage(5, "before_death", "cleaned"),
        _stage(6, "specialty", "cleaned", specialty),
        _stage(7, "type", "cleaned", f"{specialty} AND {kind}"),
        _stage(8, "study", "cleaned", f"{specialty} AND {kind} AND apptdate > {_day(S.study_start)}"),
        _stage(9, "clinic", "cleaned", f"{specialty} AND {kind} AND {window}"),
    ]), "cleaned", extra={
        "distinct_rec": f"""SELECT DISTINCT {KEYS} FROM rec WHERE patid IN (SELECT patid FROM patients)"""})


def _existing_index(cell: str = "{}") -> str:
    cells = ", ".join(
        f"""CAST({cell.format(f"count(*) FILTER (WHERE diabetes_type = '{t}')")} AS BIGINT) AS {t}""" for t in TYPES
    )
    return _on(f"""SELECT sim_week, {cells} FROM indexed
        WHERE flag_first_appt_sim = 1 AND firstatt_agg = 'Follow up' GROUP BY sim_week""", "indexed")


ATTENDED = "attended IN (5, 6)"
RAW_COLUMNS = list(X.APPOINTMENT_RULES)
CLEAN_COLUMNS = [c for c in RAW_COLUMNS if c not in ("apptage", "atentype")]
DERIVED_COLUMNS = [c for c in CLEAN_COLUMNS] + [
    "ons_dod", "diabetes_type", "firstatt_agg", "attended_agg", "discharged", "lead_firstatt", "last_appt_date",
    "next_appt_date", "last_appt_int_days", "next_appt_int_days", "last_appt_int_weeks", "next_appt_int_weeks",
    "index_appt_study", "flag_index_study",
]
SAME_BAND = _band("weeks")


def _plain() -> dict[str, str]:
    raw, coded, derived = (lambda body, s=s: _on(body, s) for s in ("raw", "coded", "derived"))
    key = "patid, attendkey, apptdate"
    start, specialty = S.study_start, "tretspef = '307' AND diabetes_type IN ('type1', 'type2')"
    out = {
        "project_rename_drop": raw(f"""SELECT {key}, tretspef AS specialty,
            CAST(datediff('day', reqdate, apptdate) AS INT) AS wait_days FROM raw"""),
        "recode_sentinels": _on("""SELECT patid, attendkey, admincat, atentype, attended, outcome, priority, refsourc,
            servtype, stafftyp, firstatt, apptage FROM rec""", "rec"),
        "code_categories": _on("""SELECT attendkey, firstatt, attended, outcome,
            CASE WHEN firstatt IN (1, 3) THEN 'New' WHEN firstatt IN (2, 4) THEN 'Follow up' END AS firstatt_agg,
            CASE WHEN attended IN (5, 6) THEN 'Attended' WHEN attended IN (2, 4) THEN 'Cancelled'
                 ELSE 'Did Not Attend' END AS attended_agg,
            CASE WHEN outcome = 1 THEN 1 WHEN outcome IN (2, 3) THEN 0 END AS discharged FROM rec""", "rec"),
        "filter_required": _on("""SELECT attendkey, tretspef, firstatt, attended FROM rec WHERE tretspef IS NOT NULL
            AND firstatt IS NOT NULL AND attended IS NOT NULL""", "rec"),
        "filter_study_start": raw(f"""SELECT {key}, CAST(apptdate > {_day(start)} AS INT) AS after_start FROM raw
            WHERE apptdate >= {_day(start)}"""),
        "filter_window_closed": raw(f"""SELECT {key} FROM raw
            WHERE apptdate >= {_day(S.sim_start)} AND apptdate <= {_day(S.sim_end)}"""),
        "filter_specialty_type": _on(f"""SELECT {key}, tretspef, diabetes_type FROM raw JOIN kinds USING (patid)
            WHERE {specialty}""", "raw", "kinds"),
        "filter_attendance": _on(f"""SELECT {key}, attended, CASE WHEN attended IN (5, 6) THEN 'Attended'
            WHEN attended IN (2, 4) THEN 'Cancelled' ELSE 'Did Not Attend' END AS attended_agg FROM rec""", "rec"),
        "calendar_week": raw(f"""SELECT attendkey, apptdate, CAST(year(apptdate) AS INT) AS year,
            {WEEK_OF_YEAR} AS week FROM raw"""),
        "relative_week": raw(f"""SELECT attendkey, apptdate,
            CAST(datediff('day', {_day(S.sim_start)}, apptdate) // 7 + 1 AS INT) AS sim_week FROM raw
            WHERE apptdate BETWEEN {_day(S.sim_start)} AND {_day(S.sim_end)}"""),
        "interval_bins": raw(f"""SELECT attendkey, weeks, {SAME_BAND} AS bin FROM
            (SELECT attendkey, {_weeks("datediff('day', reqdate, apptdate)")} AS weeks FROM raw)"""),
        "semi_join_population": _on(f"SELECT {key} FROM raw WHERE patid IN (SELECT patid FROM patients)",
                                    "raw", "patients"),
        "left_join_lookup": _on("""SELECT attendkey, tretspef, tretspef_name FROM raw
            LEFT JOIN lookup USING (tretspef)""", "raw", "lookup"),
        "left_join_attribute": _on("""SELECT attendkey, patid, diabetes_type FROM raw
            LEFT JOIN kinds USING (patid)""", "raw", "kinds"),
        "censor_after_date": _on(f"""SELECT {key}, ons_dod FROM raw LEFT JOIN patients USING (patid)
            WHERE apptdate < ons_dod OR ons_dod IS NULL""", "raw", "patients"),
        "dedupe_keep_first": _on(f"""SELECT {key}, tretspef FROM copied
            QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY attendkey) = 1""", "raw", extra={
            "copied": """SELECT * FROM raw UNION ALL
                SELECT * REPLACE (attendkey + 1000000000000000 AS attendkey) FROM raw WHERE patid % 50 = 0"""}),
        "top1_per_group": raw("""SELECT patid, min(attendkey) AS attendkey, apptdate, tretspef FROM raw
            GROUP BY patid, apptdate, tretspef"""),
        "distinct_patients": coded("""SELECT CAST(count(DISTINCT patid) + max(CASE WHEN patid IS NULL THEN 1 ELSE 0 END)
            AS BIGINT) AS n_patients FROM coded"""),
        "clean_appointments": _on("SELECT * FROM cleaned", "cleaned"),
        "last_event_date": derived(f"SELECT {key}, tretspef, firstatt_agg, last_appt_date FROM derived"),
        "next_event_date": derived(f"SELECT {key}, tretspef, outcome, next_appt_date FROM derived"),
        "gap_to_previous": derived("SELECT attendkey, last_appt_int_days, last_appt_int_weeks FROM derived"),
        "gap_to_next": derived("SELECT attendkey, next_appt_int_days, next_appt_int_weeks FROM derived"),
        "lead_event_type": derived(f"SELECT {key}, tretspef, lead_firstatt FROM derived"),
        "index_event_flag": derived(f"""SELECT {key}, tretspef, flag_index_study,
            CASE WHEN flag_index_study = 1 THEN index_appt_study END AS index_appt_study FROM derived"""),
        "index_date_broadcast": derived(f"SELECT {key}, tretspef, index_appt_study FROM derived"),
        "fill_up_down": coded(f"""SELECT {key}, tretspef, outcome, coalesce(
            first_value(outcome IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
            last_value(outcome IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
            AS outcome_filled FROM coded WINDOW w AS (PARTITION BY patid, tretspef {ORDER})"""),
        "neighbours_of_other_events": """SELECT event_id, user_id, CAST(ts AS DATE) AS day,
            lag(event_type) OVER w AS previous_type, lead(event_type) OVER w AS next_type,
            CAST(datediff('day', lag(CAST(ts AS DATE)) OVER w, CAST(ts AS DATE)) AS INT) AS days_since_previous,
            CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n_events
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id)""",
        "group_size": _on(f"""SELECT {key}, diabetes_type,
            CAST(count(*) OVER (PARTITION BY patid, diabetes_type) AS BIGINT) AS "count" FROM period""", "period"),
        "backfill_discharged": derived("SELECT attendkey, outcome, lead_firstatt, discharged FROM derived"),
        "backfill_audit": derived(" UNION ALL ".join(
            f"""SELECT '{stage}' AS stage, {column} AS discharged, {_cells(
                'lead_firstatt', {f'next_{i}': i for i in range(1, 6)})},
                CAST(count(*) FILTER (WHERE lead_firstatt IS NULL) AS BIGINT) AS na_ FROM derived GROUP BY {column}"""
            for stage, column in (("before", "discharged_coded"), ("after", "discharged")))),
        "derive_sequence": derived("SELECT * EXCLUDE (tretspef_name) FROM derived"),
        "derive_sequence_in_lanes": derived("SELECT * EXCLUDE (tretspef_name) FROM derived"),
        "study_dataset": _on("SELECT * EXCLUDE (tretspef_name) FROM study", "study"),
        "clinic_cohort": _on("SELECT * EXCLUDE (tretspef_name) FROM cohort", "cohort"),
        "clinic_cohort_without_discharged": _on(f"""SELECT {key}, sim_week FROM cohort WHERE patid NOT IN
            (SELECT patid FROM study WHERE outcome = 1 AND apptdate < {_day(S.sim_start)})""", "cohort", "study"),
        "clinic_cohort_indexed": _on("SELECT * EXCLUDE (tretspef_name) FROM indexed", "indexed"),
        "first_in_window_flag": _on(f"SELECT {key}, flag_first_appt_sim FROM indexed", "indexed"),
        "days_since_first": _on(f"SELECT {key}, date_first_appt_sim, time_since_first_d1 FROM indexed", "indexed"),
        "missed_to_next_gap": _on(f"""SELECT {key}, attended_agg, cancel_dna_next_apptdate, cancel_dna_interval
            FROM ({_missed('study')})""", "study"),
        "impute_outcome_type": _on(f"""SELECT {key}, i.firstatt, outcome, firstatt_agg, outcome2
            FROM ({_imputed('checked_window')}) i""", "checked_window"),
        "impute_outcome_type_full_history": _on(f"""SELECT {key}, firstatt_agg, outcome2
            FROM ({_imputed('checked')})""", "checked"),
        "impute_outcome_type_chained": _on(f"""SELECT {key}, firstatt_agg, outcome2
            FROM ({_imputed('checked', chained=True)})""", "checked"),
    }
    for side, levels, column, weeks in (("last", LAST, "firstatt_agg", "last_appt_int_weeks"),
                                        ("next", NEXT, "outcome", "next_appt_int_weeks")):
        rank = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(levels.values(), 1))
        out[f"bin_{side}_interval"] = _on(f"""SELECT attendkey, {column}, {weeks}, appt_int_{side}_binned,
            CASE appt_int_{side}_binned {rank} END AS level_rank FROM study""", "study")
    return out


def _tables() -> dict[str, str]:
    status = "diabetes_type", "attended_agg", STATUS
    cohort = lambda body: _on(body, "cohort")
    matrix = _share_within(
        "cohort", ["firstatt_agg", "diabetes_type", "appt_int_last_binned"], ["appt_int_next_binned"]
    )
    named = "coalesce(firstatt_agg, 'NA') || '_' || coalesce(diabetes_type, 'NA') AS group_name"
    groups = f"firstatt_agg, diabetes_type, {named}"
    counts = f"""SELECT {groups}, appt_int_last_binned, appt_int_next_binned, CAST(count(*) AS BIGINT) AS total
        FROM cohort GROUP BY ALL"""
    wide_ids = "firstatt_agg, diabetes_type, group_name, appt_int_last_binned"
    specialty = {"one": "SELECT *, diabetes_type AS stratum FROM described WHERE tretspef = '307'"}
    specialty_rows = _summary("one", SUMMARY + ["diabetes_type"], "stratum")
    level_order = "level = 'NA', TRY_CAST(level AS INT) NULLS LAST, level"
    by_variable = "PARTITION BY variable, stratum"
    small = "CASE WHEN {0} BETWEEN 1 AND 9 THEN 10 ELSE {0} END"
    out = {
        "group_count": _on("""SELECT attended_agg, firstatt_agg, CAST(count(*) AS BIGINT) AS n, CASE attended_agg
            WHEN 'Attended' THEN 1 WHEN 'Cancelled' THEN 2 ELSE 3 END AS level_rank
            FROM coded GROUP BY ALL""", "coded"),
        "share_within_group": _on(_share_within("coded", ["diabetes_type"], ["attended_agg"]), "coded"),
        "spread_counts": _on(f"SELECT tretspef, {_cells('firstatt_agg', KIND)} FROM coded GROUP BY tretspef", "coded"),
        "tabulate_one_way": _on(f"""SELECT discharged, n, {_share('n', 'sum(n) OVER ()')} AS percent,
            CASE WHEN discharged IS NOT NULL THEN
                {_share('n', 'sum(n) FILTER (WHERE discharged IS NOT NULL) OVER ()')} END AS valid_percent
            FROM (SELECT discharged, CAST(count(*) AS BIGINT) AS n FROM coded GROUP BY discharged)""", "coded"),
        "tabulate_two_way": _on(_tabulate("coded", "firstatt_agg", "discharged", {"continuing": 0, "discharged": 1}),
                                "coded"),
        "crosstab_row_pct": _on(f"""SELECT diabetes_type, {', '.join(
            f'{_share(n, _total(STATUS))} AS {n}' for n in STATUS)} FROM ({_tabulate('period', *status)})""", "period"),
        "crosstab_pct_with_n": _on(_percent_table(_tabulate("coded", "tretspef", "attended_agg", STATUS), "tretspef",
                                                  STATUS, 1), "coded"),
        "crosstab_margins": _margins("diabetes_type", "attended_agg", STATUS),
        "crosstab_margins_transposed": _margins("attended_agg", "diabetes_type", TYPES),
        "crosstab_prop": _on(_crosstab_share("diabetes_type", "attended_agg"), "period"),
        "crosstab_prop_transposed": _on(_spread(_crosstab_share("attended_agg", "diabetes_type"), "attended_agg",
                                                "diabetes_type", "prop_3dp", TYPES), "period"),
        "complete_combinations": _on(f"""SELECT * FROM {_complete(
            'checked', ['year', 'diabetes_type', 'firstatt_agg', 'outcome'])}""", "checked"),
        "null_profile": _on(_profile("raw", "raw", RAW_COLUMNS) + " UNION ALL "
                            + _profile("derived", "derived", DERIVED_COLUMNS), "raw", "derived"),
        "cohort_attrition": _attrition(),
        "weekly_existing_index": _existing_index(),
        "suppress_small_cells": _existing_index(small),
        "protected_margins": _protected(f"""SELECT {L}, {_raised(NEXT)}, CAST(sum(n) AS BIGINT) AS sum FROM raised
            GROUP BY {L} UNION ALL SELECT 'Sum', {_raised(NEXT)}, CAST(sum(n) AS BIGINT) FROM raised"""),
        "protected_shares": _protected(f"""SELECT {L}, {N}, n, {_share('n', RAISED_ROW)} AS prop,
            {_rounded('n', RAISED_ROW, 2)} AS prop_2dp FROM raised"""),
        "protected_percent": _protected(_percent_table(
            f"SELECT {L}, {_raised(NEXT)} FROM raised GROUP BY {L}", L, NEXT, 1)),
        "patient_week_grid": _grid(False, "app_count"),
        "cumulative_timeline": _grid(True, "cumulative_appt_count"),
        "unpivot_weeks": _grid(True, "cumulative_appt_count"),
        "tab_type_by_newfu": _on(_tabulate("period", "diabetes_type", "firstatt_agg", KIND), "period"),
        "tab_attended_type_by_newfu": _on(_tabulate("period", "diabetes_type", "firstatt_agg", KIND, where=ATTENDED),
                                          "period"),
        "new_fu_ratio": _ratio(),
        "new_fu_ratio_attended": _ratio(ATTENDED),
        "attendance_pct_by_type": _on(_percent_table(_tabulate("period", *status), "diabetes_type", STATUS, 0, False),
                                      "period"),
        "attendance_pct_type1": _by_kind("type1"),
        "attendance_pct_type2": _by_kind("type2"),
        "mean_appts_per_patient": _on(f"""SELECT diabetes_type, CAST(count(*) AS BIGINT) AS sum,
            CAST(count(*) AS DOUBLE) / count(DISTINCT patid) AS mean FROM period WHERE {ATTENDED}
            GROUP BY diabetes_type""", "period"),
        "mean_followups_per_patient": _on(f"""SELECT diabetes_type, firstatt_agg, CAST(count(*) AS BIGINT) AS sum,
            CAST(count(*) AS DOUBLE) / count(DISTINCT patid) AS mean FROM period
            WHERE {ATTENDED} AND firstatt_agg = 'Follow up' GROUP BY ALL""", "period"),
        "weekly_new": cohort(_tabulate("cohort", "sim_week", "diabetes_type", TYPES, False, "firstatt_agg = 'New'")),
        "transition_matrix_prop": cohort(f"SELECT *, {named} FROM ({matrix})"),
        "transition_matrix_count": cohort(counts),
        "transition_matrix_prop_wide": cohort(_spread(f"SELECT *, {named} FROM ({matrix})", wide_ids,
                                                      "appt_int_next_binned", "prop_2dp", NEXT)),
        "transition_matrix_count_wide": cohort(_spread(counts, wide_ids, "appt_int_next_binned", "total", NEXT)),
        "cumulative_by_week": cohort(f"""SELECT w.sim_week::INT AS sim_week, t.diabetes_type,
            CAST(count(c.patid) AS BIGINT) AS cum_wk_appt FROM range(1, {WEEKS + 1}) AS w(sim_week)
            CROSS JOIN (SELECT DISTINCT diabetes_type FROM cohort) t
            LEFT JOIN cohort c ON c.diabetes_type = t.diabetes_type AND c.sim_week <= w.sim_week GROUP BY ALL"""),
        "count_by_week_type": cohort("""SELECT sim_week, diabetes_type, firstatt_agg,
            CAST(count(*) AS BIGINT) AS cum_wk_appt FROM cohort GROUP BY ALL"""),
        "table_one_all": _on(_summary("described", SUMMARY, "diabetes_type"), "described"),
        "table_one_specialty": _on(specialty_rows, "described", extra=specialty),
        "table_one_detail": _on(f"""SELECT stratum, variable, level, CAST(sum(n) OVER v AS BIGINT) AS n,
            CAST(coalesce(sum(n) FILTER (WHERE level = 'NA') OVER v, 0) AS BIGINT) AS miss,
            {_share("coalesce(sum(n) FILTER (WHERE level = 'NA') OVER v, 0) * 100", 'sum(n) OVER v')} AS p_miss,
            n AS freq, percent, {_share(f'''sum(n) OVER ({by_variable} ORDER BY {level_order}
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100''', 'sum(n) OVER v')} AS cum_percent
            FROM ({specialty_rows}) WINDOW v AS ({by_variable})""", "described", extra=specialty),
        "table_one_continuous": _on(" UNION ALL ".join(
            f"""SELECT diabetes_type, '{v}' AS variable, CAST(count({v}) AS BIGINT) AS n, round(avg({v}), 6) AS mean,
                round(stddev_samp({v}), 6) AS sd FROM described GROUP BY diabetes_type"""
            for v in ("last_appt_int_days", "next_appt_int_weeks", "hes_yr")), "described"),
    }
    for end, source in (("cl", "cohort"), ("st", "study")):
        kept = "firstatt_agg = 'New' AND attended_agg = 'Attended'"
        attended = "firstatt_agg = 'Follow up'"
        one_row = _cells("appt_int_next_binned", NEXT, "nullif({}, 0)")
        out |= {
            f"last_interval_dist_{end}": _on(_percent_table(_tabulate(
                source, "diabetes_type", "appt_int_last_binned", LAST, where=attended),
                "diabetes_type", LAST, 1), source),
            f"attend_by_last_count_{end}": _on(f"""SELECT attended_agg, {_cells(
                'appt_int_last_binned', LAST, 'nullif({}, 0)')} FROM {source} WHERE {attended}
                GROUP BY attended_agg""", source),
            f"attend_by_last_prop_{end}": _on(_spread(_share_within(
                source, ["appt_int_last_binned"], ["attended_agg"], attended), "appt_int_last_binned", "attended_agg",
                "prop", STATUS, "prop_2dp"), source),
            f"new_attend_pct_{end}": _on(_percent_table(_tabulate(
                source, *status, where="firstatt_agg = 'New'"), "diabetes_type", STATUS, 1), source),
            f"new_next_count_{end}": _on(f"SELECT {one_row} FROM {source} WHERE {kept}", source),
            f"new_next_prop_{end}": _on(_spread(_share_within(
                source, ["diabetes_type"], ["appt_int_next_binned"], kept), "diabetes_type", "appt_int_next_binned",
                "prop", NEXT, "prop_2dp"), source),
            f"missed_gap_mean_{end}": _on(f"""SELECT diabetes_type, attended_agg, firstatt_agg,
                avg(cancel_dna_interval) AS mean, CAST(count(*) AS BIGINT) AS n FROM ({_missed(source)})
                WHERE attended_agg <> 'Attended' GROUP BY ALL""", source),
        }
    cuts = {
        "weekly": ("checked", f"apptdate >= {_day(S.calendar_start)}", "outcome", "checked"),
        "study_weekly": ("checked_window", "true", "outcome", "checked_window"),
        "imputed_weekly": (f"({_imputed('checked_window')})", "true", "outcome2", "checked_window"),
        "cohort_weekly": ("checked_cohort", "true", "outcome", "checked_cohort"),
    }
    for cut, (source, where, outcome, needs) in cuts.items():
        for name, codes in {"firstatt": ["firstatt_agg"], "outcome": [outcome],
                            "firstatt_outcome": ["firstatt_agg", outcome]}.items():
            keys = ["year", "week", "diabetes_type", *codes]
            out[f"{cut}_{name}"] = _on(f"SELECT * FROM {_complete(source, keys, where)}", needs)
    return out


def all_oracles() -> dict[str, str]:
    return _plain() | _tables()
