"""SQL statements that state the expected result of each registered query.

Written for a plain SQL engine over the same Parquet tables. Every statement
is built from the shared definitions below and computes windows directly,
so it checks the scalable forms used by the operators.
"""

from __future__ import annotations


def rnd(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale} + 0.0::DOUBLE)"


def mean4(x: str = "risk_score") -> str:
    return f"(sum(CAST(round_even({x} * 1e4, 0) AS BIGINT))::DOUBLE / 1e4 / nullif(count({x}), 0))"


def n_if(cond: str) -> str:
    return f"CAST(count(CASE WHEN {cond} THEN 1 END) AS BIGINT)"


def total(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


LABEL = "concat(CAST({y} AS VARCHAR), '-', lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0'))"
YEAR_LABEL = LABEL.format(y="year(o_orderdate)")
LEVELS = ("CRITICAL", "HIGH", "MODERATE", "LOW")
ROOM_NORM = "CASE WHEN school_category IN (4, 5, 7) THEN 35 WHEN school_category IN (8, 10, 11) THEN 40 ELSE 30 END"
TEACHER_NORM = "CASE WHEN school_category = 4 THEN 35 ELSE 30 END"
NEXT_ROOM_NORM = "CASE WHEN school_category IN (1, 2, 3) THEN 30 WHEN school_category IN (4, 5) THEN 35 ELSE 40 END"
NEXT_TEACHER_NORM = "CASE WHEN school_category IN (1, 2, 3, 4, 5) THEN 30 ELSE 35 END"


def lvl(suffix: str = "") -> str:
    return ", ".join(n_if(f"risk_level = '{v}'") + f" AS {v.lower()}{suffix}" for v in LEVELS)


def need(demand: str, norm: str) -> str:
    return f"CAST(ceil({demand} / ({norm})::DOUBLE) AS INTEGER)"


def short(required: str, capacity: str) -> str:
    return f"CASE WHEN {required} IS NOT NULL THEN greatest({required} - coalesce({capacity}, 0), 0) END"


def share(gap: str, required: str) -> str:
    return f"CASE WHEN {required} > 0 THEN least(coalesce({gap}, 0) / {required}::DOUBLE, 1.0::DOUBLE) END"


def fill(gap: str, running: str, cap: str) -> str:
    return f"CAST(least({gap}, greatest(0, {cap} - ({running} - {gap}))) AS INTEGER)"


def crc32(x: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: a byte is mixed in, then eight steps of the reflected polynomial."""
    steps = ", ".join(["-1"] * 8)
    bits = f"flatten(list_transform(range(1, length({x}) + 1), lambda i: [ascii(({x})[i]), {steps}]))"
    step = "CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce([4294967295] || {bits}, lambda c, b: {step}), 4294967295)"


def noise(gap: str, salt: str, method: str = "md5") -> str:
    text = f"concat(school_id, academic_year, '{salt}')"
    h = f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % 80)" if method == "md5" else f"({crc32(text)} % 80)"
    return f"CAST(((CASE WHEN {gap} > 0 THEN {gap} ELSE 0 END) * (70 + {h}) + 50) // 100 AS INTEGER)"


BY_SCHOOL = "(PARTITION BY school_id ORDER BY academic_year)"
TIE = "substr(md5(school_id), 1, 3), school_id"
LEVEL_ORDER = "CASE risk_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END"
RAW_SCORE = (
    "(0.45::DOUBLE * coalesce(teacher_deficit_ratio, 0) + 0.35::DOUBLE * coalesce(classroom_deficit_ratio, 0)"
    " + 0.20::DOUBLE * least(abs(coalesce(enrolment_growth_rate, 0)), 0.50::DOUBLE))"
)
HIGH = "IN ('HIGH', 'CRITICAL')"


def lag_in(col: str, k: int) -> str:
    return f"lag({col}, {k}) OVER {BY_SCHOOL}"


RUN3 = (
    f"CASE WHEN risk_level {HIGH} AND {lag_in('risk_level', 1)} {HIGH}"
    f" AND {lag_in('risk_level', 2)} {HIGH} THEN 1 ELSE 0 END"
)

# name -> (statement, names it needs)
DEFS: dict[str, tuple[str, list[str]]] = {}


def define(name: str, sql: str, *needs: str) -> None:
    DEFS[name] = (sql, list(needs))


define(
    "schools",
    """SELECT CAST(c_custkey AS VARCHAR) AS school_id, c_name AS school_name, n_name AS district,
       c_mktsegment AS block, r_name AS management_type,
       CAST(c_custkey % 11 + 1 AS INTEGER) AS school_category, CAST(n_nationkey % 2 + 1 AS INTEGER) AS rural_urban
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
define(
    "panel",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS school_id, {YEAR_LABEL} AS academic_year,
  CAST(sum(l_quantity) AS INTEGER) AS total_enrolment,
  CAST(count(DISTINCT l_suppkey) AS INTEGER) AS total_class_rooms,
  CAST(nullif(count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_suppkey END), 0) AS INTEGER) AS usable_class_rooms,
  CAST(nullif(count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_partkey END), 0) AS INTEGER) AS total_teachers,
  CAST(2 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)
       AS INTEGER) AS classroom_condition_score,
  min(o_orderpriority) AS building_condition,
  CAST(o_custkey % 2 + 1 AS INTEGER) AS drinking_water_flag,
  CAST((o_custkey + year(o_orderdate)) % 3 AS INTEGER) AS internet_flag
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, year(o_orderdate)""",
)
define(
    "facts",
    """SELECT p.* EXCLUDE (drinking_water_flag, internet_flag), s.* EXCLUDE (school_id),
  drinking_water_flag = 1 AS drinking_water_available, internet_flag = 1 AS internet_available
FROM panel p JOIN schools s USING (school_id)""",
    "panel",
    "schools",
)
define(
    "required",
    f"""SELECT *, {need('total_enrolment', ROOM_NORM)} AS required_class_rooms,
  {need('total_enrolment', TEACHER_NORM)} AS required_teachers FROM facts""",
    "facts",
)
define(
    "gaps",
    f"""SELECT *, {short('required_class_rooms', 'usable_class_rooms')} AS classroom_gap,
  {short('required_teachers', 'total_teachers')} AS teacher_gap FROM required""",
    "required",
)
define(
    "ratios",
    f"""SELECT *, {share('classroom_gap', 'required_class_rooms')} AS classroom_deficit_ratio,
  {share('teacher_gap', 'required_teachers')} AS teacher_deficit_ratio,
  {lag_in('total_enrolment', 1)} AS prev_enrolment FROM gaps""",
    "gaps",
)
define(
    "growth",
    """SELECT * EXCLUDE (prev_enrolment), CASE WHEN prev_enrolment IS NULL OR prev_enrolment = 0 THEN 0.0::DOUBLE
  ELSE (total_enrolment - prev_enrolment) / prev_enrolment::DOUBLE END AS enrolment_growth_rate FROM ratios""",
    "ratios",
)
define(
    "risk",
    f"""SELECT *, {rnd(RAW_SCORE, 4)} AS risk_score, CASE WHEN {RAW_SCORE} > 0.75::DOUBLE THEN 'CRITICAL'
  WHEN {RAW_SCORE} > 0.50::DOUBLE THEN 'HIGH' WHEN {RAW_SCORE} > 0.20::DOUBLE THEN 'MODERATE'
  ELSE 'LOW' END AS risk_level FROM growth""",
    "growth",
)
define(
    "priority",
    f"""SELECT *, CASE WHEN pr <= 0.05 THEN 'TOP_5' WHEN pr <= 0.10 THEN 'TOP_10' WHEN pr <= 0.20 THEN 'TOP_20'
  ELSE 'STANDARD' END AS priority_bucket FROM (
  SELECT *, {RUN3} AS persistent_high_risk_flag,
    rank() OVER (PARTITION BY academic_year ORDER BY risk_score DESC) AS state_rank,
    rank() OVER (PARTITION BY academic_year, district ORDER BY risk_score DESC) AS district_rank,
    percent_rank() OVER (PARTITION BY academic_year ORDER BY risk_score DESC) AS pr
  FROM risk)""",
    "risk",
)
define(
    "trend0",
    f"""SELECT *, {lag_in('risk_score', 1)} AS prev_risk_score, risk_score - {lag_in('risk_score', 1)} AS risk_delta,
  CAST(row_number() OVER {BY_SCHOOL} AS INTEGER) AS year_over_year_count,
  avg(risk_score) OVER (PARTITION BY school_id ORDER BY academic_year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS cumulative_avg_risk,
  {RUN3} AS chronic_risk_flag FROM priority""",
    "priority",
)
define(
    "trend",
    f"""SELECT *, CASE WHEN risk_delta IS NULL THEN 'BASELINE' WHEN risk_delta < -0.10::DOUBLE THEN 'IMPROVING'
  WHEN risk_delta > 0.10::DOUBLE THEN 'DETERIORATING' ELSE 'STABLE' END AS trend_direction,
  CASE WHEN abs(risk_delta) > 0.25::DOUBLE OR abs({lag_in('risk_delta', 1)}) > 0.25::DOUBLE THEN 1 ELSE 0 END
    AS volatile_flag FROM trend0""",
    "trend0",
)
RUNNING = "sum({g}) OVER (PARTITION BY academic_year ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BATCH_ORDER = f"{LEVEL_ORDER}, risk_score DESC, {TIE}"
define(
    "queue",
    f"""SELECT *, row_number() OVER (PARTITION BY academic_year ORDER BY {BATCH_ORDER})
    AS allocation_priority,
  {RUNNING.format(g='classroom_gap', o=BATCH_ORDER)} AS rooms_running,
  {RUNNING.format(g='teacher_gap', o=BATCH_ORDER)} AS teachers_running FROM trend""",
    "trend",
)
define(
    "report",
    f"""SELECT *, {fill('classroom_gap', 'rooms_running', '1000')} AS classrooms_allocated,
  {fill('teacher_gap', 'teachers_running', '10000')} AS teachers_allocated,
  CASE WHEN rooms_running <= 1000 THEN 1 ELSE 0 END AS classroom_resolved,
  CASE WHEN teachers_running <= 10000 THEN 1 ELSE 0 END AS teacher_resolved FROM queue""",
    "queue",
)
define(
    "tight",
    f"""SELECT *, {fill('classroom_gap', 'rooms_running', '500')} AS classrooms_allocated,
  {fill('teacher_gap', 'teachers_running', '1000')} AS teachers_allocated,
  CASE WHEN rooms_running <= 500 THEN 1 ELSE 0 END AS classroom_resolved,
  CASE WHEN teachers_running <= 1000 THEN 1 ELSE 0 END AS teacher_resolved FROM queue""",
    "queue",
)
define(
    "latest",
    "SELECT * FROM report WHERE academic_year = (SELECT max(academic_year) FROM facts)",
    "report",
)
define(
    "rollup",
    f"""SELECT coalesce(district, 'UNKNOWN') AS district, academic_year,
  count(DISTINCT school_id) AS total_schools, {mean4()} AS mean_risk,
  {rnd(f"100.0::DOUBLE * {n_if(f'risk_level {HIGH}')} / count(*)", 2)} AS pct_high_critical,
  {total('CASE WHEN classroom_gap > 0 THEN classroom_gap ELSE 0 END')} AS total_classroom_deficit,
  {total('CASE WHEN teacher_gap > 0 THEN teacher_gap ELSE 0 END')} AS total_teacher_deficit,
  {total('total_enrolment')} AS total_enrolment,
  {rnd('sum(classroom_condition_score)::DOUBLE / nullif(count(classroom_condition_score), 0)', 4)}
    AS avg_classroom_condition
FROM risk GROUP BY 1, 2""",
    "risk",
)
define(
    "graded",
    f"""SELECT * EXCLUDE (mean_risk), {rnd('mean_risk', 4)} AS avg_risk_score,
  CASE WHEN mean_risk <= 0.15::DOUBLE THEN 'A' WHEN mean_risk <= 0.30::DOUBLE THEN 'B'
    WHEN mean_risk <= 0.50::DOUBLE THEN 'C' WHEN mean_risk <= 0.75::DOUBLE THEN 'D' ELSE 'F' END AS compliance_grade
FROM rollup""",
    "rollup",
)
define(
    "index",
    """SELECT *, avg_risk_score - lag(avg_risk_score) OVER (PARTITION BY district ORDER BY academic_year)
    AS yoy_risk_improvement,
  CAST(rank() OVER (PARTITION BY academic_year ORDER BY avg_risk_score DESC) AS INTEGER) AS district_rank FROM graded""",
    "graded",
)
define(
    "requests",
    f"""SELECT *, {noise('classroom_gap', 'cr')} AS requested_classrooms,
  {noise('teacher_gap', 'tr')} AS requested_teachers FROM gaps""",
    "gaps",
)
C_OVER = "requested_classrooms > 0 AND classroom_gap > 0 AND requested_classrooms > classroom_gap * "
T_OVER = "requested_teachers > 0 AND teacher_gap > 0 AND requested_teachers > teacher_gap * "
C_RATIO = "(requested_classrooms / nullif(greatest(coalesce(classroom_gap, 0), 0), 0)::DOUBLE)"
T_RATIO = "(requested_teachers / nullif(greatest(coalesce(teacher_gap, 0), 0), 0)::DOUBLE)"
CONF = (
    f"greatest(0.0::DOUBLE, 1.0::DOUBLE - (abs(1.0::DOUBLE - coalesce({C_RATIO}, 1.0))"
    f" + abs(1.0::DOUBLE - coalesce({T_RATIO}, 1.0))) / 2.0::DOUBLE)"
)
define(
    "requests_crc32",
    f"""SELECT *, {noise('classroom_gap', 'cr', 'crc32')} AS requested_classrooms,
  {noise('teacher_gap', 'tr', 'crc32')} AS requested_teachers FROM gaps""",
    "gaps",
)
define(
    "reasons",
    f"""SELECT *, CASE
  WHEN (coalesce(classroom_gap, 0) <= 0 AND requested_classrooms > 0)
    OR (coalesce(teacher_gap, 0) <= 0 AND requested_teachers > 0) THEN 'NO_DEFICIT'
  WHEN {C_OVER} 1.5 THEN 'CLASSROOM_OVER_REQUEST' WHEN {T_OVER} 1.5 THEN 'TEACHER_OVER_REQUEST'
  WHEN {C_OVER} 1.2 THEN 'CLASSROOM_MODERATE_OVER' WHEN {T_OVER} 1.2 THEN 'TEACHER_MODERATE_OVER'
  WHEN requested_classrooms > 0 AND classroom_gap > 0 AND requested_classrooms < classroom_gap * 0.5
    THEN 'CLASSROOM_UNDER_REQUEST'
  WHEN requested_teachers > 0 AND teacher_gap > 0 AND requested_teachers < teacher_gap * 0.5
    THEN 'TEACHER_UNDER_REQUEST'
  WHEN requested_classrooms = 0 AND requested_teachers = 0 THEN 'NO_REQUEST' ELSE 'WITHIN_TOLERANCE' END AS reason_code,
  CASE WHEN classroom_gap > 0 THEN classroom_gap ELSE 0 END AS actual_classroom_gap,
  CASE WHEN teacher_gap > 0 THEN teacher_gap ELSE 0 END AS actual_teacher_gap,
  {rnd(C_RATIO, 4)} AS classroom_ratio, {rnd(T_RATIO, 4)} AS teacher_ratio, {rnd(CONF, 4)} AS confidence_score
FROM requests""",
    "requests",
)
STATUS = """CASE WHEN reason_code IN ('SCHOOL_NOT_FOUND', 'NO_DEFICIT', 'CLASSROOM_OVER_REQUEST', 'TEACHER_OVER_REQUEST')
    THEN 'REJECTED' WHEN reason_code IN ('NO_REQUEST', 'WITHIN_TOLERANCE') THEN 'ACCEPTED' ELSE 'FLAGGED' END"""
define("judged", f"SELECT *, {STATUS} AS decision_status FROM reasons", "reasons")
define(
    "judged_latest",
    "SELECT * FROM judged WHERE academic_year = (SELECT max(academic_year) FROM judged)",
    "judged",
)
define(
    "submissions",
    f"""SELECT event_id AS submission_id, CAST(user_id AS VARCHAR) AS school_id,
  {LABEL.format(y='(1995 + event_id % 7)')} AS academic_year,
  CAST(CASE WHEN event_type = 'error' THEN floor(value) * 5 ELSE floor(value / 5) END AS INTEGER) AS classrooms_requested,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER // 12 AS INTEGER) AS teachers_requested,
  '' AS justification, CASE WHEN event_type = 'view' THEN 'Head Teacher' ELSE 'School Admin' END AS submitted_by,
  ts AS submitted_at FROM events""",
)
VALID = "classrooms_requested BETWEEN 0 AND 100 AND teachers_requested BETWEEN 0 AND 100"
define(
    "sub0",
    f"""SELECT s.*, g.school_id IS NOT NULL AS found, g.total_enrolment,
  CASE WHEN g.school_id IS NOT NULL THEN coalesce(g.classroom_gap, 0) END AS classroom_gap,
  CASE WHEN g.school_id IS NOT NULL THEN coalesce(g.teacher_gap, 0) END AS teacher_gap
FROM submissions s LEFT JOIN gaps g ON s.school_id = g.school_id AND s.academic_year = g.academic_year WHERE {VALID}""",
    "submissions",
    "gaps",
)
define(
    "sub1",
    """SELECT *,
  CASE WHEN classroom_gap > 0 THEN classrooms_requested / classroom_gap::DOUBLE
    WHEN found AND classrooms_requested = 0 THEN 0.0::DOUBLE WHEN found THEN 'inf'::DOUBLE END AS cr,
  CASE WHEN teacher_gap > 0 THEN teachers_requested / teacher_gap::DOUBLE
    WHEN found AND teachers_requested = 0 THEN 0.0::DOUBLE WHEN found THEN 'inf'::DOUBLE END AS tr FROM sub0""",
    "sub0",
)
define(
    "sub2",
    """SELECT *, CASE WHEN NOT found THEN 'SCHOOL_NOT_FOUND'
  WHEN classroom_gap = 0 AND teacher_gap = 0 AND (classrooms_requested > 0 OR teachers_requested > 0) THEN 'NO_DEFICIT'
  WHEN cr > 1.5 THEN 'CLASSROOM_OVER_REQUEST' WHEN tr > 1.5 THEN 'TEACHER_OVER_REQUEST'
  WHEN cr >= 1.2 THEN 'CLASSROOM_MODERATE_OVER' WHEN tr >= 1.2 THEN 'TEACHER_MODERATE_OVER'
  WHEN cr < 0.5 AND classroom_gap > 0 THEN 'CLASSROOM_UNDER_REQUEST'
  WHEN tr < 0.5 AND teacher_gap > 0 THEN 'TEACHER_UNDER_REQUEST'
  WHEN classroom_gap = 0 AND teacher_gap = 0 THEN 'NO_REQUEST' ELSE 'WITHIN_TOLERANCE' END AS reason_code FROM sub1""",
    "sub1",
)
SUB_CLOSE = "(1.0::DOUBLE - abs(cr - 1.0) * 0.5 - abs(tr - 1.0) * 0.5)"
define(
    "judged_submissions",
    f"""SELECT * EXCLUDE (found, cr, tr), {STATUS} AS decision_status,
  CASE WHEN isinf(cr) THEN NULL ELSE cr END AS classroom_ratio,
  CASE WHEN isinf(tr) THEN NULL ELSE tr END AS teacher_ratio,
  CASE reason_code WHEN 'SCHOOL_NOT_FOUND' THEN 0.0::DOUBLE WHEN 'NO_DEFICIT' THEN 0.1::DOUBLE
    WHEN 'CLASSROOM_OVER_REQUEST' THEN 0.2::DOUBLE WHEN 'TEACHER_OVER_REQUEST' THEN 0.2::DOUBLE
    WHEN 'CLASSROOM_MODERATE_OVER' THEN 0.5::DOUBLE WHEN 'TEACHER_MODERATE_OVER' THEN 0.5::DOUBLE
    WHEN 'CLASSROOM_UNDER_REQUEST' THEN 0.6::DOUBLE WHEN 'TEACHER_UNDER_REQUEST' THEN 0.6::DOUBLE
    WHEN 'NO_REQUEST' THEN 1.0::DOUBLE
    ELSE {rnd(f'greatest(0.0::DOUBLE, least(1.0::DOUBLE, {SUB_CLOSE}))', 3)} END AS confidence_score
FROM sub2""",
    "sub2",
)
define(
    "wma0",
    f"""SELECT *, coalesce((3 * coalesce(total_enrolment - {lag_in('total_enrolment', 1)}, 0)
  + 2 * coalesce({lag_in('total_enrolment', 1)} - {lag_in('total_enrolment', 2)}, 0)
  + coalesce({lag_in('total_enrolment', 2)} - {lag_in('total_enrolment', 3)}, 0))
  / nullif(6 * {lag_in('total_enrolment', 1)}, 0)::DOUBLE, 0.0) AS avg_growth_rate FROM facts""",
    "facts",
)
define(
    "wma1",
    """SELECT school_id, district, academic_year AS base_year, total_enrolment AS base_enrolment, avg_growth_rate,
  coalesce(usable_class_rooms, 0) AS current_classrooms, coalesce(total_teachers, 0) AS current_teachers,
  coalesce(school_category, 6) AS school_category,
  1.0::DOUBLE + least(0.30::DOUBLE, greatest(-0.30::DOUBLE, avg_growth_rate)) AS step
FROM wma0 WHERE academic_year = (SELECT max(academic_year) FROM wma0)""",
    "wma0",
)
define(
    "wma2",
    """SELECT *, greatest(0, CAST(round_even(base_enrolment * pow(step, years_ahead), 0) AS INTEGER)) AS projected_enrolment,
  concat(CAST(CAST(split_part(base_year, '-', 1) AS INTEGER) + years_ahead AS VARCHAR), '-',
    lpad(CAST(CAST(split_part(base_year, '-', 2) AS INTEGER) + years_ahead AS VARCHAR), 2, '0')) AS forecast_year
FROM wma1 CROSS JOIN (VALUES (1), (2), (3)) AS h(years_ahead)""",
    "wma1",
)
define(
    "wma3",
    f"""SELECT *, {need('projected_enrolment', NEXT_ROOM_NORM)} AS projected_classrooms_req,
  {need('projected_enrolment', NEXT_TEACHER_NORM)} AS projected_teachers_req FROM wma2""",
    "wma2",
)
define(
    "wma",
    f"""SELECT * EXCLUDE (step), {short('projected_classrooms_req', 'current_classrooms')} AS projected_classroom_gap,
  {short('projected_teachers_req', 'current_teachers')} AS projected_teacher_gap FROM wma3""",
    "wma3",
)
define(
    "active",
    "SELECT school_id, count(DISTINCT academic_year) AS years_active FROM facts GROUP BY school_id",
    "facts",
)
define(
    "labels_by_school",
    """SELECT *, CASE WHEN years_active <= 3 THEN 'unstable'
  WHEN years_active = (SELECT count(DISTINCT academic_year) FROM facts) THEN 'stable' ELSE 'mid' END AS stability
FROM active""",
    "active",
)
define("labelled", "SELECT f.*, years_active, stability FROM facts f JOIN labels_by_school USING (school_id)", "facts", "labels_by_school")
define(
    "growth_pct",
    f"""SELECT * FROM (SELECT *, (total_enrolment - prev_enrolment) / nullif(prev_enrolment, 0)::DOUBLE * 100
    AS enrolment_growth_pct FROM (SELECT *, {lag_in('total_enrolment', 1)} AS prev_enrolment FROM labelled))
WHERE enrolment_growth_pct IS NOT NULL""",
    "labelled",
)
CELLS = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN l_linenumber = {n} AND l_linestatus = '{st}' THEN l_quantity END), 0) AS DOUBLE)"
    f" AS {{p}}{n}_{tail}"
    for n in range(1, 8)
    for tail, st in (("b", "O"), ("g", "F"))
)
BOYS = "CAST(coalesce(sum(CASE WHEN l_linestatus = 'O' AND l_linenumber BETWEEN 1 AND 7 THEN l_quantity END), 0) AS DOUBLE)"
GIRLS = BOYS.replace("'O'", "'F'")
define(
    "enrolment",
    f"""SELECT {YEAR_LABEL} AS year, CAST(o_custkey AS VARCHAR) AS school_id, {CELLS.format(p='c')},
  {CELLS.format(p='age_')}, {BOYS} AS total_boys, {GIRLS} AS total_girls, {BOYS} + {GIRLS} AS total_enrolment,
  {BOYS} AS total_boys_age, {GIRLS} AS total_girls_age, {BOYS} + {GIRLS} AS total_enrolment_age
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""".replace(
        "GROUP BY ALL", "GROUP BY o_custkey, year(o_orderdate)"
    ),
)
define(
    "features0",
    f"""SELECT school_id, academic_year, district, management_type, total_enrolment, school_category,
  coalesce(total_class_rooms, 0) AS total_class_rooms, coalesce(usable_class_rooms, 0) AS usable_class_rooms,
  coalesce(classroom_gap, 0) AS classroom_gap, coalesce(teacher_gap, 0) AS teacher_gap, risk_score,
  coalesce(teacher_deficit_ratio, 0) AS teacher_deficit_ratio,
  coalesce(classroom_deficit_ratio, 0) AS classroom_deficit_ratio, coalesce(total_teachers, 0) AS total_teachers,
  {lag_in('total_enrolment', 1)} AS lag1, {lag_in('total_enrolment', 2)} AS lag2, {lag_in('total_enrolment', 3)} AS lag3,
  lead(total_enrolment) OVER {BY_SCHOOL} AS next1, lead(academic_year) OVER {BY_SCHOOL} AS target_year,
  avg(total_enrolment) OVER (PARTITION BY school_id ORDER BY academic_year ROWS 2 PRECEDING) AS mean3,
  stddev_samp(total_enrolment) OVER (PARTITION BY school_id ORDER BY academic_year ROWS 2 PRECEDING) AS sd3,
  (SELECT count(DISTINCT district) FROM schools d WHERE d.district < risk.district
     AND d.school_id IN (SELECT school_id FROM panel)) AS district_code,
  (SELECT count(DISTINCT management_type) FROM schools d WHERE d.management_type < risk.management_type
     AND d.school_id IN (SELECT school_id FROM panel)) AS management_code
FROM risk""",
    "risk",
)


def cap(x: str) -> str:
    return f"least(0.30::DOUBLE, greatest(-0.30::DOUBLE, {x}))"


define(
    "features1",
    f"""SELECT *, CASE WHEN lag1 IS NOT NULL THEN {cap('(total_enrolment - lag1) / greatest(lag1, 1)::DOUBLE')} END AS growth_rate,
  CASE WHEN lag1 IS NOT NULL THEN {cap('(3 * (total_enrolment - lag1) + 2 * coalesce(lag1 - lag2, 0) + coalesce(lag2 - lag3, 0)) / (greatest(lag1, 1) * 6)::DOUBLE')} END AS wma_growth,
  CASE WHEN next1 IS NOT NULL THEN {cap('(next1 - total_enrolment) / greatest(total_enrolment, 1)::DOUBLE')} END AS target_growth
FROM features0""",
    "features0",
)
define(
    "features",
    f"""SELECT *, {lag_in('growth_rate', 1)} AS growth_rate_lag1, least(coalesce(sd3, 0.0), 500.0::DOUBLE) AS enrolment_volatility,
  total_teachers / greatest(total_enrolment, 1)::DOUBLE AS teacher_per_student,
  usable_class_rooms / greatest(total_enrolment, 1)::DOUBLE AS rooms_per_student FROM features1""",
    "features1",
)


TEST_YEAR = """(SELECT academic_year FROM (SELECT DISTINCT academic_year FROM features)
    ORDER BY academic_year DESC LIMIT 1 OFFSET 1)"""
define("carried0", "SELECT *, coalesce(growth_rate, 0.0)::DOUBLE AS ml_growth FROM features", "features")
define(
    "carried_train",
    f"""SELECT * FROM carried0 WHERE target_growth IS NOT NULL AND academic_year <> {TEST_YEAR} AND total_enrolment >= 10
  AND target_year <> (SELECT max(academic_year) FROM features)""",
    "carried0",
)
define(
    "carried1",
    "SELECT * FROM carried0 WHERE academic_year = (SELECT max(academic_year) FROM features)",
    "carried0",
)
define(
    "carried2",
    f"""SELECT school_id, district, academic_year AS base_year, total_enrolment AS base_enrolment,
  {cap('ml_growth + ((SELECT avg(target_growth) FROM carried_train) - (SELECT avg(ml_growth) FROM carried1))')} AS ml_growth_rate,
  usable_class_rooms AS current_classrooms, total_teachers AS current_teachers, school_category FROM carried1""",
    "carried1",
    "carried_train",
)
define(
    "carried3",
    """SELECT *, greatest(0, CAST(round_even(base_enrolment * pow(1.0::DOUBLE + ml_growth_rate, years_ahead), 0) AS INTEGER))
    AS projected_enrolment,
  concat(CAST(CAST(split_part(base_year, '-', 1) AS INTEGER) + years_ahead AS VARCHAR), '-',
    CASE WHEN CAST(split_part(base_year, '-', 2) AS INTEGER) + years_ahead > 99
      THEN CAST(CAST(split_part(base_year, '-', 2) AS INTEGER) + years_ahead AS VARCHAR)
      ELSE lpad(CAST(CAST(split_part(base_year, '-', 2) AS INTEGER) + years_ahead AS VARCHAR), 2, '0') END) AS forecast_year
FROM carried2 CROSS JOIN (VALUES (1), (2), (3)) AS h(years_ahead)""",
    "carried2",
)
define(
    "carried4",
    f"""SELECT *, {need('projected_enrolment', NEXT_ROOM_NORM)} AS projected_classrooms_req,
  {need('projected_enrolment', NEXT_TEACHER_NORM)} AS projected_teachers_req FROM carried3""",
    "carried3",
)
define(
    "carried",
    f"""SELECT *, {short('projected_classrooms_req', 'current_classrooms')} AS projected_classroom_gap,
  {short('projected_teachers_req', 'current_teachers')} AS projected_teacher_gap FROM carried4""",
    "carried4",
)
define(
    "carried_test",
    f"""SELECT *, greatest(0.0::DOUBLE, round_even(total_enrolment * (g + 1), 0)) AS e FROM (
  SELECT total_enrolment, next1, target_growth, method, {cap("CASE method WHEN 'learned' THEN ml_growth ELSE coalesce(wma_growth, 0.0) END")} AS g
  FROM carried0 CROSS JOIN (VALUES ('learned'), ('wma')) AS m(method)
  WHERE target_growth IS NOT NULL AND academic_year = {TEST_YEAR})""",
    "carried0",
)
define(
    "carried_quality",
    """SELECT method, count(*) AS rows,
  1 - sum((target_growth - g) * (target_growth - g)) / nullif(var_pop(target_growth) * count(*), 0) AS growth_r2,
  avg(abs(target_growth - g)) AS growth_mae,
  1 - sum((next1 - e) * (next1 - e)) / nullif(var_pop(next1) * count(*), 0) AS enrolment_r2,
  avg(abs(next1 - e)) AS enrolment_mae, avg(abs(next1 - e) / greatest(next1, 1)) * 100 AS enrolment_mape
FROM carried_test GROUP BY method""",
    "carried_test",
)


def with_defs(sql: str, *needs: str) -> str:
    """A statement with the definitions it rests on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in DEFS[name][1]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{n} AS ({DEFS[n][0]})" for n in order)
    return f"WITH {parts}\n{sql}" if parts else sql
