"""The SQL each query is checked against, over the same tables.

Written independently of the Spark plans: plain windows and joins, no care for scale.
"""

from __future__ import annotations

INGEST = "l_orderkey, l_linenumber, l_extendedprice, l_partkey"
INSTANT = "'%Y-%m-%d %H:%M:%S.%f'"
MOVE = "environment_id, current_instance_type, candidate_instance_type"


def _eid(key: str) -> str:
    return f"'env-' || lpad(CAST({key} AS VARCHAR), CAST(greatest(6, length(CAST({key} AS VARCHAR))) AS INTEGER), '0')"


def _type(key: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END"


def _shown(body: str, *doubles: str) -> str:
    """Rounds double columns as the queries do."""
    if not doubles:
        return body
    replaced = ", ".join(f"round({d}, 6) + CAST(0 AS DOUBLE) AS {d}" for d in doubles)
    return f"SELECT * REPLACE ({replaced}) FROM ({body}) shown_rows"


# --- shared steps, each a named subquery that may use earlier ones ------------------------------

STEPS: dict[str, str] = {
    "environments": f"""
        SELECT {_eid('s_suppkey')} AS environment_id, s_name AS service_name,
               {_type('s_suppkey')} AS current_instance_type,
               CASE WHEN s_suppkey % 10 = 9 THEN 'STOPPED' ELSE 'RUNNING' END AS status, s_suppkey AS seq
        FROM supplier""",
    "catalog": """
        SELECT * FROM (VALUES (0, 'small', 2, 8, CAST(0.05 AS DOUBLE)), (1, 'medium', 4, 16, CAST(0.10 AS DOUBLE)),
                              (2, 'large', 8, 32, CAST(0.20 AS DOUBLE)))
            AS c(ordinal, instance_type, vcpu, memory_gb, base_price)""",
    "raw": f"""
        SELECT l_shipdate AS timestamp,
               CASE WHEN l_orderkey % 67 = 1 THEN 'env-unknown' ELSE {_eid('l_suppkey')} END AS environment_id,
               CASE WHEN l_orderkey % 89 = 1 THEN NULL WHEN l_orderkey % 83 = 1 THEN CAST(200 AS DOUBLE)
                    ELSE (l_suppkey % 7) * 8 + l_discount * 100 END AS cpu_utilization_pct,
               CASE WHEN l_orderkey % 79 = 1 THEN CAST(-1 AS DOUBLE)
                    ELSE 10 + (l_suppkey % 5) * 8 + l_tax * 100 END AS memory_utilization_pct,
               CASE WHEN l_orderkey % 73 = 1 THEN CAST(-1 AS DOUBLE) ELSE 50 + l_tax * 100 END AS latency_ms,
               CASE WHEN l_orderkey % 97 = 1 THEN CAST(-5 AS DOUBLE) WHEN l_orderkey % 61 = 1 THEN CAST(0 AS DOUBLE)
                    ELSE l_quantity * (CASE l_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 12 END)
               END AS request_volume,
               CASE WHEN l_orderkey % 71 = 1 THEN CAST(101 AS DOUBLE)
                    WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 100 - l_discount * 10
                    ELSE CAST(100 AS DOUBLE) END AS availability_pct,
               {INGEST}
        FROM lineitem""",
    "firsts": f"""
        SELECT * EXCLUDE (nth) FROM (
            SELECT *, row_number() OVER (PARTITION BY timestamp, environment_id ORDER BY {INGEST}) AS nth,
                   count(*) OVER (PARTITION BY timestamp, environment_id) AS copies
            FROM raw) numbered WHERE nth = 1""",
    "tagged": """
        SELECT *, CASE
            WHEN timestamp IS NULL OR environment_id IS NULL OR cpu_utilization_pct IS NULL
                 OR memory_utilization_pct IS NULL OR latency_ms IS NULL OR request_volume IS NULL
                 OR availability_pct IS NULL THEN 'missing'
            WHEN cpu_utilization_pct NOT BETWEEN 0 AND 150 THEN 'cpu'
            WHEN memory_utilization_pct NOT BETWEEN 0 AND 150 THEN 'memory'
            WHEN request_volume < 0 THEN 'requests'
            WHEN latency_ms < 0 THEN 'latency'
            WHEN availability_pct NOT BETWEEN 0 AND 100 THEN 'availability'
            WHEN environment_id NOT IN (SELECT environment_id FROM environments) THEN 'unknown_environment'
            END AS failed_rule
        FROM firsts""",
    "telemetry": """
        SELECT timestamp, environment_id, cpu_utilization_pct, memory_utilization_pct, latency_ms, request_volume,
               availability_pct
        FROM tagged WHERE failed_rule IS NULL""",
    "profiled": """
        SELECT *, quantile_cont(request_volume, 0.9) OVER (PARTITION BY environment_id) AS p90,
               row_number() OVER (PARTITION BY environment_id ORDER BY timestamp) - 1 AS position,
               row_number() OVER (PARTITION BY environment_id ORDER BY
                   md5(environment_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f')), timestamp)
                 <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY environment_id) * CAST(0.05 AS DOUBLE)) AS BIGINT))
                 AS is_spike
        FROM telemetry""",
    "pricing": f"""
        SELECT o_orderdate AS timestamp, {_type('o_orderkey')} AS instance_type,
               CAST(CASE o_orderkey % 3 WHEN 0 THEN 0.05 WHEN 1 THEN 0.10 ELSE 0.20 END AS DOUBLE)
                 * (CAST(0.98 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (o_orderkey % 5)) AS hourly_price
        FROM orders""",
    "prices": "SELECT instance_type, avg(hourly_price) AS hourly_avg FROM pricing GROUP BY instance_type",
    "baseline": """
        SELECT environment_id,
               avg(cpu_utilization_pct) AS mean_cpu, median(cpu_utilization_pct) AS median_cpu,
               quantile_cont(cpu_utilization_pct, 0.95) AS p95_cpu, max(cpu_utilization_pct) AS peak_cpu,
               avg(memory_utilization_pct) AS mean_memory, quantile_cont(memory_utilization_pct, 0.95) AS p95_memory,
               max(memory_utilization_pct) AS peak_memory,
               avg(request_volume) AS mean_request_volume, quantile_cont(request_volume, 0.95) AS p95_request_volume,
               max(request_volume) AS peak_request_volume,
               avg(latency_ms) AS mean_latency, quantile_cont(latency_ms, 0.95) AS p95_latency,
               quantile_cont(latency_ms, 0.99) AS p99_latency,
               avg(availability_pct) AS measured_availability,
               count(*) FILTER (availability_pct < CAST(99.9 AS DOUBLE)) AS slo_violations
        FROM telemetry GROUP BY environment_id""",
    "events_k": "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "readings": f"""
        SELECT {_eid('user_id')} AS environment_id, ts, event_id AS reading_id, CAST(k AS DOUBLE) AS cpu,
               20 + k / CAST(2 AS DOUBLE) AS memory, value AS latency,
               CASE WHEN event_type = 'error' AND value > 100 THEN CAST(99 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END
                 AS availability
        FROM events_k""",
    "judged": """
        SELECT *, CASE WHEN cpu > 90 OR memory > 90 THEN 'ROLLBACK_REQUIRED'
                       WHEN latency > 250 OR availability < CAST(99.9 AS DOUBLE) OR cpu > 80 OR memory > 80 THEN 'DEGRADED'
                       ELSE 'STABLE' END AS health_status
        FROM readings""",
    "audit": f"""
        SELECT ts AS timestamp, event_id AS seq, {_eid('user_id')} AS environment_id, 'medium' AS current_instance,
               'small' AS candidate_instance,
               CASE event_type WHEN 'click' THEN 'PRECHECK_STARTED' WHEN 'signup' THEN 'MIGRATION_APPROVED'
                    WHEN 'view' THEN 'MIGRATION_EXECUTED' WHEN 'purchase' THEN 'POSTCHECK_PASSED'
                    ELSE CASE WHEN k >= 50 THEN 'ORIGINAL_CONFIGURATION_RESTORED' ELSE 'FAILURE_DETECTED' END END AS event,
               props AS reason
        FROM events_k""",
    "executed": """
        SELECT environment_id, seq AS migration_seq, timestamp AS migrated_at, current_instance, candidate_instance,
               row_number() OVER (PARTITION BY environment_id ORDER BY timestamp DESC, seq DESC) AS newest
        FROM audit WHERE event = 'MIGRATION_EXECUTED'""",
    "checkpoints": """
        SELECT * FROM (
            SELECT j.environment_id, x.migration_seq, x.newest, j.ts, j.cpu, j.memory, j.latency, j.availability,
                   j.health_status,
                   row_number() OVER (PARTITION BY j.environment_id, x.migration_seq ORDER BY j.ts, j.reading_id) - 1
                     AS checkpoint_no
            FROM executed x JOIN judged j ON j.environment_id = x.environment_id AND j.ts >= x.migrated_at) after
        WHERE checkpoint_no < 5""",
    "requests": f"""
        SELECT DISTINCT {_eid('user_id')} AS environment_id,
               CASE WHEN user_id % 10 = 7 THEN 'large' ELSE {_type('user_id')} END AS expected_current,
               'small' AS candidate_instance_type
        FROM events""",
    "naive": """
        SELECT e.environment_id, e.current_instance_type, coalesce(b.mean_cpu, 0) AS mean_cpu,
               CASE WHEN b.mean_cpu < 30 THEN CASE e.current_instance_type WHEN 'large' THEN 'medium' WHEN 'medium' THEN 'small' END END
                 AS recommended
        FROM environments e LEFT JOIN baseline b USING (environment_id)""",
}
NEEDS = {
    "firsts": ["raw"],
    "tagged": ["firsts", "environments"],
    "telemetry": ["tagged"],
    "profiled": ["telemetry"],
    "prices": ["pricing"],
    "baseline": ["telemetry"],
    "readings": ["events_k"],
    "judged": ["readings"],
    "audit": ["events_k"],
    "executed": ["audit"],
    "checkpoints": ["executed", "judged"],
    "naive": ["environments", "baseline"],
}

POLICY = {
    "cheaper": "k.base_price < c.base_price",
    "self": "k.ordinal = c.ordinal",
    "cheaper_and_self": "k.base_price < c.base_price OR k.ordinal = c.ordinal",
    "step_down": "k.ordinal = c.ordinal - 1",
    "step_down_or_self": "k.ordinal = greatest(c.ordinal - 1, 0)",
}
BASE_VARIANT = {
    "variant_id": "base",
    "traffic_growth": 0.0,
    "cpu_pressure": 0.0,
    "memory_pressure": 0.0,
    "profile": "steady",
    "latency_target": 250.0,
    "availability_target": 99.9,
}
TIGHT = {"variant_id": "tight_slo", "latency_target": 54.0, "availability_target": 99.99}
GROWTH = [{"variant_id": f"growth_{g}", "traffic_growth": g / 100} for g in (0, 10, 20, 30, 40)]
PROFILES = [{"variant_id": p, "profile": p} for p in ("steady", "peak", "bursty", "low-traffic", "seasonal")]


def _with(body: str, *steps: str, **extra: str) -> str:
    """Prefixes ``body`` with the steps it needs, in dependency order, then the extra ones."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in steps:
        visit(name)
    parts = [f"{n} AS ({STEPS[n]})" for n in ordered] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _variants(items: list[dict]) -> str:
    rows = []
    for item in items:
        v = BASE_VARIANT | item
        numbers = ("traffic_growth", "cpu_pressure", "memory_pressure", "latency_target", "availability_target")
        rows.append(
            f"('{v['variant_id']}', '{v['profile']}', " + ", ".join(f"CAST({v[n]} AS DOUBLE)" for n in numbers) + ")"
        )
    return (
        f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(variant_id, profile, traffic_growth, cpu_pressure,"
        " memory_pressure, latency_target, availability_target)"
    )


def _model(policy: str | None = None, variants: list[dict] | None = None, moves: str | None = None) -> dict[str, str]:
    """Subqueries from moves and variants to decided what-if rows."""
    moves = moves or f"""
        SELECT e.environment_id, c.instance_type AS current_instance_type, k.instance_type AS candidate_instance_type,
               k.ordinal AS candidate_ordinal, c.vcpu / CAST(k.vcpu AS DOUBLE) AS cpu_ratio,
               c.memory_gb / CAST(k.memory_gb AS DOUBLE) AS mem_ratio
        FROM environments e JOIN catalog c ON c.instance_type = e.current_instance_type
             JOIN catalog k ON {POLICY[policy]}"""
    volume = """t.request_volume * (1 + v.traffic_growth) * CASE v.profile
            WHEN 'peak' THEN CASE WHEN t.request_volume >= t.p90 THEN CAST(1.5 AS DOUBLE) ELSE 1 END
            WHEN 'bursty' THEN CASE WHEN t.is_spike THEN CAST(3 AS DOUBLE) ELSE 1 END
            WHEN 'low-traffic' THEN CAST(0.5 AS DOUBLE)
            WHEN 'seasonal' THEN 1 + CAST(0.3 AS DOUBLE) * sin(2 * pi() * t.position / CAST(24 AS DOUBLE))
            ELSE 1 END"""
    return {
        "moves": moves,
        "variants": _variants(variants or [{}]),
        "scaled": f"""
            SELECT t.environment_id, m.current_instance_type, m.candidate_instance_type, v.variant_id, v.traffic_growth,
                   v.cpu_pressure, v.memory_pressure, v.latency_target, v.availability_target, t.timestamp, t.is_spike,
                   t.position, t.cpu_utilization_pct,
                   {volume} AS projected_requests,
                   t.cpu_utilization_pct * m.cpu_ratio * ({volume} / CASE WHEN t.request_volume = 0 THEN 1 ELSE t.request_volume END)
                     * (1 + v.cpu_pressure) AS projected_cpu,
                   t.memory_utilization_pct * m.mem_ratio
                     * ({volume} / CASE WHEN t.request_volume = 0 THEN 1 ELSE t.request_volume END)
                     * (1 + v.memory_pressure) AS projected_memory
            FROM profiled t JOIN moves m ON m.environment_id = t.environment_id CROSS JOIN variants v""",
        "pressed": """
            SELECT *, CASE WHEN projected_cpu IS NULL OR projected_memory IS NULL THEN NULL
                           ELSE greatest(projected_cpu, projected_memory) END AS pressure FROM scaled""",
        "projected": """
            SELECT *, 50 + CASE WHEN pressure IS NULL THEN 0
                                WHEN pressure <= 75 THEN pressure / CAST(75 AS DOUBLE) * 5
                                WHEN pressure < 100 THEN 5 + pow(pressure - 75, CAST(1.5 AS DOUBLE))
                                ELSE 100 + pow(pressure - 100, 2) END AS projected_latency,
                   CASE WHEN pressure > 95
                        THEN least(greatest(100 - (pressure - 95) * CAST(0.5 AS DOUBLE), 0), 100)
                        ELSE CAST(100 AS DOUBLE) END AS projected_availability
            FROM pressed""",
        "slo": f"""
            SELECT {MOVE}, variant_id, any_value(traffic_growth) AS traffic_growth,
                   any_value(cpu_pressure) AS cpu_pressure, any_value(memory_pressure) AS memory_pressure,
                   any_value(latency_target) AS latency_target, any_value(availability_target) AS availability_target,
                   count(*) AS row_count, quantile_cont(projected_latency, 0.95) AS projected_p95_latency,
                   avg(projected_availability) AS projected_availability,
                   count(*) FILTER (projected_availability < availability_target) / CAST(count(*) AS DOUBLE) AS slo_violation_rate,
                   max(projected_cpu) AS peak_cpu, max(projected_memory) AS peak_mem,
                   avg(projected_cpu) AS mean_projected_cpu
            FROM projected GROUP BY {MOVE}, variant_id""",
        "costed": """
            SELECT s.*, s.projected_p95_latency <= s.latency_target AS latency_satisfied,
                   s.projected_availability >= s.availability_target AS availability_satisfied,
                   a.hourly_avg * s.row_count AS baseline_monthly_cost,
                   b.hourly_avg * s.row_count AS simulated_monthly_cost,
                   a.hourly_avg * s.row_count - b.hourly_avg * s.row_count AS absolute_monthly_saving,
                   CASE WHEN a.hourly_avg * s.row_count > 0
                        THEN (a.hourly_avg * s.row_count - b.hourly_avg * s.row_count) / (a.hourly_avg * s.row_count) * 100
                        ELSE 0 END AS cost_reduction_pct
            FROM slo s LEFT JOIN prices a ON a.instance_type = s.current_instance_type
                 LEFT JOIN prices b ON b.instance_type = s.candidate_instance_type""",
        "coded": """
            SELECT *, concat_ws('|', CASE WHEN absolute_monthly_saving <= 0 THEN 'NO_COST_BENEFIT' END,
                                CASE WHEN NOT latency_satisfied THEN 'LATENCY_SLO_FAILURE' END,
                                CASE WHEN NOT availability_satisfied THEN 'AVAILABILITY_SLO_FAILURE' END,
                                CASE WHEN peak_cpu > 90 THEN 'CPU_SATURATION' END,
                                CASE WHEN peak_mem > 90 THEN 'MEMORY_SATURATION' END) AS reason_codes
            FROM costed""",
        "decided": """
            SELECT *, CASE WHEN reason_codes = '' THEN 'SAFE TO RIGHTSIZE' ELSE 'DO NOT RIGHTSIZE' END AS decision
            FROM coded""",
        "best": f"""
            SELECT * FROM (
                SELECT d.*, least(100 - peak_cpu, 100 - peak_mem) AS headroom,
                       row_number() OVER (PARTITION BY d.environment_id, d.variant_id
                           ORDER BY least(100 - peak_cpu, 100 - peak_mem) DESC, k.ordinal) AS preference
                FROM decided d JOIN catalog k ON k.instance_type = d.candidate_instance_type
                WHERE decision = 'SAFE TO RIGHTSIZE' AND least(100 - peak_cpu, 100 - peak_mem) > -1) ordered
            WHERE preference = 1""",
        "detail": """
            SELECT e.environment_id, e.current_instance_type,
                   coalesce(b.candidate_instance_type, 'none') AS selected_candidate,
                   coalesce(n.readings * p.hourly_avg, 0) AS current_monthly_cost,
                   coalesce(b.simulated_monthly_cost, n.readings * p.hourly_avg, 0) AS candidate_cost,
                   coalesce(b.absolute_monthly_saving, 0) AS potential_saving,
                   CASE WHEN b.environment_id IS NULL THEN 'NO SAFE RIGHTSIZING OPTION' ELSE 'SAFE TO RIGHTSIZE' END AS decision,
                   CASE WHEN b.environment_id IS NULL THEN 'UNKNOWN' WHEN b.peak_cpu < 60 THEN 'LOW'
                        WHEN b.peak_cpu < 80 THEN 'MEDIUM' ELSE 'HIGH' END AS risk,
                   CASE WHEN b.environment_id IS NULL THEN 'NO SAFE RIGHTSIZING OPTION' ELSE 'Safe' END AS blocking_reason
            FROM environments e LEFT JOIN best b ON b.environment_id = e.environment_id
                 LEFT JOIN (SELECT environment_id, count(*) AS readings FROM telemetry GROUP BY environment_id) n
                   ON n.environment_id = e.environment_id
                 LEFT JOIN prices p ON p.instance_type = e.current_instance_type""",
        "steps": f"""
            SELECT {MOVE}, decision, CASE WHEN decision = 'SAFE TO RIGHTSIZE' THEN 'SAFE' ELSE 'BLOCKED' END AS outcome,
                   CASE WHEN NOT latency_satisfied OR NOT availability_satisfied OR peak_cpu > 90 THEN 'CRITICAL'
                        WHEN peak_cpu > 80 THEN 'HIGH' WHEN peak_cpu > 60 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
                   absolute_monthly_saving AS cost_saving
            FROM decided""",
    }


def _simulated(body: str, policy: str, variants: list[dict] | None = None, *steps: str, **extra: str) -> str:
    base = ("environments", "catalog", "profiled", "prices", *steps)
    return _with(body, *base, **_model(policy, variants), **extra)


RESULT_DOUBLES = [
    "projected_p95_latency",
    "projected_availability",
    "slo_violation_rate",
    "peak_cpu",
    "peak_mem",
    "baseline_monthly_cost",
    "simulated_monthly_cost",
    "absolute_monthly_saving",
    "cost_reduction_pct",
]
RESULT = f"{MOVE}, row_count, {', '.join(RESULT_DOUBLES)}"
SWEEP_DOUBLES = [
    "traffic_growth",
    "projected_p95_latency",
    "projected_availability",
    "absolute_monthly_saving",
    "peak_cpu",
    "peak_mem",
]
SWEEP = f"{MOVE}, variant_id, decision, reason_codes, {', '.join(SWEEP_DOUBLES)}"
METRICS = ["cpu_utilization_pct", "memory_utilization_pct", "latency_ms", "request_volume", "availability_pct"]
HISTORIES = [
    ("cpu_history", "cpu_utilization_pct", 11),
    ("memory_history", "memory_utilization_pct", 13),
    ("latency_history", "latency_ms", 17),
    ("request_history", "request_volume", 19),
    ("availability_history", "availability_pct", 23),
]
STAMP = f"strftime(timestamp, {INSTANT}) AS timestamp"


def _rule(rule: str) -> str:
    order = ["missing", "cpu", "memory", "requests", "latency", "availability", "unknown_environment"]
    earlier = ", ".join(f"'{r}'" for r in order[: order.index(rule)]) or "''"
    return _with(
        f"""SELECT environment_id, count(*) AS reached_rows, count(*) FILTER (failed_rule = '{rule}') AS removed_rows
            FROM tagged WHERE coalesce(failed_rule, 'none') NOT IN ({earlier}) GROUP BY environment_id""",
        "tagged",
    )


def _projection(variant: dict, policy: str = "step_down", extra: str = "") -> str:
    return _simulated(
        _shown(
            f"""SELECT environment_id, candidate_instance_type, {STAMP}, projected_requests, projected_cpu,
                       projected_memory{extra} FROM projected""",
            "projected_requests",
            "projected_cpu",
            "projected_memory",
        ),
        policy,
        [variant],
    )


def _curve(column: str) -> str:
    return _simulated(
        _shown(f"SELECT environment_id, candidate_instance_type, {STAMP}, {column} FROM projected", column), "cheaper"
    )


def _status_sql(body: str) -> str:
    counted = """SELECT {key} AS environment_id, CAST(sum(copies) AS BIGINT) AS input_rows,
                        count(*) FILTER (failed_rule IS NULL{more}) AS clean_rows FROM tagged {group}"""
    return body.replace("$ALL", counted.replace("{key}", "'(all)'").replace("{group}", "")).replace(
        "$EACH", counted.replace("{key}", "environment_id").replace("{group}", "GROUP BY environment_id")
    )


def _verdict(keys: str, source: str, where: str = "") -> str:
    return f"""SELECT {keys}, count(*) AS checkpoints,
                      count(*) FILTER (health_status = 'ROLLBACK_REQUIRED') AS rollback_checkpoints,
                      count(*) FILTER (health_status = 'DEGRADED') AS degraded_checkpoints,
                      CASE WHEN count(*) FILTER (health_status = 'ROLLBACK_REQUIRED') > 0
                             OR count(*) FILTER (health_status = 'DEGRADED') > 2 THEN 'ROLLBACK_REQUIRED'
                           ELSE 'STABLE' END AS verdict
               FROM {source} {where} GROUP BY {keys}"""


FIRST_FIVE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY environment_id ORDER BY ts, reading_id) - 1
                AS checkpoint_no FROM judged) numbered WHERE checkpoint_no < 5"""

REQUEST_MODEL = _model(
    moves="""
        SELECT r.environment_id, r.expected_current AS current_instance_type, r.candidate_instance_type,
               c.vcpu / CAST(k.vcpu AS DOUBLE) AS cpu_ratio, c.memory_gb / CAST(k.memory_gb AS DOUBLE) AS mem_ratio
        FROM requests r JOIN environments e ON e.environment_id = r.environment_id
             JOIN catalog c ON c.instance_type = r.expected_current
             JOIN catalog k ON k.instance_type = r.candidate_instance_type"""
)
GATE = """
    SELECT r.environment_id, r.expected_current, r.candidate_instance_type, e.status, e.current_instance_type AS actual,
           CASE WHEN e.environment_id IS NULL THEN 'NOT_FOUND' WHEN e.status <> 'RUNNING' THEN 'NOT_RUNNING'
                WHEN e.current_instance_type <> r.expected_current THEN 'INSTANCE_MISMATCH' ELSE 'passed' END AS state_check,
           d.decision AS simulated, d.reason_codes AS codes
    FROM requests r LEFT JOIN environments e ON e.environment_id = r.environment_id
         LEFT JOIN decided d ON d.environment_id = r.environment_id"""
GATED = """
    SELECT *, CASE WHEN state_check <> 'passed' THEN 'not simulated' ELSE simulated END AS decision,
           CASE WHEN state_check <> 'passed' THEN 'PRECHECK_FAILED' WHEN simulated = 'SAFE TO RIGHTSIZE'
                THEN 'MIGRATION_APPROVED' ELSE 'MIGRATION_BLOCKED' END AS event FROM gate"""

MEASURED = {
    "base_cpu": ["mean_cpu", "median_cpu", "p95_cpu", "peak_cpu"],
    "base_memory": ["mean_memory", "p95_memory", "peak_memory"],
    "base_traffic": ["mean_request_volume", "p95_request_volume", "peak_request_volume"],
    "base_latency": ["mean_latency", "p95_latency", "p99_latency"],
}

# Texts of the error catalog (fixed values).
ERROR_TEXTS = """
    SELECT * FROM (VALUES
        ('MISSING_TELEMETRY', 'Telemetry data is missing.', 'Check telemetry pipeline and re-ingest data.'),
        ('INVALID_TELEMETRY', 'Telemetry data is invalid or corrupt.', 'Check telemetry pipeline and re-ingest data.'),
        ('DUPLICATE_TELEMETRY', 'Telemetry data contains duplicate timestamps.', 'Check telemetry pipeline and re-ingest data.'),
        ('UNKNOWN_ENVIRONMENT', 'Environment ID not found in registry.', 'Manual intervention required.'),
        ('NEGATIVE_REQUEST_VOLUME', 'Request volume contains negative values.', 'Check telemetry pipeline and re-ingest data.'),
        ('NEGATIVE_LATENCY', 'Latency contains negative values.', 'Check telemetry pipeline and re-ingest data.'),
        ('CPU_SATURATION', 'CPU utilization exceeds 100%.', 'Abort rightsizing. Monitor current instance.'),
        ('MEMORY_SATURATION', 'Memory utilization exceeds 100%.', 'Abort rightsizing. Monitor current instance.'),
        ('LATENCY_SLO_FAILURE', 'Latency exceeds SLO target.', 'Abort rightsizing. Monitor current instance.'),
        ('AVAILABILITY_SLO_FAILURE', 'Availability falls below SLO target.', 'Abort rightsizing. Monitor current instance.'),
        ('NO_COST_BENEFIT', 'Candidate instance does not provide cost savings.', 'Abort rightsizing. Monitor current instance.')
    ) AS e(error_code, reason, recovery_action)"""
EXPLAINED = """SELECT f.*, coalesce(t.reason, 'Unknown error occurred.') AS reason,
                      coalesce(t.recovery_action, 'Manual intervention required.') AS recovery_action, 'FAILED' AS status
               FROM failures f LEFT JOIN texts t ON t.error_code = f.error_code"""

EVENTS = [
    "PRECHECK_STARTED", "PRECHECK_FAILED", "MIGRATION_BLOCKED", "MIGRATION_APPROVED", "MIGRATION_STARTED",
    "MIGRATION_EXECUTED", "MIGRATION_FAILED", "MIGRATION_STOPPED", "MONITORING_STARTED", "FAILURE_DETECTED",
    "POSTCHECK_PASSED", "PREDICTION_ACCURACY", "ROLLBACK_STARTED", "ROLLBACK_FAILED",
    "ORIGINAL_CONFIGURATION_RESTORED", "RESTORATION_VERIFIED",
]


def _merged() -> str:
    tables = {name: f"SELECT timestamp, environment_id, {m} FROM firsts WHERE (l_orderkey % {gap} <> 2 OR l_orderkey % 1062347 = 2)" for name, m, gap in HISTORIES}
    joins = HISTORIES[0][0] + "".join(f" FULL OUTER JOIN {name} USING (timestamp, environment_id)" for name, _, _ in HISTORIES[1:])
    return _with(
        _shown(f"SELECT {STAMP}, environment_id, {', '.join(METRICS)} FROM {joins}", *METRICS), "firsts", **tables
    )


def _history_sizes() -> str:
    return _with(
        _shown(
            " UNION ALL ".join(
                f"""SELECT environment_id, count(*) AS readings, count({m}) AS known_readings, min({m}) AS lowest,
                           max({m}) AS highest, '{name}' AS history
                    FROM firsts WHERE (l_orderkey % {gap} <> 2 OR l_orderkey % 1062347 = 2) GROUP BY environment_id"""
                for name, m, gap in HISTORIES
            ),
            "lowest",
            "highest",
        ),
        "firsts",
    )


def _funnel() -> str:
    counts = ", ".join(f"count(*) FILTER (event = '{e}') AS {e.lower()}" for e in EVENTS)
    return _with(
        _shown(
            """SELECT *, CASE WHEN precheck_started > 0 THEN migration_approved / CAST(precheck_started AS DOUBLE) * 100 ELSE 0 END AS approval_rate_pct,
                      CASE WHEN precheck_started > 0 THEN migration_blocked / CAST(precheck_started AS DOUBLE) * 100 ELSE 0 END AS block_rate_pct,
                      CASE WHEN migration_executed > 0 THEN original_configuration_restored / CAST(migration_executed AS DOUBLE) * 100 ELSE 0 END
                        AS rollback_rate_pct
               FROM counted""",
            "approval_rate_pct",
            "block_rate_pct",
            "rollback_rate_pct",
        ),
        "audit",
        counted=f"SELECT {counts} FROM audit",
    )


def _stream_windows(slide_hours: int | None) -> str:
    """Closed windows only: a window is emitted once the watermark reaches its end."""
    if slide_hours is None:
        starts = "SELECT *, date_trunc('day', ts) AS window_start FROM readings"
    else:
        starts = f"""SELECT r.*, date_trunc('hour', ts) - to_hours(CAST(g.h AS INTEGER)) AS window_start
                     FROM readings r, range(0, 24) AS g(h)"""
    body = f"""SELECT strftime(window_start, {INSTANT}) AS window_start,
                      strftime(window_start + INTERVAL 1 DAY, {INSTANT}) AS window_end, environment_id,
                      count(*) AS readings, avg(cpu) AS mean_cpu, max(cpu) AS peak_cpu,
                      quantile_cont(cpu, 0.95) AS p95_cpu, avg(memory) AS mean_memory, max(memory) AS peak_memory,
                      avg(latency) AS mean_latency, avg(availability) AS measured_availability,
                      count(*) FILTER (availability < CAST(99.9 AS DOUBLE)) AS slo_violations
               FROM spans WHERE window_start + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM readings)
               GROUP BY window_start, environment_id"""
    doubles = ["mean_cpu", "peak_cpu", "p95_cpu", "mean_memory", "peak_memory", "mean_latency", "measured_availability"]
    return _with(_shown(body, *doubles), "readings", spans=starts)


BOX = ["low", "q1", "middle", "q3", "high"]
BOX_P = [0, 0.25, 0.5, 0.75, 1]


def _box(column: str, label: str) -> str:
    numbers = ", ".join(f"quantile_cont({column}, {p}) AS {n}" for n, p in zip(BOX, BOX_P))
    return f"SELECT {MOVE}, '{label}' AS series, {numbers} FROM projected GROUP BY {MOVE}"


ORACLES: dict[str, str] = {
    # sources and sinks
    "src_environments": _with("SELECT * FROM environments", "environments"),
    "src_metric_histories": _history_sizes(),
    "src_telemetry_merge": _merged(),
    "src_pricing": _with(_shown(f"SELECT {STAMP}, instance_type, hourly_price FROM pricing", "hourly_price"), "pricing"),
    "src_full_telemetry": _with(
        _shown(
            f"""SELECT t.environment_id, e.current_instance_type AS instance_type, count(*) AS readings,
                       strftime(min(t.timestamp), {INSTANT}) AS first_reading, strftime(max(t.timestamp), {INSTANT}) AS last_reading,
                       avg(t.cpu_utilization_pct) AS mean_cpu, sum(t.request_volume) AS requests
                FROM telemetry t JOIN environments e ON e.environment_id = t.environment_id
                GROUP BY t.environment_id, e.current_instance_type""",
            "mean_cpu",
            "requests",
        ),
        "telemetry",
    ),
    "src_clustered_lookup": _with(
        """SELECT w.environment_id, known AS found, coalesce(readings, 0) AS readings
           FROM (SELECT environment_id, true AS known FROM environments WHERE status = 'STOPPED'
                 UNION ALL SELECT 'env-unknown', false) w
           LEFT JOIN (SELECT environment_id, count(*) AS readings FROM telemetry GROUP BY environment_id) t USING (environment_id)""",
        "telemetry",
        "environments",
    ),
    "src_env_lookup": _with(
        """SELECT r.environment_id, e.environment_id IS NOT NULL AS found, coalesce(e.service_name, 'none') AS service_name,
                  coalesce(e.current_instance_type, 'none') AS current_instance_type,
                  CASE WHEN e.environment_id IS NULL THEN 0 ELSE (SELECT count(*) FROM telemetry t WHERE t.environment_id = r.environment_id) END AS readings
           FROM requests r LEFT JOIN environments e ON e.environment_id = r.environment_id""",
        "requests",
        "environments",
        "telemetry",
    ),
    "sink_metric_split": _with(
        _shown(
            " UNION ALL ".join(
                f"SELECT environment_id, '{m}' AS metric, count({m}) AS readings, sum({m}) AS total FROM telemetry GROUP BY environment_id"
                for m in METRICS
            ),
            "total",
        ),
        "telemetry",
    ),
    "sink_audit_append": _with(
        """SELECT strftime(timestamp, '%Y-%m-%d') AS event_date, event, count(*) AS events FROM audit GROUP BY 1, 2""",
        "audit",
    ),
    "src_audit_by_env": _with(
        f"""SELECT environment_id, row_number() OVER (PARTITION BY environment_id ORDER BY timestamp, seq) AS entry,
                   {STAMP}, seq, event FROM audit""",
        "audit",
    ),
    "sink_results": _simulated(f"SELECT {MOVE}, decision, reason_codes, row_count FROM decided", "step_down"),
    # validation
    "val_schema": _with(
        """SELECT i.input, CAST(c.ordinal AS BIGINT) AS ordinal, c.name AS required_column,
                  NOT (i.input = 'without availability' AND c.name = 'availability_pct') AS present,
                  CASE WHEN i.input = 'without availability' AND c.name = 'availability_pct' THEN 0
                       WHEN c.name = 'cpu_utilization_pct' THEN (SELECT count(*) FROM lineitem WHERE l_orderkey % 89 <> 1)
                       ELSE (SELECT count(*) FROM raw) END AS known_values
           FROM (VALUES ('telemetry'), ('without availability')) AS i(input),
                (VALUES (0, 'timestamp'), (1, 'environment_id'), (2, 'cpu_utilization_pct'), (3, 'memory_utilization_pct'),
                        (4, 'latency_ms'), (5, 'request_volume'), (6, 'availability_pct')) AS c(ordinal, name)""",
        "raw",
    ),
    "val_timestamp": _with(
        """SELECT environment_id, count(*) AS row_count, count(*) FILTER (l_orderkey % 101 = 1) AS bad_timestamps,
                  CASE WHEN count(*) FILTER (l_orderkey % 101 = 1) > 0 THEN 'INVALID' ELSE 'VALID' END AS status
           FROM (SELECT environment_id, l_orderkey FROM raw UNION ALL SELECT '(all)', l_orderkey FROM raw) r
           GROUP BY environment_id""",
        "raw",
    ),
    "val_dedup": _with(
        _shown(f"SELECT {STAMP}, environment_id, {', '.join(METRICS)}, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice, l_partkey FROM firsts",
               *METRICS, "l_extendedprice"),
        "firsts",
    ),
    **{
        f"val_{key}": _rule(rule)
        for key, rule in [
            ("missing", "missing"),
            ("cpu", "cpu"),
            ("memory", "memory"),
            ("requests", "requests"),
            ("latency", "latency"),
            ("availability", "availability"),
            ("known_env", "unknown_environment"),
        ]
    },
    "val_clean": _with(_shown(f"SELECT {STAMP}, environment_id, {', '.join(METRICS)} FROM telemetry", *METRICS), "telemetry"),
    "val_issue_report": _with(
        """SELECT * FROM (
               SELECT CAST(r.rule_order AS BIGINT) AS rule_order, r.rule, CAST(r.n AS BIGINT) AS removed_rows,
                      'Removed ' || CAST(CAST(r.n AS BIGINT) AS VARCHAR) || r.rest AS message
               FROM (
                   SELECT 1 AS rule_order, 'duplicate' AS rule, (SELECT count(*) FROM raw) - (SELECT count(*) FROM firsts) AS n, ' duplicate records.' AS rest
                   UNION ALL SELECT 2, 'missing', (SELECT count(*) FROM tagged WHERE failed_rule = 'missing'), ' rows with missing values.'
                   UNION ALL SELECT 3, 'cpu', (SELECT count(*) FROM tagged WHERE failed_rule = 'cpu'), ' rows with invalid CPU utilization.'
                   UNION ALL SELECT 4, 'memory', (SELECT count(*) FROM tagged WHERE failed_rule = 'memory'), ' rows with invalid memory utilization.'
                   UNION ALL SELECT 5, 'requests', (SELECT count(*) FROM tagged WHERE failed_rule = 'requests'), ' rows with negative request volume.'
                   UNION ALL SELECT 6, 'latency', (SELECT count(*) FROM tagged WHERE failed_rule = 'latency'), ' rows with negative latency.'
                   UNION ALL SELECT 7, 'availability', (SELECT count(*) FROM tagged WHERE failed_rule = 'availability'), ' rows with invalid availability.'
                   UNION ALL SELECT 8, 'unknown_environment', (SELECT count(*) FROM tagged WHERE failed_rule = 'unknown_environment'), ' rows with unknown environment IDs.'
               ) r) lines WHERE removed_rows > 0""",
        "tagged",
    ),
    "val_status": _with(
        _status_sql(
            """SELECT *, CASE WHEN clean_rows < 10 THEN 'INVALID' WHEN clean_rows < input_rows THEN 'WARNING' ELSE 'VALID' END AS status,
                      CASE WHEN clean_rows = 0 THEN 'No valid data remaining after cleaning.'
                           WHEN clean_rows < 10 THEN 'Insufficient valid data volume (< 10 rows).' ELSE '' END AS issue
               FROM ($ALL UNION ALL $EACH) counted"""
        ).replace("{more}", ""),
        "tagged",
    ),
    "val_quality_grade": _with(
        _status_sql(
            """SELECT *, CASE WHEN clean_rows < 10 THEN 'INVALID' WHEN clean_rows < input_rows THEN 'WARNING' ELSE 'VALID' END AS status,
                      CASE WHEN clean_rows < 10 THEN 'LOW' WHEN clean_rows < input_rows THEN 'MEDIUM'
                           WHEN clean_rows > 500 THEN 'HIGH' ELSE 'MEDIUM' END AS quality
               FROM ($ALL UNION ALL $EACH) counted"""
        ).replace("{more}", " OR failed_rule = 'unknown_environment'"),
        "tagged",
    ),
    # baselines
    **{
        key: _with(_shown(f"SELECT environment_id, {', '.join(cols)} FROM baseline", *cols), "baseline")
        for key, cols in MEASURED.items()
    },
    "base_reliability": _with(
        _shown("SELECT environment_id, measured_availability, slo_violations FROM baseline", "measured_availability"), "baseline"
    ),
    "base_all": _with(
        _shown("SELECT * FROM baseline", *[c for cols in MEASURED.values() for c in cols], "measured_availability"), "baseline"
    ),
    # projection
    "proj_capacity": _projection({}, "cheaper"),
    "proj_growth": _projection({"traffic_growth": 0.2}),
    "proj_pressure": _projection({"cpu_pressure": 0.1, "memory_pressure": 0.2}),
    "proj_peak": _projection({"profile": "peak"}),
    "proj_bursty": _projection({"profile": "bursty"}, extra=", is_spike"),
    "proj_low_traffic": _projection({"profile": "low-traffic"}),
    "proj_seasonal": _projection({"profile": "seasonal"}, extra=", position"),
    "proj_steady": _projection({}),
    # performance, SLO, cost
    "perf_pressure": _curve("pressure"),
    "perf_latency": _curve("projected_latency"),
    "perf_availability": _curve("projected_availability"),
    "slo_eval": _simulated(
        _shown(
            f"""SELECT {MOVE}, variant_id, row_count, projected_p95_latency, projected_availability, slo_violation_rate,
                       latency_satisfied, availability_satisfied FROM costed""",
            "projected_p95_latency",
            "projected_availability",
            "slo_violation_rate",
        ),
        "cheaper",
        [{}, TIGHT],
    ),
    "peak_resources": _simulated(_shown(f"SELECT {MOVE}, peak_cpu, peak_mem FROM slo", "peak_cpu", "peak_mem"), "cheaper"),
    "cost_avg_price": _with(_shown("SELECT * FROM prices", "hourly_avg"), "prices"),
    "cost_compare": _with(
        _shown(
            """SELECT c.instance_type AS current_instance_type, k.instance_type AS candidate_instance_type,
                      a.hourly_avg AS current_hourly_avg, b.hourly_avg AS candidate_hourly_avg,
                      a.hourly_avg * 730 AS baseline_monthly_cost, b.hourly_avg * 730 AS simulated_monthly_cost,
                      a.hourly_avg * 730 - b.hourly_avg * 730 AS absolute_monthly_saving,
                      (a.hourly_avg - b.hourly_avg) / a.hourly_avg * 100 AS cost_reduction_pct
               FROM catalog c CROSS JOIN catalog k JOIN prices a ON a.instance_type = c.instance_type
                    JOIN prices b ON b.instance_type = k.instance_type""",
            "current_hourly_avg",
            "candidate_hourly_avg",
            "baseline_monthly_cost",
            "simulated_monthly_cost",
            "absolute_monthly_saving",
            "cost_reduction_pct",
        ),
        "catalog",
        "prices",
    ),
    # what-if and decision
    "whatif_run": _simulated(_shown(f"SELECT {RESULT} FROM costed", *RESULT_DOUBLES), "cheaper_and_self"),
    "whatif_profiles": _simulated(
        _shown(f"SELECT {RESULT}, variant_id FROM costed", *RESULT_DOUBLES), "step_down", PROFILES
    ),
    "whatif_average": _simulated(
        _shown(
            """SELECT p.scenario, d.environment_id, d.current_instance_type, d.candidate_instance_type, d.decision, d.reason_codes,
                      d.baseline_monthly_cost, d.simulated_monthly_cost, d.cost_reduction_pct, b.mean_cpu, d.mean_projected_cpu,
                      b.peak_cpu AS baseline_peak_cpu, d.peak_cpu, b.peak_memory, d.peak_mem, b.p95_latency,
                      d.projected_p95_latency, b.measured_availability, d.projected_availability
               FROM picked p JOIN decided d ON d.environment_id = p.environment_id JOIN baseline b ON b.environment_id = p.environment_id""",
            "baseline_monthly_cost", "simulated_monthly_cost", "cost_reduction_pct", "mean_cpu", "mean_projected_cpu",
            "baseline_peak_cpu", "peak_cpu", "peak_memory", "peak_mem", "p95_latency", "projected_p95_latency",
            "measured_availability", "projected_availability",
        ),
        "step_down_or_self",
        None,
        "baseline",
        spread="SELECT environment_id, stddev_samp(request_volume) AS sd FROM telemetry GROUP BY environment_id",
        picked="""
            SELECT 'normal' AS scenario, coalesce((SELECT e.environment_id FROM environments e JOIN spread s USING (environment_id)
                       WHERE s.sd < 50 AND e.current_instance_type = 'medium' ORDER BY e.seq LIMIT 1),
                   (SELECT environment_id FROM environments ORDER BY seq LIMIT 1)) AS environment_id
            UNION ALL SELECT 'peak', coalesce((SELECT environment_id FROM environments WHERE current_instance_type = 'large' ORDER BY seq LIMIT 1),
                   (SELECT environment_id FROM environments ORDER BY seq LIMIT 1))
            UNION ALL SELECT 'bursty', coalesce((SELECT e.environment_id FROM environments e JOIN spread s USING (environment_id)
                       WHERE s.sd > 100 AND e.current_instance_type = 'medium' ORDER BY e.seq LIMIT 1),
                   (SELECT environment_id FROM environments ORDER BY seq LIMIT 1))""",
    ),
    "decide": _simulated(f"SELECT {MOVE}, variant_id, decision, reason_codes FROM decided", "cheaper", [{}, TIGHT]),
    "decide_insufficient": _with(
        """SELECT r.environment_id, coalesce(e.current_instance_type, r.expected_current) AS current_instance_type,
                  r.candidate_instance_type, coalesce(d.row_count, 0) AS row_count,
                  CASE WHEN d.row_count IS NULL OR g.clean_rows < 10 THEN 'INSUFFICIENT DATA' ELSE d.decision END AS decision,
                  CASE WHEN d.row_count IS NULL THEN 'MISSING_TELEMETRY' WHEN g.clean_rows < 10 THEN 'INVALID_TELEMETRY'
                       ELSE d.reason_codes END AS reason_codes
           FROM requests r LEFT JOIN environments e ON e.environment_id = r.environment_id
                LEFT JOIN decided d ON d.environment_id = r.environment_id
                LEFT JOIN (SELECT environment_id, count(*) FILTER (failed_rule IS NULL OR failed_rule = 'unknown_environment') AS clean_rows
                           FROM tagged GROUP BY environment_id) g ON g.environment_id = r.environment_id""",
        "requests",
        "environments",
        "catalog",
        "profiled",
        "prices",
        **_model(
            moves="""
            SELECT r.environment_id, coalesce(e.current_instance_type, r.expected_current) AS current_instance_type,
                   r.candidate_instance_type, c.vcpu / CAST(k.vcpu AS DOUBLE) AS cpu_ratio,
                   c.memory_gb / CAST(k.memory_gb AS DOUBLE) AS mem_ratio
            FROM requests r LEFT JOIN environments e ON e.environment_id = r.environment_id
                 JOIN catalog c ON c.instance_type = coalesce(e.current_instance_type, r.expected_current)
                 JOIN catalog k ON k.instance_type = r.candidate_instance_type"""
        ),
    ),
    "decide_reasons": _simulated(
        f"""SELECT {MOVE}, decision, CASE WHEN decision = 'SAFE TO RIGHTSIZE'
                THEN 'Cost decreases while SLO targets and resource limits remain satisfied.'
                ELSE concat_ws('|',
                    CASE WHEN absolute_monthly_saving <= 0 THEN 'Candidate does not provide cost benefit.' END,
                    CASE WHEN NOT latency_satisfied
                         THEN printf('Projected P95 latency = %.2f ms (Target violated)', projected_p95_latency) END,
                    CASE WHEN NOT availability_satisfied
                         THEN printf('Projected availability = %.2f%% (Target violated)', projected_availability) END,
                    CASE WHEN peak_cpu > 90 THEN printf('Projected peak CPU = %.1f%% exceeds safe limit (90%%)', peak_cpu) END,
                    CASE WHEN peak_mem > 90 THEN printf('Projected peak memory = %.1f%% exceeds safe limit (90%%)', peak_mem) END)
                END AS reasons
            FROM decided""",
        "cheaper_and_self",
    ),
    # candidates
    "cand_generate": _simulated(f"SELECT {MOVE}, CAST(candidate_ordinal AS BIGINT) AS candidate_ordinal FROM moves", "cheaper"),
    "cand_headroom": _simulated(
        _shown(
            f"SELECT {MOVE}, least(100 - peak_cpu, 100 - peak_mem) AS headroom FROM decided WHERE decision = 'SAFE TO RIGHTSIZE'",
            "headroom",
        ),
        "cheaper",
    ),
    "cand_best": _simulated(
        _shown(f"SELECT {MOVE}, headroom, absolute_monthly_saving FROM best", "headroom", "absolute_monthly_saving"), "cheaper"
    ),
    "cand_best_variants": _simulated(
        _shown(f"SELECT {MOVE}, variant_id, headroom, absolute_monthly_saving FROM best", "headroom", "absolute_monthly_saving"),
        "cheaper",
        [{"variant_id": f"growth_{g}", "traffic_growth": g / 100} for g in (0, 20, 40)],
    ),
    "cand_none": _simulated(
        """SELECT environment_id, current_instance_type, selected_candidate, decision FROM detail""", "cheaper"
    ),
    "cand_step_down": _simulated(f"SELECT {MOVE} FROM moves", "step_down"),
    "cand_step_down_or_self": _simulated(f"SELECT {MOVE} FROM moves", "step_down_or_self"),
    "legacy_recommend": _with(
        _shown(
            "SELECT environment_id, current_instance_type, mean_cpu, coalesce(recommended, 'none') AS recommended FROM naive",
            "mean_cpu",
        ),
        "naive",
    ),
    "legacy_vs_safe": _simulated(
        _shown(
            """SELECT n.environment_id, n.current_instance_type, n.recommended, n.mean_cpu, d.decision, d.reason_codes
               FROM naive n JOIN decided d ON d.environment_id = n.environment_id AND d.candidate_instance_type = n.recommended
               WHERE d.decision <> 'SAFE TO RIGHTSIZE'""",
            "mean_cpu",
        ),
        "step_down",
        None,
        "naive",
    ),
    # sensitivity
    "sens_growth": _simulated(_shown(f"SELECT {SWEEP} FROM decided", *SWEEP_DOUBLES), "step_down", GROWTH),
    "sens_pressure": _simulated(
        _shown(
            f"SELECT {SWEEP}, cpu_pressure, memory_pressure, latency_target, availability_target FROM decided",
            *SWEEP_DOUBLES,
            "cpu_pressure",
            "memory_pressure",
            "latency_target",
            "availability_target",
        ),
        "step_down",
        [
            {"variant_id": "variation_0", "traffic_growth": 0.1},
            {"variant_id": "variation_1", "cpu_pressure": 0.1},
            {"variant_id": "variation_2", "memory_pressure": 0.1},
            TIGHT,
        ],
    ),
    "sens_flip": _simulated(
        _shown(
            f"""SELECT s.environment_id, s.current_instance_type, s.candidate_instance_type, s.highest_safe_growth,
                       coalesce(u.traffic_growth, -1) AS flip_growth,
                       coalesce(split_part(u.reason_codes, '|', 1), 'none') AS binding_constraint,
                       coalesce(u.peak_cpu, 0) AS flip_peak_cpu, coalesce(u.peak_mem, 0) AS flip_peak_mem
                FROM (SELECT {MOVE}, max(traffic_growth) FILTER (decision = 'SAFE TO RIGHTSIZE') AS highest_safe_growth
                      FROM decided GROUP BY {MOVE} HAVING bool_or(decision = 'SAFE TO RIGHTSIZE' AND traffic_growth = 0)) s
                     LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {MOVE} ORDER BY traffic_growth) AS nth
                                FROM decided WHERE decision <> 'SAFE TO RIGHTSIZE') u
                       ON u.environment_id = s.environment_id AND u.nth = 1""",
            "highest_safe_growth",
            "flip_growth",
            "flip_peak_cpu",
            "flip_peak_mem",
        ),
        "step_down",
        GROWTH,
    ),
    # portfolio
    "port_detail": _simulated(
        _shown("SELECT * FROM detail", "current_monthly_cost", "candidate_cost", "potential_saving"), "cheaper"
    ),
    "port_summary": _simulated(
        _shown(
            """SELECT count(*) AS total_environments, count(*) FILTER (selected_candidate <> 'none') AS safe_environments,
                      count(*) FILTER (selected_candidate = 'none') AS blocked_environments,
                      sum(current_monthly_cost) AS current_monthly_cost, sum(potential_saving) AS potential_monthly_savings,
                      CAST(0 AS DOUBLE) AS blocked_potential_savings, sum(potential_saving) * 12 AS potential_annual_savings
               FROM detail""",
            "current_monthly_cost",
            "potential_monthly_savings",
            "blocked_potential_savings",
            "potential_annual_savings",
        ),
        "cheaper",
    ),
    "port_blocked_savings": _simulated(
        _shown(
            """SELECT d.current_instance_type, count(*) AS blocked_environments, CAST(0 AS DOUBLE) AS blocked_potential_savings,
                      sum(coalesce(u.saving, 0)) AS unsafe_savings
               FROM detail d LEFT JOIN (SELECT environment_id, max(absolute_monthly_saving) AS saving FROM decided
                                        WHERE decision <> 'SAFE TO RIGHTSIZE' GROUP BY environment_id) u
                      ON u.environment_id = d.environment_id
               WHERE d.selected_candidate = 'none' GROUP BY d.current_instance_type""",
            "blocked_potential_savings",
            "unsafe_savings",
        ),
        "cheaper",
    ),
    "port_ranked": _simulated(
        _shown(
            """SELECT s.*, row_number() OVER (PARTITION BY s.outcome ORDER BY s.cost_saving DESC, e.seq) AS rank
               FROM steps s JOIN environments e ON e.environment_id = s.environment_id""",
            "cost_saving",
        ),
        "step_down",
    ),
    "port_top_n": _simulated(
        _shown(
            """SELECT s.* FROM steps s JOIN environments e ON e.environment_id = s.environment_id WHERE s.outcome = 'SAFE'
               ORDER BY s.cost_saving DESC, e.seq LIMIT 3""",
            "cost_saving",
        ),
        "step_down",
    ),
    "port_metrics": _simulated(
        _shown(
            """SELECT count(*) AS evaluated, count(*) FILTER (s.outcome = 'SAFE') AS safe, count(*) FILTER (s.outcome = 'BLOCKED') AS blocked,
                      count(n.recommended) AS naive_recommended,
                      count(n.recommended) FILTER (s.outcome = 'BLOCKED') AS naive_blocked,
                      CASE WHEN count(n.recommended) > 0
                           THEN count(n.recommended) FILTER (s.outcome = 'BLOCKED') / CAST(count(n.recommended) AS DOUBLE) * 100
                           ELSE 100 END AS prevention_rate_pct
               FROM steps s LEFT JOIN naive n ON n.environment_id = s.environment_id""",
            "prevention_rate_pct",
        ),
        "step_down",
        None,
        "naive",
    ),
    "risk_agent": _simulated(
        f"""SELECT {MOVE}, variant_id,
                   CASE WHEN NOT (latency_satisfied AND availability_satisfied) OR peak_cpu > 90 THEN 'CRITICAL'
                        WHEN peak_cpu > 80 THEN 'HIGH' WHEN peak_cpu > 60 THEN 'MEDIUM' ELSE 'LOW' END AS risk
            FROM costed""",
        "cheaper_and_self",
        [{}, TIGHT],
    ),
    "risk_portfolio": _simulated(
        "SELECT current_instance_type, risk, count(*) AS environments FROM detail GROUP BY 1, 2", "cheaper"
    ),
    # trade-off, views, distribution
    "tradeoff": _simulated(
        _shown(
            """SELECT k.environment_id, k.current_instance_type, k.candidate_instance_type,
                      k.simulated_monthly_cost - c.baseline_monthly_cost AS cost_delta, k.peak_cpu - c.peak_cpu AS cpu_delta,
                      k.peak_mem - c.peak_mem AS memory_delta, k.projected_p95_latency - c.projected_p95_latency AS latency_delta,
                      k.projected_availability - c.projected_availability AS availability_delta,
                      100 - greatest(k.peak_cpu, k.peak_mem) AS resource_headroom
               FROM costed k JOIN costed c ON c.environment_id = k.environment_id AND c.candidate_instance_type = c.current_instance_type
               WHERE k.candidate_instance_type <> k.current_instance_type""",
            "cost_delta",
            "cpu_delta",
            "memory_delta",
            "latency_delta",
            "availability_delta",
            "resource_headroom",
        ),
        "cheaper_and_self",
    ),
    "explain": _simulated(
        _shown(
            f"""SELECT {MOVE}, CASE WHEN decision = 'SAFE TO RIGHTSIZE' THEN 'SAFE' ELSE 'BLOCKED' END AS verdict,
                       CASE WHEN decision = 'SAFE TO RIGHTSIZE' THEN 'SAFE' ELSE 'BLOCKED' END AS document_decision,
                       candidate_instance_type AS document_candidate, peak_cpu AS cpu, peak_mem AS memory,
                       projected_p95_latency AS latency, projected_availability AS availability,
                       CASE WHEN decision = 'SAFE TO RIGHTSIZE' THEN absolute_monthly_saving ELSE 0 END AS cost_reduction,
                       CASE WHEN decision = 'SAFE TO RIGHTSIZE' THEN 'All simulated metrics are within strict safety bounds.' ELSE '' END AS evidence,
                       CAST(CASE WHEN decision = 'SAFE TO RIGHTSIZE' THEN 4 ELSE 0 END AS BIGINT) AS checks,
                       CAST(CASE WHEN decision = 'SAFE TO RIGHTSIZE' THEN 0 ELSE len(string_split(reason_codes, '|')) END AS BIGINT) AS reasons
                FROM decided""",
            "cpu",
            "memory",
            "latency",
            "availability",
            "cost_reduction",
        ),
        "cheaper",
    ),
    "view_infra": _simulated(
        _shown(
            """SELECT d.environment_id, 'INFRASTRUCTURE ENGINEER' AS view, d.peak_cpu AS resource_usage, d.decision AS safety,
                      coalesce(v.verdict, 'N/A') AS health, 'SIMULATED STAKEHOLDER VALIDATION' AS label
               FROM decided d LEFT JOIN verdicts v ON v.environment_id = d.environment_id""",
            "resource_usage",
        ),
        "step_down",
        None,
        "checkpoints",
        verdicts=_verdict("environment_id", "checkpoints", "WHERE newest = 1"),
    ),
    "view_finops": _simulated(
        _shown(
            """SELECT 'FINOPS / COST MANAGER' AS view, sum(current_monthly_cost) AS cost, sum(potential_saving) AS potential_savings,
                      CAST(count(*) FILTER (selected_candidate <> 'none') AS VARCHAR) || ' Safe' AS portfolio_health,
                      'SIMULATED STAKEHOLDER VALIDATION' AS label FROM detail""",
            "cost",
            "potential_savings",
        ),
        "cheaper",
    ),
    "view_owner": _simulated(
        _shown(
            """SELECT environment_id, 'SERVICE OWNER' AS view, projected_p95_latency AS latency, projected_availability AS availability,
                      CASE WHEN decision = 'SAFE TO RIGHTSIZE' THEN 'LOW' ELSE 'HIGH' END AS operational_risk,
                      'SIMULATED STAKEHOLDER VALIDATION' AS label FROM decided""",
            "latency",
            "availability",
        ),
        "step_down",
    ),
    "baseline_delta": _simulated(
        _shown(
            """SELECT s.environment_id, s.current_instance_type, s.candidate_instance_type,
                      s.projected_p95_latency - b.p95_latency AS latency_delta,
                      s.projected_availability - b.measured_availability AS availability_delta
               FROM slo s JOIN baseline b ON b.environment_id = s.environment_id""",
            "latency_delta",
            "availability_delta",
        ),
        "cheaper",
        None,
        "baseline",
    ),
    "dist_box": _simulated(
        _shown(
            f"{_box('cpu_utilization_pct', 'Baseline CPU')} UNION ALL {_box('projected_cpu', 'Projected CPU')}", *BOX
        ),
        "step_down",
    ),
    "trend_series": _with(
        _shown(
            f"SELECT environment_id, position, {STAMP}, cpu_utilization_pct, request_volume FROM profiled",
            "cpu_utilization_pct",
            "request_volume",
        ),
        "profiled",
    ),
    "scenario_classify": _with(
        _shown(
            """SELECT environment_id, request_stddev, CASE WHEN request_stddev > 100 THEN 'bursty' WHEN request_stddev < 50
                      THEN 'normal' ELSE 'neither' END AS scenario_class
               FROM (SELECT environment_id, stddev_samp(request_volume) AS request_stddev FROM telemetry GROUP BY environment_id) s""",
            "request_stddev",
        ),
        "telemetry",
    ),
    "scenario_pick": _with(
        """SELECT n.scenario, coalesce(f.environment_id, (SELECT environment_id FROM environments ORDER BY seq LIMIT 1)) AS environment_id,
                  f.environment_id IS NOT NULL AS matched
           FROM (VALUES ('normal'), ('peak'), ('bursty')) AS n(scenario)
                LEFT JOIN (SELECT scenario, environment_id, row_number() OVER (PARTITION BY scenario ORDER BY seq) AS nth FROM fits) f
                  ON f.scenario = n.scenario AND f.nth = 1""",
        "telemetry",
        spread="SELECT environment_id, stddev_samp(request_volume) AS sd FROM telemetry GROUP BY environment_id",
        fits="""
            SELECT 'normal' AS scenario, environment_id, seq FROM environments JOIN spread USING (environment_id)
            WHERE sd < 50 AND current_instance_type = 'medium'
            UNION ALL SELECT 'peak', environment_id, seq FROM environments WHERE current_instance_type = 'large'
            UNION ALL SELECT 'bursty', environment_id, seq FROM environments JOIN spread USING (environment_id)
            WHERE sd > 100 AND current_instance_type = 'medium'""",
    ),
    # gate, monitoring, audit
    "gate_precheck": _with(
        """SELECT environment_id, expected_current, candidate_instance_type, state_check, decision,
                  CASE WHEN state_check <> 'passed' THEN '' ELSE codes END AS reason_codes, event,
                  event = 'MIGRATION_APPROVED' AS approved FROM gated""",
        "requests", "environments", "catalog", "profiled", "prices",
        **REQUEST_MODEL, gate=GATE, gated=GATED,
    ),
    "gate_audit_rows": _with(
        """SELECT environment_id, expected_current AS current_instance, candidate_instance_type AS candidate_instance,
                  CAST(0 AS BIGINT) AS seq, 'PRECHECK_STARTED' AS event, '' AS reason FROM gated
           UNION ALL
           SELECT environment_id, expected_current, candidate_instance_type, CAST(1 AS BIGINT), event,
                  CASE WHEN state_check = 'NOT_FOUND' THEN 'Environment ' || environment_id || ' not found.'
                       WHEN state_check = 'NOT_RUNNING' THEN 'Environment ' || environment_id || ' is in status ' || status || ', expected RUNNING.'
                       WHEN state_check = 'INSTANCE_MISMATCH' THEN 'Current instance mismatch: expected ' || expected_current || ', got ' || actual
                       WHEN event = 'MIGRATION_APPROVED' THEN 'Safety checks passed.' ELSE 'blocked by decision' END
           FROM gated""",
        "requests", "environments", "catalog", "profiled", "prices",
        **REQUEST_MODEL, gate=GATE, gated=GATED,
    ),
    "health_classify": _with("SELECT environment_id, reading_id, health_status FROM judged", "judged"),
    "health_window": _with(
        _shown(
            f"""SELECT environment_id, migration_seq, checkpoint_no, 'T+' || CAST(checkpoint_no AS VARCHAR) AS checkpoint,
                       strftime(ts, {INSTANT}) AS ts, cpu, memory, latency, availability, health_status FROM checkpoints""",
            "cpu",
            "memory",
            "latency",
            "availability",
        ),
        "checkpoints",
    ),
    "health_first_readings": _with(
        "SELECT environment_id, checkpoint_no, reading_id, health_status FROM first_five", "judged", first_five=FIRST_FIVE
    ),
    "health_verdict": _with(_verdict("environment_id, migration_seq", "checkpoints"), "checkpoints"),
    "health_rollback_list": _with(
        """SELECT v.environment_id, v.migration_seq, x.current_instance AS restore_instance, x.candidate_instance AS migrated_instance,
                  v.rollback_checkpoints, v.degraded_checkpoints
           FROM verdicts v JOIN executed x ON x.environment_id = v.environment_id AND x.migration_seq = v.migration_seq
           WHERE x.newest = 1 AND v.verdict = 'ROLLBACK_REQUIRED'""",
        "checkpoints",
        verdicts=_verdict("environment_id, migration_seq", "checkpoints"),
    ),
    "accuracy_metric": _with(
        _shown(
            """SELECT *, abs(predicted - observed) AS absolute_error,
                      CASE WHEN observed = 0 AND predicted = 0 THEN 0 WHEN observed = 0 THEN 100
                           ELSE abs(predicted - observed) / observed * 100 END AS percentage_error
               FROM (SELECT reading_id, cpu AS predicted, floor(latency) AS observed FROM readings) p""",
            "predicted",
            "observed",
            "absolute_error",
            "percentage_error",
        ),
        "readings",
    ),
    "accuracy_compare": _with(
        _shown(
            """SELECT *, abs(predicted - observed) AS absolute_error,
                      CASE WHEN observed = 0 AND predicted = 0 THEN 0 WHEN observed = 0 THEN 100
                           ELSE abs(predicted - observed) / observed * 100 END AS percentage_error
               FROM (SELECT environment_id, 'CPU' AS metric, peak_cpu AS predicted, cpu AS observed FROM met
                     UNION ALL SELECT environment_id, 'Memory', peak_mem, memory FROM met
                     UNION ALL SELECT environment_id, 'P95 Latency', projected_p95_latency, latency FROM met
                     UNION ALL SELECT environment_id, 'Availability', projected_availability, availability FROM met) p""",
            "predicted",
            "observed",
            "absolute_error",
            "percentage_error",
        ),
        "catalog",
        "profiled",
        "prices",
        "checkpoints",
        **{
            "judgements": _verdict("environment_id, migration_seq", "checkpoints", "WHERE newest = 1"),
            "seen": """SELECT c.*, x.current_instance AS current_instance_type, x.candidate_instance AS candidate_instance_type
                FROM (SELECT *, row_number() OVER (PARTITION BY environment_id ORDER BY checkpoint_no DESC) AS back
                      FROM checkpoints WHERE newest = 1) c
                     JOIN executed x ON x.environment_id = c.environment_id AND x.migration_seq = c.migration_seq
                     JOIN judgements j ON j.environment_id = c.environment_id AND j.migration_seq = c.migration_seq
                WHERE c.back = 1 AND j.verdict <> 'ROLLBACK_REQUIRED'""",
        },
        **_model(
            moves="""SELECT s.environment_id, c.instance_type AS current_instance_type, k.instance_type AS candidate_instance_type,
                            k.ordinal AS candidate_ordinal, c.vcpu / CAST(k.vcpu AS DOUBLE) AS cpu_ratio,
                            c.memory_gb / CAST(k.memory_gb AS DOUBLE) AS mem_ratio
                     FROM seen s JOIN catalog c ON c.instance_type = s.current_instance_type
                          JOIN catalog k ON k.instance_type = s.candidate_instance_type"""
        ),
        **{
            "met": """SELECT s.*, o.cpu, o.memory, o.latency, o.availability
                FROM slo s JOIN seen o ON o.environment_id = s.environment_id AND o.current_instance_type = s.current_instance_type
                                      AND o.candidate_instance_type = s.candidate_instance_type"""
        },
    ),
    "audit_latest": _with(
        f"""SELECT environment_id, {STAMP}, seq, event, reason FROM (
                SELECT *, row_number() OVER (PARTITION BY environment_id ORDER BY timestamp DESC, seq DESC) AS back FROM audit) a
            WHERE back = 1""",
        "audit",
    ),
    "audit_state": _with(
        """SELECT e.environment_id, coalesce(i.instance, e.current_instance_type) AS instance_type, coalesce(s.status, 'none') AS lifecycle_status
           FROM environments e
                LEFT JOIN (SELECT environment_id, CASE event WHEN 'MIGRATION_EXECUTED' THEN candidate_instance ELSE current_instance END AS instance,
                                  row_number() OVER (PARTITION BY environment_id ORDER BY timestamp DESC, seq DESC) AS back
                           FROM audit WHERE event IN ('MIGRATION_EXECUTED', 'ORIGINAL_CONFIGURATION_RESTORED')) i
                  ON i.environment_id = e.environment_id AND i.back = 1
                LEFT JOIN (SELECT environment_id, CASE event WHEN 'MIGRATION_EXECUTED' THEN 'MIGRATED' WHEN 'POSTCHECK_PASSED' THEN 'COMPLETED'
                                                       ELSE 'ROLLED_BACK' END AS status,
                                  row_number() OVER (PARTITION BY environment_id ORDER BY timestamp DESC, seq DESC) AS back
                           FROM audit WHERE event IN ('MIGRATION_EXECUTED', 'POSTCHECK_PASSED', 'ORIGINAL_CONFIGURATION_RESTORED')) s
                  ON s.environment_id = e.environment_id AND s.back = 1""",
        "environments",
        "audit",
    ),
    "audit_order_check": "WITH RECURSIVE "
    + _with(
        """SELECT environment_id, max(n) AS events, arg_max(stage, n) AS stage,
                  count(*) FILTER (n > 0 AND flagged) AS out_of_order,
                  coalesce(min(n) FILTER (flagged), 0) AS first_entry, coalesce(arg_min(event, n) FILTER (flagged), 'none') AS first_event
           FROM walk GROUP BY environment_id""",
        "audit",
        ordered="SELECT environment_id, event, row_number() OVER (PARTITION BY environment_id ORDER BY timestamp, seq) AS n FROM audit",
        allowed="""SELECT * FROM (VALUES
                ('IDLE', 'PRECHECK_STARTED', 'CHECKING'),
                ('CHECKING', 'PRECHECK_FAILED', 'IDLE'), ('CHECKING', 'MIGRATION_BLOCKED', 'IDLE'), ('CHECKING', 'MIGRATION_APPROVED', 'APPROVED'),
                ('APPROVED', 'PRECHECK_STARTED', 'CHECKING'), ('APPROVED', 'MIGRATION_STARTED', 'MIGRATING'),
                ('MIGRATING', 'MIGRATION_EXECUTED', 'MIGRATED'), ('MIGRATING', 'MIGRATION_FAILED', 'IDLE'),
                ('MIGRATED', 'MONITORING_STARTED', 'MONITORING'),
                ('MONITORING', 'POSTCHECK_PASSED', 'COMPLETED'), ('MONITORING', 'FAILURE_DETECTED', 'FAILING'),
                ('COMPLETED', 'PREDICTION_ACCURACY', 'IDLE'), ('COMPLETED', 'PRECHECK_STARTED', 'CHECKING'),
                ('FAILING', 'MIGRATION_STOPPED', 'STOPPED'),
                ('STOPPED', 'ROLLBACK_STARTED', 'ROLLING_BACK'),
                ('ROLLING_BACK', 'ORIGINAL_CONFIGURATION_RESTORED', 'RESTORED'), ('ROLLING_BACK', 'ROLLBACK_FAILED', 'IDLE'),
                ('RESTORED', 'RESTORATION_VERIFIED', 'IDLE')
            ) AS t(stage, event, next)""",
        walk="""SELECT DISTINCT environment_id, CAST(0 AS BIGINT) AS n, 'IDLE' AS stage, '' AS event, false AS flagged FROM ordered
                UNION ALL
                SELECT o.environment_id, o.n, coalesce(a.next, w.stage), o.event, a.next IS NULL
                FROM walk w JOIN ordered o ON o.environment_id = w.environment_id AND o.n = w.n + 1
                LEFT JOIN allowed a ON a.stage = w.stage AND a.event = o.event""",
    ).removeprefix("WITH "),
    "audit_funnel": _funnel(),
    "error_catalog": _simulated(
        EXPLAINED,
        "cheaper_and_self",
        None,
        texts=ERROR_TEXTS,
        failures="""
            SELECT error_code, count(*) AS occurrences FROM (
                SELECT unnest(string_split(reason_codes, '|')) AS error_code FROM decided WHERE reason_codes <> ''
                UNION ALL SELECT 'NOT_RUNNING' FROM environments WHERE status <> 'RUNNING') seen
            GROUP BY error_code""",
    ),
    "error_events": _simulated(
        EXPLAINED,
        "step_down",
        None,
        "tagged",
        texts=ERROR_TEXTS,
        failures="""
            SELECT environment_id, 'DUPLICATE_TELEMETRY' AS error_code, CAST(sum(copies - 1) AS BIGINT) AS occurrences, 'telemetry' AS origin
            FROM tagged GROUP BY environment_id HAVING sum(copies - 1) > 0
            UNION ALL
            SELECT environment_id, CASE failed_rule WHEN 'missing' THEN 'MISSING_TELEMETRY' WHEN 'requests' THEN 'NEGATIVE_REQUEST_VOLUME'
                        WHEN 'latency' THEN 'NEGATIVE_LATENCY' WHEN 'unknown_environment' THEN 'UNKNOWN_ENVIRONMENT'
                        ELSE 'INVALID_TELEMETRY' END AS code, count(*), 'telemetry'
            FROM tagged WHERE failed_rule IS NOT NULL GROUP BY environment_id, code
            UNION ALL
            SELECT environment_id, code, count(*), 'decision'
            FROM (SELECT environment_id, unnest(string_split(reason_codes, '|')) AS code FROM decided WHERE reason_codes <> '') d
            GROUP BY environment_id, code""",
    ),
    # streaming
    "stream_baseline": _stream_windows(None),
    "stream_baseline_sliding": _stream_windows(1),
    "stream_health": _with(_verdict("environment_id, migration_seq", "checkpoints"), "checkpoints"),
    "stream_health_first": _with(_verdict("environment_id", "checkpoints", "WHERE newest = 1"), "checkpoints"),
}
ORACLES["base_incremental"] = ORACLES["base_all"]
ORACLES["src_bucketed_merge"] = ORACLES["src_telemetry_merge"]
ORACLES["stream_validate"] = ORACLES["val_clean"]
# A request is decided once a day on which it is made.
ORACLES["stream_audit"] = f"""SELECT g.*, d.requested_on FROM ({ORACLES["gate_audit_rows"]}) g JOIN (
    SELECT DISTINCT {_eid("user_id")} AS environment_id, strftime(ts, '%Y-%m-%d') AS requested_on FROM events
) d USING (environment_id)"""
