"""DuckDB oracle SQL for the registered queries.

An independent formulation: the classification here is the literal joined
form (self join on the timestamp, a chain of joins to the next timestamp,
UNION ALL, COUNT(DISTINCT)), while the Spark side runs the one-pass form.
Tables are the driver's views (events, orders, lineitem, ...).

DuckDB differences handled here: its url_encode writes %20 for a space, keeps
'~' and writes %2A for '*', so the Spark/Java form encoding is rebuilt with
three replaces.
"""

from __future__ import annotations

from ..fixtures import CUR_DT, PREV_DT, SNAPSHOTS


def enc(col: str) -> str:
    return f"replace(replace(replace(url_encode({col}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def inv_ctes(snapshots) -> str:
    """The inventory fixture of the given (dt, cut) snapshots."""
    values = ", ".join(f"('{dt}', TIMESTAMP '{cut}')" for dt, cut in snapshots)
    return f"""
snaps(dt, cut) AS (VALUES {values}),
ev AS (SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, s.dt, s.cut
       FROM events e JOIN snaps s ON e.ts < s.cut),
inv AS (
  SELECT 'bucket-' || CAST(user_id % 3 AS VARCHAR) AS bucket,
         'team' || CAST(user_id % 4 AS VARCHAR) || '/user ' || CAST(user_id AS VARCHAR) || '/profile~v*.json' AS key,
         CAST(event_id AS VARCHAR) AS version_id,
         row_number() OVER (PARTITION BY dt, user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_latest,
         event_type = 'error' AS is_delete_marker,
         CAST(floor(value * 100) AS BIGINT) AS size,
         date_trunc('hour', ts) AS last_modified_date,
         CASE WHEN event_type = 'error' THEN NULL
              WHEN event_type = 'view' THEN date_trunc('hour', ts) + INTERVAL 1 YEAR
              ELSE cut + INTERVAL 1 YEAR END AS object_lock_retain_until_date,
         CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 2 = 0 THEN 'GOVERNANCE' ELSE 'COMPLIANCE' END AS object_lock_mode,
         CASE WHEN event_type = 'error' THEN NULL ELSE 'OFF' END AS object_lock_legal_hold_status,
         CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'OFF' ELSE 'ON' END AS object_lock_event_hold_status,
         dt
  FROM ev)"""


INV = inv_ctes(SNAPSHOTS)

# Brute-force classification (an independent formulation, not the one-pass
# plan): the next timestamp of a key is the minimum over all its later
# timestamps; "the next group has a noncurrent row" is an EXISTS test.
CLS = """
stamps AS (SELECT DISTINCT bucket, dt, key, last_modified_date AS t FROM inv WHERE last_modified_date IS NOT NULL),
succ AS (
  SELECT a.bucket, a.dt, a.key, a.t, min(b.t) AS t_next
  FROM stamps a LEFT JOIN stamps b
    ON b.bucket = a.bucket AND b.dt = a.dt AND b.key = a.key AND b.t > a.t
  GROUP BY a.bucket, a.dt, a.key, a.t),
nc_stamps AS (SELECT DISTINCT bucket, dt, key, last_modified_date AS t FROM inv WHERE is_latest = false),
cand AS (
  SELECT * FROM inv
  WHERE is_latest = false AND is_delete_marker = false AND object_lock_event_hold_status = 'ON'),
peer_rows AS (
  SELECT c.bucket, c.dt, c.key, c.version_id, p.is_delete_marker AS sdm,
         coalesce(p.is_latest = false, false) AS peer_nc
  FROM cand c JOIN inv p
    ON p.bucket = c.bucket AND p.dt = c.dt AND p.key = c.key AND p.last_modified_date = c.last_modified_date
   AND p.version_id <> c.version_id),
next_rows AS (
  SELECT c.bucket, c.dt, c.key, c.version_id, s.is_delete_marker AS sdm, false AS peer_nc
  FROM cand c
  JOIN succ x ON x.bucket = c.bucket AND x.dt = c.dt AND x.key = c.key AND x.t = c.last_modified_date
  JOIN inv s ON s.bucket = c.bucket AND s.dt = c.dt AND s.key = c.key AND s.last_modified_date = x.t_next
  WHERE s.is_latest = false
     OR NOT EXISTS (SELECT 1 FROM nc_stamps n
                    WHERE n.bucket = s.bucket AND n.dt = s.dt AND n.key = s.key AND n.t = s.last_modified_date)),
poss AS (SELECT * FROM peer_rows UNION ALL SELECT * FROM next_rows),
verdict AS (
  SELECT bucket, dt, key, version_id,
         count(DISTINCT sdm) AS kinds,
         CASE WHEN bool_or(NOT sdm) THEN false WHEN bool_or(sdm) THEN true END AS sdm_all,
         max(CASE WHEN peer_nc THEN 1 ELSE 0 END) AS nc_peer
  FROM poss GROUP BY bucket, dt, key, version_id),
classified AS (
  SELECT c.bucket, c.dt, c.key, c.version_id, c.object_lock_mode, c.last_modified_date,
         c.object_lock_retain_until_date,
         coalesce(v.kinds, 0) AS superseder_kinds,
         v.sdm_all AS superseder_is_delete_marker, v.nc_peer AS has_tied_noncurrent_peer,
         CASE WHEN coalesce(v.kinds, 0) = 0 THEN 'unclassified'
              WHEN v.kinds > 1 THEN 'withheld'
              WHEN v.sdm_all THEN 'delete' ELSE 'overwrite' END AS superseder_class,
         x.t_next AS next_lmd
  FROM cand c
  LEFT JOIN verdict v ON v.bucket = c.bucket AND v.dt = c.dt AND v.key = c.key AND v.version_id = c.version_id
  LEFT JOIN succ x ON x.bucket = c.bucket AND x.dt = c.dt AND x.key = c.key AND x.t = c.last_modified_date)"""


def _elig(release_mode: str, src: str = "classified") -> str:
    if release_mode == "either":
        return ("SELECT bucket, dt, key, object_lock_mode, version_id, last_modified_date FROM cand "
                "WHERE object_lock_mode IN ('COMPLIANCE', 'GOVERNANCE')")
    flag = "true" if release_mode == "delete" else "false"
    return ("SELECT bucket, dt, key, object_lock_mode, version_id, last_modified_date FROM classified "
            f"WHERE superseder_kinds = 1 AND superseder_is_delete_marker = {flag} "
            "AND object_lock_mode IN ('COMPLIANCE', 'GOVERNANCE')")


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def eligible_dedup_ctes(release_mode: str) -> str:
    """elig (all snapshots), pm (manifest of prev), cur_elig, deduped."""
    return f"""
elig AS ({_elig(release_mode)}),
pm AS (SELECT bucket, {enc('key')} AS key, version_id, object_lock_mode AS mode FROM elig WHERE dt = '{PREV_DT}'),
cur_elig AS (SELECT * FROM elig WHERE dt = '{CUR_DT}'),
deduped AS (
  SELECT e.* FROM cur_elig e LEFT JOIN pm
    ON pm.bucket = e.bucket AND pm.mode = e.object_lock_mode AND pm.key = {enc('e.key')} AND pm.version_id = e.version_id
  WHERE pm.version_id IS NULL),
suppressed AS (
  SELECT e.* FROM cur_elig e
  WHERE EXISTS (SELECT 1 FROM pm WHERE pm.bucket = e.bucket AND pm.mode = e.object_lock_mode
                AND pm.key = {enc('e.key')} AND pm.version_id = e.version_id))"""


def quoted(text: str) -> str:
    """A Python text inside an SQL string literal."""
    return text.replace("'", "''")


def decision_ctes(passes=((1, 100, 0),), submit_error: str = "NULL") -> str:
    """Runs per (bucket, dt), fixture config, counts, ladder inputs and
    decisions (DuckDB twin of plans.runs.decision_inputs + decide). Each pass
    (pass, bucket-1 threshold, day offset) decides every run once."""
    pv = ", ".join(f"({p}, {t}, {o})" for p, t, o in passes)
    return f"""
elig AS ({_elig('delete')}),
runs AS (SELECT DISTINCT bucket, dt, substr(sha256(bucket || '/' || dt), 1, 16) AS run_id FROM inv),
modes(mode) AS (VALUES ('COMPLIANCE'), ('GOVERNANCE')),
passes(pass, b1_threshold, day_offset) AS (VALUES {pv}),
cnt AS (SELECT bucket, dt, object_lock_mode AS mode, count(*) AS n FROM elig GROUP BY bucket, dt, object_lock_mode),
file AS (
  SELECT bucket, dt, object_lock_mode AS mode, count(*) AS n FROM elig
  WHERE NOT (bucket = 'bucket-0' AND object_lock_mode = 'GOVERNANCE')
    AND NOT (bucket = 'bucket-0' AND dt = '{PREV_DT}' AND object_lock_mode = 'COMPLIANCE' AND substr(md5(version_id), 1, 1) < '4')
  GROUP BY bucket, dt, object_lock_mode),
evid AS (
  SELECT bucket, dt, mode, n, NOT (bucket = 'bucket-0' AND dt = '{CUR_DT}' AND mode = 'GOVERNANCE') AS there,
         bucket = 'bucket-2' AND dt = '{PREV_DT}' AND mode = 'COMPLIANCE' AS foreign_key,
         bucket = 'bucket-2' AND dt = '{PREV_DT}' AND mode = 'GOVERNANCE' AS failed
  FROM cnt WHERE NOT (bucket = 'bucket-0' AND dt = '{PREV_DT}' AND mode = 'GOVERNANCE')),
inp AS (
  SELECT p.pass, p.day_offset, r.run_id, r.bucket, r.dt, m.mode, coalesce(c.n, 0) AS trigger_count,
         'q-' || r.run_id || '-' || m.mode AS count_query_id,
         sha256(r.run_id || '/' || m.mode || '/count') AS count_hash,
         coalesce(f.n, 0) AS file_count,
         CASE WHEN NOT coalesce(e.there, false) THEN coalesce(c.n, 0) WHEN NOT e.failed THEN coalesce(f.n, 0) END AS verified_count,
         e.bucket IS NOT NULL AS manifest_listed,
         CASE WHEN e.foreign_key THEN 'manifests/combined/elsewhere/' || m.mode || '/manifest.csv'
              WHEN e.bucket IS NOT NULL THEN 'manifests/combined/' || r.run_id || '/' || m.mode || '/manifest.csv' END AS manifest_key,
         coalesce(e.there, false) AS manifest_exists, CAST({submit_error} AS VARCHAR) AS submit_error,
         r.bucket = 'bucket-2' AS report_only,
         CAST(CASE WHEN r.bucket = 'bucket-1' THEN p.b1_threshold ELSE 1000 END AS BIGINT) AS safety_threshold
  FROM runs r CROSS JOIN modes m CROSS JOIN passes p
  LEFT JOIN cnt c ON c.bucket = r.bucket AND c.dt = r.dt AND c.mode = m.mode
  LEFT JOIN file f ON f.bucket = r.bucket AND f.dt = r.dt AND f.mode = m.mode
  LEFT JOIN evid e ON e.bucket = r.bucket AND e.dt = r.dt AND e.mode = m.mode),
lad AS (
  SELECT *,
    CASE WHEN count_query_id IS NULL OR count_query_id = '' OR count_hash IS NULL OR count_hash = ''
              OR trigger_count IS NULL OR trigger_count < 0 THEN 'withheld'
         WHEN verified_count IS NULL THEN 'withheld'
         WHEN trigger_count <> verified_count THEN 'withheld'
         WHEN verified_count = 0 THEN 'skipped'
         WHEN NOT report_only AND verified_count > safety_threshold THEN 'withheld'
         WHEN NOT coalesce(manifest_listed, false) THEN 'withheld'
         WHEN manifest_key IS NULL OR NOT starts_with(manifest_key, 'manifests/combined/' || run_id || '/' || mode || '/')
              OR contains(manifest_key, '..') THEN 'withheld'
         WHEN NOT coalesce(manifest_exists, false) THEN 'withheld'
         WHEN submit_error IS NOT NULL THEN 'withheld'
         WHEN report_only THEN 'suspended' ELSE 'created' END AS outcome,
    CASE WHEN count_query_id IS NULL OR count_query_id = '' OR count_hash IS NULL OR count_hash = ''
              OR trigger_count IS NULL OR trigger_count < 0 THEN 'missing_or_invalid_count_metadata'
         WHEN verified_count IS NULL THEN 'count_query_verification_failed'
         WHEN trigger_count <> verified_count THEN 'count_mismatch'
         WHEN verified_count = 0 THEN NULL
         WHEN NOT report_only AND verified_count > safety_threshold THEN 'safety_threshold_exceeded'
         WHEN NOT coalesce(manifest_listed, false) THEN 'positive_count_without_manifest'
         WHEN manifest_key IS NULL OR NOT starts_with(manifest_key, 'manifests/combined/' || run_id || '/' || mode || '/')
              OR contains(manifest_key, '..') THEN 'invalid_manifest_key'
         WHEN NOT coalesce(manifest_exists, false) THEN 'manifest_not_found'
         WHEN submit_error = 'event_hold_unsupported' THEN 'event_hold_unsupported_by_runtime'
         WHEN submit_error IS NOT NULL THEN 'create_job_failed'
         ELSE NULL END AS reason,
    sha256(bucket || '/' || run_id || '/' || dt || '/' || mode) AS decision_token
  FROM inp),
decisions AS (
  SELECT pass, day_offset, run_id, bucket, dt, mode, outcome, reason,
         CASE WHEN reason IS NULL OR reason NOT IN ('missing_or_invalid_count_metadata',
              'count_query_verification_failed', 'count_mismatch') THEN verified_count END AS verified_count,
         verified_count AS query_count, trigger_count, safety_threshold, report_only, manifest_key, decision_token,
         CASE WHEN outcome IN ('created', 'suspended') THEN 'job-' || substr(decision_token, 1, 12) END AS job_id
  FROM lad)"""


def _pl(n: str, word: str) -> str:
    return f"(CAST({n} AS VARCHAR) || ' {word}' || CASE WHEN {n} <> 1 THEN 's' ELSE '' END)"


def run_summary_sql() -> str:
    n = "coalesce(verified_count, 0)"
    line = f"""CASE
      WHEN outcome = 'created' THEN mode || ': released ' || {_pl(n, 'event hold')} || ' (job ' || job_id || ').'
      WHEN outcome = 'suspended' THEN mode || ': found ' || {_pl(n, 'eligible version')} || ', job ' || job_id
           || ' created suspended for review (report-only) -- nothing released.'
      WHEN outcome = 'skipped' THEN mode || ': no eligible versions this run.'
      WHEN reason = 'safety_threshold_exceeded' THEN mode || ': WITHHELD -- ' || CAST(verified_count AS VARCHAR)
           || ' eligible versions exceeds SafetyThreshold (' || CAST(safety_threshold AS VARCHAR)
           || '); no job created, review and re-run to proceed.'
      WHEN reason = 'count_mismatch' THEN mode || ': WITHHELD -- eligibility count mismatch (query '
           || coalesce(CAST(query_count AS VARCHAR), 'None') || ' vs manifest '
           || coalesce(CAST(trigger_count AS VARCHAR), 'None') || '); no job created.'
      ELSE mode || ': WITHHELD -- ' || coalesce(reason, 'unknown') || '.' END"""
    ordk = "CASE outcome WHEN 'created' THEN 0 WHEN 'suspended' THEN 1 WHEN 'skipped' THEN 2 ELSE 3 END"
    return with_ctes(INV, CLS, decision_ctes(), f"""
g AS (
  SELECT run_id, bucket, dt, bool_or(report_only) AS report_only,
         count(*) FILTER (WHERE outcome = 'created') AS jobs_created,
         count(*) FILTER (WHERE outcome = 'suspended') AS jobs_pending,
         count(*) FILTER (WHERE outcome = 'withheld') AS jobs_withheld,
         CAST(sum(CASE WHEN outcome IN ('suspended', 'withheld') THEN coalesce(verified_count, 0) ELSE 0 END) AS BIGINT) AS versions,
         coalesce(string_agg(CASE WHEN outcome = 'skipped' THEN mode END, ',' ORDER BY mode), '') AS modes_skipped,
         coalesce(string_agg(CASE WHEN outcome = 'withheld' THEN mode || '=' || reason END, ','
                             ORDER BY mode || '=' || reason), '') AS modes_withheld,
         string_agg({line}, ' ' ORDER BY {ordk}, mode) AS lines
  FROM decisions GROUP BY run_id, bucket, dt)""", body=f"""
SELECT run_id, bucket, dt, report_only, jobs_created, jobs_pending, jobs_withheld, versions, modes_skipped, modes_withheld,
  CASE WHEN jobs_pending > 0 OR jobs_withheld > 0 THEN
         concat_ws(', ',
           CASE WHEN jobs_pending > 0 THEN {_pl('jobs_pending', 'job')} || ' pending'
                ELSE {_pl('jobs_withheld', 'job')} || ' withheld' END,
           CASE WHEN jobs_pending > 0 AND jobs_withheld > 0 THEN CAST(jobs_withheld AS VARCHAR) || ' withheld' END,
           CASE WHEN versions > 0 THEN format('{{:,}}', versions) || ' version' || CASE WHEN versions <> 1 THEN 's' ELSE '' END END)
       WHEN length(modes_skipped) > 0 THEN 'nothing eligible' ELSE 'no modes evaluated' END
    || CASE WHEN report_only THEN ' [Report-Only]' ELSE '' END AS headline,
  'Run ' || run_id || ' against ' || bucket || ' (inventory ' || dt || '), '
    || CASE WHEN report_only THEN 'report-only' ELSE 'active' END || ' mode.'
    || CASE WHEN lines IS NULL THEN ' No modes were evaluated for this run.' ELSE ' ' || lines END AS summary
FROM g""")


EVENTS = """
jr AS (
  SELECT lpad(lower(hex(o_orderkey // 2)), 8, '0') AS run_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'GOVERNANCE' ELSE 'COMPLIANCE' END AS mode,
         'job-' || CAST(o_orderkey AS VARCHAR) AS job_id,
         CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'O' THEN 'Failed' ELSE 'Active' END AS status,
         o_orderkey, o_orderdate AS event_time,
         'bucket-' || CAST((o_orderkey // 2) % 3 AS VARCHAR) AS bucket
  FROM orders),
rep AS (
  SELECT lpad(lower(hex(l_orderkey // 2)), 8, '0') AS run_id,
         CASE WHEN l_orderkey % 2 = 0 THEN 'GOVERNANCE' ELSE 'COMPLIANCE' END AS mode,
         'job-' || CAST(l_orderkey AS VARCHAR) AS job_id,
         'bucket-' || CAST((l_orderkey // 2) % 3 AS VARCHAR) AS bucket,
         'order+' || CAST(l_orderkey AS VARCHAR) || '%2Fline%7E' || CAST(l_linenumber AS VARCHAR) AS key,
         CAST(l_linenumber AS VARCHAR) AS version_id,
         CASE WHEN l_returnflag = 'R' THEN 'PermanentFailure' ELSE 'Succeeded' END AS task_status
  FROM lineitem),
rt AS (
  SELECT job_id, count(*) FILTER (WHERE task_status = 'Succeeded') AS succeeded,
         count(*) FILTER (WHERE task_status IN ('PermanentFailure', 'TemporaryFailure')) AS failed,
         count(*) AS total
  FROM rep GROUP BY job_id),
jobs AS (
  SELECT jr.job_id, jr.status, coalesce(rt.succeeded, 0) AS succeeded, coalesce(rt.failed, 0) AS failed,
         coalesce(rt.total, 0) AS total, CASE WHEN jr.status <> 'Complete' THEN jr.status END AS failure_reason,
         CASE WHEN jr.o_orderkey % 11 = 0 THEN 'someone-else' ELSE 'unhold' END AS tag_created_by,
         CASE WHEN jr.o_orderkey % 13 = 0 THEN 'not-a-hex-id' ELSE jr.run_id END AS tag_run_id,
         jr.bucket
  FROM jr LEFT JOIN rt ON rt.job_id = jr.job_id),
recs AS (
  SELECT lpad(lower(hex(o_orderkey // 2)), 8, '0') AS run_id,
         'bucket-' || CAST((o_orderkey // 2) % 3 AS VARCHAR) AS bucket,
         count(*) AS jobs_expected, min(o_orderdate) AS snapshot_ts
  FROM orders GROUP BY o_orderkey // 2 HAVING (o_orderkey // 2) % 50 <> 0),
recjobs AS (SELECT run_id, job_id, mode FROM jr WHERE run_id IN (SELECT run_id FROM recs)),
evs AS (
  SELECT job_id, CASE WHEN o_orderkey % 17 = 0 THEN 'Complete' ELSE status END AS event_status, event_time, bucket FROM jr
  UNION ALL
  SELECT job_id, CASE WHEN o_orderkey % 17 = 0 THEN 'Complete' ELSE status END, event_time + INTERVAL 1 MINUTE, bucket
  FROM jr WHERE o_orderkey % 7 = 0),
routed AS (
  SELECT e.job_id, e.event_status, e.event_time, e.bucket, j.status AS job_status, j.succeeded, j.failed, j.total,
         j.failure_reason, j.tag_created_by, j.tag_run_id AS run_id,
         CASE WHEN e.job_id IS NULL OR e.event_status NOT IN ('Complete', 'Cancelled', 'Failed') THEN 'non_terminal_event'
              WHEN j.status IS NULL THEN 'job_not_found'
              WHEN j.status NOT IN ('Complete', 'Cancelled', 'Failed') THEN 'job_not_terminal'
              WHEN j.tag_created_by IS DISTINCT FROM 'unhold' THEN 'not_this_solution'
              WHEN j.tag_run_id IS NULL OR j.tag_run_id = '' THEN 'missing_run_id_tag'
              WHEN NOT regexp_full_match(j.tag_run_id, '[0-9A-Fa-f]{1,64}') THEN 'invalid_run_id_tag'
              WHEN r.run_id IS NULL THEN 'no_active_jobs_record'
              WHEN rj.job_id IS NULL THEN 'job_not_in_record'
              ELSE 'accepted' END AS route
  FROM evs e LEFT JOIN jobs j ON j.job_id = e.job_id
  LEFT JOIN recs r ON r.run_id = j.tag_run_id
  LEFT JOIN recjobs rj ON rj.run_id = j.tag_run_id AND rj.job_id = e.job_id),
firsts AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY run_id, job_id ORDER BY event_time) = 1
                 THEN 'accepted' ELSE 'duplicate_event' END AS first_route
  FROM routed WHERE route = 'accepted')"""


def _fmt(n: str) -> str:
    return f"format('{{:,}}', {n})"


def run_outcome_sql() -> str:
    outcome = f"""CASE WHEN length(concat_ws(', ',
        CASE WHEN released + failed > 0 THEN
          CASE WHEN failed > 0 THEN {_fmt('released')} || ' of ' || {_fmt('released + failed')} || ' version'
                    || CASE WHEN released + failed <> 1 THEN 's' ELSE '' END || ' released, ' || {_fmt('failed')} || ' failed'
               ELSE {_fmt('released')} || ' version' || CASE WHEN released <> 1 THEN 's' ELSE '' END || ' released' END END,
        CASE WHEN jobs_not_complete > 0 THEN {_pl('jobs_not_complete', 'job')} || ' did not complete' END)) > 0
      THEN concat_ws(', ',
        CASE WHEN released + failed > 0 THEN
          CASE WHEN failed > 0 THEN {_fmt('released')} || ' of ' || {_fmt('released + failed')} || ' version'
                    || CASE WHEN released + failed <> 1 THEN 's' ELSE '' END || ' released, ' || {_fmt('failed')} || ' failed'
               ELSE {_fmt('released')} || ' version' || CASE WHEN released <> 1 THEN 's' ELSE '' END || ' released' END END,
        CASE WHEN jobs_not_complete > 0 THEN {_pl('jobs_not_complete', 'job')} || ' did not complete' END)
      ELSE 'finished, nothing released' END"""
    return with_ctes(EVENTS, """
g AS (
  SELECT run_id, count(*) AS jobs_terminal,
         CAST(sum(CASE WHEN job_status = 'Complete' THEN succeeded ELSE 0 END) AS BIGINT) AS released,
         CAST(sum(CASE WHEN job_status = 'Complete' THEN failed ELSE 0 END) AS BIGINT) AS failed,
         count(*) FILTER (WHERE job_status IN ('Cancelled', 'Failed')) AS jobs_not_complete
  FROM firsts WHERE first_route = 'accepted' GROUP BY run_id),
o AS (SELECT r.run_id, r.bucket, r.jobs_expected, g.jobs_terminal, g.released, g.failed,
             g.released + g.failed AS total, g.jobs_not_complete, g.jobs_terminal >= r.jobs_expected AS complete
      FROM recs r JOIN g ON g.run_id = r.run_id)""",
                     body=f"SELECT *, CASE WHEN complete THEN {outcome} END AS outcome FROM o")


# Parameters shared by the projection queries (the originals collect none).
RELEASE_TIME = "2024-02-02 00:00:00"
HOLD_DAYS = 400
NONCURRENT_DAYS = 30
EVIDENCE_MAX_DAYS = 60
WRITE_ONCE_PREFIXES = ["team0/", "team2/"]

# W2 interval bounds over the joined-form classification (tied flags from the
# group counts).
BECAME = f"""
ties AS (
  SELECT bucket, dt, key, last_modified_date, count(*) AS g_all,
         count(*) FILTER (WHERE is_latest = false) AS g_nc
  FROM inv WHERE last_modified_date IS NOT NULL GROUP BY bucket, dt, key, last_modified_date),
became AS (
  SELECT c.*, t.g_all - 1 > 0 AS has_tied_peer, t.g_nc - 1 > 0 AS has_tied_noncurrent,
         CASE WHEN c.superseder_class = 'unclassified' THEN NULL
              WHEN t.g_all - 1 > 0 THEN c.last_modified_date ELSE c.next_lmd END AS noncurrent_since_min,
         CASE WHEN c.superseder_class = 'unclassified' THEN NULL
              WHEN c.next_lmd IS NOT NULL AND (NOT (t.g_all - 1 > 0) OR t.g_nc - 1 > 0) THEN c.next_lmd
              ELSE c.last_modified_date END AS noncurrent_since_max
  FROM classified c LEFT JOIN ties t ON t.bucket = c.bucket AND t.dt = c.dt AND t.key = c.key
   AND t.last_modified_date = c.last_modified_date)"""


def cls_on(src: str, name: str) -> str:
    """The classification CTEs over another inventory CTE ``src``, with every
    CTE name suffixed by ``name``."""
    import re
    body = CLS
    for t in ("stamps", "succ", "nc_stamps", "cand", "peer_rows", "next_rows", "poss", "verdict", "classified"):
        body = re.sub(rf"\b{t}\b", f"{t}_{name}", body)
    return re.sub(r"\binv\b", src, body)


# The inventory with gaps: a quarter of the keys has no current version listed
# and some flags are unknown (see catalog.gaps).
GAPS = """
gaps AS (
  SELECT bucket, dt, key, version_id,
         CASE WHEN substr(md5(version_id), 1, 1) = '1' THEN NULL ELSE is_latest END AS is_latest,
         CASE WHEN substr(md5(version_id), 1, 1) = '0' THEN NULL ELSE is_delete_marker END AS is_delete_marker,
         last_modified_date, object_lock_retain_until_date, object_lock_mode, object_lock_event_hold_status
  FROM inv WHERE NOT (is_latest AND substr(md5(key), 1, 1) < '4')),
gaps_nodm AS (SELECT * FROM gaps WHERE is_delete_marker IS DISTINCT FROM true OR is_latest IS DISTINCT FROM false)"""


def violations_sql(parts: str, cand: str = "cand") -> str:
    """U3 both ways: candidates missing from the parts, and rows of the parts
    that are no candidate or come twice."""
    k = "bucket, dt, key, version_id"
    c = f"SELECT {k} FROM {cand} WHERE object_lock_mode IN ('COMPLIANCE', 'GOVERNANCE')"
    p = (f"SELECT {k} FROM {parts} WHERE object_lock_mode IN ('COMPLIANCE', 'GOVERNANCE') "
         "AND superseder_class IN ('delete', 'overwrite', 'withheld', 'unclassified')")
    return (f"SELECT {k}, 'missing' AS violation FROM ({c} EXCEPT ALL {p})\nUNION ALL\n"
            f"SELECT {k}, 'extra_or_overlap' AS violation FROM ({p} EXCEPT ALL {c})")


# Parquet message-schema fields of a full delivery, in delivery order.
DELIVERY_FIELDS = [
    "required binary bucket (STRING);",
    "required binary key (STRING);",
    "optional binary version_id (STRING);",
    "optional boolean is_latest;",
    "optional boolean is_delete_marker;",
    "optional int64 size;",
    "optional int64 last_modified_date (TIMESTAMP(MILLIS,true));",
    "optional int64 object_lock_retain_until_date (TIMESTAMP(MILLIS,true));",
    "optional binary object_lock_mode (STRING);",
    "optional binary object_lock_legal_hold_status (STRING);",
    "optional binary object_lock_event_hold_status (STRING);",
]
EXTRA_FIELD = "optional binary checksum_algorithm (STRING);"


def schema_drift_sql() -> str:
    fields = "[" + ", ".join(f"'{f}'" for f in DELIVERY_FIELDS) + "]"
    req = "['key', 'version_id', 'is_latest', 'is_delete_marker', 'last_modified_date', 'object_lock_mode', 'object_lock_event_hold_status']"
    opt = "['bucket', 'size', 'object_lock_retain_until_date', 'object_lock_legal_hold_status']"
    return with_ctes(INV, f"""
dl AS (
  SELECT bucket, dt,
         CASE WHEN bucket = 'bucket-0' AND dt = '{CUR_DT}' THEN 'CSV' ELSE 'Parquet' END AS fileFormat,
         'message s3.inventory {{ ' || array_to_string(
           CASE WHEN bucket = 'bucket-2' AND dt = '{PREV_DT}'
                  THEN list_filter({fields}, lambda f: NOT contains(f, ' object_lock_event_hold_status'))
                WHEN bucket = 'bucket-1'
                  THEN list_concat(list_filter({fields}, lambda f: NOT contains(f, ' size;')), ['{EXTRA_FIELD}'])
                ELSE {fields} END, ' ') || ' }}' AS fileSchema
  FROM (SELECT DISTINCT bucket, dt FROM inv)),
p AS (SELECT *, list_distinct(regexp_extract_all(coalesce(fileSchema, ''), '\\b(?:required|optional|repeated)\\s+(\\w+)\\s+(\\w+)', 2)) AS cols FROM dl),
s AS (SELECT *,
        list_sort(list_filter({req}, lambda x: NOT list_contains(cols, x))) AS mreq,
        list_sort(list_filter({opt}, lambda x: NOT list_contains(cols, x))) AS mopt,
        list_sort(list_filter(cols, lambda x: NOT list_contains(list_concat({req}, {opt}), x))) AS und
      FROM p)""", body="""
SELECT bucket, dt, fileFormat, array_to_string(list_sort(cols), ',') AS delivered_columns,
       array_to_string(mreq, ',') AS missing_required, array_to_string(mopt, ',') AS missing_optional,
       array_to_string(und, ',') AS undeclared_columns,
       coalesce(fileFormat = 'Parquet', false) AND len(cols) > 0 AND len(mreq) = 0 AS ok,
       CASE WHEN NOT coalesce(fileFormat = 'Parquet', false) THEN 'not_parquet'
            WHEN len(cols) = 0 THEN 'unparseable_schema'
            WHEN len(mreq) > 0 THEN 'missing_required_columns' ELSE 'ok' END AS verdict
FROM s""")
