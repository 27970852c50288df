"""The testdata -> model rules of ``civiccases.sources.adapter`` in DuckDB SQL.

These are the oracle's own statements, written independently of the Spark
plans: the model tables are CTEs over the driver's pre-registered views
(``orders``, ``lineitem``, ...).  ``with_model(sql)`` prepends the CTEs a
query needs (dependencies resolved), so each oracle string is self-contained.
"""

from __future__ import annotations

import re

from civiccases.sources import adapter as A
from civiccases.sources.model import SEED_DEPARTMENTS

# any complaint for every fourth event, one of a thirtieth of them for the others
VOTE_TARGET = ("(CASE WHEN event_id % 4 = 0 THEN (event_id * 7 + user_id) % greatest((SELECT count(*) FROM orders), 1) "
               "ELSE (event_id * 7 + user_id) % greatest((SELECT count(*) FROM orders) // 30, 1) END)")
AS_OF = "TIMESTAMP '2001-08-01 12:00:00'"
VOTE_CUTOFF = "TIMESTAMP '2024-01-16 00:00:00'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _seg(col: str) -> str:
    return "CASE " + col + " " + " ".join(
        f"WHEN {_q(s)} THEN {i}" for i, s in enumerate(A.SEGMENTS)) + " END"


def _pick(expr: str, values: list[str]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


def _secs(expr: str) -> str:
    return f"(INTERVAL 1 SECOND * CAST({expr} AS BIGINT))"


_DEPT_ROWS = ", ".join(
    f"({i + 1}, {_q(n)}, {_q(nt)}, {_q(c)}, {sla}, CAST(NULL AS VARCHAR), TRUE)"
    for i, (n, nt, c, sla) in enumerate(SEED_DEPARTMENTS))

LIVE_OVERDUE = ("({as_of} > {p}sla_deadline AND {p}status NOT IN ('resolved','closed','rejected'))")


def live_overdue(prefix: str = "", as_of: str = AS_OF) -> str:
    return LIVE_OVERDUE.format(as_of=as_of, p=prefix)



def _caller(prefix: str, at: str = "") -> str:
    """The caller's key of a request: first forwarded address, else the socket's, else 'unknown'."""
    k, me = f"{at}event_id", f"'{prefix}' || CAST({at}user_id AS VARCHAR)"
    forwarded = f"CASE {k} % 3 WHEN 0 THEN ' ' || {me} || ' , 10.0.0.' || ({k} % 250) WHEN 1 THEN ' ,10.0.0.1' END"
    remote = f"CASE WHEN {k} % 3 = 0 THEN '10.9.9.9' WHEN {k} % 101 = 0 THEN '' ELSE {me} END"
    return f"coalesce(nullif(trim(split_part({forwarded}, ',', 1)), ''), nullif({remote}, ''), 'unknown')"


CTES: dict[str, str] = {
    "departments": f"""SELECT id, name, name_te, code, sla_days, email, id <> 9 AS is_active FROM (VALUES {_DEPT_ROWS})
        AS t(id, name, name_te, code, sla_days, email, is_active)""",
    "seed_departments": f"""SELECT * FROM (VALUES {_DEPT_ROWS})
        AS t(id, name, name_te, code, sla_days, email, is_active)""",
    "districts": """SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS name_te,
        printf('D%02d', n_nationkey) AS code FROM nation""",
    "mandals": f"""SELECT CAST(n_nationkey * 5 + s.pos AS INTEGER) AS id, CAST(n_nationkey AS INTEGER) AS district_id,
        s.name AS name, CAST(NULL AS VARCHAR) AS name_te
        FROM nation CROSS JOIN (VALUES {", ".join(f"({i}, {_q(s)})" for i, s in enumerate(A.SEGMENTS))}) AS s(pos, name)""",
    "citizens": f"""SELECT c_custkey AS id, c_name AS name, printf('9%09d', c_custkey) AS phone,
        CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS aadhaar_hash,
        CAST(c_nationkey % 24 AS INTEGER) AS district_id,
        CAST((c_nationkey % 24) * 5 + {_seg('c_mktsegment')} AS INTEGER) AS mandal_id,
        CAST(NULL AS VARCHAR) AS village, CASE WHEN c_custkey % 2 = 0 THEN 'te' ELSE 'en' END AS lang_pref,
        CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS last_login FROM customer""",
    "officers": f"""SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS name,
        printf('officer%d@civicdesk.example.org', s_suppkey) AS email, printf('8%09d', s_suppkey) AS phone,
        CAST(s_suppkey % 10 + 1 AS INTEGER) AS department_id, CAST(s_nationkey % 24 AS INTEGER) AS district_id,
        {_pick('s_suppkey % 4', A.OFFICER_ROLES)} AS role, s_suppkey % 9 <> 0 AS is_active,
        CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS last_login FROM supplier""",
    "upvotes": f"""SELECT event_id AS id, complaint_id, voter_ip, ts AS voted_at FROM (
        SELECT event_id, ts, {VOTE_TARGET} AS complaint_id, 'v' || CAST(user_id AS VARCHAR) AS voter_ip,
               row_number() OVER (PARTITION BY {VOTE_TARGET}, user_id ORDER BY ts, event_id) AS rn
        FROM events WHERE event_type IN ('click', 'view') AND ts < {VOTE_CUTOFF}) v WHERE rn = 1""",
    "complaint_base": f"""SELECT o.o_orderkey AS id, o.o_custkey, o.o_orderdate, o.o_orderpriority,
        c.c_nationkey, c.c_mktsegment, o.o_orderstatus,
        CAST((o.o_orderkey + o.o_custkey) % 9 + 1 AS INTEGER) AS department_id,
        o.o_orderdate + {_secs('(1 + o.o_orderkey % 20) * 86400 + o.o_custkey % 86400')} AS done_at
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "complaint_status": f"""SELECT b.*, dep.sla_days,
        CASE WHEN b.o_orderstatus = 'F' AND b.done_at <= {AS_OF}
                  THEN CASE WHEN b.id % 5 = 0 THEN 'closed' ELSE 'resolved' END
             WHEN b.o_orderstatus = 'P' AND b.id % 6 = 0 THEN 'rejected'
             WHEN b.o_orderstatus = 'O' THEN {_pick('b.id % 4', ['submitted', 'acknowledged', 'assigned', 'in_progress'])}
             ELSE 'in_progress' END AS status
        FROM complaint_base b LEFT JOIN departments dep ON dep.id = b.department_id""",
    "complaint_wide": f"""SELECT s.*,
        CASE WHEN s.id % 101 = 0 THEN NULL
             ELSE s.o_orderdate + {_secs('COALESCE(NULLIF(s.sla_days, 0), 7) * 86400')} END AS sla_deadline
        FROM complaint_status s""",
    "complaints": f"""SELECT w.id,
        'AP-' || CAST(year(w.o_orderdate) AS VARCHAR) || '-' || d.code || '-'
            || printf('%05d', row_number() OVER (ORDER BY w.o_orderdate, w.id)) AS complaint_no,
        CASE WHEN w.id % 7 = 0 THEN NULL ELSE w.o_custkey END AS citizen_id,
        w.department_id, CAST(w.c_nationkey % 24 AS INTEGER) AS district_id,
        CASE WHEN w.id % 5 = 0 THEN NULL ELSE CAST((w.c_nationkey % 24) * 5 + {_seg('w.c_mktsegment')} AS INTEGER) END
            AS mandal_id,
        CAST(NULL AS VARCHAR) AS village, 'Case ' || CAST(w.id AS VARCHAR) AS title,
        COALESCE(doc.text, '') AS description,
        CASE w.o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'urgent' ELSE 'normal' END
            AS priority,
        CAST(NULL AS DECIMAL(10,8)) AS latitude, CAST(NULL AS DECIMAL(11,8)) AS longitude,
        CAST(NULL AS VARCHAR) AS address, w.status,
        CASE WHEN w.status IN ('assigned','in_progress','resolved','closed') THEN CAST(w.id % 10 AS INTEGER) END
            AS assigned_to,
        w.sla_deadline,
        CASE WHEN w.id % 11 = 0 THEN NULL
             ELSE (w.id % 3 = 0 AND COALESCE({live_overdue('w.')}, FALSE)) END AS is_overdue,
        w.id % 7 = 0 AS is_anonymous, 'web' AS source, w.o_orderdate AS created_at,
        CASE WHEN w.status IN ('resolved','closed') THEN w.done_at ELSE w.o_orderdate END AS updated_at,
        CASE WHEN w.status IN ('resolved','closed') THEN w.done_at END AS resolved_at,
        CAST(NULL AS TIMESTAMP) AS closed_at,
        w.department_id IN (1,2,3,5,6) AS is_public,
        CAST(COALESCE(v.n, CASE WHEN w.id % 13 = 0 THEN NULL ELSE 0 END) AS INTEGER) AS upvote_count
        FROM complaint_wide w
        LEFT JOIN districts d ON d.id = CAST(w.c_nationkey % 24 AS INTEGER)
        LEFT JOIN (SELECT doc_id, text FROM documents) doc ON doc.doc_id = w.id % (SELECT count(*) FROM documents)
        LEFT JOIN (SELECT complaint_id, count(*) AS n FROM upvotes GROUP BY complaint_id) v ON v.complaint_id = w.id""",
    "line_events": f"""SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice,
        l.l_returnflag, l.l_linestatus,
        o.o_orderdate + {_secs('l.l_linenumber * 86400 + l.l_partkey % 86400')} AS ts,
        {_pick('(l.l_orderkey + l.l_linenumber + l.l_partkey) % 6', A.LINE_STATUSES)} AS line_status
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "timeline": """SELECT row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
            AS id, l_orderkey AS complaint_id, line_status AS status,
        CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'Line ' || CAST(l_linenumber AS VARCHAR) END AS note,
        CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_suppkey AS INTEGER) END AS updated_by,
        ts AS created_at
        FROM line_events WHERE line_status <> 'closed' AND l_partkey % 97 <> 0""",
    "status_updates": f"""SELECT row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey,
            l_extendedprice) AS update_id,
        l_orderkey + CASE WHEN l_partkey % 97 = 0 THEN {A.UNKNOWN_ID_OFFSET} ELSE 0 END AS complaint_id,
        line_status AS status,
        CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'Line ' || CAST(l_linenumber AS VARCHAR) END AS note,
        CAST(l_suppkey + CASE WHEN l_partkey % 89 = 0 THEN 1000000 ELSE 0 END AS INTEGER) AS officer_id, ts
        FROM line_events""",
    "attachments": """SELECT page_id AS id, page_id % greatest((SELECT count(*) FROM orders) // 375, 1) AS complaint_id, url AS file_url,
        CASE WHEN page_id % 3 = 0 THEN 'image' ELSE 'pdf' END AS file_type,
        CAST(round(length(html) / 1024.0) AS INTEGER) AS file_size_kb,
        TIMESTAMP '2001-07-01 00:00:00' + INTERVAL 1 SECOND * CAST(page_id * 60 AS BIGINT) AS uploaded_at
        FROM pages""",
    "notifications": """SELECT o.o_orderkey AS id, o.o_orderkey AS complaint_id, o.o_custkey AS citizen_id,
        'sms' AS channel, 'Complaint registered: ' || c.complaint_no AS message, 'sent' AS status,
        c.created_at AS sent_at
        FROM orders o JOIN complaints c ON c.id = o.o_orderkey
        WHERE o.o_custkey % 5 <> 0""",
    "filing_requests": f"""SELECT o.o_orderkey AS request_id,
        CASE WHEN o.o_orderkey % 83 = 0 THEN -o.o_custkey ELSE o.o_custkey END AS caller_id,
        CASE WHEN o.o_orderkey % 67 = 0 THEN NULL ELSE CAST((o.o_orderkey + o.o_custkey) % 9 + 1 AS INTEGER) END
            AS department_id,
        CASE WHEN o.o_orderkey % 59 = 0 THEN NULL WHEN o.o_orderkey % 61 = 0 THEN 99
             ELSE CAST(c.c_nationkey % 24 AS INTEGER) END AS district_id,
        CASE WHEN o.o_orderkey % 5 = 0 THEN NULL WHEN o.o_orderkey % 79 = 0 THEN 99999
             ELSE CAST((c.c_nationkey % 24) * 5 + {_seg('c.c_mktsegment')} AS INTEGER) END AS mandal_id,
        CASE WHEN o.o_orderkey % 101 = 0 THEN repeat('v', 201) END AS village,
        CASE WHEN o.o_orderkey % 53 = 0 THEN ''
             ELSE 'Case ' || CAST(o.o_orderkey AS VARCHAR)
                  || CASE WHEN o.o_orderkey % 73 = 0 THEN repeat('x', 300) ELSE '' END END AS title,
        'Report ' || CAST(o.o_orderkey AS VARCHAR) AS description,
        CASE WHEN o.o_orderkey % 71 = 0 THEN 'purple' ELSE
             CASE o.o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'urgent'
             WHEN '3-MEDIUM' THEN 'normal' WHEN '4-NOT SPECIFIED' THEN '' ELSE NULL END END AS priority,
        CASE WHEN o.o_orderkey % 89 = 0 THEN 'abc' WHEN o.o_orderkey % 11 = 0 THEN '16.5' END AS latitude,
        CASE WHEN o.o_orderkey % 11 = 0 THEN '' WHEN o.o_orderkey % 13 = 0 THEN '80.25' END AS longitude,
        CASE WHEN o.o_orderkey % 2 = 0 THEN '' ELSE 'Door ' || CAST(o.o_orderkey AS VARCHAR) END AS address,
        CASE WHEN o.o_orderkey % 7 = 0 THEN 'true' ELSE 'false' END AS is_anonymous,
        CASE WHEN o.o_orderkey % 3 = 0 THEN printf('%012d', o.o_custkey) WHEN o.o_orderkey % 3 = 1 THEN ''
             ELSE NULL END AS aadhaar,
        CASE WHEN o.o_orderkey % 97 = 0 THEN 'a source of 21 letter'
             WHEN o.o_orderkey % 4 = 0 THEN 'mobile' ELSE NULL END AS source,
        o.o_orderdate AS ts
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "upload_requests": """SELECT file_id, request_id, mimetype, size_bytes FROM (
        SELECT page_id AS file_id, CAST(floor(page_id / 4) AS BIGINT) AS request_id,
               CASE WHEN page_id % 3 = 0 THEN 'image/png' ELSE 'text/html' END AS mimetype,
               CAST(length(html) AS BIGINT) * CASE WHEN page_id % 23 = 0 THEN 1000 ELSE 1 END AS size_bytes
        FROM pages
        UNION ALL
        SELECT page_id, CAST(floor(page_id / 4) + 1 AS BIGINT),
               CASE WHEN page_id % 3 = 0 THEN 'image/png' ELSE 'text/html' END,
               CAST(length(html) AS BIGINT) * CASE WHEN page_id % 23 = 0 THEN 1000 ELSE 1 END
        FROM pages WHERE page_id % 9 = 0) u""",
    "registration_requests": """SELECT c_custkey AS request_id,
        CASE WHEN c_custkey % 31 = 0 THEN '' ELSE c_name END AS name,
        CASE WHEN c_custkey % 5 = 0 THEN printf('9%09d', c_custkey)
             ELSE printf('7%09d', CAST(floor(c_custkey / 2) AS BIGINT)) END AS phone,
        CASE WHEN c_custkey % 47 = 0 THEN repeat('c', 200) || '@mail.example.org'
             WHEN c_custkey % 3 = 0 THEN printf('c%d@mail.example.org', c_custkey) END AS email,
        CAST(CASE WHEN c_custkey % 41 = 0 THEN 99 ELSE c_nationkey % 24 END AS INTEGER) AS district_id,
        CAST(CASE WHEN c_custkey % 43 = 0 THEN 99999 WHEN c_custkey % 2 = 0 THEN c_nationkey * 5 + c_custkey % 5 END
             AS INTEGER) AS mandal_id,
        CASE WHEN c_custkey % 53 = 0 THEN repeat('v', 201)
             WHEN c_custkey % 7 = 0 THEN printf('Village %d', c_custkey % 100) END AS village,
        CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'en' ELSE 'te' END AS lang_pref,
        TIMESTAMP '2001-08-01 00:00:00' + INTERVAL 1 SECOND * CAST((c_custkey * 37) % 1000 AS BIGINT) AS ts
        FROM customer""",
    "vote_requests": f"""SELECT e.event_id AS vote_id,
        CASE WHEN e.event_id % 97 = 0 THEN 'AP-0000-D99-' || CAST(e.event_id AS VARCHAR) ELSE c.complaint_no END
            AS complaint_no,
        {_caller('v', 'e.')} AS voter_ip, e.ts
        FROM (SELECT *, {VOTE_TARGET} AS target FROM events) e LEFT JOIN complaints c ON c.id = e.target
        WHERE e.event_type IN ('click', 'view') AND e.ts >= {VOTE_CUTOFF}""",
    "logins": """SELECT CASE WHEN event_id % 2 = 0 THEN 'citizen' ELSE 'officer' END AS actor_type,
        user_id AS actor_id, ts FROM events WHERE event_type = 'purchase'""",
    "client_requests": f"SELECT event_id AS request_id, {_caller('c')} AS client, CASE event_type "
        + " ".join(f"WHEN {_q(et)} THEN {_q(r)}" for et, r in A.ROUTES) + " END AS route, ts FROM events",
    "code_events": f"""SELECT event_id,
        CASE WHEN user_id % 50 = 0 THEN printf('9%08d', user_id) ELSE printf('9%09d', user_id) END AS phone,
        CASE WHEN event_type = 'signup' THEN 'send' ELSE 'attempt' END AS kind,
        CASE WHEN event_type = 'signup' OR event_id % 3 <> 0 THEN {_q(A.TEST_CODE)} ELSE '000000' END AS code,
        ts FROM events WHERE event_type IN ('signup', 'click', 'error')""",
}


def _deps(name: str) -> list[str]:
    body = CTES[name]
    return [other for other in CTES if other != name and re.search(rf"\b{other}\b", body)]


def with_model(query: str) -> str:
    """Prefix ``query`` with the model CTEs it (transitively) references."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for dep in _deps(name):
            visit(dep)
        needed.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", query):
            visit(name)
    if not needed:
        return query
    ctes = ",\n".join(f"{name} AS (\n{CTES[name]}\n)" for name in needed)
    q = query.lstrip()
    if q[:4].upper() == "WITH":
        return f"WITH {ctes},\n{q[4:].lstrip()}"
    return f"WITH {ctes}\n{q}"
