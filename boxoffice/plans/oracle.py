"""DuckDB SQL for the registered queries, over the same Parquet tables.

``VIEWS`` restates the derived marketplace tables; each query is prefixed with the ones it uses.
"""

from __future__ import annotations

import re

from boxoffice.operators.attendees import spend_axis
from boxoffice.plans.catalog import AS_OF, DETAIL_RULES, PRUNED, TICKS, TREND_AS_OF, TYPES, YEAR
from boxoffice.schema import SETTING_DEFAULTS

# The rules of the data model, written out here once more so that a gap in the library's own lists shows.
REFERENCES = {
    "listings": {"creator_id": "users"}, "listing_details": {"listing_id": "listings"}, "registrations": {"user_id": "users", "listing_id": "listings"},
    "registration_answers": {"registration_id": "registrations"}, "payments": {"registration_id": "registrations"},
    "listing_views": {"listing_id": "listings"}, "reply_log": {"user_id": "users"}, "waitlist": {"listing_id": "listings"},
    "threads": {"user_id": "users", "creator_id": "users", "listing_id": "listings"}, "messages": {"thread_id": "threads", "sender_id": "users"},
    "reviews": {"listing_id": "listings", "user_id": "users"}, "saves": {"user_id": "users", "listing_id": "listings"},
    "follows": {"follower_id": "users", "creator_id": "users"}, "notifications": {"user_id": "users"},
}
SET_NULL = {("threads", "listing_id")}
REQUIRED = (
    "users.name users.email listings.creator_id listings.title listings.type listings.date_start listing_details.listing_id listing_details.field_key "
    "registrations.user_id registrations.listing_id registrations.ticket_code registration_answers.registration_id registration_answers.question_key "
    "payments.registration_id payments.amount listing_views.listing_id listing_views.date reply_log.user_id reply_log.prompt waitlist.listing_id "
    "waitlist.email threads.user_id threads.creator_id messages.thread_id messages.sender_id messages.message_text reviews.listing_id reviews.user_id "
    "reviews.rating saves.user_id saves.listing_id follows.follower_id follows.creator_id notifications.user_id notifications.message").split()
UNIQUE = (("users.email unique", "users", "lower(strip_accents(rtrim(email)))", "email IS NOT NULL"),
          ("registrations.ticket_code unique", "registrations", "lower(strip_accents(rtrim(ticket_code)))", "ticket_code IS NOT NULL"),
          ("saves pair unique", "saves", "user_id, listing_id", "user_id IS NOT NULL AND listing_id IS NOT NULL"),
          ("follows pair unique", "follows", "follower_id, creator_id", "follower_id IS NOT NULL AND creator_id IS NOT NULL"))

NOW = f"TIMESTAMP '{AS_OF}'"
C = "1000000000000000"
# Restated sizes of the derivation: attendees, creators, listings; the parties of a conversation; its days.
_N, _S, _P = (f"(SELECT greatest(1, count(*)) FROM {t})" for t in ("customer", "supplier", "part"))
_CHAT_USER, _CHAT_CREATOR = f"conv_id // 3 % {_N}", f"{C} + conv_id // 2 % {_S}"
_CHAT_DAY = "TIMESTAMP '2001-01-01' + to_days(CAST(conv_id % 300 * 10 + {turn} AS INTEGER))"
_MESSAGE = "conv_id * 16777216 + {turn}"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


VIEWS: dict[str, str] = {
    "users": f"""
        SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email, 'user' AS role,
               TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey * 13 % 2404 AS INTEGER)) AS created_at,
               c_acctbal < 0 AS is_banned, n_name AS city, lower(c_mktsegment) AS preferences,
               CAST(NULL AS VARCHAR) AS organization_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT {C} + s_suppkey, s_name, lower(s_name) || '@example.com', 'creator',
               TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 37 % 2404 AS INTEGER)), false, n_name,
               CASE WHEN s_suppkey % 3 > 0 THEN 'promo,large' END,
               CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 > 1 THEN s_name || ' Org' END
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "listings": f"""
        SELECT p_partkey AS id, {C} + p_partkey // 20 AS creator_id, p_name AS title, lower(p_type) AS type,
               p_brand || ' ' || p_name || ' ' || p_type AS description,
               TIMESTAMP '1996-01-01 18:00:00' + to_days(CAST(p_partkey * 11 % 2500 AS INTEGER)) AS date_start,
               CASE WHEN p_partkey % 5 > 0 THEN TIMESTAMP '1996-01-01 21:00:00'
                   + to_days(CAST(p_partkey * 11 % 2500 + p_partkey % 3 AS INTEGER)) END AS date_end,
               CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS venue,
               CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN ''
                    WHEN p_partkey % 17 = 0 THEN lower(n_name) ELSE n_name END AS city,
               CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END AS capacity,
               CASE WHEN p_partkey % 4 = 0 THEN CAST(0 AS DECIMAL(10,2)) ELSE CAST(p_retailprice AS DECIMAL(10,2)) END AS price,
               CASE p_partkey % 10 WHEN 0 THEN 'draft' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'ended' ELSE 'published' END AS status,
               TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey * 3 % 2300 AS INTEGER)) AS created_at
        FROM part JOIN supplier ON s_suppkey = p_partkey // 20 JOIN nation ON s_nationkey = n_nationkey""",
    "registrations": """
        SELECT id, user_id, listing_id, 'EE-' || listing_id || '-' || ok AS ticket_code,
               CASE flag WHEN 'A' THEN 'cancelled' WHEN 'N' THEN 'pending' ELSE 'confirmed' END AS status,
               flag = 'R' AND ok % 3 = 0 AS checked_in,
               CASE WHEN flag = 'R' AND ok % 3 = 0 THEN created_at + to_days(1) END AS checked_in_at, created_at
        FROM (SELECT l_orderkey || '-' || l_partkey AS id, l_orderkey AS ok, o_custkey AS user_id, l_partkey AS listing_id,
                     max(l_returnflag) AS flag, o_orderdate AS created_at
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              GROUP BY l_orderkey, l_partkey, o_custkey, o_orderdate)""",
    "payments": """
        SELECT l_orderkey || '-' || l_partkey AS registration_id, CAST(l_extendedprice AS DECIMAL(10,2)) AS amount,
               CASE l_linenumber % 3 WHEN 0 THEN 'upi' WHEN 1 THEN 'card' ELSE 'netbanking' END AS method,
               CASE WHEN l_linestatus = 'F' THEN 'success' WHEN l_returnflag = 'A' THEN 'refunded'
                    WHEN l_returnflag = 'N' THEN 'pending' ELSE 'failed' END AS status,
               l_shipdate AS created_at
        FROM lineitem""",
    "reviews": """
        SELECT l_partkey AS listing_id, o_custkey AS user_id, CAST(1 + l_quantity % 5 AS INTEGER) AS rating,
               'review of ' || l_partkey AS review_text, l_shipdate AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_returnflag = 'R'""",
    "activity": "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "save_toggles": "SELECT event_id, user_id, k AS listing_id, ts FROM activity WHERE event_type = 'click'",
    "follow_toggles": f"SELECT event_id, user_id AS follower_id, {C} + (user_id * 13 + k) % {_S} AS creator_id, ts FROM activity WHERE event_type = 'signup'",
    "view_hits": "SELECT event_id, k AS listing_id, ts FROM activity WHERE event_type = 'view'",
    "status_log": f"""
        SELECT event_id, (event_id * 31 + k) % {_P} AS listing_id, ts,
               CASE event_id % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'cancelled' ELSE 'draft' END AS status
        FROM activity WHERE event_type = 'error'""",
    "ban_log": """
        SELECT event_id, user_id, ts, CASE event_id % 7 WHEN 0 THEN 'ban' WHEN 1 THEN 'unban' ELSE 'toggle' END AS action
        FROM activity WHERE event_type = 'error'""",
    "setting_log": """
        SELECT event_id, user_id AS scope_id, ts, 'v' || k AS setting_value,
               CASE k % 4 WHEN 0 THEN 'max_tickets_per_user' WHEN 1 THEN 'maintenance_mode' WHEN 2 THEN 'tagline'
                          ELSE 'support_email' END AS setting_key
        FROM activity WHERE event_type = 'purchase'""",
    "notifications": """
        SELECT event_id AS id, user_id, 'listing ' || k AS message, event_id % 2 = 0 AS is_read, ts AS created_at
        FROM activity WHERE event_type = 'error'""",
    "thread_requests": f"""
        SELECT event_id AS request_id, user_id, {C} + (user_id * 13 + k) % {_S} AS creator_id,
               CASE WHEN event_id % 3 > 0 THEN (user_id * 13 + k) % {_P} END AS listing_id, ts
        FROM activity WHERE event_type = 'purchase'""",
    "scans": """
        SELECT DISTINCT reg || '/' || line || '/' || strftime(moment, '%Y%m%d%H') || '/' || CAST(quantity AS INTEGER) AS scan_id,
               scanner_id, ticket_code, listing_id, moment AS ts
        FROM (SELECT reg, line, quantity, b.ts + to_hours(again) AS moment,
                     CASE WHEN mix % 50 = 0 THEN l.creator_id + 1 ELSE l.creator_id END AS scanner_id,
                     CASE WHEN mix % 97 > 0 THEN 'EE-' || part || '-' || ok END AS ticket_code,
                     CASE WHEN line = 7 THEN part + 1 ELSE part END AS listing_id
              FROM (SELECT l_orderkey || '-' || l_partkey AS reg, l_orderkey AS ok, l_orderkey * 7 + l_partkey AS mix, l_partkey AS part, l_linenumber AS line, l_shipdate AS ts,
                           l_quantity AS quantity FROM lineitem) b
              JOIN listings l ON l.id = part
              JOIN (VALUES (0), (1)) v(again) ON again = 0 OR mix % 5 = 0)""",
    "threads": f"""
        SELECT conv_id AS id, {_CHAT_USER} AS user_id, {_CHAT_CREATOR} AS creator_id,
               CASE WHEN conv_id % 4 > 0 THEN conv_id % {_P} END AS listing_id, {_CHAT_DAY.format(turn="max(turn)")} AS last_message_at
        FROM conversations GROUP BY conv_id""",
    "messages": f"""
        SELECT {_MESSAGE.format(turn="turn")} AS id, conv_id AS thread_id,
               CASE WHEN role = 'assistant' THEN {_CHAT_CREATOR} ELSE {_CHAT_USER} END AS sender_id, text AS message_text,
               turn % 3 <> 0 AS is_read, {_CHAT_DAY.format(turn="turn")} AS sent_at
        FROM conversations WHERE role <> 'system'""",
    "read_log": f"""
        SELECT conv_id AS thread_id, CASE WHEN conv_id % 2 = 0 THEN {_CHAT_USER} ELSE {_CHAT_CREATOR} END AS reader_id,
               {_CHAT_DAY.format(turn="turn")} AS read_at
        FROM conversations WHERE turn = 2""",
    "delete_log": f"""
        SELECT {_MESSAGE.format(turn="1")} AS message_id, CASE WHEN conv_id % 5 = 0 THEN {_CHAT_CREATOR} ELSE {_CHAT_USER} END AS requester_id
        FROM conversations WHERE turn = 1 AND conv_id % 5 < 2""",
    "waitlist": """
        SELECT r.id, r.listing_id, u.email, r.created_at FROM registrations r JOIN users u ON r.user_id = u.id
        WHERE r.status = 'pending' AND (r.user_id * 7 + r.listing_id) % 9 = 0""",
    "listing_details": """
        SELECT p_partkey * 2 AS id, p_partkey AS listing_id, 'brand' AS field_key, p_brand AS field_value FROM part
        UNION ALL SELECT p_partkey * 2 + 1, p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part""",
    "registration_log": """
        SELECT l_orderkey || '-' || l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'cancelled' WHEN 'N' THEN 'pending' ELSE 'confirmed' END AS status,
               l_shipdate AS ts, l_linenumber * 1000 + ascii(l_returnflag) AS seq FROM lineitem""",
    "payment_log": """
        SELECT l_orderkey || '-' || l_partkey AS id, l_linestatus = 'F' AS success, CAST(l_extendedprice AS DECIMAL(10,2)) AS amount, l_shipdate AS ts,
               l_linenumber, l_linestatus FROM lineitem""",
    "seat_events": """
        SELECT id, listing_id, 'request' AS kind, created_at AS ts FROM registrations
        UNION ALL SELECT id || '/off', listing_id, 'release', created_at + to_days(CAST((user_id * 7 + listing_id) % 90 + 1 AS INTEGER))
        FROM registrations WHERE status = 'cancelled'""",
    "registration_answers": """
        SELECT CAST(l_linenumber AS BIGINT) AS id, l_orderkey || '-' || l_partkey AS registration_id, 'qty' AS question_key,
               CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS answer FROM lineitem
        UNION ALL SELECT l_linenumber, l_orderkey || '-' || l_partkey, 'flag', l_returnflag FROM lineitem""",
    "listing_edits": """
        SELECT l_orderkey || '-' || l_partkey AS edit_id, l_partkey AS listing_id, max(l_shipdate) AS ts, 'edit ' || l_orderkey AS title,
               CASE l_orderkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'large' ELSE 'promo' END AS type,
               CASE WHEN l_orderkey % 7 > 0 THEN 'about ' || l_orderkey END AS description, max(l_shipdate) + to_days(30) AS date_start,
               CASE WHEN l_orderkey % 5 > 0 THEN max(l_shipdate) + to_days(31) END AS date_end,
               CASE WHEN l_orderkey % 2 = 0 THEN 'hall ' || l_orderkey % 40 END AS venue,
               CASE WHEN l_orderkey % 11 > 0 THEN 'city ' || l_orderkey % 90 END AS city,
               CAST(max(l_quantity) AS INTEGER) AS capacity, max(CAST(l_extendedprice AS DECIMAL(10,2))) AS price,
               CASE WHEN l_orderkey % 3 > 0 THEN 'banner-' || l_orderkey END AS banner
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "listing_edit_details": """
        SELECT edit_id, listing_id, 'size' AS field_key, CAST(capacity AS VARCHAR) AS field_value FROM listing_edits
        UNION ALL SELECT edit_id, listing_id, 'brand', CAST(capacity AS VARCHAR) FROM listing_edits WHERE capacity % 2 = 0""",
    "profile_edits": f"""
        SELECT o_orderkey AS edit_id, o_custkey AS user_id, o_orderdate AS ts, 'name ' || o_orderkey AS name,
               lpad(CAST(o_orderkey AS VARCHAR), 10, '5') AS phone, o_orderpriority AS bio, 'org ' || o_orderkey AS organization_name,
               CAST(NULL AS VARCHAR) AS website_url, 'city ' || o_orderstatus AS city, 'promo,small' AS preferences,
               CASE WHEN o_orderkey % 5 = 0 THEN 'avatar-' || o_orderkey END AS avatar
        FROM orders
        UNION ALL
        SELECT p_partkey, {C} + p_partkey // 20, TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey * 3 % 2300 AS INTEGER)), p_name,
               lpad(CAST(p_partkey AS VARCHAR), 10, '6'), p_brand, 'org ' || p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'https://example.com/' || p_partkey END, 'nowhere', lower(p_type), NULL
        FROM part""",
    "model_replies": """
        SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'no object here' WHEN 1 THEN '{bad' WHEN 2 THEN 'so {bad} it is'
            WHEN 3 THEN '{"reason": "only a reason ' || doc_id || '"}'
            WHEN 4 THEN '{"status": "Safe"} and {"status": "Flagged"}'
            ELSE 'Sure! {"status": "' || CASE WHEN toxic = 1 THEN 'Flagged' WHEN quality = 0 THEN 'Warning' ELSE 'Safe' END
                 || '",' || chr(10) || ' "price": ' || doc_id || '}' || chr(10) || 'done' END AS reply
        FROM labels""",
    "parsed_replies": r"""
        SELECT *, regexp_extract(reply, '(?s)\{.*\}') AS obj, obj <> '' AND json_valid(obj) AS good FROM model_replies""",
    "reply_log": f"""
        SELECT doc_id % {_N} AS user_id, 'review ' || doc_id AS prompt, reply AS response FROM model_replies""",
    "listing_views": "SELECT listing_id, CAST(ts AS DATE) AS date, count(*) AS views FROM view_hits GROUP BY ALL",
    "search_requests": """
        SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 3 = 0 THEN '' ELSE coalesce(type, '') END AS type,
               CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 2 > 0 THEN '' ELSE coalesce(city, '') END AS city,
               o_orderkey % 17 > 0 AND o_orderkey % 5 = 0 AS free_only
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS first FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
        LEFT JOIN listings ON first = id""",
    "live": "SELECT * FROM registrations WHERE status <> 'cancelled'",
    "paid": "SELECT * FROM payments WHERE status = 'success'",
    "seats": "SELECT listing_id, count(*) AS registered FROM live GROUP BY listing_id",
    "ledger": """
        SELECT r.listing_id, count(r.id) AS registered, sum(p.amount) AS revenue
        FROM live r LEFT JOIN paid p ON p.registration_id = r.id GROUP BY r.listing_id""",
    "first_paid": """
        SELECT registration_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY registration_id
            ORDER BY created_at, amount, method) AS n FROM paid) WHERE n = 1""",
    "answers": """
        SELECT registration_id, question_key, answer FROM (SELECT *, row_number() OVER (
            PARTITION BY registration_id, question_key ORDER BY id DESC, answer DESC) AS n FROM registration_answers) WHERE n = 1""",
    "answer_text": "SELECT registration_id, string_agg(question_key || '=' || answer, ';' ORDER BY question_key) AS answers FROM answers GROUP BY 1",
    "saves": """
        SELECT user_id, listing_id, max(ts) AS saved_at FROM save_toggles GROUP BY ALL HAVING count(*) % 2 = 1""",
    "follows": """
        SELECT follower_id, creator_id, max(ts) AS followed_at FROM follow_toggles WHERE follower_id <> creator_id
        GROUP BY ALL HAVING count(*) % 2 = 1""",
    "spans": """
        SELECT follower_id, creator_id, ts AS followed_at, off AS unfollowed_at FROM (
            SELECT *, row_number() OVER w AS n, lead(ts) OVER w AS off FROM follow_toggles WHERE follower_id <> creator_id
            WINDOW w AS (PARTITION BY follower_id, creator_id ORDER BY ts, event_id)) WHERE n % 2 = 1""",
    "months": "SELECT range AS month, strftime(make_date(2000, CAST(range AS INTEGER), 1), '%b') AS label FROM range(1, 13)",
    "revenue_months": f"""
        SELECT m.month, m.label, coalesce(CAST(sum(p.amount) AS DOUBLE), 0) AS revenue FROM months m
        LEFT JOIN paid p ON year(p.created_at) = {YEAR} AND month(p.created_at) = m.month GROUP BY ALL""",
    "registration_months": f"""
        SELECT m.month, m.label, count(r.id) AS registrations FROM months m
        LEFT JOIN live r ON year(r.created_at) = {YEAR} AND month(r.created_at) = m.month GROUP BY ALL""",
    "signup_months": f"""
        SELECT m.month, m.label, count(u.id) AS new_users FROM months m
        LEFT JOIN users u ON u.role = 'user' AND year(u.created_at) = {YEAR} AND month(u.created_at) = m.month GROUP BY ALL""",
    "type_axis": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(TYPES)) + ") a(ordinal, value, label)",
    "status_axis": "SELECT * FROM (VALUES (0, 'published', 'Published'), (1, 'draft', 'Draft'), (2, 'cancelled', 'Cancelled'), "
                   "(3, 'ended', 'Ended')) a(ordinal, value, label)",
    "type_counts": "SELECT CAST(ordinal AS BIGINT) AS ordinal, value, label, count(l.id) AS listings FROM type_axis LEFT JOIN listings l ON l.type = value GROUP BY ALL",
    "status_counts": "SELECT CAST(ordinal AS BIGINT) AS ordinal, value, label, count(l.id) AS listings FROM status_axis LEFT JOIN listings l ON l.status = value GROUP BY ALL",
    "city_top": """
        SELECT min(city) AS label, count(*) AS listings FROM listings WHERE city IS NOT NULL AND rtrim(city) <> ''
        GROUP BY lower(strip_accents(rtrim(city))) ORDER BY 2 DESC, 1 LIMIT 10""",
    "method_counts": "SELECT upper(method) AS label, count(*) AS payments FROM paid GROUP BY 1",
    "performance": """
        SELECT l.creator_id, l.id AS listing_id, l.title, l.capacity, l.status, l.type, coalesce(g.registered, 0) AS registered, g.revenue
        FROM listings l LEFT JOIN ledger g ON g.listing_id = l.id WHERE l.status <> 'cancelled'""",
    "user_types": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, type) AS ordinal FROM (
            SELECT r.user_id, l.type, count(*) AS n FROM live r JOIN listings l ON r.listing_id = l.id GROUP BY r.user_id, l.type)""",
    "open_listings": f"SELECT * FROM listings WHERE status = 'published' AND date_start > {NOW}",
    "judged_scans": """
        SELECT s.scan_id, s.ts, r.id AS registration_id,
               CASE WHEN s.ticket_code IS NULL THEN 'missing' WHEN l.id IS NULL OR l.creator_id <> s.scanner_id THEN 'unauthorized'
                    WHEN r.id IS NULL THEN 'invalid' WHEN r.status <> 'confirmed' THEN 'status' WHEN r.checked_in THEN 'already'
                    ELSE 'success' END AS verdict
        FROM scans s LEFT JOIN listings l ON l.id = s.listing_id
        LEFT JOIN registrations r ON r.ticket_code = s.ticket_code AND r.listing_id = s.listing_id""",
    "gone": "SELECT id FROM users WHERE is_banned OR (role = 'creator' AND id % 7 = 0)",
    "last_settings": """
        SELECT scope_id, setting_key, setting_value FROM (SELECT *, row_number() OVER (
            PARTITION BY scope_id, setting_key ORDER BY ts DESC, event_id DESC) AS n FROM setting_log) WHERE n = 1""",
    "last_edits": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY ts DESC, edit_id DESC) AS n FROM listing_edits) WHERE n = 1""",
    "catalogue": """
        SELECT l.id AS listing_id, l.title, l.type, l.city, l.date_start, CAST(l.price AS DOUBLE) AS price, CAST(l.capacity AS BIGINT) AS capacity,
               u.name AS creator_name, coalesce(s.registered, 0) AS registered, l.created_at, l.description
        FROM listings l JOIN users u ON u.id = l.creator_id LEFT JOIN seats s ON s.listing_id = l.id WHERE l.status = 'published'""",
}

_SHOWN = "SELECT * EXCLUDE (description) FROM catalogue"
_PAGED = "type IN ('economy', 'small', 'large') AND contains(lower(city), 'nation')"
_PCT = "CAST(CASE WHEN {d} > 0 THEN floor({n} / {d} * 100) ELSE 0 END AS BIGINT)"


def _pct(part: str, whole: str) -> str:
    return _PCT.format(n=part, d=whole)


def _short(text: str, size: int) -> str:
    return f"CASE WHEN length({text}) > {size} THEN left({text}, {size}) || '...' ELSE {text} END"


def _title(text: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({text}, '_', ' '), ' '), "
            "lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")


_MIDPOINTS = " ".join(f"WHEN {m}.0 / 20 THEN {round(m / 20, 1)}" for m in range(21, 100, 2))
_SPEND = spend_axis(AS_OF)
_SPEND_AXIS = ", ".join(f"({i}, '{p:%Y-%m}', '{p:%b}')" for i, p in enumerate(_SPEND))

_CHART = """
    SELECT '{chart}' AS chart, {ordinal} AS ordinal, label, CAST({value} AS DECIMAL(20,2)) AS value FROM {source}"""
_CHARTS = " UNION ALL ".join(_CHART.format(chart=c, ordinal=o, value=v, source=s) for c, o, v, s in (
    ("revenue_monthly", "month", "revenue", "revenue_months"), ("regs_monthly", "month", "registrations", "registration_months"),
    ("user_growth", "month", "new_users", "signup_months"), ("events_type", "ordinal", "listings", "type_counts"),
    ("city_breakdown", "row_number() OVER (ORDER BY listings DESC, label)", "listings", "city_top"),
    ("event_status", "ordinal", "listings", "status_counts"),
    ("payment_methods", "row_number() OVER (ORDER BY label)", "payments", "method_counts")))


def _orphans(child: str, key: str, parent: str) -> str:
    return (f"SELECT '{child}.{key} reference', (SELECT count(*) FROM {child} WHERE {key} IS NOT NULL "
            f"AND {key} NOT IN (SELECT id FROM {parent}))")


def _where(rule: str, table: str, condition: str) -> str:
    return f"SELECT '{rule}', (SELECT count(*) FROM {table} WHERE {condition})"


_REPEATED = "SELECT '{rule}', (SELECT count(*) FROM (SELECT 1 FROM {table} WHERE {filled} GROUP BY {keys} HAVING count(*) > 1))"



_TREND = f"""
        SELECT u.id AS creator_id, CAST(a.i AS BIGINT) AS ordinal, strftime(a.day, '%m-%d') AS label, count(r.id) AS registrations
        FROM users u
        JOIN (SELECT range AS i, CAST(TIMESTAMP '{TREND_AS_OF}' - to_days(CAST(29 - range AS INTEGER)) AS DATE) AS day FROM range(0, 30)) a ON true
        LEFT JOIN (SELECT r.id, r.created_at, l.creator_id FROM live r JOIN listings l ON r.listing_id = l.id) r
               ON r.creator_id = u.id AND CAST(r.created_at AS DATE) = a.day
        WHERE u.role = 'creator' GROUP BY ALL"""
_TOP8 = f"""
        SELECT creator_id, ordinal, listing_id, {_short('title', 15)} AS label, coalesce(CAST(revenue AS DOUBLE), 0) AS revenue
        FROM (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY revenue DESC NULLS LAST, listing_id) AS ordinal FROM performance)
        WHERE ordinal <= 8"""
_OBJECT = """
        SELECT {keys}, count(*) AS points, string_agg(label, '|' ORDER BY ordinal) AS labels, CAST(sum(value) AS DOUBLE) AS total,
               '{{"labels":["' || string_agg(label, '","' ORDER BY ordinal) || '"],"data":[' || string_agg(CAST(value AS VARCHAR), ',' ORDER BY ordinal)
               || ']}}' AS payload
        FROM ({rows}) GROUP BY {keys}"""


def _lost(parent: str) -> str:
    """The ids of a table that the deletion of users takes along."""
    if parent == "users":
        return "SELECT id FROM gone"
    return f"SELECT id FROM {parent} WHERE " + " OR ".join(
        f"{c} IN ({_lost(p)})" for c, p in REFERENCES[parent].items() if (parent, c) not in SET_NULL)


def _left(table: str) -> str:
    if table == "users":
        return "SELECT * FROM users WHERE id NOT IN (SELECT id FROM gone)"
    emptied = [(c, p) for c, p in REFERENCES[table].items() if (table, c) in SET_NULL]
    replaced = "".join(f", CASE WHEN {c} IN ({_lost(p)}) THEN NULL ELSE {c} END AS {c}" for c, p in emptied)
    shown = f"* EXCLUDE ({', '.join(c for c, _ in emptied)}){replaced}" if emptied else "*"
    return f"SELECT {shown} FROM {table} WHERE " + " AND ".join(
        f"({c} IS NULL OR {c} NOT IN ({_lost(p)}))" for c, p in REFERENCES[table].items() if (table, c) not in SET_NULL)


# One step of the recursion per event of a listing: the level before it.
_MOVES = """
        WITH RECURSIVE numbered AS MATERIALIZED (
            SELECT e.*, CASE WHEN l.capacity > 0 THEN l.capacity ELSE 1000000000 END AS seats, l.id % 4 * 3 AS room,
                   row_number() OVER (PARTITION BY e.listing_id ORDER BY e.ts, e.id) AS place
            FROM seat_events e JOIN listings l ON l.id = e.listing_id),
        run AS (
            SELECT listing_id, 1::BIGINT AS place, 0::BIGINT AS level FROM numbered WHERE place = 1
            UNION ALL
            SELECT r.listing_id, r.place + 1, CASE WHEN e.kind = 'request' THEN least(r.level + 1, greatest(e.seats + e.room, r.level)) ELSE greatest(r.level - 1, 0) END
            FROM run r JOIN numbered e ON e.listing_id = r.listing_id AND e.place = r.place),
        moves AS MATERIALIZED (
            SELECT *, kind = 'request' AS asks, kind = 'request' AND level < seats + room AS taken,
                   CASE WHEN kind = 'request' THEN level < seats ELSE level > seats END AS given
            FROM numbered JOIN run USING (listing_id, place))"""


BODIES: dict[str, str] = {
    "platform_kpis": f"""
        SELECT (SELECT count(*) FROM users WHERE role = 'user') AS total_users,
               (SELECT count(*) FROM users WHERE role = 'creator') AS total_creators,
               (SELECT count(*) FROM listings WHERE status = 'published') AS total_listings,
               (SELECT count(*) FROM live) AS total_registrations,
               (SELECT coalesce(CAST(sum(amount) AS DOUBLE), 0) FROM paid) AS total_revenue,
               (SELECT count(*) FROM listings WHERE status = 'published' AND CAST(date_start AS DATE) = CAST({NOW} AS DATE)) AS listings_today,
               (SELECT count(*) FROM users WHERE role = 'user' AND created_at >= date_trunc('day', {NOW} - to_days(7))) AS new_users_this_week""",
    "revenue_by_month": "SELECT * FROM revenue_months",
    "registrations_by_month": "SELECT * FROM registration_months",
    "signups_by_month": "SELECT * FROM signup_months",
    "monthly_summary": "SELECT * FROM revenue_months JOIN registration_months USING (month, label) JOIN signup_months USING (month, label)",
    "listings_by_type": "SELECT * FROM type_counts",
    "listings_by_status": "SELECT * FROM status_counts",
    "revenue_by_type": f"""
        SELECT l.type, {_title('l.type')} AS label, CAST(sum(p.amount) AS DOUBLE) AS revenue
        FROM paid p JOIN registrations r ON p.registration_id = r.id JOIN listings l ON r.listing_id = l.id GROUP BY l.type""",
    "top_listings": f"""
        SELECT l.id AS listing_id, l.title, count(r.id) AS registrations, CAST(sum(p.amount) AS DOUBLE) AS revenue,
               CAST(l.capacity AS BIGINT) AS capacity, {_pct('count(r.id)', 'l.capacity')} AS fill_pct
        FROM listings l LEFT JOIN registrations r ON r.listing_id = l.id AND r.status <> 'cancelled'
        LEFT JOIN payments p ON p.registration_id = r.id AND p.status = 'success'
        WHERE l.status = 'published' GROUP BY l.id, l.title, l.capacity ORDER BY registrations DESC, l.id LIMIT 5""",
    "top_creators": """
        SELECT u.id AS creator_id, u.name, count(DISTINCT l.id) AS listings, count(r.id) AS attendees, CAST(sum(p.amount) AS DOUBLE) AS revenue
        FROM users u JOIN listings l ON l.creator_id = u.id LEFT JOIN registrations r ON r.listing_id = l.id AND r.status <> 'cancelled'
        LEFT JOIN payments p ON p.registration_id = r.id AND p.status = 'success'
        WHERE u.role = 'creator' GROUP BY u.id, u.name ORDER BY revenue DESC NULLS LAST, u.id LIMIT 5""",
    "recent_activity": """
        SELECT r.id AS registration_id, r.created_at, u.name AS user_name, l.title AS listing_title
        FROM registrations r JOIN users u ON r.user_id = u.id JOIN listings l ON r.listing_id = l.id
        ORDER BY r.created_at DESC, r.id LIMIT 10""",
    "city_breakdown": "SELECT * FROM city_top",
    "payment_mix": "SELECT * FROM method_counts",
    "users_by_role": "SELECT role, count(*) AS users FROM users GROUP BY role",
    "listing_admin_report": """
        SELECT l.id AS listing_id, l.title, l.status, u.name AS creator_name,
               (SELECT count(*) FROM live r WHERE r.listing_id = l.id) AS registered, x.revenue, l.created_at
        FROM listings l JOIN users u ON u.id = l.creator_id
        LEFT JOIN (SELECT r.listing_id, CAST(sum(p.amount) AS DOUBLE) AS revenue FROM paid p JOIN registrations r ON p.registration_id = r.id
                   GROUP BY 1) x ON x.listing_id = l.id
        WHERE contains(lower(l.title), 'bolt') AND l.status = 'published'""",
    "chart_json": _OBJECT.format(keys="chart", rows=_CHARTS),
    "creator_chart_json": _OBJECT.format(keys="creator_id, chart", rows=" UNION ALL ".join(
        f"SELECT creator_id, '{chart}' AS chart, ordinal, label, CAST({value} AS DECIMAL(20,2)) AS value FROM ({rows})" for chart, value, rows in (
            ("revenue_by_event", "revenue", _TOP8), ("registration_trend", "registrations", _TREND)))),
    "listing_lookup": "SELECT id, title, status, created_at FROM listings WHERE id IN (SELECT listing_id FROM saves)",
    "registration_lookup": "SELECT id, user_id, listing_id, status FROM registrations WHERE id IN (SELECT id FROM waitlist)",
    "ticket_lookup": "SELECT ticket_code, id, user_id, listing_id, status FROM registrations WHERE ticket_code IN (SELECT ticket_code FROM scans)",
    "thread_lookup": "SELECT id, user_id, creator_id, listing_id FROM threads WHERE id IN (SELECT thread_id FROM read_log)",
    "creator_summary": """
        SELECT u.id AS creator_id, coalesce(e.n, 0) AS total_listings, coalesce(a.n, 0) AS total_attendees,
               coalesce(CAST(p.s AS DOUBLE), 0) AS total_revenue,
               CASE WHEN e.cap > 0 THEN coalesce(a.n, 0) / e.cap * 100 ELSE 0.0 END AS avg_fill_rate
        FROM users u
        LEFT JOIN (SELECT creator_id, count(*) AS n, CAST(sum(capacity) AS BIGINT) AS cap FROM listings WHERE status <> 'cancelled' GROUP BY 1) e ON e.creator_id = u.id
        LEFT JOIN (SELECT l.creator_id, count(*) AS n FROM live r JOIN listings l ON r.listing_id = l.id GROUP BY 1) a ON a.creator_id = u.id
        LEFT JOIN (SELECT l.creator_id, sum(p.amount) AS s FROM paid p JOIN registrations r ON p.registration_id = r.id
                   JOIN listings l ON r.listing_id = l.id GROUP BY 1) p ON p.creator_id = u.id
        WHERE u.role = 'creator'""",
    "creator_revenue_top8": _TOP8,
    "creator_trend": _TREND,
    "creator_performance": f"""
        SELECT creator_id, listing_id, title, CAST(capacity AS BIGINT) AS capacity, status, type, registered, CAST(revenue AS DOUBLE) AS revenue,
               {_pct('registered', 'capacity')} AS fill_pct,
               CASE WHEN fill_pct > 75 THEN 'success' WHEN fill_pct > 40 THEN 'warning' ELSE 'danger' END AS band FROM performance""",
    "creator_top_listing": """
        SELECT creator_id, listing_id, title, registered, CAST(revenue AS DOUBLE) AS revenue
        FROM (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY registered DESC, listing_id) AS n FROM performance) WHERE n = 1""",
    "creator_public_stats": """
        SELECT u.id AS creator_id, coalesce(nullif(u.organization_name, ''), u.name) AS display_name,
               CASE WHEN u.preferences IS NULL THEN '' ELSE 'Promo, Large' END AS interests,
               (SELECT count(*) FROM listings l WHERE l.creator_id = u.id AND l.status IN ('published', 'ended')) AS total_listings,
               (SELECT count(*) FROM live r JOIN listings l ON r.listing_id = l.id WHERE l.creator_id = u.id) AS total_attendees,
               (SELECT count(*) FROM follows f WHERE f.creator_id = u.id) AS followers, strftime(u.created_at, '%B %Y') AS member_since
        FROM users u WHERE u.role = 'creator'""",
    "creator_manage_stats": """
        SELECT u.id AS creator_id, count(l.id) AS listings, count(CASE WHEN l.status = 'published' THEN 1 END) AS published,
               CAST(coalesce(sum(s.registered), 0) AS BIGINT) AS registered, coalesce(CAST(sum(l.price) AS DOUBLE), 0) AS list_price_sum
        FROM users u LEFT JOIN listings l ON l.creator_id = u.id LEFT JOIN seats s ON s.listing_id = l.id
        WHERE u.role = 'creator' GROUP BY u.id""",
    "creator_published": "SELECT creator_id, id AS listing_id, title, type, date_start FROM listings WHERE status = 'published'",
    "creator_listings": """
        SELECT l.creator_id, l.id AS listing_id, l.title, l.status, l.created_at, coalesce(s.registered, 0) AS registered
        FROM listings l LEFT JOIN seats s ON s.listing_id = l.id""",
    "user_summary": f"""
        SELECT u.id AS user_id, coalesce(a.n, 0) AS tickets_total, coalesce(a.up, 0) AS upcoming_listings,
               coalesce(a.n - a.up, 0) AS past_listings, coalesce(CAST(p.s AS DOUBLE), 0) AS total_spent
        FROM users u
        LEFT JOIN (SELECT r.user_id, count(*) AS n, count(CASE WHEN l.date_start > {NOW} THEN 1 END) AS up
                   FROM live r JOIN listings l ON r.listing_id = l.id GROUP BY 1) a ON a.user_id = u.id
        LEFT JOIN (SELECT r.user_id, sum(p.amount) AS s FROM paid p JOIN registrations r ON p.registration_id = r.id GROUP BY 1) p ON p.user_id = u.id
        WHERE u.role = 'user'""",
    "user_spend_6m": f"""
        SELECT u.id AS user_id, CAST(a.ordinal AS BIGINT) AS ordinal, a.label, coalesce(CAST(s.total AS DOUBLE), 0) AS spent
        FROM users u JOIN (VALUES {_SPEND_AXIS}) a(ordinal, month, label) ON true
        LEFT JOIN (SELECT r.user_id, strftime(p.created_at, '%Y-%m') AS month, sum(p.amount) AS total
                   FROM paid p JOIN registrations r ON p.registration_id = r.id
                   WHERE p.created_at >= date_trunc('month', {NOW} - to_days(180)) GROUP BY ALL) s ON s.user_id = u.id AND s.month = a.month
        WHERE u.role = 'user'""",
    "user_type_history": f"""
        SELECT u.id AS user_id, coalesce(h.ordinal, 1) AS ordinal, coalesce({_title('h.type')}, 'No Events') AS label,
               coalesce(h.n, 1) AS registrations, CASE WHEN h.ordinal = 1 THEN h.type END AS top_type
        FROM users u LEFT JOIN user_types h ON h.user_id = u.id WHERE u.role = 'user'""",
    "user_upcoming": f"""
        SELECT user_id, ordinal, listing_id, title, type, date_start, city, venue, ticket_code FROM (
            SELECT r.user_id, l.id AS listing_id, l.title, l.type, l.date_start, l.city, l.venue, r.ticket_code,
                   row_number() OVER (PARTITION BY r.user_id ORDER BY l.date_start, r.id) AS ordinal
            FROM live r JOIN listings l ON r.listing_id = l.id WHERE l.date_start > {NOW}) WHERE ordinal <= 3""",
    "ticket_book": f"""
        SELECT r.user_id, r.id AS registration_id, r.ticket_code, r.status, l.title, l.type, l.date_start, l.city, l.venue,
               CASE WHEN l.date_start > {NOW} AND r.status <> 'cancelled' THEN 'upcoming'
                    WHEN l.date_start <= {NOW} OR r.status = 'cancelled' THEN 'past' END AS bucket
        FROM registrations r JOIN listings l ON r.listing_id = l.id""",
    "recommendations": """
        , picked AS (
            SELECT u.id AS user_id, o.id AS listing_id, row_number() OVER (PARTITION BY u.id ORDER BY o.created_at DESC, o.id) AS ordinal
            FROM users u LEFT JOIN user_types h ON h.user_id = u.id AND h.ordinal = 1 JOIN open_listings o ON h.type IS NULL OR h.type = o.type
            WHERE u.role = 'user' AND NOT EXISTS (SELECT 1 FROM live r WHERE r.user_id = u.id AND r.listing_id = o.id)),
        others AS (
            SELECT u.id AS user_id, o.id AS listing_id, row_number() OVER (PARTITION BY u.id ORDER BY sha256(o.id || ':0')) AS ordinal
            FROM users u JOIN user_types h ON h.user_id = u.id AND h.ordinal = 1 JOIN open_listings o ON true
            WHERE u.role = 'user' AND u.id NOT IN (SELECT user_id FROM picked)
              AND NOT EXISTS (SELECT 1 FROM live r WHERE r.user_id = u.id AND r.listing_id = o.id))
        SELECT x.user_id, x.ordinal, l.id AS listing_id, l.title, l.type, l.city, l.date_start, CAST(l.price AS DOUBLE) AS price, x.fallback
        FROM (SELECT *, false AS fallback FROM picked UNION ALL SELECT *, true FROM others) x JOIN listings l ON l.id = x.listing_id
        WHERE x.ordinal <= 6""",
    "search_type_in": f"{_SHOWN} WHERE type IN ('economy', 'promo')",
    "search_city": f"{_SHOWN} WHERE contains(lower(city), 'nation_1')",
    "search_text": f"{_SHOWN} WHERE contains(lower(title), 'gear') OR contains(lower(city), 'gear') OR contains(lower(description), 'gear')",
    "indexed_search_text": f"{_SHOWN} WHERE contains(lower(title), 'hot gear') OR contains(lower(city), 'hot gear') OR contains(lower(description), 'hot gear')",
    "indexed_search_short": f"""{_SHOWN} WHERE contains(lower(city), 'nation_2')
        AND (contains(lower(title), '#9') OR contains(lower(city), '#9') OR contains(lower(description), '#9'))""",
    "indexed_search_scan": f"""{_SHOWN} WHERE price > 0
        AND (contains(lower(title), 'nation_') OR contains(lower(city), 'nation_') OR contains(lower(description), 'nation_'))""",
    "indexed_user_search": """
        SELECT id AS user_id, name, email, role, is_banned, created_at, (SELECT count(*) FROM live r WHERE r.user_id = u.id) AS total_regs
        FROM users u WHERE contains(lower(name), 'mer#00000001') OR contains(lower(email), 'mer#00000001')
        ORDER BY created_at DESC, id LIMIT 20""",
    "indexed_registration_search": """
        SELECT r.id AS registration_id, r.ticket_code, r.status, r.created_at, l.title AS listing_title, u.name AS user_name
        FROM registrations r JOIN listings l ON r.listing_id = l.id JOIN users u ON r.user_id = u.id
        WHERE (contains(lower(r.ticket_code), '0012') OR contains(lower(u.name), '0012')) AND r.status = 'confirmed'
        ORDER BY r.created_at DESC, r.id LIMIT 20""",
    "search_dates": f"{_SHOWN} WHERE date_start >= TIMESTAMP '2001-06-01' AND date_start <= TIMESTAMP '2001-09-02'",
    "search_price": f"{_SHOWN} WHERE price = 0",
    "search_sorted": f"{_SHOWN} WHERE price > 0 ORDER BY price DESC, listing_id LIMIT 12",
    "catalogue_search": f"{_SHOWN} WHERE {_PAGED} ORDER BY date_start, listing_id LIMIT 12 OFFSET 12",
    "search_page_counts": f"SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 12)) AS BIGINT) AS total_pages FROM catalogue WHERE {_PAGED}",
    "user_search": """
        SELECT id AS user_id, name, email, role, is_banned, created_at, (SELECT count(*) FROM live r WHERE r.user_id = u.id) AS total_regs
        FROM users u WHERE role = 'user' AND (contains(lower(name), 'customer#00000') OR contains(lower(email), 'customer#00000'))
        ORDER BY created_at DESC, id LIMIT 20 OFFSET 20""",
    "user_search_counts": """
        SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS total_pages
        FROM users WHERE is_banned AND (contains(lower(name), '00001') OR contains(lower(email), '00001'))""",
    "registration_ledger": """
        SELECT r.id AS registration_id, r.ticket_code, r.status, r.created_at, l.title AS listing_title, u.name AS user_name
        FROM registrations r JOIN listings l ON r.listing_id = l.id JOIN users u ON r.user_id = u.id""",
    "registration_search": """
        SELECT r.id AS registration_id, r.ticket_code, r.status, r.created_at, l.title AS listing_title, u.name AS user_name
        FROM registrations r JOIN listings l ON r.listing_id = l.id JOIN users u ON r.user_id = u.id
        WHERE (contains(lower(r.ticket_code), 'ee-1') OR contains(lower(u.name), 'ee-1')) AND r.status = 'confirmed'
        ORDER BY r.created_at DESC, r.id LIMIT 20 OFFSET 40""",
    "registration_search_counts": """
        SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS total_pages
        FROM registrations r JOIN listings l ON r.listing_id = l.id JOIN users u ON r.user_id = u.id
        WHERE (contains(lower(r.ticket_code), 'ee-1') OR contains(lower(u.name), 'ee-1')) AND r.status = 'confirmed'""",
    "similar_listings": """
        SELECT listing_id, ordinal, similar_id, title, date_start, creator_name FROM (
            SELECT a.id AS listing_id, b.id AS similar_id, b.title, b.date_start, u.name AS creator_name,
                   row_number() OVER (PARTITION BY a.id ORDER BY b.date_start, b.id) AS ordinal
            FROM listings a JOIN listings b ON a.type = b.type AND a.id <> b.id AND b.status = 'published' JOIN users u ON u.id = b.creator_id)
        WHERE ordinal <= 3""",
    "user_directory": "SELECT id AS user_id, name, email, role, created_at, is_banned FROM users",
    "keyed_lookup": """
        SELECT id AS user_id, name, email, role, created_at, is_banned FROM users WHERE lower(email) IN (SELECT lower(email) FROM waitlist)""",
    "registered_already": """
        SELECT s.user_id, s.listing_id, r.id IS NOT NULL AS registered, r.ticket_code FROM saves s
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, listing_id ORDER BY id) AS n FROM live) r
               ON r.user_id = s.user_id AND r.listing_id = s.listing_id AND r.n = 1""",
    "listing_card": f"""
        , shown AS (SELECT *, date_diff('second', {NOW}, date_start) AS s FROM listings WHERE status = 'published')
        SELECT id AS listing_id, {_short('title', 15)} AS short_title, {_title('type')} AS type_label,
               coalesce(nullif(city, ''), nullif(venue, ''), 'Online') AS place,
               coalesce(strftime(date_start, '%b %d, %Y %I:%M %p'), 'TBD') AS starts,
               CASE WHEN date_start < {NOW} THEN 'Event Started' ELSE
                    CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd ' ELSE '' END || (s % 86400 // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS countdown,
               CASE WHEN price = 0 THEN 'FREE' ELSE '₹' || CAST(round_even(CAST(price AS DOUBLE), 0) AS BIGINT) END AS price_text FROM shown""",
    "seat_availability": f"""
        SELECT l.id AS listing_id, CAST(l.capacity AS BIGINT) AS capacity, coalesce(s.registered, 0) AS registered,
               CASE WHEN l.capacity > 0 THEN l.capacity - coalesce(s.registered, 0) END AS spots_left,
               {_pct('coalesce(s.registered, 0)', 'l.capacity')} AS fill_pct,
               l.capacity > 0 AND coalesce(s.registered, 0) >= l.capacity AS sold_out
        FROM listings l LEFT JOIN seats s ON s.listing_id = l.id""",
    "registration_counts": "SELECT * FROM seats",
    "ticket_detail": """
        SELECT r.ticket_code, r.id AS registration_id, r.status, l.title, l.type AS listing_type, l.date_start, l.date_end, l.venue, l.city,
               u.name AS user_name, u.email AS user_email, coalesce(a.answers, '') AS answers, coalesce(CAST(p.amount AS DOUBLE), 0) AS paid_amount
        FROM registrations r JOIN listings l ON r.listing_id = l.id JOIN users u ON r.user_id = u.id
        LEFT JOIN answer_text a ON a.registration_id = r.id LEFT JOIN first_paid p ON p.registration_id = r.id""",
    "attendee_list": """
        SELECT r.listing_id, r.id AS registration_id, r.ticket_code, r.status, r.created_at, r.user_id, u.name, u.email,
               coalesce(a.answers, '') AS answers, CAST(p.amount AS DOUBLE) AS paid_amount
        FROM registrations r JOIN users u ON r.user_id = u.id
        LEFT JOIN answer_text a ON a.registration_id = r.id LEFT JOIN first_paid p ON p.registration_id = r.id""",
    "attendee_export": """
        SELECT r.listing_id, r.ticket_code AS "Ticket Code", u.name AS "Name", u.email AS "Email", r.status AS "Status",
               strftime(r.created_at, '%Y-%m-%d') AS "Date", CAST(p.amount AS VARCHAR) AS "Amount Paid"
        FROM registrations r JOIN users u ON r.user_id = u.id LEFT JOIN first_paid p ON p.registration_id = r.id""",
    "attendee_stats": f"""
        SELECT l.id AS listing_id, count(r.id) AS total, count(CASE WHEN r.status = 'confirmed' THEN 1 END) AS confirmed,
               coalesce(CAST(sum(p.amount) AS DOUBLE), 0) AS revenue,
               {_pct("count(CASE WHEN r.status = 'confirmed' THEN 1 END)", 'l.capacity')} AS cap_pct
        FROM listings l LEFT JOIN registrations r ON r.listing_id = l.id LEFT JOIN first_paid p ON p.registration_id = r.id
        GROUP BY l.id, l.capacity""",
    "listing_detail": """
        SELECT l.id AS listing_id, l.title, l.type, l.status, l.date_start, l.city, u.name AS creator_name, coalesce(s.registered, 0) AS registered,
               d.details FROM listings l JOIN users u ON u.id = l.creator_id LEFT JOIN seats s ON s.listing_id = l.id
        LEFT JOIN (SELECT listing_id, string_agg(field_key || '=' || field_value, ';' ORDER BY field_key) AS details
                   FROM listing_details GROUP BY 1) d ON d.listing_id = l.id""",
    "recent_checkins": """
        SELECT listing_id, ordinal, ticket_code, checked_in_at, name FROM (
            SELECT r.listing_id, r.ticket_code, r.checked_in_at, u.name,
                   row_number() OVER (PARTITION BY r.listing_id ORDER BY r.checked_in_at DESC, r.id) AS ordinal
            FROM registrations r JOIN users u ON r.user_id = u.id WHERE r.checked_in) WHERE ordinal <= 10""",
    "ticket_payload": """
        SELECT r.id AS registration_id,
               CAST(json_object('code', r.ticket_code, 'event', l.title, 'user', u.name, 'date', strftime(l.date_start, '%Y-%m-%d')) AS VARCHAR) AS payload,
               'EE-' || r.listing_id || '-' || upper(substr(sha256(CAST(r.id AS VARCHAR)), 1, 6)) AS short_code
        FROM registrations r JOIN listings l ON r.listing_id = l.id JOIN users u ON r.user_id = u.id""",
    "admission": """
        , asked AS (
            SELECT r.id, r.user_id, r.listing_id, r.created_at, u.role, l.status, l.capacity,
                   row_number() OVER (PARTITION BY r.user_id, r.listing_id ORDER BY r.created_at, r.id) AS nth
            FROM live r LEFT JOIN users u ON u.id = r.user_id LEFT JOIN listings l ON l.id = r.listing_id),
        counted AS (
            SELECT *, count(CASE WHEN nth = 1 THEN 1 END) OVER (PARTITION BY listing_id ORDER BY created_at, id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM asked)
        SELECT id, user_id, listing_id, created_at,
               CASE WHEN role IS NULL OR role <> 'user' THEN 'not_allowed' WHEN status IS NULL OR status <> 'published' THEN 'not_found'
                    WHEN capacity > 0 AND before >= capacity THEN 'sold_out' WHEN nth > 1 THEN 'duplicate' ELSE 'admitted' END AS verdict
        FROM counted""",
    "settlement": """
        , outcomes AS (
            SELECT r.id, r.status, r.created_at, l.price, l.price + CASE WHEN l.price > 0 THEN 10 ELSE 0 END AS due, f.method, f.created_at AS tried,
                   CASE WHEN r.status = 'confirmed' THEN 'already_confirmed' WHEN l.price = 0 THEN 'free'
                        WHEN f.registration_id IS NOT NULL THEN 'paid' ELSE 'awaiting_payment' END AS outcome
            FROM registrations r JOIN listings l ON r.listing_id = l.id
            LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY registration_id ORDER BY created_at, amount, method) AS n FROM paid) f
                   ON f.registration_id = r.id AND f.n = 1)
        SELECT id AS registration_id, outcome, CAST(due AS DOUBLE) AS amount_due,
               CASE WHEN outcome = 'awaiting_payment' THEN status ELSE 'confirmed' END AS new_status,
               CAST(CASE WHEN outcome = 'paid' THEN due ELSE 0 END AS DOUBLE) AS charged, CASE WHEN outcome = 'paid' THEN method END AS method,
               CASE outcome WHEN 'paid' THEN tried WHEN 'free' THEN created_at END AS paid_at
        FROM outcomes""",
    "checkin_verdicts": """
        SELECT scan_id, CASE WHEN verdict = 'success' AND row_number() OVER (
                   PARTITION BY CASE WHEN verdict = 'success' THEN registration_id END, verdict ORDER BY ts, scan_id) > 1
               THEN 'already' ELSE verdict END AS verdict FROM judged_scans""",
    "waitlist_promotion": """
        , queue AS (
            SELECT listing_id, email, created_at, id FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, email ORDER BY created_at, id) AS n
                FROM waitlist WHERE trim(email) <> '') WHERE n = 1),
        placed AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY created_at, id) AS place FROM queue)
        SELECT q.listing_id, q.email, q.place, l.capacity = 0 OR q.place <= l.capacity - coalesce(s.registered, 0) AS promoted
        FROM placed q JOIN listings l ON l.id = q.listing_id LEFT JOIN seats s ON s.listing_id = q.listing_id""",
    "seat_history": f"""
        SELECT * FROM ({_MOVES},
            queue AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY place) AS turn FROM moves WHERE taken),
            seated AS (SELECT listing_id, ts AS seated_at, row_number() OVER (PARTITION BY listing_id ORDER BY place) AS turn FROM moves WHERE given)
            SELECT m.id, m.listing_id, m.ts, CASE WHEN NOT m.taken THEN 'sold_out' WHEN m.given THEN 'admitted' WHEN s.seated_at IS NULL THEN 'waiting'
                   ELSE 'promoted' END AS verdict, CASE WHEN m.given THEN m.ts ELSE s.seated_at END AS seated_at
            FROM moves m LEFT JOIN queue q ON q.id = m.id LEFT JOIN seated s ON s.listing_id = q.listing_id AND s.turn = q.turn WHERE m.asks)""",
    "seat_state": f"""
        SELECT * FROM ({_MOVES},
            ended AS (SELECT *, CASE WHEN asks THEN CASE WHEN taken THEN level + 1 ELSE level END ELSE greatest(level - 1, 0) END AS after FROM moves)
            SELECT listing_id, CAST(max_by(least(after, seats), place) AS BIGINT) AS held, CAST(max_by(greatest(after - seats, 0), place) AS BIGINT) AS waiting,
                   CAST(max(greatest(after - seats, 0)) AS BIGINT) AS most_waiting, count(CASE WHEN asks AND given THEN 1 END) AS admitted,
                   count(CASE WHEN NOT asks AND given THEN 1 END) AS promoted, count(CASE WHEN asks AND NOT taken THEN 1 END) AS sold_out
            FROM ended GROUP BY listing_id)""",
    "stream_kpi_changes": f"""
        , shown AS (SELECT l.id, l.date_start, coalesce(g.status, l.status) AS status FROM listings l LEFT JOIN (
            SELECT listing_id, max_by(status, (ts, event_id)) AS status FROM status_log GROUP BY 1) g ON g.listing_id = l.id),
        booked AS (SELECT id, max_by(status, (ts, seq)) AS status FROM registration_log GROUP BY 1),
        charged AS (SELECT CASE WHEN success THEN amount END AS paid FROM (SELECT *, row_number() OVER (
            PARTITION BY id ORDER BY ts DESC, l_linenumber DESC, success DESC, amount DESC) AS n FROM payment_log) WHERE n = 1)
        SELECT (SELECT count(*) FROM users WHERE role = 'user') AS total_users,
               (SELECT count(*) FROM users WHERE role = 'creator') AS total_creators,
               (SELECT count(*) FROM shown WHERE status = 'published') AS total_listings,
               (SELECT count(*) FROM booked WHERE status <> 'cancelled') AS total_registrations,
               (SELECT coalesce(CAST(sum(paid) AS DOUBLE), 0) FROM charged) AS total_revenue,
               (SELECT count(*) FROM shown WHERE status = 'published' AND CAST(date_start AS DATE) = CAST({NOW} AS DATE)) AS listings_today,
               (SELECT count(*) FROM users WHERE role = 'user' AND created_at >= date_trunc('day', {NOW} - to_days(7))) AS new_users_this_week""",
    "save_state": "SELECT * FROM saves",
    "follow_state": "SELECT * FROM follows",
    "follow_notices": """
        SELECT s.creator_id AS user_id, u.name || ' started following you!' AS message, s.followed_at AS created_at
        FROM spans s JOIN users u ON u.id = s.follower_id""",
    "publish_fanout": """
        SELECT g.event_id, s.follower_id AS user_id, u.name || ' has published a new event: ' || l.title AS message, '/events/' || l.id AS link,
               g.ts AS created_at
        FROM status_log g JOIN listings l ON l.id = g.listing_id JOIN users u ON u.id = l.creator_id JOIN spans s ON s.creator_id = l.creator_id
        WHERE g.status = 'published' AND g.ts >= s.followed_at AND (s.unfollowed_at IS NULL OR g.ts < s.unfollowed_at)""",
    "notification_feed": """
        SELECT user_id, ordinal, id AS notification_id, message, is_read, strftime(created_at, '%b %d, %H:%M') AS date_str FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS ordinal FROM notifications) WHERE ordinal <= 10""",
    "unread_notifications": "SELECT user_id, count(CASE WHEN NOT is_read THEN 1 END) AS unread FROM notifications GROUP BY 1",
    "saved_feed": """
        SELECT s.user_id, s.ordinal, s.listing_id, l.title, l.type, l.city, l.date_start, CAST(l.price AS DOUBLE) AS price
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, listing_id) AS ordinal FROM saves) s
        JOIN listings l ON l.id = s.listing_id WHERE s.ordinal <= 4""",
    "saved_flags": """
        SELECT DISTINCT t.user_id, t.listing_id, s.user_id IS NOT NULL AS is_saved FROM save_toggles t
        LEFT JOIN saves s ON s.user_id = t.user_id AND s.listing_id = t.listing_id""",
    "following_flags": """
        SELECT DISTINCT t.follower_id, t.creator_id, f.creator_id IS NOT NULL AS is_following FROM follow_toggles t
        LEFT JOIN follows f ON f.follower_id = t.follower_id AND f.creator_id = t.creator_id""",
    "listing_ratings": f"""
        , per AS (SELECT listing_id, count(*) AS n, CAST(sum(rating) AS DOUBLE) / count(*) AS mean FROM reviews GROUP BY 1)
        SELECT l.id AS listing_id, coalesce(p.n, 0) AS reviews, coalesce(CASE p.mean {_MIDPOINTS} ELSE round(p.mean, 1) END, 0.0)::DOUBLE AS avg_rating
        FROM listings l LEFT JOIN per p ON p.listing_id = l.id""",
    "review_list": """
        SELECT r.listing_id, u.name, CAST(r.rating AS BIGINT) AS rating, r.review_text, r.created_at
        FROM reviews r JOIN users u ON u.id = r.user_id""",
    "daily_views": "SELECT listing_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS views FROM view_hits GROUP BY ALL",
    "unread_messages": """
        SELECT p.id AS user_id, count(m.id) AS unread
        FROM (SELECT user_id AS id, id AS thread_id FROM threads UNION SELECT creator_id, id FROM threads) p
        LEFT JOIN messages m ON m.thread_id = p.thread_id AND NOT m.is_read AND m.sender_id <> p.id GROUP BY 1""",
    "inbox": f"""
        SELECT v.viewer_id, v.thread_id, u.name AS other_name, l.title AS listing_title, coalesce({_short('x.message_text', 40)}, 'No messages yet') AS preview,
               (SELECT count(*) FROM messages m WHERE m.thread_id = v.thread_id AND NOT m.is_read AND m.sender_id <> v.viewer_id) AS unread,
               v.last_message_at
        FROM (SELECT id AS thread_id, user_id AS viewer_id, creator_id AS other_id, listing_id, last_message_at FROM threads
              UNION ALL SELECT id, creator_id, user_id, listing_id, last_message_at FROM threads) v
        JOIN users u ON u.id = v.other_id LEFT JOIN listings l ON l.id = v.listing_id
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC, id DESC) AS n FROM messages) x
               ON x.thread_id = v.thread_id AND x.n = 1""",
    "thread_since": """
        SELECT m.thread_id, m.id AS message_id, m.sender_id, m.message_text, m.sent_at FROM messages m
        LEFT JOIN (SELECT DISTINCT thread_id FROM read_log) c ON c.thread_id = m.thread_id
        WHERE m.id > CASE WHEN c.thread_id IS NULL THEN 0 ELSE c.thread_id * 16777216 + 2 END""",
    "thread_upsert": """
        , keyed AS (
            SELECT q.request_id, CASE WHEN q.listing_id IS NOT NULL THEN coalesce(
                       (SELECT 'T' || min(t.id) FROM threads t WHERE t.user_id = q.user_id AND t.creator_id = q.creator_id AND t.listing_id = q.listing_id),
                       'N' || first_value(q.request_id) OVER (PARTITION BY q.user_id, q.creator_id, q.listing_id ORDER BY q.ts, q.request_id))
                   ELSE coalesce(
                       (SELECT 'T' || min(t.id) FROM threads t WHERE t.user_id = q.user_id AND t.creator_id = q.creator_id),
                       'N' || first_value(q.request_id) OVER (PARTITION BY q.user_id, q.creator_id ORDER BY q.ts, q.request_id)) END AS thread_key
            FROM thread_requests q WHERE q.user_id <> q.creator_id)
        SELECT request_id, thread_key, thread_key = 'N' || request_id AS created FROM keyed""",
    "message_state": """
        SELECT m.id AS message_id, m.thread_id, m.sender_id,
               CASE WHEN EXISTS (SELECT 1 FROM delete_log d WHERE d.message_id = m.id AND d.requester_id = m.sender_id)
                    THEN 'This message was deleted' ELSE m.message_text END AS message_text,
               m.is_read OR EXISTS (SELECT 1 FROM read_log r WHERE r.thread_id = m.thread_id AND r.reader_id <> m.sender_id
                                    AND r.read_at >= m.sent_at) AS is_read, m.sent_at
        FROM messages m""",
    "thread_activity": """
        SELECT t.id AS thread_id, coalesce(greatest(t.last_message_at, max(m.sent_at)), t.last_message_at) AS last_message_at
        FROM threads t LEFT JOIN messages m ON m.thread_id = t.id GROUP BY t.id, t.last_message_at""",
    "lifecycle_update": f"""
        SELECT id AS listing_id, status AS old_status, CASE status WHEN 'published' THEN 'ended' ELSE 'cancelled' END AS new_status FROM listings
        WHERE (status = 'published' AND date_end < {NOW}) OR (status = 'draft' AND date_start < {NOW})""",
    "listing_status_latest": """
        SELECT l.id AS listing_id, coalesce(g.status, l.status) AS status, g.status IS NOT NULL AS changed FROM listings l
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY ts DESC, event_id DESC) AS n FROM status_log) g
               ON g.listing_id = l.id AND g.n = 1""",
    "ban_state": """
        , marked AS (SELECT *, max(CASE WHEN action <> 'toggle' THEN rank END) OVER (PARTITION BY user_id) AS set_rank FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM ban_log)),
        folded AS (SELECT user_id, max(CASE WHEN rank = set_rank THEN action END) AS last_set,
                          count(CASE WHEN action = 'toggle' AND (set_rank IS NULL OR rank > set_rank) THEN 1 END) AS flips FROM marked GROUP BY 1)
        SELECT u.id AS user_id, (CASE f.last_set WHEN 'ban' THEN true WHEN 'unban' THEN false ELSE u.is_banned END) <> (coalesce(f.flips, 0) % 2 = 1) AS is_banned
        FROM users u LEFT JOIN folded f ON f.user_id = u.id WHERE u.role <> 'admin'""",
    "listing_latest": """
        SELECT l.id AS listing_id, """ + ", ".join(
        f"CASE WHEN e.edit_id IS NOT NULL THEN e.{c} ELSE l.{c} END AS {c}" for c in ("title", "type", "description", "date_start", "date_end", "venue", "city")) + """,
               CAST(coalesce(e.capacity, l.capacity) AS BIGINT) AS capacity, CAST(coalesce(e.price, l.price) AS DOUBLE) AS price, b.banner, e.edit_id
        FROM listings l LEFT JOIN last_edits e ON e.listing_id = l.id
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY ts DESC, edit_id DESC) AS m FROM listing_edits
                   WHERE banner IS NOT NULL) b ON b.listing_id = l.id AND b.m = 1""",
    "details_latest": """
        SELECT listing_id, field_key, field_value FROM listing_details WHERE listing_id NOT IN (SELECT listing_id FROM listing_edits)
        UNION ALL SELECT d.listing_id, d.field_key, d.field_value FROM listing_edit_details d JOIN last_edits e ON e.edit_id = d.edit_id""",
    "profile_latest": """
        , ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, edit_id DESC) AS n FROM profile_edits),
        avatars AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, edit_id DESC) AS m FROM profile_edits WHERE avatar IS NOT NULL)
        SELECT u.id AS user_id, coalesce(e.name, u.name) AS name, e.phone, e.bio,
               CASE WHEN e.user_id IS NOT NULL AND u.role = 'creator' THEN e.organization_name ELSE u.organization_name END AS organization_name,
               CASE WHEN u.role = 'creator' THEN e.website_url END AS website_url,
               CASE WHEN e.user_id IS NOT NULL AND u.role = 'user' THEN e.city ELSE u.city END AS city,
               coalesce(e.preferences, u.preferences) AS preferences, a.avatar
        FROM users u LEFT JOIN ranked e ON e.user_id = u.id AND e.n = 1 LEFT JOIN avatars a ON a.user_id = u.id AND a.m = 1""",
    "settings_latest": "SELECT * FROM last_settings",
    "settings_defaults": "SELECT * FROM last_settings UNION ALL SELECT s.scope_id, d.k, d.v FROM (SELECT DISTINCT scope_id FROM setting_log) s JOIN (VALUES "
        + ", ".join(f"('{k}', '{v}')" for k, v in SETTING_DEFAULTS) + ") d(k, v) ON true "
        "WHERE NOT EXISTS (SELECT 1 FROM last_settings x WHERE x.scope_id = s.scope_id AND x.setting_key = d.k)",
    "review_intake": """
        , forms AS (
            SELECT l_partkey AS listing_id, o_custkey AS user_id, l_shipdate AS created_at, CAST(l_quantity AS INTEGER) AS q
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT listing_id, user_id, CASE WHEN q % 11 > 0 AND q % 13 > 0 THEN CAST(q % 8 AS BIGINT) END AS rating, 'review ' || listing_id AS review_text, created_at,
               q % 11 > 0 AND q % 13 > 0 AND q % 8 BETWEEN 1 AND 5 AS accepted,
               CASE WHEN q % 11 > 0 AND q % 13 > 0 AND q % 8 BETWEEN 1 AND 5 THEN '' ELSE 'rating' END AS errors FROM forms""",
    "listing_intake": """
        , forms AS (
            SELECT p_partkey AS form_id, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE lower(p_type) END AS type,
                   CASE WHEN p_partkey % 29 > 0 THEN make_timestamp(2001, p_partkey % 9 + 1, 15, 18, 0, 0) END AS date_start FROM part)
        SELECT form_id, title, type, date_start, title <> '' AND type <> '' AND date_start IS NOT NULL AS accepted,
               concat_ws(',', CASE WHEN title = '' THEN 'title' END, CASE WHEN type = '' THEN 'type' END, CASE WHEN date_start IS NULL THEN 'date_start' END) AS errors
        FROM forms""",
    "answer_quality": """
        , forms AS (SELECT l_orderkey || '-' || l_partkey AS registration_id, l_orderkey % 31 = 0 OR l_orderkey % 37 = 0 AS bad_phone,
                           CAST(max(l_quantity) AS INTEGER) % 8 NOT BETWEEN 1 AND 5 AS bad_qty FROM lineitem GROUP BY l_orderkey, l_partkey)
        SELECT registration_id, concat_ws(',', CASE WHEN bad_phone THEN 'phone' END, CASE WHEN bad_qty THEN 'qty' END) AS errors,
               NOT bad_phone AND NOT bad_qty AS accepted FROM forms""",
    "missing_details": """
        SELECT l.id AS listing_id, l.type, r.k AS field_key FROM listings l JOIN (VALUES """
        + ", ".join(f"('{t}', '{k}')" for t, k in DETAIL_RULES) + """) r(t, k) ON r.t = l.type
        WHERE NOT EXISTS (SELECT 1 FROM listing_details d WHERE d.listing_id = l.id AND d.field_key = r.k AND trim(d.field_value) <> '')""",
    "verdict_parse": """
        SELECT doc_id, CASE WHEN good THEN coalesce(json_extract_string(obj, '$.status'), 'Warning') ELSE 'Warning' END AS status,
               CASE WHEN obj = '' THEN 'Could not parse AI response.' WHEN NOT good THEN 'AI review failed.'
                    ELSE coalesce(json_extract_string(obj, '$.reason'), reply) END AS reason FROM parsed_replies""",
    "price_parse": """
        SELECT doc_id, CASE WHEN good THEN coalesce(json_extract_string(obj, '$.price'), '499') ELSE '499' END AS price,
               CASE WHEN obj = '' THEN reply WHEN NOT good THEN 'Using default pricing suggestion.'
                    ELSE coalesce(json_extract_string(obj, '$.reason'), 'Based on market research.') END AS reason FROM parsed_replies""",
    "filter_parse": "SELECT * FROM search_requests",
    "batch_search": """
        , matched AS (
            SELECT q.request_id, l.id AS listing_id, l.title, row_number() OVER (PARTITION BY q.request_id ORDER BY l.created_at DESC, l.id) AS ordinal
            FROM search_requests q JOIN listings l ON l.status = 'published' AND (q.type = '' OR q.type = l.type)
             AND (q.city = '' OR contains(lower(l.city), lower(q.city))) AND (NOT q.free_only OR l.price = 0))
        SELECT request_id, ordinal, listing_id, title FROM matched WHERE ordinal <= 12""",
    "answers_map": "SELECT * FROM answers",
    "cascade_prune": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, (SELECT count(*) FROM ({_left(table)})) AS rows_left" for table in ("users", *REFERENCES))
        + f" UNION ALL SELECT 'threads without listing', (SELECT count(*) FROM ({_left('threads')}) WHERE listing_id IS NULL)",
    **{f"pruned_{table}": f"SELECT {', '.join(columns)} FROM ({_left(table)})" for table, columns in PRUNED.items()},
    "answers_append": "SELECT id, registration_id, question_key, answer FROM registration_answers WHERE trim(answer) <> ''",
    "ai_log_append": f"""
        SELECT doc_id % 150 AS user_id, 'review ' || doc_id AS prompt, reply AS response, 'text-model' AS model_used, {NOW} AS created_at FROM model_replies""",
    "integrity_audit": "SELECT a AS rule, b AS violations FROM (" + " UNION ALL ".join([
        *(_REPEATED.format(rule=rule, table=table, keys=keys, filled=filled) for rule, table, keys, filled in UNIQUE),
        _where("users.role domain", "users", "role NOT IN ('admin', 'creator', 'user')"), _where("users.name length", "users", "length(name) > 100"),
        _where("listings.status domain", "listings", "status NOT IN ('draft', 'published', 'cancelled', 'upcoming', 'live', 'ended')"),
        _where("listings.type domain", "listings", f"type NOT IN ({_list(k for k, _ in TYPES)})"),
        _where("registrations.status domain", "registrations", "status NOT IN ('confirmed', 'pending', 'cancelled', 'checked_in')"),
        _where("payments.status domain", "payments", "status NOT IN ('success', 'pending', 'failed', 'refunded')"),
        _where("reviews.rating range", "reviews", "rating NOT BETWEEN 1 AND 5"),
        *(_where(f"{rule} required", rule.split(".")[0], f"{rule.split('.')[1]} IS NULL") for rule in REQUIRED),
        *(_orphans(table, c, parent) for table, columns in REFERENCES.items() for c, parent in columns.items()),
    ]) + ") x(a, b)",
    # Streams: what a drained stream has emitted.
    "stream_daily_views": "SELECT listing_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS views FROM view_hits GROUP BY ALL",
    "stream_first_scans": """
        SELECT registration_id, scan_id, ts AS checked_in_at FROM (SELECT *, row_number() OVER (PARTITION BY registration_id ORDER BY ts, scan_id) AS n
            FROM judged_scans WHERE verdict = 'success') WHERE n = 1""",
    "stream_activity_counts": "SELECT event_type, count(*) AS events FROM events GROUP BY 1",
    "stream_unread": "SELECT user_id, count(CASE WHEN NOT is_read THEN 1 END) AS unread FROM notifications GROUP BY 1",
    "stream_unread_messages": """
        SELECT p.id AS user_id, count(CASE WHEN NOT m.is_read THEN 1 END) AS unread
        FROM (SELECT user_id AS id, id AS thread_id FROM threads UNION SELECT creator_id, id FROM threads) p
        JOIN messages m ON m.thread_id = p.thread_id AND m.sender_id <> p.id GROUP BY 1""",
    "stream_saves": "SELECT user_id, listing_id, count(*) % 2 = 1 AS is_on FROM save_toggles GROUP BY ALL",
    "stream_follows": "SELECT follower_id, creator_id, count(*) % 2 = 1 AS is_on FROM follow_toggles WHERE follower_id <> creator_id GROUP BY ALL",
    "stream_lifecycle": f"""
        SELECT id AS listing_id, status AS old_status, CASE status WHEN 'published' THEN 'ended' ELSE 'cancelled' END AS new_status FROM listings
        WHERE (status = 'published' AND date_end < {NOW}) OR (status = 'draft' AND date_start < {NOW})""",
    "stream_due_sweep": f"""
        SELECT id AS listing_id, status AS old_status, CASE status WHEN 'published' THEN 'ended' ELSE 'cancelled' END AS new_status, min(tick) AS tick
        FROM listings JOIN (VALUES {", ".join(f"(TIMESTAMP '{x}')" for x in TICKS)}) c(tick)
          ON (status = 'published' AND date_end < tick) OR (status = 'draft' AND date_start < tick) GROUP BY ALL""",
    "stream_messages": "SELECT thread_id, id, sender_id, message_text, sent_at FROM messages",
}


def _used_views(sql: str) -> list[str]:
    """The views a query names, directly or through other views, in definition order."""
    found: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"[a-z_]+", pending.pop()))
        for name in words & VIEWS.keys() - found:
            found.add(name)
            pending.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def _statement(body: str) -> str:
    body = body.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in _used_views(body))
    if body.startswith(","):
        return f"WITH {views}\n{body}" if views else f"WITH {body[1:].strip()}"
    return f"WITH {views}\n{body}" if views else body


# Streams, and reports over a stored layout, that end up with what a batch report gives.
for _other, _batch in {
    "stream_kpis": "platform_kpis", "stream_publish_notices": "publish_fanout", "bucketed_ticket_detail": "ticket_detail",
    "bucketed_attendee_list": "attendee_list", "bucketed_settlement": "settlement",
}.items():
    BODIES[_other] = BODIES[_batch]
BODIES["bucketed_top_listings"] = BODIES["top_listings"].replace("LIMIT 5", "LIMIT 50")

ORACLE: dict[str, str] = {name: _statement(body) for name, body in BODIES.items()}
