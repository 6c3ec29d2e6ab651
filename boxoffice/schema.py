"""Table schemas, enumerated domains and fixed reference values."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _STR, _INT = T.LongType(), T.StringType(), T.IntegerType()
_TS, _BOOL, _DATE = T.TimestampNTZType(), T.BooleanType(), T.DateType()
_MONEY = T.DecimalType(10, 2)


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


# Registration ids are text: natural keys need not fit into a number.
SCHEMAS: dict[str, T.StructType] = {
    "users": _table(
        ("id", _LONG), ("name", _STR), ("email", _STR), ("role", _STR), ("created_at", _TS),
        ("is_banned", _BOOL), ("city", _STR), ("preferences", _STR), ("organization_name", _STR),
    ),
    "listings": _table(
        ("id", _LONG), ("creator_id", _LONG), ("title", _STR), ("type", _STR), ("description", _STR),
        ("date_start", _TS), ("date_end", _TS), ("venue", _STR), ("city", _STR), ("capacity", _INT),
        ("price", _MONEY), ("status", _STR), ("created_at", _TS),
    ),
    "listing_details": _table(
        ("id", _LONG), ("listing_id", _LONG), ("field_key", _STR), ("field_value", _STR),
    ),
    "registrations": _table(
        ("id", _STR), ("user_id", _LONG), ("listing_id", _LONG), ("ticket_code", _STR), ("status", _STR),
        ("checked_in", _BOOL), ("checked_in_at", _TS), ("created_at", _TS),
    ),
    "registration_answers": _table(
        ("id", _LONG), ("registration_id", _STR), ("question_key", _STR), ("answer", _STR),
    ),
    "payments": _table(
        ("registration_id", _STR), ("amount", _MONEY), ("method", _STR), ("status", _STR), ("created_at", _TS),
    ),
    "listing_views": _table(("listing_id", _LONG), ("date", _DATE), ("views", _LONG)),
    "reply_log": _table(
        ("user_id", _LONG), ("prompt", _STR), ("response", _STR), ("model_used", _STR), ("created_at", _TS),
    ),
    "waitlist": _table(("id", _STR), ("listing_id", _LONG), ("email", _STR), ("created_at", _TS)),
    "threads": _table(
        ("id", _LONG), ("user_id", _LONG), ("creator_id", _LONG), ("listing_id", _LONG), ("last_message_at", _TS),
    ),
    "messages": _table(
        ("id", _LONG), ("thread_id", _LONG), ("sender_id", _LONG), ("message_text", _STR),
        ("is_read", _BOOL), ("sent_at", _TS),
    ),
    "reviews": _table(
        ("listing_id", _LONG), ("user_id", _LONG), ("rating", _INT), ("review_text", _STR), ("created_at", _TS),
    ),
    "saves": _table(("user_id", _LONG), ("listing_id", _LONG), ("saved_at", _TS)),
    "follows": _table(("follower_id", _LONG), ("creator_id", _LONG), ("followed_at", _TS)),
    "notifications": _table(
        ("id", _LONG), ("user_id", _LONG), ("message", _STR), ("link", _STR), ("is_read", _BOOL), ("created_at", _TS),
    ),
}

# The activity stream as it lands on disk.
ACTIVITY_SCHEMA = _table(
    ("event_id", _LONG), ("ts", _TS), ("user_id", _LONG), ("event_type", _STR), ("value", T.DoubleType()),
    ("props", _STR),
)
CHAT_SCHEMA = _table(("conv_id", _LONG), ("turn", _LONG), ("role", _STR), ("text", _STR))
PART_SCHEMA = _table(
    ("p_partkey", _LONG), ("p_name", _STR), ("p_brand", _STR), ("p_type", _STR), ("p_size", _INT),
    ("p_retailprice", T.DoubleType()),
)
LINEITEM_SCHEMA = _table(
    ("l_orderkey", _LONG), ("l_partkey", _LONG), ("l_suppkey", _LONG), ("l_linenumber", _INT),
    ("l_quantity", T.DoubleType()), ("l_extendedprice", T.DoubleType()), ("l_discount", T.DoubleType()),
    ("l_tax", T.DoubleType()), ("l_returnflag", _STR), ("l_linestatus", _STR), ("l_shipdate", _TS),
)

# ---- Fixed values: results depend on these exact words and numbers. ----
ROLES = ("admin", "creator", "user")
LISTING_STATUSES = ("draft", "published", "cancelled", "upcoming", "live", "ended")
REGISTRATION_STATUSES = ("confirmed", "pending", "cancelled", "checked_in")
PAYMENT_STATUSES = ("success", "pending", "failed", "refunded")

LISTING_TYPES = (
    ("concert", "Concert / Music Show"),
    ("tech_conference", "Tech Conference"),
    ("workshop", "Workshop / Bootcamp"),
    ("sports", "Sports Tournament"),
    ("wedding", "Wedding / Private Event"),
    ("exhibition", "Exhibition / Expo"),
    ("webinar", "Online Webinar"),
    ("food_festival", "Food Festival"),
    ("charity", "Charity / NGO Event"),
    ("comedy", "Comedy / Theatre Show"),
)
STATUS_AXIS = ("published", "draft", "cancelled", "ended")
REQUIRED_DETAILS = (
    ("concert", "seating_type"),
    ("concert", "artist_name"),
    ("workshop", "skill_level"),
    ("sports", "sport_name"),
    ("webinar", "platform"),
    ("charity", "ngo_name"),
)
BOOKING_FEE = 10
CURRENCY = "₹"
PAGE_CATALOGUE = 12
PAGE_ADMIN = 20
TICKET_PREFIX = "EE-"
DELETED_MESSAGE = "This message was deleted"
# Platform setting defaults; the platform's own name and address are left to the caller.
SETTING_DEFAULTS = (
    ("max_tickets_per_user", "5"),
    ("allow_guest_browsing", "true"),
    ("maintenance_mode", "false"),
)
# ---- End of fixed values. ----
