"""Integrity audit and cascading deletes, which Parquet tables do not enforce by themselves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.text import folded, folds_by_case, plain_folded
from boxoffice.operators.base import zero_filled
from boxoffice.schema import LISTING_STATUSES, LISTING_TYPES, PAYMENT_STATUSES, REGISTRATION_STATUSES, ROLES
from boxoffice.session import materialize
from boxoffice.sources.tables import Tables


UNIQUE_KEYS = {
    "users.email unique": ("users", ["email"]),
    "registrations.ticket_code unique": ("registrations", ["ticket_code"]),
    "saves pair unique": ("saves", ["user_id", "listing_id"]),
    "follows pair unique": ("follows", ["follower_id", "creator_id"]),
}
# Per referring table: referring column and the table it points to. A deleted parent takes its rows along, but for
# SET_NULL, where only the reference goes.
REFERENCES = {
    "listings": {"creator_id": "users"},
    "listing_details": {"listing_id": "listings"},
    "registrations": {"user_id": "users", "listing_id": "listings"},
    "registration_answers": {"registration_id": "registrations"},
    "payments": {"registration_id": "registrations"},
    "listing_views": {"listing_id": "listings"},
    "reply_log": {"user_id": "users"},
    "waitlist": {"listing_id": "listings"},
    "threads": {"user_id": "users", "creator_id": "users", "listing_id": "listings"},
    "messages": {"thread_id": "threads", "sender_id": "users"},
    "reviews": {"listing_id": "listings", "user_id": "users"},
    "saves": {"user_id": "users", "listing_id": "listings"},
    "follows": {"follower_id": "users", "creator_id": "users"},
    "notifications": {"user_id": "users"},
}
SET_NULL = {("threads", "listing_id")}
REQUIRED = {
    "users": ("name", "email"), "listings": ("creator_id", "title", "type", "date_start"), "listing_details": ("listing_id", "field_key"),
    "registrations": ("user_id", "listing_id", "ticket_code"), "registration_answers": ("registration_id", "question_key"),
    "payments": ("registration_id", "amount"), "threads": ("user_id", "creator_id"), "messages": ("thread_id", "sender_id", "message_text"),
    "reviews": ("listing_id", "user_id", "rating"), "saves": ("user_id", "listing_id"), "follows": ("follower_id", "creator_id"),
    "notifications": ("user_id", "message"), "listing_views": ("listing_id", "date"), "reply_log": ("user_id", "prompt"),
    "waitlist": ("listing_id", "email"),
}


def _facts(t: Tables, rules: dict[str, dict[str, Column]]) -> tuple[DataFrame, list[str], list[str]]:
    """Everything the audit asks of the tables, from one scan of each: (number, key) with how often it occurs.

    The numbers stand, in this order, for references (key: the id), unique keys (the values), row rules (no key) and
    parents (their ids); the names of the rules, and the referring rules' parents, come along.
    """
    references = [(f"{table}.{c} reference", table, c, parent) for table, columns in REFERENCES.items() for c, parent in columns.items()]
    names = [r[0] for r in references] + list(UNIQUE_KEYS) + [n for checks in rules.values() for n in checks]
    parents = sorted({r[3] for r in references})
    parts = []
    for table in sorted({*REFERENCES, *rules, *parents}):
        found = [(r[0], F.col(r[2]).cast("string")) for r in references if r[1] == table]
        # ids joined by a bar stay apart; of text there is one column
        found += [(n, reduce(lambda a, b: F.concat(a, F.lit("|"), b), [F.col(k).cast("string") for k in keys]))
                  for n, (of, keys) in UNIQUE_KEYS.items() if of == table]
        # a rule that comes out NULL is broken
        found += [(n, F.when(F.coalesce(rule, F.lit(True)), F.lit(""))) for n, rule in rules.get(table, {}).items()]
        numbered = [(names.index(n), key) for n, key in found]
        if table in parents:
            numbered.append((len(names) + parents.index(table), F.col("id").cast("string")))
        facts = F.array_compact(F.array(*(F.when(key.isNotNull(), F.struct(F.lit(n).alias("number"), key.alias("key"))) for n, key in numbered)))
        parts.append(getattr(t, table).select(F.inline(facts)))
    counts = reduce(DataFrame.unionByName, parts).groupBy("number", "key").agg(F.count("*").alias("n"))
    return counts, names, [f"{len(names) + parents.index(r[3])}" for r in references]


def _named(rules: Sequence[str]) -> Column:
    """Rules travel as small numbers and get their names at the end."""
    return F.array(*[F.lit(r) for r in rules])[F.col("number")]


def _row_rules(types: Sequence[tuple[str, str]]) -> dict[str, dict[str, Column]]:
    domains = {
        "users": {"users.role domain": ~F.col("role").isin(*ROLES), "users.name length": F.length("name") > 100},
        "listings": {
            "listings.status domain": ~F.col("status").isin(*LISTING_STATUSES),
            "listings.type domain": ~F.col("type").isin(*[k for k, _ in types])},
        "registrations": {"registrations.status domain": ~F.col("status").isin(*REGISTRATION_STATUSES)},
        "payments": {"payments.status domain": ~F.col("status").isin(*PAYMENT_STATUSES)},
        "reviews": {"reviews.rating range": ~F.col("rating").between(1, 5)},
    }
    return {table: domains.get(table, {}) | {f"{table}.{c} required": F.col(c).isNull() for c in columns} for table, columns in REQUIRED.items()}


def _repeated(keys: DataFrame) -> DataFrame:
    """One violation per (number, key) that occurs more than once, as the database compares text; of (number, key, n).

    Plain text is hashed by its lower case. Only other text, and the plain text that equals some of it, is compared by the
    collation; what of that was counted as plain is not counted again.
    """
    plain = keys.filter(folds_by_case(F.col("key"))).groupBy("number", plain_folded(F.col("key")).alias("key")).agg(F.sum("n").alias("n"))
    odd = keys.filter(~folds_by_case(F.col("key")))
    again = (F.col("n") > 1).cast("bigint")
    met = plain.alias("p").join(odd.alias("o"), (F.col("p.number") == F.col("o.number")) & (folded(F.col("p.key")) == folded(F.col("o.key"))), "left_semi")
    mixed = met.withColumn("counted", again).unionByName(odd.withColumn("counted", F.lit(0).cast("bigint")))
    mixed = mixed.groupBy("number", folded(F.col("key")).alias("key")).agg(F.sum("n").alias("n"), F.sum("counted").alias("counted"))
    found = plain.select("number", again.alias("violations")).unionByName(mixed.select("number", (again - F.col("counted")).alias("violations")))
    return found.filter(F.col("violations") > 0)


def integrity_audit(t: Tables, *, types: Sequence[tuple[str, str]] = LISTING_TYPES) -> DataFrame:
    """Violations per rule: unique keys, domains, required values, references. Clean rules show 0.

    Every table is read once, and folded to distinct keys before they are shuffled, so a hot parent is one row per task; the
    folded facts are stored, and each kind of rule reads them. Unique text compares as the database does, without regard to case,
    accents and trailing spaces; a key with a NULL part never repeats. Runs a job while it is built.
    """
    counts, names, targets = _facts(t, _row_rules(types))
    facts = materialize(counts, "audit-facts")
    unique = len(targets), len(targets) + len(UNIQUE_KEYS)
    referred = facts.filter(F.col("number") < len(targets)).withColumn("parent", F.array(*[F.lit(int(n)) for n in targets])[F.col("number")])
    known = facts.filter(F.col("number") >= len(names)).select(F.col("number").alias("parent"), "key")
    lost = referred.join(known, ["parent", "key"], "left_anti").select("number", F.col("n").alias("violations"))
    repeated = _repeated(facts.filter(F.col("number").between(unique[0], unique[1] - 1)))
    broken = facts.filter(F.col("number").between(unique[1], len(names) - 1)).select("number", F.col("n").alias("violations"))
    found = reduce(DataFrame.unionByName, (lost, repeated, broken)).select(_named(names).alias("rule"), "violations")
    axis = t.spark.createDataFrame([(n,) for n in names], "rule string")
    return zero_filled(found, axis, ["rule"], ["violations"])


def cascade_prune(t: Tables, gone_users: DataFrame, *, only: str | None = None) -> dict[str, DataFrame]:
    """What is left of every table, or of one, after users (column id) are deleted, following REFERENCES downwards.

    The ids lost per parent are stored once and read for every child. Runs jobs.
    """
    wanted = set(REFERENCES) if only is None else _with_parents(only)
    lost = {"users": materialize(gone_users.select("id").distinct(), "gone-users")}
    left = {"users": t.users.join(lost["users"], "id", "left_anti")}
    for table, columns in REFERENCES.items():
        if table not in wanted:
            continue
        rows = getattr(t, table)
        hits = []
        for column, parent in columns.items():
            ids = lost[parent].select(F.col("id").alias(column))
            if (table, column) in SET_NULL:
                marked = rows.join(ids.withColumn("_lost", F.lit(True)), column, "left")
                rows = marked.withColumn(column, F.when(F.col("_lost").isNull(), F.col(column))).select(*rows.columns)
            else:
                hits.append(ids)
        if table in _PARENTS and (only is None or table != only):
            doomed = [rows.join(ids, ids.columns, "left_semi").select("id") for ids in hits]
            lost[table] = materialize(reduce(DataFrame.unionByName, doomed).distinct(), f"gone-{table}")
        left[table] = reduce(lambda kept, ids: kept.join(ids, ids.columns, "left_anti"), hits, rows).select(*rows.columns)
    return left


def _with_parents(table: str) -> set[str]:
    return {table}.union(*(_with_parents(p) for p in REFERENCES.get(table, {}).values()))


_PARENTS = {parent for columns in REFERENCES.values() for parent in columns.values()}


def prune_counts(t: Tables, gone_users: DataFrame) -> DataFrame:
    """Rows left per table after the cascade, and threads that lost their listing."""
    left = cascade_prune(t, gone_users)
    parts = [f.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left") for name, f in left.items()]
    parts.append(left["threads"].agg(F.count_if(F.col("listing_id").isNull()).alias("rows_left")).select(
        F.lit("threads without listing").alias("table_name"), "rows_left"))
    return reduce(DataFrame.unionByName, parts)
