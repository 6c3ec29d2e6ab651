import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from boxoffice.schema import SCHEMAS  # noqa: E402
from boxoffice.session import local_session  # noqa: E402
from boxoffice.sources.tables import Tables  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "boxoffice-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


def ts(text):
    return datetime.fromisoformat(text)


def frame(spark, schema, rows):
    """Rows as dicts; absent columns are NULL, numbers in text columns become text."""
    def fit(value, field):
        return str(value) if isinstance(value, int) and field.dataType.typeName() == "string" else value
    return spark.createDataFrame([tuple(fit(r.get(f.name), f) for f in schema.fields) for r in rows], schema)


@pytest.fixture
def tables(spark):
    """Literal tables: ``tables(users=[{...}], listings=[...])``; tables not given are empty."""
    def build(**given):
        return Tables.of(spark, **{n: frame(spark, s, given.get(n, [])) for n, s in SCHEMAS.items()})
    return build


def user(id, role="user", **more):
    return {"id": id, "name": f"n{id}", "email": f"e{id}@x.y", "role": role, "created_at": ts("2026-01-01"), "is_banned": False, **more}


def listing(id, creator_id=900, **more):
    base = {"title": f"t{id}", "type": "concert", "date_start": ts("2026-06-01T18:00"), "capacity": 10, "price": Decimal("0.00"),
            "status": "published", "created_at": ts("2026-01-01")}
    return {"id": id, "creator_id": creator_id, **base, **more}


def reg(id, user_id, listing_id, status="confirmed", **more):
    return {"id": id, "user_id": user_id, "listing_id": listing_id, "ticket_code": f"C{id}", "status": status, "checked_in": False,
            "created_at": ts("2026-03-01"), **more}


def pay(registration_id, amount, status="success", **more):
    return {"registration_id": registration_id, "amount": Decimal(amount), "method": "card", "status": status,
            "created_at": ts("2026-03-02"), **more}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
