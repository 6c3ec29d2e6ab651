"""Reading verdicts, prices and filters out of free-text model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.functions import replies as r


def verdict_parse(rows: DataFrame) -> DataFrame:
    """Moderation verdict and reason; a readable object without a reason quotes the whole reply."""
    fields = F.col("fields")
    none, broken = F.col("object") == "", fields.isNull()
    status = F.when(none | broken, r.VERDICT_DEFAULT).otherwise(r.field_or(fields, "status", F.lit(r.VERDICT_DEFAULT)))
    reason = F.when(none, r.VERDICT_NO_OBJECT).when(broken, r.VERDICT_BROKEN).otherwise(r.field_or(fields, "reason", F.col("reply")))
    return r.with_fields(rows, "reply").select("doc_id", status.alias("status"), reason.alias("reason"))


def price_parse(rows: DataFrame) -> DataFrame:
    """Suggested price as text, and the reason; without an object the reply itself is the reason."""
    fields = F.col("fields")
    none, broken = F.col("object") == "", fields.isNull()
    price = F.when(none | broken, r.PRICE_DEFAULT).otherwise(r.field_or(fields, "price", F.lit(r.PRICE_DEFAULT)))
    reason = F.when(none, F.col("reply")).when(broken, r.PRICE_REASON_BROKEN).otherwise(
        r.field_or(fields, "reason", F.lit(r.PRICE_REASON_DEFAULT)))
    return r.with_fields(rows, "reply").select("doc_id", price.alias("price"), reason.alias("reason"))
