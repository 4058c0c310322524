"""The constraints of the warehouse's tables, by table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.operators.constraints import Check, Constraint, Reference, Required, Unique, one_of

#: What columns of a few values may hold.
CATEGORIES = ("dairy", "grain", "produce", "meat", "packaged", "seafood", "spice", "oil")
SOURCE_TYPES = ("fssai", "usfda", "efsa", "apeda", "state_health", "agmarknet")
NODE_TYPES = ("farm", "mandi", "processor", "warehouse", "brand", "retailer")
INFERENCE_TYPES = ("direct_test", "propagated", "insufficient_data")
USER_TIERS = ("consumer_free", "consumer_premium", "fmcg", "insurance")
DISPUTE_STATES = ("pending", "under_review", "resolved_removed", "resolved_kept", "resolved_flagged")
DISPUTE_TYPES = ("incorrect_data", "stale_data", "wrong_brand", "supply_chain_error", "other")
REQUEST_STATES = ("pending", "received", "partial", "appealed", "rejected")
FRAUD_OUTCOMES = ("confirmed_fraud", "false_positive", "needs_more_data")
AGE_GROUPS = ("child_1_3", "child_4_6", "child_7_9", "adolescent", "adult", "elderly", "pregnant")
SEXES = ("male", "female", "all")


def constraints(name: str, parents: dict[str, DataFrame], key: str = "id") -> list[Constraint]:
    """The constraints of a table. parents: the tables that it refers to, by name, each with its key; references to others aren't checked."""
    required = lambda *columns: [Required(c) for c in columns]
    to = lambda column, parent: [Reference(f"{column}_known", column, parents[parent], key)] if parent in parents else []
    unique = lambda *columns: [Unique("_".join(columns) + "_once", columns)]
    between = Check("confidence_score_range", F.col("confidence_score").between(0, 1)) if name == "records" else None
    tables = {
        "commodities": lambda: [*required("name", "category"), one_of("category", CATEGORIES), *unique("name")],
        "contaminants": lambda: [*required("name"), *unique("name")],
        "districts": lambda: [*required("name", "state"), *unique("census_code"), *unique("name", "state")],
        "mandis": lambda: [*required("name", "district_id"), *to("district_id", "districts"), *unique("agmarknet_id")],
        "labs": lambda: [*required("name", "tier"), Check("tier_value", F.col("tier").isin(1, 2, 3))],
        "brands": lambda: [*required("name"), *unique("name")],
        "records": lambda: [
            *required("source_type", "commodity_id", "contaminant_id", "confidence_score"), one_of("source_type", SOURCE_TYPES), between, *to("lab_id", "labs"), *to("commodity_id", "commodities"),
            *to("contaminant_id", "contaminants"), *to("district_id", "districts"), *to("mandi_id", "mandis"), *to("brand_id", "brands"), Check("review_outcome_value", F.col("review_outcome").isin(*FRAUD_OUTCOMES)),
        ],
        "nodes": lambda: [*required("node_type"), one_of("node_type", NODE_TYPES), *to("district_id", "districts"), *to("commodity_id", "commodities")],
        "edges": lambda: [*required("source", "target"), *to("source", "nodes"), *to("target", "nodes"), Check("ends_differ", F.col("source") != F.col("target"))],
        "aggregates": lambda: [*required("district_id", "commodity_id", "quarter"), *to("district_id", "districts"), *to("commodity_id", "commodities"), *unique("district_id", "commodity_id", "quarter")],
        "estimates": lambda: [*required("brand_id", "commodity_id", "inference_type"), one_of("inference_type", INFERENCE_TYPES), *to("brand_id", "brands"), *to("commodity_id", "commodities")],
        "users": lambda: [one_of("tier", USER_TIERS), *unique("email"), *unique("phone"), Check("email_or_phone", F.col("email").isNotNull() | F.col("phone").isNotNull()), *to("home_district_id", "districts")],
        "disputes": lambda: [*required("brand_id"), *to("brand_id", "brands"), one_of("status", DISPUTE_STATES), one_of("dispute_type", DISPUTE_TYPES)],
        "requests": lambda: [one_of("status", REQUEST_STATES)],
        "consumption": lambda: [*required("commodity_id"), *to("commodity_id", "commodities"), one_of("age_group", AGE_GROUPS), one_of("sex", SEXES), *unique("commodity_id", "state", "age_group", "sex", "source_year")],
    }
    return tables[name]()
