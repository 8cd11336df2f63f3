"""All registered queries: name -> (Spark builder, SQL twin or None)."""

from __future__ import annotations

from heliofleet.plans import answer_plans, fleet_plans, ingest_plans, routing_plans, streaming_plans, text_plans

REGISTERED = {
    **fleet_plans.REGISTERED,
    **ingest_plans.REGISTERED,
    **text_plans.REGISTERED,
    **routing_plans.REGISTERED,
    **answer_plans.REGISTERED,
    **streaming_plans.REGISTERED,
}
