"""First-stage triage: a rule table over event facts, scored to one of three states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.evidence import confidence_score
from emberframe.operators.blocks import seen_around
from emberframe.operators.components import materialise


@dataclass(frozen=True)
class Rule:
    """``fire`` and ``clear``: (comparison, bound, points) that speak for or against a fire."""

    rule_id: str
    feature: str
    fire: tuple[str, float, int] | None
    clear: tuple[str, float, int] | None


#: The rules' bounds and points.
RULES = (
    Rule("FIRMS_CONFIDENCE", "mean_confidence", (">=", 0.75, 2), ("<=", 0.25, 2)),
    Rule("FRP_MAGNITUDE", "max_frp", (">=", 20.0, 2), ("<=", 2.0, 1)),
    Rule("REPEAT_OBSERVATIONS", "observation_count", (">=", 3.0, 2), ("<=", 1.0, 1)),
    Rule("VEGETATED_LAND_CONTEXT", "vegetated_fraction", (">=", 0.5, 1), None),
    Rule("URBAN_LAND_CONTEXT", "urban_fraction", None, (">=", 0.75, 2)),
    Rule("SETTLEMENT_PROXIMITY", "settlement_distance_km", None, ("<=", 1.0, 1)),
    Rule("PERSISTENT_HEAT_SOURCE", "persistent_heat_source_match", None, (">=", 1.0, 5)),
    Rule("VOLCANO_GEOTHERMAL_CONTEXT", "volcano_geothermal_distance_km", None, ("<=", 3.0, 5)),
    Rule("RECENT_RAINFALL", "recent_rainfall_mm", ("<=", 2.0, 1), (">=", 20.0, 1)),
    Rule("NEARBY_DETECTIONS", "nearby_detection_count", (">=", 2.0, 1), None),
)
#: Bounds that a feature's values must keep; counts are whole.
RANGES = {
    "vegetated_fraction": (0.0, 1.0),
    "urban_fraction": (0.0, 1.0),
    "settlement_distance_km": (0.0, None),
    "volcano_geothermal_distance_km": (0.0, None),
    "recent_rainfall_mm": (0.0, None),
    "nearby_detection_count": (0.0, None),
}
#: Points that one side needs.
DECISIVE = 4
STATES = ("LIKELY_FIRE", "AMBIGUOUS", "LIKELY_NON_FIRE")
FIRE, CLEAR, NEUTRAL, MISSING = "SUPPORTS_FIRE", "SUPPORTS_NON_FIRE", "NEUTRAL", "NOT_EVALUATED"


def nearby_detections(events: DataFrame, obs: DataFrame, radius_km: float = 10.0, hours: float = 24.0) -> DataFrame:
    """(event, nearby_detection_count): other events' detections around the centroid and the event's times; 0 is a row too.

    ``events``: event, lat, lon, first, last; ``obs``: event, latitude, longitude, ts.
    """
    asked = materialise(events.select("event", "lat", "lon", "first", "last"))
    counts = seen_around(asked, obs, radius_km, int(hours))
    return asked.select("event").join(counts, "event", "left").select("event", F.coalesce("n", F.lit(0)).alias("nearby_detection_count"))


def confidence_summary(obs: DataFrame) -> DataFrame:
    """(event, mean_confidence, scored, seen): mean over the detections whose confidence can be read."""
    score = confidence_score(F.col("confidence"))
    return obs.groupBy("event").agg(F.avg(score).alias("mean_confidence"), F.count(score).alias("scored"), F.count("*").alias("seen"))


def _checked(feature: str) -> Column:
    """A feature's value; one that isn't finite or out of its range fails the query."""
    value = F.col(feature).cast("double")
    low, high = RANGES.get(feature, (None, None))
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    bad = bad if low is None else bad | (value < low)
    bad = bad if high is None else bad | (value > high)
    bad = bad | (value != F.floor(value)) if feature.endswith("_count") else bad
    return F.when(bad, F.raise_error(F.lit(f"{feature} is out of range")).cast("double")).otherwise(value)


def rule_evaluations(facts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Long table (event, nth, rule_id, feature, value, effect, points, evidence_id, quality); every rule has a row for every event.

    ``facts`` holds event and the rules' features; one that is null or not there is NOT_EVALUATED, which is not a negative.
    """

    def holds(value: Column, test: tuple[str, float, int] | None) -> Column:
        return F.lit(False) if test is None else (value >= test[1] if test[0] == ">=" else value <= test[1])

    rows = []
    for nth, rule in enumerate(rules):
        value = _checked(rule.feature) if rule.feature in facts.columns else F.lit(None).cast("double")
        effect = F.when(value.isNull(), MISSING).when(holds(value, rule.fire), FIRE).when(holds(value, rule.clear), CLEAR).otherwise(NEUTRAL)
        points = F.when(value.isNull(), 0).when(holds(value, rule.fire), rule.fire[2] if rule.fire else 0).when(holds(value, rule.clear), rule.clear[2] if rule.clear else 0).otherwise(0)
        rows.append(F.struct(F.lit(nth).alias("nth"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.feature).alias("feature"), value.alias("value"), effect.alias("effect"), points.alias("points")))
    long = facts.select("event", F.explode(F.array(*rows)).alias("r")).select("event", "r.*")
    there = F.col("value").isNotNull()
    return long.withColumns({
        "evidence_id": F.when(there, F.concat_ws("_", F.lit("DERIVED_STAGE1"), F.col("event").cast("string"), F.when(F.col("feature") == "mean_confidence", "confidence").otherwise(F.col("feature")))),
        "quality": F.when(there, F.when(F.col("feature") == "mean_confidence", 0.65).otherwise(0.82)),
    })


def decisions(evaluations: DataFrame) -> DataFrame:
    """(event, fire_score, non_fire_score, state, decisive_rules, missing_rules): exactly one side with enough points decides."""
    side = lambda effect: F.sum(F.when(F.col("effect") == effect, F.col("points")).otherwise(0))
    named = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("nth", "rule_id")))), lambda x: x["rule_id"])
    a = evaluations.groupBy("event").agg(
        side(FIRE).alias("fire_score"), side(CLEAR).alias("non_fire_score"), named(F.col("points") > 0).alias("decisive_rules"), named(F.col("effect") == MISSING).alias("missing_rules")
    )
    fire, clear = F.col("fire_score") >= DECISIVE, F.col("non_fire_score") >= DECISIVE
    return a.withColumn("state", F.when(fire & ~clear, STATES[0]).when(clear & ~fire, STATES[2]).otherwise(STATES[1]))


def metrics_of_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence rows as context metrics: those with an id, a source and a value; an unknown quality is 0.8, an unknown unit 'unknown'."""
    ok = evidence.where((F.coalesce(F.trim("evidence_id"), F.lit("")) != "") & (F.coalesce(F.trim("source"), F.lit("")) != "") & F.col("value").isNotNull())
    quality = F.coalesce("quality", F.lit(0.8))
    checked = F.when(quality.between(0, 1), quality).otherwise(F.raise_error(F.lit("a quality is out of range")).cast("double"))
    return ok.withColumns({"quality": checked, "unit": F.coalesce("unit", F.lit("unknown"))})


def evidence_of_metrics(metrics: DataFrame, evaluated_at: str) -> DataFrame:
    """Context metrics as evidence rows again; what lacks a time or a reference gets the evaluation's and the event's."""
    return metrics.withColumns({"retrieved_at": F.coalesce("retrieved_at", F.lit(evaluated_at)), "raw_reference": F.coalesce("raw_reference", F.col("event").cast("string"))})


#: Columns that differ from run to run.
VOLATILE = ("retrieved_at",)


def without_volatile(rows: DataFrame) -> DataFrame:
    return rows.drop(*VOLATILE)


def triage_summary(decided: DataFrame) -> DataFrame:
    """(state, events, queue, queue_compression): all three states, those without events too."""
    states = F.explode(F.array(*map(F.lit, STATES))).alias("state")
    counts = decided.groupBy("state").count()
    total = decided.agg(F.count("*").alias("n"), F.count_if(F.col("state") != STATES[2]).alias("queue"))
    rows = decided.sparkSession.range(1).select(states).join(counts, "state", "left").crossJoin(F.broadcast(total))
    return rows.select("state", F.coalesce("count", F.lit(0)).alias("events"), "queue", F.bround(F.col("n") / F.when(F.col("queue") > 0, F.col("queue")), 4).alias("queue_compression"))
