"""The output contract: what a score record must be, as one column of violation codes.

A record is a JSON text. Its keys are looked at as they are written, so that unknown and missing ones show; its
values are read once into a typed column. Registries are small literals, so checking needs no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import registry as R

_TYPES = {
    "schema_version": "string", "release_id": "string", "study_release_id": "string", "score_id": "string", "score_name": "string", "period": "struct<id:string,granularity:string,start:string,end:string>",
    "evidence_class": "string", "release_state": "string", "score": "double", "confidence": "struct<value:double,method:string,calibration_version:string>",
    "uncertainty_interval": "struct<lower:double,upper:double,level:double,method:string,replicates:int,cluster_unit:string>", "coverage": "struct<eligible_rate:double,matched_rate:double,complete:boolean>",
    "baseline": "struct<value:double,complete:boolean>", "current_value": "double", "change": "struct<absolute:double,relative:double>", "trend": "string",
    "components": "map<string,struct<raw_value:double,normalized_value:double,weight:double,unit:string,status:string>>", "warnings": "array<struct<code:string,severity:string,message:string>>",
    "suppression": "struct<status:string,reasons:array<string>>", "lineage": "struct<manifest_sha256:string>", "versions": "map<string,string>",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in _TYPES.items())
TOLERANCE = 1e-9


def _any(*conditions: Column) -> Column:
    """Whether one of them holds; an unknown one doesn't."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def _differs(keys: Column, names: str) -> Column:
    return ~F.array_sort(keys).eqNullSafe(F.array(*map(F.lit, sorted(names.split()))))


def _out(x: Column, low: float, high: float) -> Column:
    return (x < low) | (x > high)


def _lookup(key: Column, values: dict[str, str]) -> Column:
    """The listed words for a key; none for an unknown one."""
    entries = [e for k, v in values.items() for e in (F.lit(k), F.array(*map(F.lit, v.split())) if v else F.array().cast("array<string>"))]
    return F.coalesce(F.element_at(F.create_map(*entries), key), F.array().cast("array<string>"))


def rules(p: str = "p", payload: str = "payload") -> dict[str, Column]:
    """Violation codes and their conditions, in the order in which they are told."""
    c = lambda path: F.col(f"{p}.{path}")
    parts = F.map_values(c("components"))
    suppressed = c("suppression.status") == "suppressed"
    held = [c("score"), c("confidence.value"), c("uncertainty_interval.lower"), c("uncertainty_interval.upper"), c("baseline.value"), c("current_value"), c("change.absolute")]
    total = lambda f: F.aggregate(parts, F.lit(0.0), lambda a, x: a + f(x))
    required = _lookup(c("score_id"), {k: v[1] for k, v in R.SCORES.items()})
    keys = F.map_keys(c("components"))
    schema = [
        _differs(F.json_object_keys(payload), R.FIELDS), *(_differs(F.json_object_keys(F.get_json_object(payload, f"$.{o}")), names) for o, names in R.OBJECTS.items()),
        c("schema_version") != R.SCHEMA_VERSION, ~c("score_id").isin(*R.SCORES), ~c("evidence_class").isin(*R.EVIDENCE.split()), ~c("release_state").isin(*R.STATES.split()),
        ~c("trend").isin(*R.TRENDS.split()), _out(c("score"), 0, 100), _out(c("confidence.value"), 0, 1), _out(c("coverage.eligible_rate"), 0, 1), _out(c("coverage.matched_rate"), 0, 1),
        ~c("lineage.manifest_sha256").rlike("^[0-9a-f]{64}$"), F.exists(F.map_values(c("versions")), lambda v: ~v.rlike(r"^\d+\.\d+\.\d+$")), ~c("period.start").rlike(r"^\d{4}-\d{2}-\d{2}$"),
        suppressed & _any(*(x.isNotNull() for x in held), c("trend") != "insufficient", F.size(c("suppression.reasons")) < 1, F.exists(parts, lambda x: x["raw_value"].isNotNull() | ~x["status"].isin("missing", "suppressed"))),
        ~suppressed & _any(*(x.isNull() for x in held), ~c("coverage.complete"), ~c("baseline.complete"), F.exists(parts, lambda x: x["raw_value"].isNull() | ~x["status"].isin("available", "degraded"))),
    ]
    change = c("current_value") - c("baseline.value")
    uncertain = [c("uncertainty_interval.lower") > c("uncertainty_interval.upper"), c("uncertainty_interval.level") != R.LEVEL, c("uncertainty_interval.replicates") < R.REPLICATES]
    arithmetic = [
        F.abs(c("score") - total(lambda x: x["weight"] * x["normalized_value"])) > TOLERANCE, F.abs(c("change.absolute") - change) > TOLERANCE,
        F.abs(c("change.relative") - F.try_divide(change, c("baseline.value"))) > TOLERANCE,
    ]
    listed = lambda k: _lookup(c("release_id"), {r: v[k] for r, v in R.RELEASES.items()})
    conditions = [
        _any(*schema), _any(F.exists(c("warnings"), lambda w: ~w["code"].isin(*R.WARNINGS.split()))), _any(c("period.start") > c("period.end")), _any(*uncertain),
        _any(F.size(F.array_except(required, keys)) > 0), _any(~F.array_contains(listed(0), c("score_id")), ~F.array_contains(listed(1), c("evidence_class"))),
        _any(c("evidence_class").isin(*R.NEEDS_STUDY.split()) & (c("study_release_id").isNull() | ~F.array_contains(listed(2), c("study_release_id")))),
        _any(F.abs(total(lambda x: x["weight"]) - 1) > TOLERANCE), _any(*arithmetic),
    ]
    return dict(zip(R.CODES.split(), conditions, strict=True))


def violations(records: DataFrame, payload: str = "payload") -> DataFrame:
    """``records`` and ``codes``, the violations joined by commas, and ``error``, the first of them or null. A text that is no record is a schema_error."""
    read = records.withColumn("p", F.from_json(payload, SCHEMA))
    codes = F.array_compact(F.array(*(F.when(cond, code) for code, cond in rules("p", payload).items())))
    sound = F.json_object_keys(payload).isNotNull()
    got = read.withColumn("codes", F.when(sound, codes).otherwise(F.array(F.lit("schema_error"))))
    return got.withColumn("error", F.try_element_at("codes", F.lit(1))).withColumn("codes", F.array_join("codes", ",")).drop("p")
