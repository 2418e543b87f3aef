"""Semantic forms: structured input, rule forms of texts, their feature strings, motifs, lift and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import models as MO
from corpusloom.operators import sequences as Q
from corpusloom.plans.documents import _forms_sql, phrase_forms
from corpusloom.plans.models import labels
from corpusloom.queries import query
from corpusloom.sources.tables import table

#: (type of sequence, id, label, pattern, score). The last pattern asks for missing bindings.
MOTIFS = (
    ("logic", "changing_landscape_need_solution_abstract_benefit", "landscape, need, solution, benefit", "ChangingLandscapeClaim|OrganizationNeedClaim|AISolutionClaim|AbstractBenefitClaim", 86),
    ("logic", "need_then_solution", "need, solution", "OrganizationNeedClaim|AISolutionClaim", 60), ("concepts", "audience_in_workflow", "audience in its workflow", "GenericAudience|SpecificWorkflow", 40),
    ("propositions", "solution_benefits_audience", "benefit for an audience", "AbstractBusinessOutcome benefits GenericAudience", 55), ("missing", "benefit_without_measure", "nothing measured", "metric|baseline|timeframe", 30),
)
_ITEM = r"[^|]+"


def _items(field: str) -> str:
    return f"list_filter(string_split({field}, '|'), lambda x: x <> '')"


_FEATURES = f"""(SELECT doc_id, unnest(list_distinct(list_concat(list_concat(list_transform(c, lambda x: 'concept:' || x), list_transform(range(1, len(c)), lambda i: 'concept_set:' || array_to_string(c[i:i + 1], '|'))),
  list_concat(list_concat(list_transform(range(1, len(c) - 1), lambda i: 'concept_set:' || array_to_string(c[i:i + 2], '|')), ['logic_seq:' || logic]), list_concat(list_concat(list_transform(l, lambda x: 'logic:' || x), list_transform(p, lambda x: 'proposition:' || x)),
  list_concat(list_transform(m, lambda x: 'missing:' || x), list_transform(g, lambda x: 'grounded:' || x))))))) AS feature
FROM (SELECT *, {_items('concepts')} AS c, {_items('logic')} AS l, {_items('propositions')} AS p, {_items('missing')} AS m, {_items('grounded')} AS g FROM ({_forms_sql()})))"""


def form_features(forms: DataFrame) -> DataFrame:
    """doc_id and the distinct feature strings of its form; the joined logic is one even when empty."""
    some = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    named = lambda prefix, xs: F.transform(xs, lambda x: F.concat(F.lit(prefix), x))
    grams = [F.regexp_extract_all("concepts", F.lit(f"(?=({r'\|'.join([_ITEM] * n)})){_ITEM}"), F.lit(1)) for n in (2, 3)]
    every = F.concat(
        named("concept:", some("concepts")), *(named("concept_set:", g) for g in grams), F.array(F.concat(F.lit("logic_seq:"), "logic")), named("logic:", some("logic")),
        named("proposition:", some("propositions")), named("missing:", some("missing")), named("grounded:", some("grounded")),
    )
    return Q.exploded(forms, ("doc_id",), F.array_distinct(every), "feature")


@query(f"SELECT feature, count(*)::BIGINT AS docs FROM {_FEATURES} GROUP BY 1")
def form_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_features(phrase_forms(spark, sf_dir)).groupBy("feature").agg(F.count("*").alias("docs"))


def _holds(sequence: str, pattern: str) -> Column:
    """Whether the pattern stands, in one piece, in a sequence joined by bars."""
    bar = F.lit("|")
    return F.contains(F.concat(bar, sequence, bar), F.lit(f"|{pattern}|"))


def motifs(forms: DataFrame) -> DataFrame:
    """``forms`` and ``motifs``: the motifs a form matches, best score first, as structs of id, label and score."""
    each = []
    for kind, name, label, pattern, score in MOTIFS:
        found = F.array_size(F.array_except(F.split(F.lit(pattern), r"\|"), F.split("missing", r"\|"))) == 0 if kind == "missing" else _holds(kind, pattern)
        each.append(F.when(found, F.struct((-F.lit(score)).alias("by"), F.lit(name).alias("id"), F.lit(label).alias("label"), F.lit(score).alias("score"))))
    return forms.withColumn("motifs", F.array_sort(F.array_compact(F.array(*each))))


_MOTIF_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {f'len(list_filter(string_split({chr(39)}{p}{chr(39)}, {chr(39)}|{chr(39)}), lambda x: NOT list_contains(string_split(missing, {chr(39)}|{chr(39)}), x))) = 0' if k == 'missing' else f'contains({chr(39)}|{chr(39)} || {k} || {chr(39)}|{chr(39)}, {chr(39)}|{p}|{chr(39)})'} THEN {{'by': {-s}, 'id': '{n}', 'label': '{lab}', 'score': {s}}} END"
    for k, n, lab, p, s in MOTIFS
) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, len(ms)::BIGINT AS matched, coalesce(array_to_string(list_transform(list_sort(ms), lambda x: x.id || '=' || x.score), ','), '') AS motifs FROM (SELECT doc_id, {_MOTIF_SQL} AS ms FROM ({_forms_sql()}))")
def motif_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs of every kind of sequence, contiguous, with their scores."""
    got = motifs(phrase_forms(spark, sf_dir))
    return got.select("doc_id", F.size("motifs").cast("long").alias("matched"), F.array_join(F.transform("motifs", lambda m: F.concat_ws("=", m["id"], m["score"].cast("string"))), ",").alias("motifs"))


_FLIFT = f"""(WITH n AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM documents JOIN labels USING (doc_id) WHERE text <> ''),
c AS (SELECT feature, count(*) FILTER (quality = 1) AS ai, count(*) FILTER (quality = 0) AS human FROM {_FEATURES} JOIN (SELECT doc_id, quality FROM labels JOIN documents USING (doc_id) WHERE text <> '') USING (doc_id) GROUP BY 1)
SELECT feature, ((ai + 1) / (n1 + 2)) / CASE WHEN n0 > 0 THEN (human + 1) / (n0 + 2) ELSE 1 / (n1 + 2) END AS lift FROM c, n)"""


@query(f"""
WITH f AS ({_forms_sql()}),
c AS (SELECT doc_id, sum(CASE WHEN lift > 1 THEN least(28, round_even((lift - 1) * 16, 0)) WHEN lift < 1 THEN -least(18, round_even((1 - lift) * 16, 0)) ELSE 0 END) AS v FROM {_FEATURES} JOIN {_FLIFT} USING (feature) GROUP BY 1),
s AS (SELECT f.doc_id, greatest(0, least(100, 50 + coalesce(v, 0) - 4 * len({_items('grounded')})))::INT AS score, list_sort({_MOTIF_SQL}) AS ms, len({_items('logic')}) AS steps FROM f LEFT JOIN c USING (doc_id))
SELECT doc_id, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN len(ms) > 0 AND score >= 70 THEN 'strong: ' || (ms[1]).label WHEN len(ms) > 0 AND score >= 45 THEN 'moderate: ' || (ms[1]).label WHEN len(ms) > 0 THEN 'grounded: ' || (ms[1]).label WHEN steps >= 4 THEN 'abstract steps' ELSE 'none' END AS summary FROM s""")
def semantic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift of a form's features, less its groundings, with the best motif in the summary."""
    forms = motifs(phrase_forms(spark, sf_dir))
    f = form_features(forms)
    some = lambda c: F.size(F.filter(F.split(c, r"\|"), lambda x: x != ""))
    counted = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id").join(labels(spark, sf_dir), "doc_id")
    scored = MO.lift_scores(forms.select("doc_id"), f, MO.lift(f, counted), forms.select("doc_id", some("grounded").alias("groundings")))
    best, any_ = F.col("motifs")[0]["label"], F.size("motifs") > 0
    say = lambda how: F.concat(F.lit(how), best)
    summary = F.when(any_ & (F.col("score") >= 70), say("strong: ")).when(any_ & (F.col("score") >= 45), say("moderate: ")).when(any_, say("grounded: ")).when(F.col("steps") >= 4, "abstract steps").otherwise("none")
    return scored.join(forms.select("doc_id", "motifs", some("logic").alias("steps")), "doc_id").select("doc_id", "score", "band", summary.alias("summary"))


def structured_form(rows: DataFrame) -> DataFrame:
    """concepts, logic, propositions, missing and grounded of structured input, each without repeats, joined by bars.

    ``rows`` has doc_id, concepts (array of struct label, term, id) and propositions (array of struct subject,
    predicate, object, sources). A proposition without sources lacks its grounding; no concepts, or no
    propositions, are missing bindings themselves.
    """
    node = lambda n: F.coalesce(*(F.when(F.trim(n[k]) != "", F.trim(n[k])) for k in ("label", "term", "id")), F.lit(""))
    joined = lambda xs: F.array_join(F.array_distinct(F.filter(xs, lambda x: x != "")), "|")
    said = lambda p: F.array_join(F.filter(F.array(p["subject"], p["predicate"], p["object"]), lambda x: F.trim(x) != ""), " ")
    c, p = F.coalesce("concepts", F.array().cast(rows.schema["concepts"].dataType)), F.coalesce("propositions", F.array().cast(rows.schema["propositions"].dataType))
    bare = F.filter(p, lambda x: F.coalesce(F.array_size(x["sources"]), F.lit(0)) == 0)
    missing = F.array_compact(F.array(F.when(F.size(bare) > 0, "sumo_grounding"), F.when(F.size(p) == 0, "sumo_proposition"), F.when(F.size(c) == 0, "sumo_concept")))
    return rows.select(
        "doc_id", joined(F.transform(c, node)).alias("concepts"), joined(F.transform(p, lambda x: F.trim(F.coalesce(x["predicate"], F.lit(""))))).alias("logic"),
        joined(F.transform(p, said)).alias("propositions"), F.array_join(missing, "|").alias("missing"), joined(F.flatten(F.transform(p, lambda x: F.coalesce(x["sources"], F.array().cast("array<string>"))))).alias("grounded"),
    )


def preferred(rows: DataFrame, forms: list[str]) -> DataFrame:
    """doc_id, the first of the named struct columns that is not null as ``form``, and its name as ``form_source``."""
    return rows.select("doc_id", F.coalesce(*forms).alias("form"), F.coalesce(*(F.when(F.col(f).isNotNull(), f) for f in forms)).alias("form_source"))


@query("""
WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sumo_map' WHEN 1 THEN 'sumo_output' WHEN 2 THEN 'sumo_sequence_form' ELSE 'text' END AS form_source FROM documents)
SELECT r.doc_id, form_source, CASE form_source WHEN 'sumo_map' THEN 'Process|Human|c3' WHEN 'sumo_output' THEN '' WHEN 'sumo_sequence_form' THEN 'given' ELSE f.concepts END AS concepts,
  CASE form_source WHEN 'sumo_map' THEN 'uses|makes' WHEN 'sumo_output' THEN 'uses' WHEN 'sumo_sequence_form' THEN '' ELSE f.logic END AS logic,
  CASE form_source WHEN 'sumo_map' THEN 'Human uses Process|makes Thing' WHEN 'sumo_output' THEN 'Human uses Process' WHEN 'sumo_sequence_form' THEN '' ELSE f.propositions END AS propositions,
  CASE form_source WHEN 'sumo_map' THEN 'sumo_grounding' WHEN 'sumo_output' THEN 'sumo_concept' WHEN 'sumo_sequence_form' THEN '' ELSE f.missing END AS missing,
  CASE form_source WHEN 'sumo_map' THEN 'doc' WHEN 'sumo_output' THEN 'doc|web' WHEN 'sumo_sequence_form' THEN '' ELSE f.grounded END AS grounded
FROM r JOIN (__FORMS__) f ON f.doc_id = r.doc_id""".replace("__FORMS__", _forms_sql()))
def structured_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms by preference: structured input of two kinds, a given form, else the rules over the text."""
    concept = lambda *xs: "named_struct('label', {}, 'term', {}, 'id', {})".format(*("cast(null as string)" if x is None else f"'{x}'" for x in xs))
    said = lambda s, p, o, *src: f"named_struct('subject', '{s}', 'predicate', '{p}', 'object', '{o}', 'sources', array({', '.join(f"'{x}'" for x in src)}))"
    concepts = "array(" + ", ".join([concept("Process", None, "c1"), concept("", "Human", None), concept(None, " ", "c3"), concept("Process", "x", None)]) + ")"
    first = f"array({said('Human', 'uses', 'Process', 'doc')}, {said('', 'makes', 'Thing').replace('array()', 'cast(array() as array<string>)')}, {said('Human', 'uses', 'Process', 'doc')})"
    second = f"array({said('Human', 'uses', 'Process', 'doc', 'web')})"
    rows = table(spark, sf_dir, "documents").select("doc_id")
    given = rows.select("doc_id", F.expr(f"CASE WHEN doc_id % 4 = 0 THEN {concepts} END").alias("concepts"), F.expr(f"CASE doc_id % 4 WHEN 0 THEN {first} WHEN 1 THEN {second} END").alias("propositions"))
    fields = ("concepts", "logic", "propositions", "missing", "grounded")
    form = structured_form(given).select("doc_id", F.struct(*fields).alias("s"))
    legacy = phrase_forms(spark, sf_dir).select("doc_id", F.struct(*fields).alias("text"))
    empty = F.struct(F.lit("given").alias("concepts"), *(F.lit("").alias(f) for f in fields[1:]))
    every = form.join(legacy, "doc_id").select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("s")).alias("sumo_map"), F.when(F.col("doc_id") % 4 == 1, F.col("s")).alias("sumo_output"), F.when(F.col("doc_id") % 4 == 2, empty).alias("sumo_sequence_form"), "text"
    )
    return preferred(every, ["sumo_map", "sumo_output", "sumo_sequence_form", "text"]).select("doc_id", "form_source", *(f"form.{f}" for f in fields))
