"""Registries of the output contract."""

from __future__ import annotations

# Names, codes and limits that must be exactly these for right results.
SCORES = {
    "S1": ("External Exploration", "source_breadth public_knowledge_use citation_depth"),
    "S2": ("Source Concentration", "domain_concentration publisher_concentration ownership_concentration"),
    "S3": ("Language Homogenization", "lexical_convergence syntactic_convergence rhetorical_convergence semantic_convergence"),
    "S4": ("Perspective Diversity", "frame_breadth argument_breadth cause_breadth action_breadth"),
    "S5": ("Model-Language Diffusion", "pattern_prevalence cross_domain_diffusion temporal_lead_lag"),
    "S6": ("Human Knowledge Contribution", "qa_contribution explanatory_contribution maintenance_contribution"),
    "S7": ("Employer AI Compulsion", "primary_level_pressure required_prevalence monitoring_or_enforcement_prevalence"),
    "S8": ("Novel Information Density", "claim_novelty perspective_novelty source_novelty"),
}
WARNINGS = (
    "EXPERIMENTAL LOW_SAMPLE_SIZE LOW_EFFECTIVE_SAMPLE_SIZE BASELINE_INCOMPLETE SOURCE_OUTAGE SOURCE_MIX_SHIFT COVERAGE_SHIFT "
    "TOPIC_OR_GENRE_CONFOUNDER BENCHMARK_REGRESSION EXTRACTOR_DRIFT LINEAGE_INCOMPLETE LICENSE_RESTRICTED CONFIDENCE_UNAVAILABLE "
    "RELATIVE_CHANGE_UNDEFINED VERSION_BREAK SUPPRESSED"
)
#: release: scores, evidence classes, approved studies.
RELEASES = {
    "contract-fixtures-v1": ("S1 S2 S3 S4 S5 S6 S7 S8", "descriptive", ""),
    "contract-fixtures-s3-exposure-v1": ("S3", "exposure_association", "study-fixture-exposure-v1"),
    "contract-fixtures-s7-causal-v1": ("S7", "causal_estimate", "study-fixture-causal-v1"),
}
LEVEL, REPLICATES = 0.95, 1000
EVIDENCE = "descriptive exposure_association causal_estimate"
NEEDS_STUDY = "exposure_association causal_estimate"
STATES = "experimental validated production retired"
TRENDS = "increasing decreasing stable insufficient not_applicable"
FIELDS = (
    "schema_version release_id study_release_id score_id score_name entity topic source_frame period evidence_class release_state score confidence "
    "uncertainty_interval sample coverage baseline current_value change trend components warnings suppression lineage versions calculated_at links"
)
OBJECTS = {
    "entity": "id type label version", "source_frame": "id label source_family_count version", "period": "id granularity start end",
    "confidence": "value method calibration_version", "uncertainty_interval": "lower upper level method replicates cluster_unit", "sample": "size effective_size unit",
    "coverage": "eligible_rate matched_rate entity_count source_count source_family_count complete dimensions", "baseline": "id start end value complete version",
    "change": "absolute relative", "suppression": "status reasons", "lineage": "data_snapshot_ids run_id manifest_sha256",
    "versions": "scorer feature_pipeline corpus benchmark ontology score_registry warning_registry release_registry", "links": "methodology benchmark release",
}
SCHEMA_VERSION = "observatory.score_output.v1"
CODES = (
    "schema_error unknown_warning invalid_period invalid_uncertainty missing_component unsupported_evidence_class study_release_required "
    "component_weight_mismatch arithmetic_mismatch"
)
# End of the fixed values.
