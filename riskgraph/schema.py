"""Declared schemas of the records that are written as JSON and read back."""

from __future__ import annotations

#: A review draft; the fields in other languages are optional.
DRAFT_RECORD = (
    "txId long, risk_score int, risk_level string, risk_summary string, risk_summary_zh string, "
    "triggered_reason_codes array<struct<rule_id:string,rule_name:string,description:string,description_zh:string>>, "
    "suspicious_behavior_description array<string>, suspicious_behavior_description_zh array<string>, "
    "evidence_references array<struct<rule_id:string,evidence:string>>, missing_information array<string>, missing_information_zh array<string>, "
    "human_review_questions array<string>, human_review_questions_zh array<string>, suggested_next_review_action string, "
    "suggested_next_review_action_zh string, analyst_decision string, llm_status string")

#: The dataset summary.
DATASET_SUMMARY = (
    "keyFactors struct<nodeCount:long,directedEdgeCount:long,timeStepCount:long,timeStepRange:array<int>,"
    "rawFeatureCountIncludingTxIdAndTimeStep:int,anonymousFeatureCount:int>, labelDistribution map<string,long>, "
    "graphSummary struct<directedEdgeCount:long,averageDirectedDegreeApprox:double,weakComponentCount:long,largestWeakComponentSize:long,"
    "singleNodeComponentCount:long>, "
    "generatedDemoCaseSummary struct<maxDemoCases:long,riskBandDistribution:map<string,long>,demoLabelDistribution:map<string,long>>")
