"""Evidence, review contexts, template drafts, draft requests and responses.

All per-case work is row-local (struct / array / map expressions); the only
grouping is the retrieved chunks (at most k per case, a bounded group).
Evidence is kept long (id, rule, field, numeric value, text value) as the
canonical form; maps and texts are built from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph import config as C
from riskgraph.functions.pyjson import json_object, json_text
from riskgraph.functions.text import py_float_text

REVIEW_OBJECT_TYPE = C.REVIEW_OBJECT_TYPE


def _value_text(field: str, kind: str) -> Column:
    c = F.col(field)
    if kind == "int":
        return c.cast("long").cast("string")
    if kind == "double":
        return py_float_text(c)
    return c.cast("string")


def _value_num(field: str, kind: str) -> Column:
    if kind == "text":
        return F.lit(None).cast("double")
    return F.col(field).cast("double")


def evidence_rows(cases: DataFrame, rule_ids=C.SUPPORTED_RULE_IDS) -> DataFrame:
    """X11: (id, rule_id, field_pos, field, num_value, text_value) for every hit rule."""
    entries = []
    for rid in rule_ids:
        for pos, (field, kind) in enumerate(C.EVIDENCE_FIELDS[rid], start=1):
            entries.append(F.when(F.col(f"{rid}_hit"), F.struct(
                F.lit(rid).alias("rule_id"), F.lit(pos).alias("field_pos"), F.lit(field).alias("field"),
                _value_num(field, kind).alias("num_value"), _value_text(field, kind).alias("text_value"),
            )))
    arr = F.filter(F.array(*entries), lambda x: x.isNotNull())
    return cases.select("id", F.inline(arr))


def evidence_text_expr(rid: str) -> Column:
    """X10: "field: value, field: value" for one rule (the note excluded)."""
    parts = [F.concat(F.lit(f"{field}: "), _value_text(field, kind)) for field, kind in C.EVIDENCE_FIELDS[rid]]
    return F.concat_ws(", ", *parts)


def _all_evidence_fields() -> list[tuple[str, str]]:
    seen: dict[str, str] = {}
    for rid in C.SUPPORTED_RULE_IDS:
        for field, kind in C.EVIDENCE_FIELDS[rid]:
            seen.setdefault(field, kind)
    return list(seen.items())


_SPARK_KIND = {"int": "long", "double": "double", "text": "string"}


def evidence_values_expr(rid: str) -> Column:
    """Typed evidence of one rule (numbers stay numbers) with its note, as a
    struct over all evidence fields; fields of other rules are NULL and are
    left out when written as JSON."""
    own = {f for f, _ in C.EVIDENCE_FIELDS[rid]}
    parts = [
        (F.col(f).cast(_SPARK_KIND[k]) if f in own else F.lit(None).cast(_SPARK_KIND[k])).alias(f)
        for f, k in _all_evidence_fields()
    ]
    return F.struct(*parts, F.lit(C.PROXY_NOTES[rid]).alias("proxy_note"))


def _rule_doc(rid: str) -> Column:
    name, pdr, desc, limit = C.RULE_DOCS[rid]
    return F.struct(F.lit(name).alias("rule_name"), F.lit(pdr).alias("pdr_rule_name"),
                    F.lit(desc).alias("description"), F.lit(limit).alias("dataset_limit"))


def triggered_rule_structs(rule_ids=C.SUPPORTED_RULE_IDS) -> Column:
    """Array of triggered-rule structs in rule order."""
    items = []
    for rid in rule_ids:
        name, pdr, _desc, _limit = C.RULE_DOCS[rid]
        items.append(F.when(F.col(f"{rid}_hit"), F.struct(
            F.lit(rid).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(pdr).alias("pdr_rule_name"),
            F.lit("triggered").alias("status"), F.col(f"{rid}_score").cast("int").alias("score"),
            evidence_values_expr(rid).alias("evidence_fields"), _rule_doc(rid).alias("rule_doc"),
        )))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def draft_notes(rule_ids=C.SUPPORTED_RULE_IDS) -> Column:
    """What a template draft says about each triggered rule, in rule order."""
    items = [F.when(F.col(f"{rid}_hit"), F.struct(
        F.lit(rid).alias("rule_id"), F.lit(C.RULE_DOCS[rid][0]).alias("rule_name"), F.col(f"{rid}_score").cast("int").alias("score"),
        evidence_text_expr(rid).alias("evidence_text"), F.lit(C.PROXY_NOTES[rid]).alias("proxy_note"))) for rid in rule_ids]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def unsupported_rule_struct() -> Column:
    rid = "R006"
    name, pdr, _d, _l = C.RULE_DOCS[rid]
    ev = F.struct(F.lit("unavailable").alias("status"), F.array(*[F.lit(m) for m in C.UNSUPPORTED_MISSING_FIELDS]).alias("missing_fields"),
                  F.lit(C.UNSUPPORTED_NOTE).alias("proxy_note"))
    return F.struct(F.lit(rid).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(pdr).alias("pdr_rule_name"),
                    F.lit("unsupported_by_dataset").alias("status"), F.lit(0).alias("score"),
                    ev.alias("evidence_fields"), _rule_doc(rid).alias("rule_doc"))


def chunks_per_case(retrieved: DataFrame) -> DataFrame:
    """(id, chunks array) in rank order; each group has at most k rows."""
    s = F.struct(
        F.col("chunk_rank").alias("chunk_rank"), "source_id", "title", "publisher", "url", "page", "chunk_id",
        F.col("excerpt").alias("text"), "retrieval_score",
    )
    return retrieved.groupBy("id").agg(F.sort_array(F.collect_list(s)).alias("chunks")).select(
        "id", F.transform("chunks", lambda c: c.dropFields("chunk_rank")).alias("retrieved_pdf_chunks"))


def review_contexts(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """C4: one nested context per case (cases = review queue rows).  ``id`` and ``draft_notes`` serve
    later steps and are not part of the record (``context_records``)."""
    ch = chunks_per_case(retrieved)
    empty_chunks = F.array().cast(ch.schema["retrieved_pdf_chunks"].dataType)
    df = cases.join(ch, "id", "left")
    return df.select(
        "id",
        F.struct(F.lit(REVIEW_OBJECT_TYPE).alias("type"), F.col("id").alias("txId")).alias("review_object"),
        F.coalesce(F.col("label_name"), F.lit("unknown")).alias("known_label_for_research_only"),
        F.struct(F.coalesce(F.col("primary_segment"), F.lit("")).alias("primary_segment")).alias("address_profile_adapter"),
        F.struct(F.coalesce(F.col("risk_score"), F.lit(0)).cast("int").alias("risk_score"),
                 F.coalesce(F.col("risk_level"), F.lit("Low")).alias("risk_level")).alias("risk"),
        F.struct(
            F.coalesce(F.col("one_hop_neighbor_count"), F.lit(0)).cast("long").alias("one_hop_neighbor_count"),
            F.coalesce(F.col("one_hop_risk_neighbor_share"), F.lit(0.0)).alias("one_hop_risk_neighbor_share"),
            F.coalesce(F.col("two_hop_neighbor_count"), F.lit(0)).cast("long").alias("two_hop_neighbor_count"),
            F.coalesce(F.col("two_hop_risk_neighbor_share"), F.lit(0.0)).alias("two_hop_risk_neighbor_share"),
            F.coalesce(F.col("distance_to_known_illicit_cluster"), F.lit("")).alias("distance_to_known_illicit_cluster"),
        ).alias("graph_exposure"),
        triggered_rule_structs().alias("triggered_rules"),
        F.array(unsupported_rule_struct()).alias("unsupported_rules"),
        F.coalesce(F.col("retrieved_pdf_chunks"), empty_chunks).alias("retrieved_pdf_chunks"),
        F.array(*[F.lit(x) for x in C.UNAVAILABLE_FIELDS]).alias("missing_information"),
        F.array(*[F.lit(x) for x in C.GENERATION_BOUNDARIES]).alias("generation_boundaries"),
        draft_notes().alias("draft_notes"),
    )


def context_records(contexts: DataFrame) -> DataFrame:
    """The written form of contexts; evidence fields of other rules are NULL and are left out of the JSON."""
    return contexts.drop("id", "draft_notes")


def fallback_drafts(contexts: DataFrame) -> DataFrame:
    """Template draft per context (no model call)."""
    tx = F.col("review_object.txId")
    rules = F.col("draft_notes")
    return contexts.select(
        "id",
        tx.alias("txId"),
        F.col("risk.risk_score").alias("risk_score"),
        F.col("risk.risk_level").alias("risk_level"),
        C.sentence(C.FALLBACK_SUMMARY, tx).alias("risk_summary"),
        F.transform(rules, lambda r: F.struct(
            r["rule_id"].alias("rule_id"), r["rule_name"].alias("rule_name"),
            C.sentence(C.FALLBACK_REASON, r["rule_name"], r["score"]).alias("description"),
        )).alias("triggered_reason_codes"),
        F.transform(rules, lambda r: F.format_string("[%s] %s", r["rule_id"], r["proxy_note"])).alias(
            "suspicious_behavior_description"),
        F.transform(rules, lambda r: F.struct(r["rule_id"].alias("rule_id"), r["evidence_text"].alias("evidence"))).alias(
            "evidence_references"),
        F.col("missing_information"),
        F.array(*[F.lit(x) for x in C.FALLBACK_QUESTIONS]).alias("human_review_questions"),
        F.lit(C.FALLBACK_NEXT_ACTION).alias("suggested_next_review_action"),
        F.lit(C.PENDING).alias("analyst_decision"),
        F.lit("fallback").alias("llm_status"),
    )


def _evidence_json(rule: Column) -> Column:
    """A triggered rule's evidence as JSON text, its fields in the rule's own order and the note last."""
    out = F.lit(None).cast("string")
    for rid in C.SUPPORTED_RULE_IDS:
        fields = rule["evidence_fields"]
        own = [(f, fields[f], T.StringType() if k == "text" else T.DoubleType() if k == "double" else T.LongType()) for f, k in C.EVIDENCE_FIELDS[rid]]
        own.append(("proxy_note", fields["proxy_note"], T.StringType()))
        out = F.when(rule["rule_id"] == rid, json_object(own)).otherwise(out)
    return out


def draft_requests(contexts: DataFrame) -> DataFrame:
    """(id, system, user) messages for an outside model; the payload is JSON text as Python's ``json.dumps`` writes it."""
    text = T.StringType()
    rules = F.transform("triggered_rules", lambda r: F.concat(
        F.lit('{"rule_id": '), json_text(r["rule_id"], text), F.lit(', "rule_name": '), json_text(r["rule_name"], text),
        F.lit(', "evidence": '), _evidence_json(r), F.lit(', "limit": '), json_text(r["rule_doc"]["dataset_limit"], text), F.lit("}")))
    payload = F.concat(
        F.lit('{"txId": '), F.col("review_object.txId").cast("string"), F.lit(', "risk_level": '), json_text(F.col("risk.risk_level"), text),
        F.lit(', "triggered_rules": ['), F.array_join(rules, ", "),
        F.lit('], "missing_info": '), json_text(F.col("missing_information"), T.ArrayType(text)), F.lit("}"))
    return contexts.select(
        "id",
        F.lit(C.DRAFT_PROMPT).alias("system"),
        F.concat(F.lit(C.DRAFT_USER_PREFIX), payload).alias("user"),
        F.lit(0.1).alias("temperature"),
    )


DRAFT_BODY = {
    "risk_summary": "string",
    "triggered_reason_codes": "array<struct<rule_id:string,rule_name:string,description:string>>",
    "suspicious_behavior_description": "array<string>",
    "evidence_references": "array<struct<rule_id:string,evidence:string>>",
    "missing_information": "array<string>",
    "human_review_questions": "array<string>",
    "suggested_next_review_action": "string",
}
FIXED_KEYS = ("txId", "risk_score", "risk_level", "llm_status", "analyst_decision")


def parse_responses(responses: DataFrame) -> DataFrame:
    """(id, content) -> (id, parsed_ok, parsed struct, extra map, extra_json).

    A response counts if it is a JSON object, whatever its fields hold.  Each
    field is then read on its own and is NULL where its type differs; keys
    outside the draft's fields are kept in ``extra`` (value as text, nested values
    as JSON text) and, with their types, in ``extra_json`` (one JSON object).
    """
    body = F.try_parse_json(F.col("content"))
    ok = F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))
    fields = [F.try_variant_get(body, f"$.{name}", kind).alias(name) for name, kind in DRAFT_BODY.items()]
    every = F.from_json(F.when(ok, F.col("content")), "map<string,string>")
    known = F.array(*[F.lit(k) for k in (*DRAFT_BODY, *FIXED_KEYS)])
    typed = F.from_json(F.when(ok, F.col("content")), "map<string,variant>")
    own = lambda k, _v: ~F.array_contains(known, k)
    return responses.select("id", ok.alias("parsed_ok"), F.when(ok, F.struct(*fields)).alias("parsed"),
                            F.map_filter(every, own).alias("extra"), F.to_json(F.map_filter(typed, own)).alias("extra_json"))


def merge_drafts(contexts: DataFrame, responses: DataFrame) -> DataFrame:
    """Model draft where the response is a JSON object, else the template; id, score,
    level, status and decision always come from the context.  A response is the draft: fields that it
    lacks are NULL, other keys that it has are in ``extra`` and ``extra_json`` (at top level once written)."""
    fb = fallback_drafts(contexts)
    df = fb.join(parse_responses(responses), "id", "left")
    ok = F.coalesce(F.col("parsed_ok"), F.lit(False))
    return df.select(
        "id", "txId", "risk_score", "risk_level",
        *[F.when(ok, F.col("parsed")[name]).otherwise(F.col(name)).alias(name) for name in DRAFT_BODY],
        F.lit(C.PENDING).alias("analyst_decision"),
        F.when(ok, F.lit("success")).otherwise(F.lit("fallback")).alias("llm_status"),
        F.when(ok, F.col("extra")).alias("extra"),
        F.when(ok, F.col("extra_json")).alias("extra_json"),
    )


def draft_violations(drafts: DataFrame, cases: DataFrame) -> DataFrame:
    """(id, violation, detail): reason codes that are not triggered rules,
    missing required fields, and a decision other than pending."""
    hits = cases.select("id", F.inline(F.filter(F.array(*[
        F.when(F.col(f"{r}_hit"), F.struct(F.lit(r).alias("rule_id"))) for r in C.SUPPORTED_RULE_IDS]),
        lambda x: x.isNotNull())))
    codes = drafts.select("id", F.explode_outer("triggered_reason_codes").alias("c")).where(F.col("c").isNotNull()).select(
        "id", F.col("c.rule_id").alias("rule_id"))
    bad_codes = codes.join(hits, ["id", "rule_id"], "left_anti").select(
        "id", F.lit("reason_code_not_triggered").alias("violation"), F.coalesce(F.col("rule_id"), F.lit("")).alias("detail"))
    required = list(DRAFT_BODY)
    missing = drafts.select("id", F.inline(F.filter(F.array(*[
        F.when(F.col(c).isNull(), F.struct(F.lit("missing_field").alias("violation"), F.lit(c).alias("detail")))
        for c in required]), lambda x: x.isNotNull())))
    decision = drafts.where(F.col("analyst_decision") != C.PENDING).select(
        "id", F.lit("decision_not_pending").alias("violation"), F.col("analyst_decision").alias("detail"))
    return bad_codes.unionByName(missing).unionByName(decision)
