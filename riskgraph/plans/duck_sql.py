"""Independent SQL (DuckDB dialect) for the differential check of every query.

The statements are built from the same fixed values as the engine (weights,
predicates, bands, keywords), over the driver's tables.  One WITH clause holds
all common table expressions; DuckDB only evaluates those a statement uses.
"""

from __future__ import annotations

from riskgraph import config as C
from riskgraph.functions.rounding import ratio_sql
from riskgraph.operators.corpus import RETRIEVAL_RULES, keyword_vocabulary

WS_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _weight_case(rid: str, mode: str) -> str:
    whens = " ".join(f"WHEN {q(seg)} THEN {w}" for seg, r, w in C.weight_rows(mode) if r == rid)
    return f"CASE WHEN {rid}_hit THEN (CASE primary_segment {whens} ELSE 0 END) ELSE 0 END"


def _band_case(col: str) -> str:
    whens = " ".join(f"WHEN {col} >= {t} THEN {q(lab)}" for t, lab in C.RISK_BANDS)
    return f"CASE {whens} ELSE 'Low' END"


def _gq_cols() -> str:
    cols = []
    for m in C.SEGMENT_METRICS:
        for p in C.SEGMENT_PROBS:
            cols.append(f"quantile_cont({m}::DOUBLE, {p}) AS q_{m}_{C.prob_label(p)}")
    return ", ".join(cols)


def _tw_cols() -> str:
    cols = []
    for m in C.THRESHOLD_METRICS:
        for p in C.THRESHOLD_PROBS:
            cols.append(f"quantile_cont({m}::DOUBLE, {p}) AS thresh_{m}_{C.prob_label(p)}")
    return ", ".join(cols)


def _hits() -> str:
    return ", ".join(f"coalesce(({C.RULE_PREDICATES[r]}), false) AS {r}_hit" for r in C.RULE_IDS)


def _scores(mode: str) -> str:
    return ", ".join(f"CAST({_weight_case(r, mode)} AS INTEGER) AS {r}_score" for r in C.RULE_IDS)


SKIP = 300
BATCH = 100
POOL = BATCH * C.POOL_FACTOR
SEED = C.SAMPLING_SEED


DRAWN = (f"SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id) AS draw "
         f"FROM pool QUALIFY draw <= {BATCH}")
# one stratum per risk level, two seeds: every level, segment and rule occurs
MIXED = (f"SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id) AS draw FROM ranked WHERE id IN ("
         + " UNION ALL ".join(
             f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY risk_level ORDER BY md5('{s}:' || CAST(id AS VARCHAR)), id) AS rn "
             f"FROM scored) t WHERE rn <= {C.PER_STRATUM}" for s in (SEED, SEED + 1)) + ")")


def ctes(mode: str = "published", skip: int = SKIP, batch: int = BATCH, sample: str = DRAWN) -> list[str]:
    pool = batch * C.POOL_FACTOR
    raw_sum = " + ".join(f"{r}_score" for r in C.RULE_IDS)
    return [
        """g_edges AS (
  SELECT src, dst FROM (
    SELECT l_orderkey AS src,
           lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey) AS dst
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t
  WHERE dst IS NOT NULL)""",
        """g_nodes AS (
  SELECT o_orderkey AS id,
         CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 50) + 1 AS INTEGER) AS time_step,
         o_totalprice / 100000 AS f_001,
         coalesce(q, 0) / 50 AS f_002,
         coalesce(d, 0) * 10 AS f_003
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, max(l_discount) AS d
                         FROM lineitem GROUP BY l_orderkey) li ON l_orderkey = o_orderkey)""",
        """g_labels AS (
  SELECT id, class_raw,
         CASE WHEN class_raw = '1' THEN 'illicit' WHEN class_raw = '2' THEN 'licit' ELSE 'unknown' END AS label_name
  FROM (SELECT o_orderkey AS id,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice >= 350000 THEN '1'
                    WHEN o_orderstatus = 'O' THEN '2' ELSE 'unknown' END AS class_raw
        FROM orders) t)""",
        """deg AS (
  SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree
  FROM (SELECT src AS id, 1 AS o, 0 AS i FROM g_edges UNION ALL SELECT dst AS id, 0 AS o, 1 AS i FROM g_edges) t
  GROUP BY id)""",
        """steps AS (SELECT time_step, CAST(count(*) AS BIGINT) AS time_step_activity FROM g_nodes GROUP BY time_step)""",
        """metrics AS (
  SELECT n.id, n.time_step, coalesce(l.label_name, 'unknown') AS label_name,
         CAST(coalesce(d.in_degree, 0) AS BIGINT) AS in_degree,
         CAST(coalesce(d.out_degree, 0) AS BIGINT) AS out_degree,
         CAST(coalesce(d.in_degree, 0) + coalesce(d.out_degree, 0) AS BIGINT) AS total_degree,
         CAST(coalesce(d.in_degree, 0) + coalesce(d.out_degree, 0) AS BIGINT) AS neighbor_complexity,
         s.time_step_activity,
         coalesce(d.out_degree, 0) / (coalesce(d.in_degree, 0) + 1e-9) AS out_in_ratio,
         (abs(n.f_001) + abs(n.f_002) + abs(n.f_003)) / 3 AS anonymized_behavior_intensity,
         n.f_001, n.f_002, n.f_003
  FROM g_nodes n LEFT JOIN g_labels l ON l.id = n.id LEFT JOIN deg d ON d.id = n.id
       LEFT JOIN steps s ON s.time_step = n.time_step)""",
        f"""gq AS (SELECT {_gq_cols()} FROM metrics)""",
        f"""segmented AS (
  SELECT m.*,
    CASE WHEN coalesce(out_degree > q_out_degree_p90, false) OR coalesce(anonymized_behavior_intensity > q_anonymized_behavior_intensity_p90, false)
           THEN {q(C.SEGMENT_HIGH_VALUE)}
         WHEN coalesce(total_degree > q_total_degree_p85, false) OR coalesce(neighbor_complexity > q_neighbor_complexity_p85, false)
              OR coalesce(time_step_activity > q_time_step_activity_p85, false)
           THEN {q(C.SEGMENT_ACTIVE)}
         ELSE {q(C.SEGMENT_LOW)} END AS primary_segment,
    CAST(coalesce(total_degree > q_total_degree_p85, false) AS INTEGER)
      + CAST(coalesce(neighbor_complexity > q_neighbor_complexity_p85, false) AS INTEGER) AS secondary_tag_count
  FROM metrics m CROSS JOIN gq)""",
        f"""tw AS (SELECT primary_segment, {_tw_cols()} FROM segmented GROUP BY primary_segment)""",
        """with_thresh AS (SELECT s.*, tw.* EXCLUDE (primary_segment) FROM segmented s LEFT JOIN tw USING (primary_segment))""",
        f"""hits AS (SELECT *, {_hits()} FROM with_thresh)""",
        f"""weighted AS (SELECT *, {_scores(mode)} FROM hits)""",
        f"""scored AS (
  SELECT *, CAST(least(risk_score_raw, 100) AS INTEGER) AS risk_score,
         {_band_case('least(risk_score_raw, 100)')} AS risk_level
  FROM (SELECT *, CAST({raw_sum} AS INTEGER) AS risk_score_raw FROM weighted) t)""",
        f"""ranked AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, id) AS rank FROM scored)""",
        f"""pool AS (SELECT * FROM ranked WHERE rank > {skip} AND rank <= {skip + pool})""",
        f"""sample AS ({sample})""",
        # graph exposure
        """adj AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM g_edges UNION ALL SELECT dst AS a, src AS b FROM g_edges) t)""",
        """risky AS (SELECT n.id FROM g_nodes n JOIN g_labels l ON l.id = n.id WHERE l.label_name = 'illicit')""",
        """hop1 AS (SELECT a, CAST(count(*) AS BIGINT) AS n1, CAST(count(r.id) AS BIGINT) AS r1
             FROM adj LEFT JOIN risky r ON r.id = adj.b GROUP BY a)""",
        """pairs2 AS (SELECT DISTINCT x.a AS a, y.b AS c FROM adj x JOIN adj y ON x.b = y.a WHERE x.a <> y.b)""",
        """two AS (SELECT p.a, p.c FROM pairs2 p WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.a = p.a AND adj.b = p.c))""",
        """hop2 AS (SELECT a, CAST(count(*) AS BIGINT) AS n2, CAST(count(r.id) AS BIGINT) AS r2
             FROM two LEFT JOIN risky r ON r.id = two.c GROUP BY a)""",
        f"""exposure AS (
  SELECT n.id,
         coalesce(h1.n1, 0) AS one_hop_neighbor_count, coalesce(h1.r1, 0) AS one_hop_risky_count,
         {ratio_sql("coalesce(h1.r1, 0)", "greatest(coalesce(h1.n1, 0), 1)", 4)} AS one_hop_risk_neighbor_share,
         coalesce(h2.n2, 0) AS two_hop_neighbor_count, coalesce(h2.r2, 0) AS two_hop_risky_count,
         {ratio_sql("coalesce(h2.r2, 0)", "greatest(coalesce(h2.n2, 0), 1)", 4)} AS two_hop_risk_neighbor_share,
         CASE WHEN coalesce(h1.r1, 0) > 0 THEN {q(C.DISTANCE_1)} WHEN coalesce(h2.r2, 0) > 0 THEN {q(C.DISTANCE_2)}
              ELSE {q(C.DISTANCE_NONE)} END AS distance_to_known_illicit_cluster
  FROM g_nodes n LEFT JOIN hop1 h1 ON h1.a = n.id LEFT JOIN hop2 h2 ON h2.a = n.id)""",
        # exposure for the sample only
        """s_adj AS (SELECT adj.* FROM adj WHERE a IN (SELECT id FROM sample))""",
        """s_hop1 AS (SELECT a, CAST(count(*) AS BIGINT) AS n1, CAST(count(r.id) AS BIGINT) AS r1
             FROM s_adj LEFT JOIN risky r ON r.id = s_adj.b GROUP BY a)""",
        """s_two AS (SELECT p.a, p.c FROM (SELECT DISTINCT x.a AS a, y.b AS c FROM s_adj x JOIN adj y ON x.b = y.a WHERE x.a <> y.b) p
             WHERE NOT EXISTS (SELECT 1 FROM s_adj WHERE s_adj.a = p.a AND s_adj.b = p.c))""",
        """s_hop2 AS (SELECT a, CAST(count(*) AS BIGINT) AS n2, CAST(count(r.id) AS BIGINT) AS r2
             FROM s_two LEFT JOIN risky r ON r.id = s_two.c GROUP BY a)""",
        f"""s_exposure AS (
  SELECT s.id,
         coalesce(h1.n1, 0) AS one_hop_neighbor_count, coalesce(h1.r1, 0) AS one_hop_risky_count,
         {ratio_sql("coalesce(h1.r1, 0)", "greatest(coalesce(h1.n1, 0), 1)", 4)} AS one_hop_risk_neighbor_share,
         coalesce(h2.n2, 0) AS two_hop_neighbor_count, coalesce(h2.r2, 0) AS two_hop_risky_count,
         {ratio_sql("coalesce(h2.r2, 0)", "greatest(coalesce(h2.n2, 0), 1)", 4)} AS two_hop_risk_neighbor_share,
         CASE WHEN coalesce(h1.r1, 0) > 0 THEN {q(C.DISTANCE_1)} WHEN coalesce(h2.r2, 0) > 0 THEN {q(C.DISTANCE_2)}
              ELSE {q(C.DISTANCE_NONE)} END AS distance_to_known_illicit_cluster
  FROM sample s LEFT JOIN s_hop1 h1 ON h1.a = s.id LEFT JOIN s_hop2 h2 ON h2.a = s.id)""",
        """queue AS (SELECT s.* EXCLUDE (rank, draw), e.* EXCLUDE (id), s.draw FROM sample s JOIN s_exposure e USING (id))""",
    ]


def with_sql(select: str, mode: str = "published", **kw) -> str:
    return "WITH " + ",\n".join(ctes(mode, **kw)) + "\n" + select


# ---------------------------------------------------------------------------
# corpus
# ---------------------------------------------------------------------------

def _source_case(col: str, idx: int, default: str) -> str:
    whens = " ".join(f"WHEN {q(s[0])} THEN {q(s[idx])}" for s in C.GUIDANCE_SOURCES)
    return f"CASE {col} {whens} ELSE {default} END"


def corpus_ctes(rule_keywords=None, default_keywords=None) -> list[str]:
    rk = rule_keywords or C.DRIVER_RULE_KEYWORDS
    dk = default_keywords if default_keywords is not None else C.DRIVER_DEFAULT_KEYWORDS
    vocab = keyword_vocabulary(rk, dk)
    rank_case = "CASE source_id " + " ".join(
        f"WHEN {q(s[0])} THEN {i}" for i, s in enumerate(C.GUIDANCE_SOURCES)) + f" ELSE {len(C.GUIDANCE_SOURCES)} END"
    counts = ",\n".join(
        f"CAST((length(lt) - length(replace(lt, {q(kw)}, ''))) / {len(kw)} AS BIGINT) AS kw{i}"
        for i, kw in enumerate(vocab))

    def msum(kws):
        return " + ".join(f"kw{vocab.index(k.lower())}" for k in kws) if kws else "0"

    per_rule = [msum(rk.get(r, [])) for r in RETRIEVAL_RULES]
    base = msum(dk)
    mask_rows = []
    for m in range(1 << len(RETRIEVAL_RULES)):
        parts = [f"({base})"] + [f"({per_rule[i]})" for i in range(len(RETRIEVAL_RULES)) if m & (1 << i)]
        mask_rows.append(f"SELECT {m} AS rule_mask, chunk_id, source_id, page, source_rank, chunk_no, text, "
                         f"CAST({' + '.join(parts)} AS BIGINT) AS retrieval_score FROM kwc")
    return [
        f"""pages AS (
  SELECT source AS source_id,
         {_source_case('source', 1, 'source')} AS title,
         {_source_case('source', 3, "''")} AS publisher,
         {_source_case('source', 2, "''")} AS url,
         {rank_case.replace('source_id', 'source')} AS source_rank,
         CAST(doc_id AS BIGINT) AS page,
         trim(regexp_replace(coalesce(text, ''), '{WS_CLASS}+', ' ', 'g'), ' ') AS text
  FROM documents)""",
        f"""windows AS (
  SELECT p.*, w.j, trim(substring(p.text, w.j * {C.CHUNK_SIZE - C.CHUNK_OVERLAP} + 1, {C.CHUNK_SIZE}), ' ') AS ctext
  FROM pages p,
       LATERAL (SELECT unnest(range(0, greatest(0, CAST(ceil((length(p.text) - {C.CHUNK_SIZE}) / {C.CHUNK_SIZE - C.CHUNK_OVERLAP}) AS BIGINT)) + 1)) AS j) w
  WHERE length(p.text) > 0)""",
        f"""chunks AS (
  SELECT source_id, title, publisher, url, source_rank, page,
         CAST(row_number() OVER (PARTITION BY source_id, page ORDER BY j) AS INTEGER) AS chunk_no,
         printf('%s-p%03d-c%02d', source_id, page, row_number() OVER (PARTITION BY source_id, page ORDER BY j)) AS chunk_id,
         ctext AS text
  FROM windows WHERE length(ctext) > {C.CHUNK_MIN_CHARS})""",
        f"""kwc AS (SELECT *, {counts} FROM (SELECT *, lower(text) AS lt FROM chunks) t)""",
        "mask_scores AS (SELECT * FROM (" + "\nUNION ALL\n".join(mask_rows) + ") t WHERE retrieval_score > 0)",
        f"""topk AS (
  SELECT *, row_number() OVER (PARTITION BY rule_mask ORDER BY retrieval_score DESC, page, source_rank, source_id, chunk_no) AS chunk_rank
  FROM mask_scores QUALIFY chunk_rank <= {C.TOP_K_CHUNKS})""",
    ]


def corpus_sql(select: str) -> str:
    return "WITH " + ",\n".join(corpus_ctes()) + "\n" + select


def vocab_names() -> list[str]:
    return keyword_vocabulary(C.DRIVER_RULE_KEYWORDS, C.DRIVER_DEFAULT_KEYWORDS)
