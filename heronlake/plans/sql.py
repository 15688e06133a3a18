"""DuckDB SQL twins of the registered queries."""

from __future__ import annotations

from ..schemas import DIMS, MCC_RISK
from . import fixed

D = ", ".join(DIMS)
RISK = "CASE mcc " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MCC_RISK.items()) + " ELSE 0.5::DOUBLE END"
CODES = "[" + ", ".join(f"'{c}'" for c in [*MCC_RISK, "0000", "9999"]) + "]"


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _r4(x: str) -> str:
    return f"floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


RAW = [
    _clamp("amount / 10000.0::DOUBLE"),
    _clamp("(1 + k % 14)::DOUBLE / 12.0::DOUBLE"),
    _clamp("amount / coalesce(nullif(user_avg, 0.0::DOUBLE), 1.0::DOUBLE) / 10.0::DOUBLE"),
    "hour(ts)::DOUBLE / 23.0::DOUBLE",
    "(isodow(ts) - 1)::DOUBLE / 6.0::DOUBLE",
    "CASE WHEN lt IS NULL THEN -1.0::DOUBLE ELSE " + _clamp("(floor(epoch(ts)) - floor(epoch(lt)))::DOUBLE / 60.0::DOUBLE / 1440.0::DOUBLE") + " END",
    "CASE WHEN lt IS NULL THEN -1.0::DOUBLE ELSE " + _clamp("abs(k - lk)::DOUBLE * 12.5::DOUBLE / 1000.0::DOUBLE") + " END",
    _clamp("((event_id * 7919) % 120000)::DOUBLE / 100.0::DOUBLE / 1000.0::DOUBLE"),
    _clamp("n24::DOUBLE / 20.0::DOUBLE"),
    "(event_type IN ('click', 'view', 'purchase'))::INT::DOUBLE",
    "(event_type IN ('purchase', 'signup'))::INT::DOUBLE",
    "(nth = 1)::INT::DOUBLE",
    RISK,
    _clamp("merchant_avg / 10000.0::DOUBLE"),
]
BASE = f"""
e0 AS (SELECT event_id, ts, user_id, event_type, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k, round(value * 100)::BIGINT AS c FROM events),
f0 AS (SELECT *, c * 0.4::DOUBLE AS amount, {CODES}[(k % 12 + 1)::INT] AS mcc,
  CASE WHEN user_id % 10 = 0 THEN 0.0::DOUBLE ELSE (sum(c) OVER (PARTITION BY user_id))::DOUBLE * 0.4::DOUBLE / count(*) OVER (PARTITION BY user_id) END AS user_avg,
  (sum(c) OVER (PARTITION BY k))::DOUBLE * 0.4::DOUBLE / count(*) OVER (PARTITION BY k) AS merchant_avg,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n24,
  row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS nth,
  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lt, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lk FROM e0),
v AS (SELECT event_id, k, (k >= 65)::INT AS y, mcc, nth, {", ".join(f"{_r4(x)} AS d{i}" for i, x in enumerate(RAW))} FROM f0),
raw AS (SELECT event_id, k, (k >= 65)::INT AS y, {", ".join(f"{x} AS d{i}" for i, x in enumerate(RAW))} FROM f0)"""


def _d2(a: str, b: str) -> str:
    return " + ".join(f"({a}.{d} - {b}.{d}) * ({a}.{d} - {b}.{d})" for d in DIMS)


KNN = f"""
p AS (SELECT q.event_id AS qid, r.event_id AS ref_id, r.y, {_d2("q", "r")} AS d FROM v q JOIN v r ON q.event_id % 20 = 0 AND r.event_id <> q.event_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id)::INT AS rank FROM p) WHERE rank <= 5),
vote AS (SELECT qid, sum(y)::DOUBLE / 5.0::DOUBLE AS fraud_score FROM n GROUP BY qid)"""
EMB = """
m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, (label >= 7)::INT AS y FROM embeddings),
q AS (SELECT vec_id AS qid, e FROM m WHERE vec_id % 20 = 0),
r AS (SELECT vec_id AS ref_id, e, y FROM m),
c AS (SELECT vec_id AS cluster_id, e FROM m WHERE vec_id % (SELECT floor(sqrt(count(*)))::BIGINT FROM embeddings) = 0)"""
FOLD = "list_reduce(list_prepend(0.0::DOUBLE, {}), lambda s, t: s + t)"
L2 = FOLD.format("list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))")
L1 = FOLD.format("list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))")
DOT = FOLD.format("list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])")
POINTS = (
    "(CASE WHEN d0 > 0.7::DOUBLE THEN 15 ELSE 0 END + CASE WHEN d1 > 0.6::DOUBLE THEN 10 ELSE 0 END + CASE WHEN d2 > 0.8::DOUBLE THEN 15 ELSE 0 END"
    " + CASE WHEN d7 > 0.7::DOUBLE THEN 15 ELSE 0 END + CASE WHEN d11 = 1 THEN 15 ELSE 0 END + CASE WHEN d12 > 0.6::DOUBLE THEN 10 ELSE 0 END"
    " + CASE WHEN d8 > 0.8::DOUBLE THEN 10 ELSE 0 END + CASE WHEN d5 = -1 AND d0 > 0.5::DOUBLE THEN 10 ELSE 0 END)"
)
SAFE = "d10 = 1 AND d11 = 0 AND d0 < 0.3::DOUBLE"
LDA = " + ".join(f"d{i} * ({w}::DOUBLE)" for i, w in enumerate(fixed.WEIGHTS)) + f" + ({fixed.INTERCEPT}::DOUBLE)"


def _tree(nodes: list, tree: int) -> str:
    by = {n[1]: n for n in nodes if n[0] == tree}

    def at(i: int) -> str:
        _, _, f, t, left, right, value = by[i]
        return f"{value}::DOUBLE" if f < 0 else f"CASE WHEN d{f}::FLOAT <= {t}::FLOAT THEN {at(left)} ELSE {at(right)} END"

    return f"({at(0)})"


TREE = _tree(fixed.TREE, 0)
FOREST = "(" + " + ".join(_tree(fixed.FOREST, t) for t in range(5)) + ") / 5.0::DOUBLE"
COUNTS = "count(*) FILTER ({p} = 1 AND {e} = 1) AS tp, count(*) FILTER ({p} = 1 AND {e} = 0) AS fp, count(*) FILTER ({p} = 0 AND {e} = 1) AS fn, count(*) FILTER ({p} = 0 AND {e} = 0) AS tn"


def _hash(t: int, h: int) -> str:
    a, b = fixed.PROJECTIONS[t][h]
    total = " + ".join(f"d{i} * ({x}::DOUBLE)" for i, x in enumerate(a))
    return f"floor(({total} + {b}::DOUBLE) / {fixed.LSH_WIDTH}::DOUBLE)::BIGINT"


LSH = f"""
h AS (SELECT event_id, t.i AS table_idx, [{", ".join("CASE t.i " + " ".join(f"WHEN {t} THEN {_hash(t, h)}" for t in range(fixed.LSH_TABLES)) + " END" for h in range(fixed.LSH_HASHES))}] AS bucket_key
  FROM v, range({fixed.LSH_TABLES}) t(i)),
met AS (SELECT DISTINCT a.event_id AS qid, b.event_id AS ref_id FROM h a JOIN h b ON a.table_idx = b.table_idx AND a.bucket_key = b.bucket_key
  WHERE a.event_id % 20 = 0 AND b.event_id <> a.event_id),
poor AS (SELECT w.event_id AS qid FROM v w LEFT JOIN (SELECT qid, count(*) AS n FROM met GROUP BY qid) g ON w.event_id = g.qid WHERE w.event_id % 20 = 0 AND coalesce(n, 0) < 15),
cand AS (SELECT * FROM met UNION SELECT qid, event_id FROM poor, (SELECT event_id FROM v ORDER BY event_id LIMIT 500) WHERE qid <> event_id)"""
PROBE = f"""
pr AS (SELECT * FROM (SELECT qid, cluster_id, cd, row_number() OVER (PARTITION BY qid ORDER BY cd, cluster_id) AS place FROM
  (SELECT qid, cluster_id, {L2.format(a="q.e", b="c.e")} AS cd FROM q, c)) WHERE place <= (SELECT ceil(0.75 * count(*)) FROM c)),
asg AS (SELECT ref_id, e, y, cluster_id FROM (SELECT ref_id, r.e, r.y, cluster_id, row_number() OVER (PARTITION BY ref_id ORDER BY {L2.format(a="r.e", b="c.e")}, cluster_id) AS place FROM r, c) WHERE place = 1)"""
IVF = f"""
near AS (SELECT pr.qid, pr.place, ref_id, asg.y, {L2.format(a="q.e", b="asg.e")} AS d FROM pr JOIN q ON pr.qid = q.qid JOIN asg ON pr.cluster_id = asg.cluster_id AND asg.ref_id <> pr.qid),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id)::INT AS rank FROM near) WHERE rank <= 5)"""
EARLY = f"""
near0 AS (SELECT pr.qid, pr.place, ref_id, asg.y, {L2.format(a="q.e", b="asg.e")} AS d FROM pr JOIN q ON pr.qid = q.qid JOIN asg ON pr.cluster_id = asg.cluster_id AND asg.ref_id <> pr.qid),
kth AS (SELECT a.qid, a.place, (SELECT list_sort(list(b.d)) FROM near0 b WHERE b.qid = a.qid AND b.place <= a.place) AS ds, lead(cd) OVER (PARTITION BY a.qid ORDER BY a.place) AS nxt FROM pr a),
stp AS (SELECT qid, min(place) AS last FROM kth WHERE len(ds) >= 5 AND sqrt(nxt) > 1.5::DOUBLE * sqrt(ds[5]) GROUP BY qid),
near AS (SELECT near0.* FROM near0 LEFT JOIN stp ON near0.qid = stp.qid WHERE last IS NULL OR place <= last),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id)::INT AS rank FROM near) WHERE rank <= 5)"""
CENTROIDS = ", ".join(f"avg(d{i}) FILTER (y = {{y}}) AS m{i}" for i in range(14))


def _metric(expression: str) -> str:
    return f"""WITH {EMB}, p AS (SELECT qid, ref_id, r.y, {expression} AS d FROM q, r WHERE qid <> ref_id)
SELECT qid, rank, ref_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id)::INT AS rank FROM p) WHERE rank <= 5"""


QUANT = "greatest(-32767::DOUBLE, least(32767::DOUBLE, {}))::BIGINT"
STORED, ASKED = QUANT.format("round_even(x * 32767.0::DOUBLE, 0)"), QUANT.format("round(x * 32767.0::DOUBLE)")
RATIO = "sqrt(l) / (sqrt(f) + sqrt(l) + 1e-10::DOUBLE)"
THREE_TIER = f"""
g AS (SELECT {CENTROIDS.format(y=0)} FROM v), b AS (SELECT {CENTROIDS.format(y=1)} FROM v),
s AS (SELECT event_id, v.y, {POINTS} AS points, {SAFE} AS safe, {" + ".join(f"(d{i} - g.m{i}) * (d{i} - g.m{i})" for i in range(14))} AS l, {" + ".join(f"(d{i} - b.m{i}) * (d{i} - b.m{i})" for i in range(14))} AS f FROM v, g, b),
t AS (SELECT event_id, y, CASE WHEN points < 10 AND safe THEN 'legit_fast' WHEN points > 60 THEN 'fraud_fast' WHEN {RATIO} > 0.65 THEN 'fraud' WHEN {RATIO} < 0.35 THEN 'legit' ELSE 'knn' END AS tier FROM s)"""
COV = " UNION ALL ".join(f"SELECT y, {i} AS i, {j} AS j, round(covar_samp(d{i}, d{j}), 6) AS cov FROM v GROUP BY y" for i in range(8) for j in range(i, 8))
PAIRS14 = [(i, j) for i in range(14) for j in range(i, 14)]
POOLED = f"""c AS (SELECT y, unnest([{", ".join(f"struct_pack(i := {i}, j := {j}, cov := covar_samp(d{i}, d{j}))" for i, j in PAIRS14)}]) AS x FROM v GROUP BY y)
SELECT x.i AS i, x.j AS j, round(sum(x.cov) / 2.0::DOUBLE + CASE WHEN x.i = x.j THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END, 6) AS cov FROM c GROUP BY x.i, x.j"""
GRAM = f"""g AS (SELECT unnest([{", ".join(f"struct_pack(i := {i}, j := {j}, total := sum(round(d{i} * 10000.0::DOUBLE) * round(d{j} * 10000.0::DOUBLE)))" for i, j in PAIRS14)}]) AS x FROM v)
SELECT x.i AS i, x.j AS j, x.total AS total FROM g"""
PROJECTED = ", ".join(" + ".join(f"d{c} * ({x}::DOUBLE)" for c, x in enumerate(row)) + f" AS p{i}" for i, row in enumerate(fixed.MATRIX))


def _squared(mean: list[float]) -> str:
    return "(" + " + ".join(f"(p{i} - ({mean[i]}::DOUBLE)) * (p{j} - ({mean[j]}::DOUBLE)) * ({fixed.INVERSE[i][j]}::DOUBLE)" for i in range(8) for j in range(8)) + ")"


TWO_STAGE = f"""s AS (SELECT event_id AS qid, {FOREST} AS probability FROM v), u AS (SELECT * FROM s WHERE abs(probability - 0.513::DOUBLE) <= 0.2::DOUBLE)"""
IVF_EVENTS = f"""c AS (SELECT event_id AS cluster_id, {D} FROM v WHERE event_id % (SELECT floor(sqrt(count(*)))::BIGINT FROM events) = 0),
asg AS (SELECT v.event_id AS ref_id, arg_min(c.cluster_id, struct_pack(d := {_d2("v", "c")}, i := c.cluster_id)) AS cluster_id FROM v, c GROUP BY v.event_id),
pr AS (SELECT q.event_id AS qid, unnest(arg_min(c.cluster_id, struct_pack(d := {_d2("q", "c")}, i := c.cluster_id), 24)) AS cluster_id FROM v q JOIN u ON q.event_id = u.qid, c GROUP BY q.event_id),
p AS (SELECT q.event_id AS qid, r.event_id AS ref_id, r.y, {_d2("q", "r")} AS d FROM pr JOIN v q ON q.event_id = pr.qid JOIN asg ON asg.cluster_id = pr.cluster_id JOIN v r ON r.event_id = asg.ref_id AND r.event_id <> q.event_id)"""
DECIDED = """n AS (SELECT qid, arg_min(y, struct_pack(d := d, i := ref_id), 5) AS ys FROM p GROUP BY qid)
SELECT qid, 'forest' AS stage, (probability >= 0.513::DOUBLE)::INT AS fraud FROM s WHERE abs(probability - 0.513::DOUBLE) > 0.2::DOUBLE
UNION ALL SELECT qid, 'knn', (list_sum(ys)::DOUBLE / 5.0::DOUBLE >= 0.6::DOUBLE)::INT FROM n"""
STATS = f"c AS (SELECT count(*) AS n, count(*) FILTER (fraud_score >= 0.6::DOUBLE) AS f, count(*) FILTER (fraud_score = 0.6::DOUBLE) AS g FROM vote) SELECT n AS total, f AS fraud_count, n - f AS legit_count, {_r4('f::DOUBLE / n')} AS fraud_rate, {_r4('(n - f)::DOUBLE / n')} AS legit_rate, g AS edge_case_count, {_r4('g::DOUBLE / n')} AS edge_case_rate FROM c"
STAGES = "(VALUES (1, 60::BIGINT, 450::BIGINT), (2, 60::BIGINT, 900::BIGINT), (3, 30::BIGINT, 901::BIGINT)) s(stage, duration, target)"
SCORES = "(VALUES (0, 0, 0, 1.0::DOUBLE), (5, 5, 0, 3.0), (0, 0, 0, 100.0), (30, 20, 0, 10.0), (100, 50, 0, 300.0), (500, 250, 0, 200.0), (500, 300, 0, 10.0), (0, 0, 5000, 60000.0), (40, 15, 0, 5.81), (0, 0, 0, 0.0)) s(fp, fn, err, p99)"
PROB = f"pb AS (SELECT event_id, y AS expected, {FOREST} AS probability FROM v)"
SWEEP = " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (probability >= {t}::DOUBLE AND expected = 1) AS tp, count(*) FILTER (probability >= {t}::DOUBLE AND expected = 0) AS fp, "
    f"count(*) FILTER (probability < {t}::DOUBLE AND expected = 1) AS fn, count(*) FILTER (probability < {t}::DOUBLE AND expected = 0) AS tn FROM pb"
    for t in fixed.THRESHOLDS
)
GRID = " UNION ALL ".join(
    f"SELECT {a}::INT AS legit, {b}::INT AS fraud, count(*) FILTER ((points < {a} AND safe) OR points > {b}) AS fast, count(*) FILTER (points < {a} AND safe AND y = 1) AS fp FROM s WHERE points BETWEEN 15 AND 70"
    for a in (10, 12, 15, 18, 20)
    for b in (60, 65, 70, 75, 80)
)
BAND = " UNION ALL ".join(
    f"SELECT {b}::DOUBLE AS band, count(*) FILTER (abs(probability - 0.5) <= {b}::DOUBLE) AS fallback, count(*) FILTER (abs(probability - 0.5) <= {b}::DOUBLE AND (probability >= 0.5) <> (expected = 1)) AS covered_errors, "
    f"count(*) FILTER (abs(probability - 0.5) > {b}::DOUBLE AND probability >= 0.5 AND expected = 0) AS fp, count(*) FILTER (abs(probability - 0.5) > {b}::DOUBLE AND probability < 0.5 AND expected = 1) AS fn FROM pb"
    for b in fixed.BANDS
)


def oracles() -> dict[str, str]:
    return {
        "q_vectorize": f"WITH {BASE} SELECT event_id, {D} FROM v",
        "q_vectorize_served": f"WITH {BASE} SELECT event_id, {', '.join(f'floor({d} * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS {d}' for d in DIMS)} FROM raw",
        "q_dim_time": f"WITH {BASE} SELECT event_id, d3 AS hour_of_day, d4 AS day_of_week, d5 AS minutes_since_last FROM v",
        "q_dim_amounts": f"WITH {BASE} SELECT event_id, d0 AS amount, d2 AS amount_vs_avg, d13 AS merchant_avg FROM v",
        "q_sentinel": f"WITH {BASE} SELECT event_id, d5, d6 FROM v WHERE d5 = -1 AND d6 = -1",
        "q_label_encode": f"WITH {BASE} SELECT y, count(*) AS n FROM v GROUP BY y",
        "q_mcc_join": f"WITH {BASE} SELECT event_id, mcc, {RISK} AS mcc_risk FROM v",
        "q_known_semi": f"WITH {BASE} SELECT event_id FROM v WHERE nth <> 1",
        "q_known_anti": f"WITH {BASE} SELECT event_id FROM v WHERE nth = 1",
        "q_knn_exact": f"WITH {BASE}, {KNN} SELECT qid, rank, ref_id, round(d, 6) AS d2 FROM n",
        "q_knn_pairs": f"WITH {BASE}, {KNN} SELECT qid, rank, ref_id, round(d, 6) AS d2 FROM n",
        "q_knn_vote": f"WITH {BASE}, {KNN} SELECT qid, fraud_score, fraud_score < 0.6::DOUBLE AS approved FROM vote",
        "q_decision": f"WITH {BASE}, {KNN} SELECT fraud_score < 0.6::DOUBLE AS approved, count(*) AS n FROM vote GROUP BY 1",
        "q_fail_open": f"WITH {BASE}, {KNN} SELECT qid, coalesce(CASE WHEN qid % 3 = 0 THEN NULL ELSE fraud_score END, 0.5::DOUBLE) < 0.6::DOUBLE AS approved FROM vote",
        "q_knn_embeddings": _metric(L2.format(a="q.e", b="r.e")),
        "q_brute_force_labels": f"""WITH {EMB}, p AS (SELECT qid, ref_id, r.y, {L2.format(a="q.e", b="r.e")} AS d FROM q, r WHERE qid <> ref_id), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id) AS rank FROM p) WHERE rank <= 5)
SELECT qid, string_agg(y::VARCHAR, ',' ORDER BY rank) AS labels FROM n GROUP BY qid""",
        "q_knn_l1": _metric(L1.format(a="q.e", b="r.e")),
        "q_knn_cosine": _metric(f"1.0::DOUBLE - {DOT.format(a='q.e', b='r.e')} / (sqrt({DOT.format(a='q.e', b='q.e')}) * sqrt({DOT.format(a='r.e', b='r.e')}))"),
        "q_quantize_i16": f"WITH {EMB} SELECT vec_id, array_to_string(list_transform(e, lambda x: {STORED}), ',') AS quantized FROM m",
        "q_knn_i16": f"""WITH {EMB}, qi AS (SELECT qid, list_transform(e, lambda x: {ASKED}) AS e FROM q), ri AS (SELECT ref_id, list_transform(e, lambda x: {STORED}) AS e FROM r),
p AS (SELECT qid, ref_id, list_sum(list_transform(list_zip(qi.e, ri.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM qi, ri WHERE qid <> ref_id)
SELECT qid, rank, ref_id, round(sqrt(d::DOUBLE) / 32767.0::DOUBLE, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id)::INT AS rank FROM p) WHERE rank <= 5""",
        "q_ivf_offsets": f"WITH {EMB}, {PROBE}, s AS (SELECT c.cluster_id, count(ref_id) AS n FROM c LEFT JOIN asg ON c.cluster_id = asg.cluster_id GROUP BY c.cluster_id) SELECT cluster_id, n, coalesce(sum(n) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s",
        "q_ivf_probe": f"WITH {EMB}, {PROBE} SELECT qid, place::INT AS place, cluster_id FROM pr",
        "q_ivf_knn": f"WITH {EMB}, {PROBE}, {IVF} SELECT qid, rank, ref_id, round(d, 6) AS d FROM n",
        "q_ivf_score": f"WITH {EMB}, {PROBE}, {IVF} SELECT qid, sum(y)::DOUBLE / 5.0::DOUBLE AS fraud_score FROM n GROUP BY qid",
        "q_ivf_early_exit": f"WITH {EMB}, {PROBE}, {EARLY} SELECT qid, rank, ref_id, round(sqrt(d), 6) AS distance FROM n",
        "q_lsh_hash": f"WITH {BASE}, {LSH} SELECT event_id, table_idx::INT AS table_idx, array_to_string(bucket_key, ',') AS bucket_key FROM h",
        "q_lsh_candidates": f"WITH {BASE}, {LSH} SELECT qid, count(*) AS n, sum(ref_id)::BIGINT AS ids FROM cand GROUP BY qid",
        "q_lsh_knn": f"WITH {BASE}, {LSH}, p AS (SELECT c.qid, c.ref_id, {_d2('a', 'b')} AS d FROM cand c JOIN v a ON c.qid = a.event_id JOIN v b ON c.ref_id = b.event_id) SELECT qid, rank, ref_id, round(sqrt(d), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id)::INT AS rank FROM p) WHERE rank <= 5",
        "q_rules_risk": f"WITH {BASE} SELECT event_id, round({POINTS} / 100.0::DOUBLE, 2) AS risk FROM v",
        "q_fast_path": f"WITH {BASE}, s AS (SELECT y, CASE WHEN {POINTS} < 15 AND {SAFE} THEN 'legit_fast' WHEN {POINTS} > 70 THEN 'fraud_fast' ELSE 'miss' END AS method FROM v) SELECT method, y, count(*) AS n FROM s GROUP BY method, y",
        "q_three_tier_centroid": f"WITH {BASE}, {THREE_TIER} SELECT tier, y, count(*) AS n FROM t GROUP BY tier, y",
        "q_centroids": f"WITH {BASE} SELECT y, count(*) AS n, {', '.join(f'round(avg(d{i}), 6) AS d{i}' for i in range(14))} FROM v GROUP BY y",
        "q_class_cov": f"WITH {BASE} {COV}",
        "q_pooled_cov": f"WITH {BASE}, {POOLED}",
        "q_gram": f"WITH {BASE}, {GRAM}",
        "q_mahalanobis_difference": f"WITH {BASE}, w AS (SELECT event_id, {PROJECTED} FROM v) SELECT event_id, floor(({_squared(fixed.MEANS[0])} - {_squared(fixed.MEANS[1])}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS difference FROM w",
        "q_two_stage_ivf": f"WITH {BASE}, {TWO_STAGE}, {IVF_EVENTS}, {DECIDED}",
        "q_ivf_i16": f"""WITH {EMB}, {PROBE}, qi AS (SELECT qid, list_transform(e, lambda x: {ASKED}) AS e FROM q), ri AS (SELECT ref_id, cluster_id, list_transform(e, lambda x: {STORED}) AS e FROM asg),
p AS (SELECT pr.qid, ref_id, list_sum(list_transform(list_zip(qi.e, ri.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pr JOIN qi ON pr.qid = qi.qid JOIN ri ON pr.cluster_id = ri.cluster_id AND ref_id <> pr.qid)
SELECT qid, rank, ref_id, round(sqrt(d::DOUBLE) / 32767.0::DOUBLE, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id)::INT AS rank FROM p) WHERE rank <= 5""",
        "q_golden_entries": f"WITH {BASE}, {KNN} SELECT qid, 'tx-' || qid AS id, round(f0.amount, 6) AS amount, fraud_score < 0.6::DOUBLE AS expected_approved, fraud_score AS expected_fraud_score FROM vote JOIN f0 ON vote.qid = f0.event_id",
        "q_golden_stats": f"WITH {BASE}, {KNN}, {STATS}",
        "q_request_counters": f"""WITH {BASE}, a AS (SELECT CASE WHEN event_id % 7 <> 0 THEN {POINTS} < 30 END AS a, y = 0 AS e, value AS ms FROM v JOIN events USING (event_id))
SELECT count(*) FILTER (NOT a AND NOT e) AS tp_count, count(*) FILTER (a AND e) AS tn_count, count(*) FILTER (NOT a AND e) AS fp_count, count(*) FILTER (a AND NOT e) AS fn_count,
count(*) FILTER (a IS NULL) AS error_count, round(count(*) FILTER (a IS NULL) / count(*)::DOUBLE, 6) AS error_rate, max(ms) AS max_ms FROM a""",
        "q_text_columns": "SELECT event_id, repeat(' ', greatest(0, 10 - length(event_id::VARCHAR))) || event_id AS number, event_type || repeat(' ', greatest(0, 10 - length(event_type))) AS kind, md5(props)[1:7] AS commit FROM events",
        "q_stream_score": f"""WITH {BASE}, s AS (SELECT event_id, {LDA} AS lda, {TREE} AS cart FROM raw), f AS (SELECT event_id, CASE WHEN lda > 2 THEN 1.0 WHEN lda < -2 THEN 0.0 WHEN cart > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM s)
SELECT 'tx-' || event_id AS id, x < 0.6::DOUBLE AS approved, x AS fraud_score, CASE WHEN x = 1 THEN '{{"approved":false,"fraud_score":1.0}}' ELSE '{{"approved":true,"fraud_score":0.0}}' END AS body FROM f""",
        "q_svd_project": f"WITH {BASE} SELECT event_id, {', '.join('round(' + ' + '.join(f'd{c} * ({x}::DOUBLE)' for c, x in enumerate(row)) + f', 6) + 0.0::DOUBLE AS p{i}' for i, row in enumerate(fixed.MATRIX))} FROM v",
        "q_lda_score": f"WITH {BASE} SELECT event_id, round({LDA}, 6) AS score FROM raw",
        "q_lda_gate_cart": f"WITH {BASE}, s AS (SELECT event_id, {LDA} AS lda, {TREE} AS cart FROM raw) SELECT event_id, CASE WHEN lda > 2 THEN 1 WHEN lda < -2 THEN 0 WHEN cart > 0.5 THEN 1 ELSE 0 END::INT AS fraud FROM s",
        "q_tree_predict": f"WITH {BASE} SELECT event_id, {TREE} AS probability FROM v",
        "q_tree_boxes": f"WITH {BASE} SELECT event_id, {TREE} AS probability FROM v",
        "q_forest_predict": f"WITH {BASE}, {PROB} SELECT event_id, round(probability, 6) AS probability, (probability >= 0.5)::INT AS fraud FROM pb",
        "q_forest_sweep": f"WITH {BASE}, {PROB} SELECT *, 25 * fp + 90 * fn AS penalty FROM ({SWEEP})",
        "q_best_threshold": f"WITH {BASE}, {PROB}, s AS (SELECT *, 25 * fp + 90 * fn AS penalty FROM ({SWEEP})) SELECT threshold, penalty FROM s ORDER BY penalty, threshold LIMIT 1",
        "q_grid_thresholds": f"WITH {BASE}, s AS (SELECT y, {POINTS} AS points, {SAFE} AS safe FROM v) {GRID}",
        "q_band_coverage": f"WITH {BASE}, {PROB} {BAND}",
        "q_two_stage": f"""WITH {BASE}, {TWO_STAGE},
p AS (SELECT q.event_id AS qid, r.event_id AS ref_id, r.y, {_d2("q", "r")} AS d FROM v q JOIN u ON q.event_id = u.qid JOIN v r ON r.event_id <> q.event_id),
{DECIDED}""",
        "q_hybrid_lda_cart": f"WITH {BASE}, s AS (SELECT y, {LDA} AS lda, {TREE} AS cart FROM raw) "
        + " UNION ALL ".join(
            f"SELECT {b}::INT AS band, count(*) FILTER (abs(lda) <= {b}) AS fallback, {COUNTS.format(p='pred', e='y')} FROM (SELECT *, CASE WHEN lda > {b} THEN 1 WHEN lda < -{b} THEN 0 WHEN cart > 0.5 THEN 1 ELSE 0 END AS pred FROM s)"
            for b in (10, 5, 3, 2)
        ),
        "q_confusion": f"WITH {BASE}, {KNN}, s AS (SELECT (fraud_score >= 0.6::DOUBLE)::INT AS predicted, v.y AS expected FROM vote JOIN v ON vote.qid = v.event_id) SELECT {COUNTS.format(p='predicted', e='expected')} FROM s",
        "q_accuracy_penalty": f"WITH {BASE}, {KNN}, s AS (SELECT (fraud_score >= 0.6::DOUBLE)::INT AS predicted, v.y AS expected FROM vote JOIN v ON vote.qid = v.event_id), c AS (SELECT {COUNTS.format(p='predicted', e='expected')} FROM s) SELECT *, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, fp + 3 * fn AS weighted, 25 * fp + 90 * fn AS penalty FROM c",
        "q_contest_score": f"""WITH b AS (SELECT fp::BIGINT AS fp, fn::BIGINT AS fn, err::BIGINT AS err, p99, (fp + 3 * fn + 5 * err)::BIGINT AS e, (fp + fn + err) / 5000.0::DOUBLE AS rate FROM {SCORES}),
x AS (SELECT *, CASE WHEN p99 <= 0 THEN 0.0::DOUBLE WHEN p99 > 2000 THEN -3000.0::DOUBLE ELSE 1000.0::DOUBLE * log10(1000.0::DOUBLE / greatest(p99, 1.0::DOUBLE)) END AS p,
  CASE WHEN rate > 0.15::DOUBLE THEN -3000.0::DOUBLE ELSE 1000.0::DOUBLE * log10(1.0::DOUBLE / greatest(e / 5000.0::DOUBLE, 0.001::DOUBLE)) - 300.0::DOUBLE * log10(1.0::DOUBLE + e) END AS d FROM b)
SELECT fp, fn, err, p99, e AS weighted_errors, round(p, 2) AS p99_score, round(d, 2) AS detection_score, round(p + d, 2) AS final_score FROM x""",
        "q_p99": "SELECT event_type, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
        "q_dataset_stats": f"WITH {BASE}, {KNN}, {STATS}",
        "q_ramp_requests": f"WITH x AS (SELECT *, lag(target, 1, 1::BIGINT) OVER (ORDER BY stage) AS rate_from FROM {STAGES}), y AS (SELECT stage::INT AS stage, duration, target, rate_from, ((rate_from + target) * duration) // 2 AS requests FROM x) SELECT *, sum(requests) OVER (ORDER BY stage)::BIGINT AS cumulative FROM y",
        "q_stratified_sample": f"WITH {BASE} SELECT y, event_id FROM (SELECT y, event_id, row_number() OVER (PARTITION BY y ORDER BY event_id) AS n FROM v) WHERE n <= 100",
        "q_false_positives_top20": f"WITH {BASE} SELECT event_id, {POINTS} AS points, d0, d11 FROM v WHERE {POINTS} < 15 AND {SAFE} AND y = 1 ORDER BY event_id LIMIT 20",
        "q_results_upsert": f"WITH {BASE}, o AS (SELECT event_id, k, 'old' AS origin FROM v WHERE event_id % 2 = 0), w AS (SELECT event_id, k + 1 AS k, 'new' AS origin FROM v WHERE event_id % 3 = 0) SELECT * FROM o WHERE event_id NOT IN (SELECT event_id FROM w) UNION ALL SELECT * FROM w",
        "q_round_robin": "SELECT ((event_id - 1) % 2 + 2) % 2 AS node, count(*) AS n FROM events GROUP BY 1",
        "q_json_roundtrip": f"WITH {BASE} SELECT event_id, round(amount, 6) AS amount, mcc, (nth = 1) AS unknown, lt IS NULL AS first_one FROM f0",
        "q_set_union": f"WITH {BASE} SELECT k FROM v WHERE y = 1 UNION SELECT k FROM v WHERE event_id % 7 = 0",
    }
