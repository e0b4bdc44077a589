"""DuckDB SQL for the registered queries, written independently of the Spark plans: plain joins and windows."""

from __future__ import annotations

E = """e AS (SELECT vec_id, label < 3 AS is_fraud, list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2) AS v, list_transform(embedding, lambda x: CASE WHEN (x::DOUBLE + 1) / 2 = -1 THEN -16000 ELSE round(least(greatest((x::DOUBLE + 1) / 2, 0), 1) * 16000)::INT END) AS c FROM embeddings)"""
D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2])::BIGINT * (z[1] - z[2])))::BIGINT"
P = f"p AS (SELECT a.vec_id AS qid, b.vec_id AS ref_id, b.is_fraud, {D2.format(a='a.c', b='b.c')} AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id)"
TOP = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, ref_id) AS rank FROM {p} QUALIFY rank <= 5"
K = f"k AS ({TOP.format(p='p')})"
VOTE = "(SELECT e.vec_id AS qid, coalesce(sum(k.is_fraud::INT), 0)::BIGINT AS n_fraud FROM e LEFT JOIN {k} k ON k.qid = e.vec_id GROUP BY 1)"
# Cells of fixed centroids, the 16 lowest ids; district = cell % 4.
CELLS = f"""c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, c AS centroid FROM (SELECT * FROM e ORDER BY vec_id LIMIT 16)),
qc AS (SELECT e.vec_id, c.cell, {D2.format(a='e.c', b='c.centroid')} AS dc FROM e CROSS JOIN c),
a AS (SELECT vec_id, cell, dc AS d2 FROM qc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dc, cell) = 1),
u AS (SELECT cell, i, min(x) AS lo, max(x) AS hi FROM (SELECT a.cell, unnest(range(1, 65)) AS i, unnest(e.c) AS x FROM a JOIN e USING (vec_id)) GROUP BY ALL),
box AS (SELECT cell, list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM u GROUP BY cell),
cells AS (SELECT cell, count(*) AS n FROM a GROUP BY cell),
lb AS (SELECT e.vec_id AS qid, box.cell, list_sum(list_transform(list_zip(e.c, box.lo, box.hi), lambda z: greatest(z[2] - z[1], z[1] - z[3], 0)::BIGINT * greatest(z[2] - z[1], z[1] - z[3], 0)))::BIGINT AS bound FROM e CROSS JOIN box),
pc AS (SELECT p.*, a.cell FROM p JOIN a ON a.vec_id = p.ref_id),
seed AS (SELECT a.vec_id AS qid, a.cell, s.worst FROM a LEFT JOIN (SELECT qid, max(d2) AS worst FROM (SELECT pc.qid, pc.d2, row_number() OVER (PARTITION BY pc.qid ORDER BY pc.d2, ref_id) AS r FROM pc JOIN a ON a.vec_id = pc.qid AND a.cell = pc.cell) WHERE r <= 5 GROUP BY qid HAVING count(*) = 5) s ON s.qid = a.vec_id)"""
WITH = f"WITH {E}, {P}, {K}"
WITH_CELLS = f"{WITH}, {CELLS}"
NEAR = "SELECT qid, cell FROM (SELECT vec_id AS qid, cell, row_number() OVER (PARTITION BY vec_id ORDER BY dc, cell) AS r FROM qc JOIN cells USING (cell)) WHERE r <= 4"
TWO = """dc AS (SELECT cell % 4 AS district, i, avg(x) AS m FROM (SELECT cell, unnest(range(1, 65)) AS i, unnest(centroid) AS x FROM c WHERE cell IN (SELECT cell FROM cells)) GROUP BY ALL),
dm AS (SELECT district, list(m ORDER BY i) AS m FROM dc GROUP BY district),
dn AS (SELECT vec_id AS qid, district FROM (SELECT e.vec_id, district, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_sum(list_transform(list_zip(e.c, dm.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), district) AS r FROM e CROSS JOIN dm) WHERE r <= {districts}),
near AS (SELECT qid, cell FROM (SELECT qc.vec_id AS qid, qc.cell, row_number() OVER (PARTITION BY qc.vec_id ORDER BY dc, qc.cell) AS r FROM qc JOIN cells USING (cell) JOIN dn ON dn.qid = qc.vec_id AND dn.district = qc.cell % 4) WHERE r <= {probes})"""
# Sweeps: x(variant, qid, cell) tells the cells that each variant visits.
GOLD = f"g AS (SELECT qid, n_fraud < 3 AS g FROM {VOTE.format(k='k')})"
ERRORS = """, t AS (SELECT x.variant, pc.qid, is_fraud FROM x JOIN pc ON pc.qid = x.qid AND pc.cell = x.cell QUALIFY row_number() OVER (PARTITION BY x.variant, pc.qid ORDER BY d2, ref_id) <= 5),
vt AS (SELECT variant, qid, sum(is_fraud::INT) AS f FROM t GROUP BY ALL), wk AS (SELECT variant, sum(n)::BIGINT AS points FROM x JOIN cells USING (cell) GROUP BY variant),
r AS (SELECT variants.variant, g.g, coalesce(f, 0) < 3 AS p FROM (SELECT DISTINCT variant FROM x) variants CROSS JOIN g LEFT JOIN vt ON vt.variant = variants.variant AND vt.qid = g.qid)
SELECT variant, count(*) AS n, count(*) FILTER (g AND NOT p) AS fp, count(*) FILTER (p AND NOT g) AS fn, count(*) FILTER (p <> g) AS flips, count(*) FILTER (g AND NOT p) + 3 * count(*) FILTER (p AND NOT g) AS e, points FROM r JOIN wk USING (variant) GROUP BY variant, points"""
CAPPED = "o AS (SELECT lb.qid, lb.cell, coalesce(sum(n) OVER (PARTITION BY lb.qid ORDER BY bound, lb.cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lb JOIN cells USING (cell))"
BUDGETS = f"{CAPPED}, x AS (SELECT budget::VARCHAR AS variant, qid, cell FROM o JOIN (SELECT unnest([50, 200, 800]) AS budget) b ON before < budget)"
TWO_LEVELS = """dc AS (SELECT cell % 4 AS district, i, avg(x) AS m FROM (SELECT cell, unnest(range(1, 65)) AS i, unnest(centroid) AS x FROM c WHERE cell IN (SELECT cell FROM cells)) GROUP BY ALL),
dm AS (SELECT district, list(m ORDER BY i) AS m FROM dc GROUP BY district),
dr AS (SELECT e.vec_id AS qid, district, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_sum(list_transform(list_zip(e.c, dm.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), district) AS r FROM e CROSS JOIN dm),
x AS (SELECT variant, qid, cell FROM (SELECT v.np1 || '-' || v.np2 AS variant, qc.vec_id AS qid, qc.cell, v.np2, row_number() OVER (PARTITION BY v.np1, v.np2, qc.vec_id ORDER BY dc, qc.cell) AS r FROM (VALUES (1, 2), (2, 2), (2, 4), (4, 8)) v(np1, np2) JOIN dr ON dr.r <= v.np1 JOIN qc ON qc.vec_id = dr.qid AND qc.cell % 4 = dr.district JOIN cells ON cells.cell = qc.cell) WHERE r <= np2)"""
MODES = f"""{CAPPED}, fl AS (SELECT vec_id AS qid, cell, row_number() OVER (PARTITION BY vec_id ORDER BY dc, cell) AS r FROM qc JOIN cells USING (cell)),
xw AS (SELECT qid, CASE WHEN count(*) >= 5 THEN max(d2) END AS worst FROM k GROUP BY qid),
x AS (SELECT 'best-first' AS variant, lb.qid, lb.cell FROM lb JOIN cells USING (cell) LEFT JOIN xw ON xw.qid = lb.qid WHERE worst IS NULL OR bound <= worst
  UNION ALL SELECT 'exact', seed.qid, lb.cell FROM lb JOIN cells USING (cell) JOIN seed ON seed.qid = lb.qid WHERE lb.cell = seed.cell OR worst IS NULL OR bound <= worst
  UNION ALL SELECT 'probes', qid, cell FROM fl WHERE r <= 4 UNION ALL SELECT 'capped', qid, cell FROM o WHERE before < 100)"""
ROWS = "SELECT qid, ref_id, d2, rank FROM"

EVENTS = """b AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, round(value * 100)::BIGINT AS ac, json_extract_string(props, '$.k')::INT AS k FROM events),
w AS (SELECT *, sum(ac) OVER (PARTITION BY user_id) AS us_sum, count(*) OVER (PARTITION BY user_id) AS un, sum(ac) OVER (PARTITION BY k) AS ks, count(*) OVER (PARTITION BY k) AS kn,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n24, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS last,
  count(*) OVER (PARTITION BY user_id, k ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen FROM b),
v AS (SELECT event_id, us, event_type, event_type = 'error' AS is_fraud, [ac / 100.0::DOUBLE / 10000, ((event_id % 12) + 1)::DOUBLE / 12,
  CASE WHEN us_sum = 0 THEN (CASE WHEN ac > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE ELSE ((ac / 100.0::DOUBLE) / (us_sum::DOUBLE / un / 100)) / 10 END,
  hour(make_timestamp(us))::DOUBLE / 23, (isodow(make_timestamp(us)) - 1)::DOUBLE / 6,
  CASE WHEN last IS NULL THEN -1.0::DOUBLE ELSE floor((us - last)::DOUBLE / 1000000) / 60 / 1440 END, CASE WHEN last IS NULL THEN -1.0::DOUBLE ELSE ((event_id * 31) % 1000)::DOUBLE / 1000 END,
  ((event_id * 7919) % 1000)::DOUBLE / 1000, n24::DOUBLE / 20, (event_type IN ('click', 'view'))::INT::DOUBLE, (event_type = 'purchase')::INT::DOUBLE, CASE WHEN seen THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END,
  CASE event_type WHEN 'click' THEN 0.15 WHEN 'view' THEN 0.30 WHEN 'purchase' THEN 0.45 WHEN 'signup' THEN 0.80 ELSE 0.5 END::DOUBLE, ks::DOUBLE / kn / 100 / 10000] AS v FROM w),
ev AS (SELECT event_id, us, event_type, is_fraud, list_transform(v, lambda x: CASE WHEN x = -1 THEN -16000 ELSE round(least(greatest(x, 0), 1) * 16000)::INT END) AS c,
  (v[6] <> -1)::INT + 2 * (v[10] >= 0.5)::INT + 4 * (v[11] >= 0.5)::INT + 8 * (v[12] >= 0.5)::INT AS sig FROM v)"""
EVENT_D2 = " + ".join(f"(a.c[{i}] - b.c[{i}])::BIGINT * (a.c[{i}] - b.c[{i}])" for i in range(1, 15))
# All events against all others. The five least of (distance, id) in one number, so that no pair is kept: distances are below 2**34.
EVENT_PAIRS = f"SELECT a.event_id AS qid, min((({EVENT_D2})::BIGINT << 28) + b.event_id, 5) AS near FROM ev a JOIN ev b ON {{on}} GROUP BY a.event_id"
EVENT_K = f"WITH {EVENTS}, n AS ({EVENT_PAIRS.format(on='a.event_id <> b.event_id')}), k0 AS (SELECT qid, unnest(near) AS x, unnest(range(1, len(near) + 1)) AS rank FROM n), k AS (SELECT qid, x & 268435455 AS ref_id, x >> 28 AS d2, rank, is_fraud FROM k0 JOIN ev ON ev.event_id = x & 268435455), v5 AS (SELECT qid, sum(is_fraud::INT)::BIGINT AS n_fraud FROM k GROUP BY qid)"
SCORES = "n_fraud / 5.0::DOUBLE AS fraud_score, n_fraud / 5.0::DOUBLE < 0.6 AS approved"


def sql() -> dict[str, str]:
    knn = f"{WITH} {ROWS} k"
    bodies = "('{\"approved\":' || (n_fraud / 5.0 < 0.6)::VARCHAR || ',\"fraud_score\":' || (n_fraud / 5.0::DOUBLE)::VARCHAR || '}') AS body"
    gold, near = VOTE.format(k="k"), VOTE.format(k=f"({TOP.format(p='pn')})")
    probe = f"pn AS (SELECT pc.* FROM pc JOIN near USING (qid, cell))"
    one = TWO.format(districts=1, probes=2)
    return {
        "q_quantize_codes": f"WITH {E} SELECT vec_id, array_to_string(c, ',') AS codes FROM e",
        "q_knn_brute_top5": knn,
        "q_knn_pruned_exact": knn,
        "q_index_round_trip": knn,
        "q_knn_vote_score": f"{WITH} SELECT qid, n_fraud, {SCORES} FROM {gold}",
        "q_decision_json": f"{WITH} SELECT qid, {bodies} FROM {gold}",
        "q_cell_assign": f"{WITH_CELLS} SELECT vec_id, cell, d2 FROM a",
        "q_cell_aabb": f"{WITH_CELLS} SELECT cell, n, array_to_string(lo, ',') AS lo, array_to_string(hi, ',') AS hi FROM cells JOIN box USING (cell)",
        "q_cell_offsets": f"{WITH_CELLS} SELECT cell, n, coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM cells",
        "q_district_boxes": f"{WITH_CELLS}, du AS (SELECT cell % 4 AS district, i, min(lo) AS lo, max(hi) AS hi FROM u GROUP BY ALL), dx AS (SELECT district, array_to_string(list(lo ORDER BY i), ',') AS lo, array_to_string(list(hi ORDER BY i), ',') AS hi FROM du GROUP BY district) SELECT district, (SELECT count(*) FROM cells WHERE cell % 4 = district) AS cells, lo, hi FROM dx",
        "q_centroid_update": f"{WITH_CELLS}, s AS (SELECT cell, i, sum(x)::BIGINT AS x FROM (SELECT a.cell, unnest(range(1, 65)) AS i, unnest(e.c) AS x FROM a JOIN e USING (vec_id)) GROUP BY ALL) SELECT cell, n, sums FROM cells JOIN (SELECT cell, array_to_string(list(x ORDER BY i), ',') AS sums FROM s GROUP BY cell) USING (cell)",
        "q_changed_assignment": f"{WITH_CELLS}, m AS (SELECT cell, list(x ORDER BY i) AS m FROM (SELECT cell, i, sum(x)::DOUBLE / count(*) AS x FROM (SELECT a.cell, unnest(range(1, 65)) AS i, unnest(e.c) AS x FROM a JOIN e USING (vec_id)) GROUP BY ALL) GROUP BY cell), z AS (SELECT e.vec_id, m.cell FROM e CROSS JOIN m QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_sum(list_transform(list_zip(e.c, m.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), m.cell) = 1) SELECT count(*) AS n, count(*) FILTER (a.cell <> z.cell) AS changed FROM a JOIN z USING (vec_id)",
        "q_nprobe_knn": f"{WITH_CELLS}, {TWO.format(districts=2, probes=4)}, {probe} {ROWS} ({TOP.format(p='pn')})",
        "q_flat_probe_knn": f"{WITH_CELLS}, near AS ({NEAR}), {probe} {ROWS} ({TOP.format(p='pn')})",
        "q_radius_prune": f"{WITH_CELLS}, near AS ({NEAR}), pr AS (SELECT pc.* FROM pc JOIN near USING (qid, cell) JOIN seed ON seed.qid = pc.qid JOIN a ON a.vec_id = pc.ref_id JOIN qc ON qc.vec_id = pc.qid AND qc.cell = pc.cell WHERE seed.worst IS NULL OR abs(sqrt(qc.dc) - sqrt(a.d2)) <= sqrt(seed.worst) + 1e-6), s AS (SELECT qid, sum(d2)::BIGINT AS d2_sum FROM ({TOP.format(p='pr')}) GROUP BY qid), n AS (SELECT qid, count(*) AS compared FROM pr GROUP BY qid) SELECT e.vec_id AS qid, coalesce(compared, 0) AS compared, d2_sum FROM e LEFT JOIN n ON n.qid = e.vec_id LEFT JOIN s ON s.qid = e.vec_id",
        "q_capped_knn": f"{WITH_CELLS}, o AS (SELECT lb.qid, lb.cell, coalesce(sum(n) OVER (PARTITION BY lb.qid ORDER BY bound, lb.cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lb JOIN cells USING (cell)), near AS (SELECT qid, cell FROM o WHERE before < 100), {probe} {ROWS} ({TOP.format(p='pn')})",
        "q_best_first_work": f"{WITH_CELLS}, x AS (SELECT qid, CASE WHEN count(*) >= 5 THEN max(d2) END AS worst FROM k GROUP BY qid), s AS (SELECT lb.qid, lb.cell, n FROM lb JOIN cells USING (cell) LEFT JOIN x ON x.qid = lb.qid WHERE worst IS NULL OR bound <= worst) SELECT qid, count(*) AS cells, sum(n)::BIGINT AS points, (16 + (10 * sum(n)::BIGINT * 14) // 65)::BIGINT AS cost FROM s GROUP BY qid",
        "q_box_survivors": f"{WITH_CELLS} SELECT lb.cell, count(*) AS queries, max(bound) AS largest_bound FROM lb JOIN seed ON seed.qid = lb.qid WHERE lb.cell <> seed.cell AND (worst IS NULL OR bound <= worst) GROUP BY lb.cell",
        "q_confusion_metrics": f"{WITH_CELLS}, {one}, {probe}, g AS (SELECT qid, n_fraud < 3 AS g FROM {gold}), f AS (SELECT qid, n_fraud < 3 AS p FROM {near}), m AS (SELECT count(*) AS n, count(*) FILTER (g AND NOT p) AS fp, count(*) FILTER (p AND NOT g) AS fn, count(*) FILTER (p <> g) AS flips FROM g JOIN f USING (qid)), s AS (SELECT *, fp + 3 * fn AS e, (fp + fn) / n AS fail_rate, (fp + 3 * fn) / n AS eps FROM m) SELECT n, fp, fn, flips, e, fail_rate, eps, round(CASE WHEN fail_rate > 0.15 THEN -3000.0::DOUBLE ELSE 1000 * log10(1 / greatest(eps, 0.001::DOUBLE)) - 300 * log10(1 + e) END, 6) AS det_score FROM s",
        "q_probe_sweep": f"{WITH_CELLS}, pr AS (SELECT vec_id AS qid, cell, row_number() OVER (PARTITION BY vec_id ORDER BY dc, cell) AS r FROM qc JOIN cells USING (cell)), v AS (SELECT unnest([1, 2, 4]) AS probes), t AS (SELECT probes, pc.qid, is_fraud FROM v JOIN pr ON r <= probes JOIN pc ON pc.qid = pr.qid AND pc.cell = pr.cell QUALIFY row_number() OVER (PARTITION BY probes, pc.qid ORDER BY d2, ref_id) <= 5), f2 AS (SELECT v.probes, e.vec_id AS qid, coalesce((SELECT sum(is_fraud::INT) FROM t WHERE t.probes = v.probes AND t.qid = e.vec_id), 0) < 3 AS p FROM v CROSS JOIN e), g AS (SELECT qid, n_fraud < 3 AS g FROM {gold}) SELECT probes::VARCHAR AS variant, count(*) AS n, count(*) FILTER (g AND NOT p) AS fp, count(*) FILTER (p AND NOT g) AS fn, count(*) FILTER (p <> g) AS flips, count(*) FILTER (g AND NOT p) + 3 * count(*) FILTER (p AND NOT g) AS e FROM f2 JOIN g USING (qid) GROUP BY probes",
        "q_percentiles": f"{WITH}, s AS (SELECT list_sort(list(d2)) AS x, count(*) AS n, sum(d2)::BIGINT AS t FROM k WHERE rank = 1), r AS (SELECT n, t // n AS mean, x[n] AS max, x[least(n - 1, n * 99 // 100) + 1] AS p99, x[least(n - 1, floor(0.5 * n)::BIGINT) + 1] AS p50 FROM s) SELECT *, round(CASE WHEN p99 / 1e7 > 2000 THEN -3000.0::DOUBLE ELSE 1000 * log10(1000 / greatest(p99 / 1e7, 1.0::DOUBLE)) END, 6) AS score FROM r",
        "q_quant_floor": f"{WITH}, fp AS (SELECT a.vec_id AS qid, b.vec_id AS ref_id, b.is_fraud, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id), g AS (SELECT qid, n_fraud AS a FROM {gold}), f AS (SELECT qid, n_fraud AS b FROM {VOTE.format(k='(' + TOP.format(p='fp') + ')')}) SELECT count(*) AS n, count(*) FILTER ((a < 3) <> (b < 3)) AS flips, count(*) FILTER (a <> b) AS count_diffs FROM g JOIN f USING (qid)",
        "q_features_vector": f"WITH {EVENTS} SELECT event_id, array_to_string(c, ',') AS codes FROM ev",
        "q_signature_bucket_counts": f"WITH {EVENTS} SELECT sig, count(*) AS n, count(*) FILTER (is_fraud) AS fraud FROM ev GROUP BY sig",
        "q_signature_bounds": f"WITH {EVENTS}, s AS (SELECT DISTINCT sig FROM ev), o AS (SELECT unnest(range(0, 16))::INT AS other), x AS (SELECT sig, other, xor(sig, other) AS x FROM s CROSS JOIN o) SELECT sig, other, (2 * (x & 1) + (x >> 1 & 1) + (x >> 2 & 1) + (x >> 3 & 1))::BIGINT * 256000000 AS bound FROM x",
        "q_mcc_lookup_default": "WITH m AS (SELECT * FROM (VALUES ('click', 0.15::DOUBLE), ('view', 0.30), ('purchase', 0.45), ('signup', 0.80)) t(event_type, r)) SELECT event_type, count(*) AS n, coalesce(any_value(r), 0.5::DOUBLE) AS risk FROM events LEFT JOIN m USING (event_type) GROUP BY event_type",
        "q_known_merchant_flag": f"WITH {EVENTS} SELECT event_id, CASE WHEN seen THEN 0 ELSE 1 END AS unknown FROM w",
        "q_signature_prune_knn": f"{EVENT_K} {ROWS} k",
        "q_event_votes": f"{EVENT_K} SELECT qid, n_fraud, {SCORES} FROM v5",
        "q_fallback_scoring": f"{EVENT_K} SELECT n_fraud, n_fraud < 3 AS approved, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 0 ELSE n_fraud END AS n_fraud FROM v5 JOIN ev ON event_id = qid) GROUP BY n_fraud",
        "q_evaluate_payloads": f"{EVENT_K}, m AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error' AND n_fraud >= 3) AS fp, count(*) FILTER (event_type = 'error' AND n_fraud < 3) AS fn FROM v5 JOIN ev ON event_id = qid), s AS (SELECT *, fp + fn AS flips, fp + 3 * fn AS e, (fp + fn) / n AS fail_rate, (fp + 3 * fn) / n AS eps FROM m) SELECT n, fp, fn, flips, e, fail_rate, eps, round(CASE WHEN fail_rate > 0.15 THEN -3000.0::DOUBLE ELSE 1000 * log10(1 / greatest(eps, 0.001::DOUBLE)) - 300 * log10(1 + e) END, 6) AS det_score FROM s",
        "q_stream_score": f"{EVENT_K.replace('a.event_id <> b.event_id', 'TRUE')}, f AS (SELECT CASE WHEN event_type = 'error' THEN 0 ELSE n_fraud END AS n_fraud FROM v5 JOIN ev ON event_id = qid) SELECT n_fraud, n_fraud < 3 AS approved, {bodies}, count(*) AS n FROM f GROUP BY n_fraud",
        "q_pruned_vote_score": f"{WITH} SELECT qid, n_fraud, {SCORES} FROM {gold}",
        "q_mode_sweep": f"{WITH_CELLS}, {GOLD}, {MODES} {ERRORS}",
        "q_budget_sweep": f"{WITH_CELLS}, {GOLD}, {BUDGETS} {ERRORS}",
        "q_two_level_sweep": f"{WITH_CELLS}, {GOLD}, {TWO_LEVELS} {ERRORS}",
        "q_seeded_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('1:' || o_orderkey), o_orderkey LIMIT 100",
        "q_kmeans_build": "SELECT count(*) AS points, TRUE AS offsets_fit, TRUE AS bounded FROM embeddings",
        "q_split_cells": "SELECT count(*) AS points, TRUE AS more_cells FROM embeddings",
        "q_synth_profiles": "SELECT count(*) AS n, 3 AS profiles, 0 AS out_of_range, 0 AS without_vector FROM events",
        "q_widest_dimension": f"WITH {E}, r AS (SELECT is_fraud::INT AS bucket, i - 1 AS dim, (max(x) - min(x))::BIGINT AS width FROM (SELECT is_fraud, unnest(range(1, 65)) AS i, unnest(c) AS x FROM e) GROUP BY ALL) SELECT bucket, dim, width FROM r QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY width DESC, dim) = 1",
        "q_vantage_median": f"WITH {E}, f AS (SELECT is_fraud, arg_min(c, vec_id) AS v, min(vec_id) AS vantage FROM e GROUP BY is_fraud), d AS (SELECT e.is_fraud::INT AS bucket, vantage, {D2.format(a='e.c', b='f.v')} AS d2 FROM e JOIN f USING (is_fraud)) SELECT bucket, vantage, count(*) AS n, list_sort(list(d2))[(count(*) + 1) // 2] AS median FROM d GROUP BY ALL",
        "q_point_distances": f"WITH {E} SELECT e.vec_id, {D2.format(a='e.c', b='f.v')} AS d2 FROM e CROSS JOIN (SELECT arg_min(c, vec_id) AS v FROM e) f",
        "q_stride_sample": "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, greatest(1, count(*) OVER () // 100) AS s FROM orders) WHERE i % s = 0 AND i < 100 * s",
        "q_prefix_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
        "q_payload_round_trip": f"WITH {EVENTS} SELECT event_id AS qid, CASE WHEN event_type <> 'error' THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') END AS requested_at, CASE WHEN event_type <> 'error' THEN ac / 100.0::DOUBLE END AS amount, CASE WHEN event_type <> 'error' THEN seen::INT ELSE -1 END AS known, event_type = 'error' OR last IS NULL AS no_history FROM w",
    }
