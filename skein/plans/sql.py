"""DuckDB SQL of the registered queries that SQL expresses."""

_SIM = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
_OBS = """o AS (SELECT user_id AS track_id, event_id AS frame, epoch_us(ts) / 1e6 AS ts, value AS x,
  coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS y, event_type FROM events)"""
_BOX = """a AS (SELECT l_orderkey AS frame, l_partkey AS id, l_linenumber * 10 + 0.0::DOUBLE AS x1, l_linenumber * 5 + 0.0::DOUBLE AS y1,
  l_linenumber * 10 + 0.0::DOUBLE + 10 + l_quantity AS x2, l_linenumber * 5 + 0.0::DOUBLE + 20 + l_quantity / 2 AS y2 FROM lineitem),
b AS (SELECT frame, id, x1 + 2 AS x1, y1 + 4 AS y1, x2 + 2 AS x2, y2 + 4 AS y2 FROM a),
inter AS (SELECT a.frame, a.id AS truth_id, b.id AS found_id,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas
  FROM a JOIN b ON a.frame = b.frame),
iou AS (SELECT frame, truth_id, found_id, i / (areas - i + 1e-8) AS iou FROM inter)"""
_CROPS = """c AS (SELECT l_orderkey * 10 + l_linenumber AS crop_id, l_suppkey AS identity, l_quantity * 5 AS width, l_linenumber * 30.0::DOUBLE AS height,
  l_tax * 3000 + 5 AS mean, l_discount * 1000 AS contrast, l_extendedprice / 100 AS sharpness, 1 - l_discount AS confidence, l_linenumber - 1.0::DOUBLE AS x1 FROM lineitem),
g AS (SELECT *, CASE WHEN width * height < 1600 OR width < 30 OR height < 30 THEN 'size'
  WHEN NOT width / greatest(height, 1) BETWEEN 0.25 AND 4.0 THEN 'aspect'
  WHEN NOT mean BETWEEN 12 AND 248 THEN 'exposure' WHEN sharpness < 35 THEN 'blur' END AS prune_reason FROM c),
q AS (SELECT *, CASE WHEN prune_reason IS NULL THEN round(
  0.35::DOUBLE * least(1, greatest(0, (sharpness - 35) / 400)) + 0.25::DOUBLE * least(1, greatest(0, width * height / 50176)) + 0.15::DOUBLE * least(1, greatest(0, contrast / 70))
  + 0.15::DOUBLE * least(1, greatest(0, confidence)) + 0.10::DOUBLE * CASE WHEN x1 <= 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 4) ELSE 0.0::DOUBLE END AS quality FROM g)"""
_FOREST = """f AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 5 <> 0 AND c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer),
up AS (SELECT node, node AS master, 0 AS depth FROM f
  UNION ALL SELECT up.node, f.parent, depth + 1 FROM up JOIN f ON f.node = up.master WHERE f.parent IS NOT NULL),
masters AS (SELECT node, arg_max(master, depth) AS master FROM up GROUP BY node)"""


def _element_wise(how: str) -> str:
    return f"""SELECT label, pos, round({how}, 6) AS value FROM (
      SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, pos"""


_ISO = """strftime(make_timestamp((1785628800000000 + round({s} * 1000000))::BIGINT), '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN round({s} * 1000000)::BIGINT % 1000000 = 0 THEN '' ELSE '.' || lpad((round({s} * 1000000)::BIGINT % 1000000)::VARCHAR, 6, '0') END || '+00:00'"""

_LINES = """l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY ALL)"""
_MEANS = """WITH m AS (SELECT label, pos, avg(v) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)"""

SQL = {
    "knn_topk": f"""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
      SELECT vec_id, label, round(greatest(0, 1 - {_SIM.format(a="embedding", b="q")}), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10""",
    "knn_filtered": f"""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
      SELECT vec_id, label, round(greatest(0, 1 - {_SIM.format(a="embedding", b="q")}), 6) AS distance FROM embeddings, q WHERE label = 3 ORDER BY distance, vec_id LIMIT 10""",
    "knn_multi_query": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id)::INT AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(greatest(0, 1 - {_SIM.format(a="a.embedding", b="b.embedding")}), 6) AS distance
      FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10""",
    "euclidean_topk": """SELECT query_id, item_id, round(distance, 4) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id)::INT AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 6) AS distance
      FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 5""",
    "cosine_distance_edge": """SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE), (1, 1.0, 0.0, 0.5, 1.0), (2, 1.0, 0.0, 0.5, 1.0), (3, 1.0, 0.0, 0.5, 1.0),
      (4, 0.0, 1.0, 1.0, 0.0), (5, 2.0, -1.0, 0.0, 2.0), (6, 1.0, 0.0, 0.5, 1.0)) AS t(id, distance, similarity, score, by_sql)""",
    "all_pairs_stats": f"""SELECT label_a, label_b, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS deviation, round(min(s), 6) AS least, round(max(s), 6) AS most FROM (
      SELECT a.label AS label_a, b.label AS label_b, {_SIM.format(a="a.embedding", b="b.embedding")} AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) GROUP BY ALL""",
    "hybrid_keyword_score": """SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN c_acctbal / 9999 ELSE 0.1 END
      + CASE WHEN contains('a red truck near the building', lower(c_mktsegment)) THEN 0.05 ELSE 0 END + 0.05, 6) AS score FROM customer""",
    "vec_mean_by_label": _element_wise("avg(v)"),
    "vec_max_by_label": _element_wise("max(v)"),
    "vec_last_by_label": _element_wise("arg_max(v, vec_id)"),
    "reid_metrics": f"""WITH r AS (SELECT a.vec_id AS q, (a.label = b.label)::INT AS hit,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_SIM.format(a="a.embedding", b="b.embedding")}, 6) DESC, b.vec_id) AS rank
      FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
      s AS (SELECT *, sum(hit) OVER (PARTITION BY q ORDER BY rank) AS seen FROM r),
      p AS (SELECT q, min(rank) AS f, max(rank) AS l, count(*) AS n, avg(seen / rank) AS ap FROM s WHERE hit = 1 GROUP BY q)
      SELECT round(100 * avg((f = 1)::INT), 6) AS rank1, round(100 * avg((f <= 5)::INT), 6) AS rank5, round(100 * avg(ap), 6) AS map, round(100 * avg(n / l), 6) AS minp, count(*) AS n_queries FROM p""",
    "nl_metrics": """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
      p AS (SELECT user_id % 7 AS g, user_id, min(rank) FILTER (event_type = 'purchase') AS r FROM r GROUP BY ALL),
      t AS (SELECT g, avg(coalesce((r <= 1)::INT, 0)) AS r1, avg(coalesce((r <= 5)::INT, 0)) AS r5, avg(coalesce((r <= 10)::INT, 0)) AS r10, avg(coalesce(1 / r, 0)) AS mrr FROM p GROUP BY g)
      SELECT round(avg(r1), 6) AS r1, round(avg(r5), 6) AS r5, round(avg(r10), 6) AS r10, round(avg(mrr), 6) AS mrr, count(*) AS n_groups FROM t""",
    "frame_match_counts": f"WITH {_BOX} SELECT frame, count(*) AS n_pairs, round(max(iou), 6) AS best FROM iou WHERE iou >= 0.3 GROUP BY frame",
    "iou_pairs": f"WITH {_BOX} SELECT frame, truth_id, found_id, round(iou, 6) AS iou FROM iou WHERE iou >= 0.5",
    "where_compiler": "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value >= 10 AND value < 60.5 AND user_id > 3",
    "metadata_fallback": "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20",
    "temporal_context": """SELECT a.event_id, count(*) AS n, min(b.event_id) AS first_id, max(b.event_id) AS last_id FROM events a JOIN events b ON a.user_id = b.user_id
      AND epoch_us(b.ts) >= epoch_us(a.ts) - 3600000000 AND epoch_us(b.ts) < epoch_us(a.ts) + 3600000000 WHERE a.event_type = 'error' GROUP BY a.event_id""",
    "overlap_join_15s": """WITH i AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + abs(value) * 60 AS e FROM events)
      SELECT a.user_id, count(*) AS n_pairs FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_id < b.event_id AND greatest(a.s, b.s) <= least(a.e, b.e) + 15 GROUP BY a.user_id""",
    "asof_nearest": """SELECT p.event_id, arg_min(v.event_id, (abs(epoch_us(v.ts) - epoch_us(p.ts)), v.ts, v.event_id)) AS view_id
      FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id GROUP BY p.event_id""",
    "track_comparison": """WITH o AS (SELECT o_custkey AS a, min(epoch_us(o_orderdate)) / 1e6 AS s, max(epoch_us(o_orderdate)) / 1e6 AS e, avg(o_totalprice) AS w, count(*)::DOUBLE AS h FROM orders GROUP BY 1),
      j AS (SELECT x.a, CASE WHEN greatest(x.e, y.e) > least(x.s, y.s) THEN greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s)) ELSE 0 END AS t,
        greatest(0, 1 - (abs(x.w - y.w) / greatest(x.w, y.w) + abs(x.h - y.h) / greatest(x.h, y.h)) / 2) AS z FROM o x JOIN o y ON x.a = y.a + 1)
      SELECT a AS track, round(t, 6) AS time, round(z, 6) AS size, round((0.2::DOUBLE * z + 0.15::DOUBLE * (0.7::DOUBLE * t + 0.15::DOUBLE)) / 0.35::DOUBLE, 6) AS overall FROM j""",
    "video_catalog": f"""WITH n AS (SELECT 'clip' || user_id || '.mp4' AS video_name FROM events UNION SELECT 'S01_c' || lpad(s_nationkey::VARCHAR, 3, '0') || '.avi' FROM supplier),
      k AS (SELECT video_name, (row_number() OVER (ORDER BY video_name) - 1)::INT AS video_index FROM n)
      SELECT video_name, CASE WHEN video_name LIKE 'clip%' THEN 'c' || CASE WHEN length(regexp_extract(video_name, 'clip(\\d+)', 1)) < 3 THEN lpad(regexp_extract(video_name, 'clip(\\d+)', 1), 3, '0') ELSE regexp_extract(video_name, 'clip(\\d+)', 1) END
        ELSE regexp_extract(video_name, '(c\\d+)', 1) END AS camera_id, video_index, video_index * 120.0::DOUBLE AS start_timestamp_sec, {_ISO.format(s="(video_index * 120.0::DOUBLE)")} AS start_timestamp_iso FROM k""",
    "upsert_last_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "class_sets": """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'),
      t AS (SELECT 'both' AS kind, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT 'any', * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'gone', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
      SELECT kind, count(*) AS n, sum(l_partkey)::BIGINT AS total FROM t GROUP BY kind""",
    "master_resolution": f"WITH RECURSIVE {_FOREST} SELECT node, master FROM masters",
    "connected_components": f"WITH RECURSIVE {_FOREST} SELECT node, master AS label FROM masters WHERE node IN (SELECT node FROM f WHERE parent IS NOT NULL UNION SELECT parent FROM f WHERE parent IS NOT NULL)",
    "pivot_counts": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
    "mode_with_tie": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
    "top3_per_cluster": "SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey)::INT AS rank FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY rank <= 3",
    "variant_meta": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract(props, '$.k')::BIGINT ELSE -1 END AS k, CASE WHEN event_id % 3 <> 0 THEN 'bad:' || event_type END AS raw FROM events""",
    "names_and_keys": f"""SELECT p_partkey, 'c006_vdo.avi' AS feed, p_partkey::VARCHAR AS track, p_partkey::INT AS frame,
      round(CASE WHEN p_size % 2 = 0 THEN p_size + 0.5 ELSE p_partkey / 30.0::DOUBLE END::DOUBLE, 6) AS time,
      CASE p_size % 9 WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' WHEN 5 THEN 'bus' WHEN 7 THEN 'truck' ELSE 'unknown' END AS class_label, {_ISO.format(s="(p_size * 0.25::DOUBLE)")} AS iso FROM part""",
    "velocity_heading": f"""WITH {_OBS}, n AS (SELECT *, greatest(lead(ts) OVER w - ts, 1e-6) AS dt, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM o WINDOW w AS (PARTITION BY track_id ORDER BY ts, frame)),
      v AS (SELECT track_id, frame, coalesce(dx / dt, lag(dx / dt) OVER w, 0) AS vx, coalesce(dy / dt, lag(dy / dt) OVER w, 0) AS vy FROM n WINDOW w AS (PARTITION BY track_id ORDER BY ts, frame))
      SELECT track_id, frame, round(vx, 4) AS vx, round(vy, 4) AS vy, round(atan2(vy, vx), 4) AS heading FROM v""",
    "central_diff": f"""WITH {_OBS}, n AS (SELECT track_id, frame, coalesce(lead(ts) OVER w, ts) - coalesce(lag(ts) OVER w, ts) AS dt,
        coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM o WINDOW w AS (PARTITION BY track_id ORDER BY ts, frame))
      SELECT track_id, frame, round(CASE WHEN dt > 0 THEN dx / dt ELSE 0 END, 6) AS dx, round(CASE WHEN dt > 0 THEN dy / dt ELSE 0 END, 6) AS dy FROM n""",
    "arc_length": f"""WITH {_OBS}, n AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM o WINDOW w AS (PARTITION BY track_id ORDER BY ts, frame))
      SELECT track_id, frame, round(sum(step) OVER (PARTITION BY track_id ORDER BY ts, frame ROWS UNBOUNDED PRECEDING), 4) AS arc FROM n""",
    "run_length": """WITH d AS (SELECT DISTINCT user_id AS track_id, datediff('day', DATE '2024-01-01', ts::DATE) AS frame FROM events),
      i AS (SELECT track_id, frame - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS isle FROM d)
      SELECT track_id, max(n) AS max_consecutive FROM (SELECT track_id, isle, count(*) AS n FROM i GROUP BY ALL) GROUP BY track_id""",
    "lifecycle_events": f"""WITH {_OBS}, n AS (SELECT *, ts - lag(ts) OVER w AS b, lead(ts) OVER w - ts AS a FROM o WINDOW w AS (PARTITION BY track_id ORDER BY ts, frame)),
      e AS (SELECT track_id, frame, CASE WHEN b IS NULL THEN 'created' WHEN b > 86400 THEN 'recovered' ELSE 'updated' END AS event_type FROM n
        UNION ALL SELECT track_id, frame, 'lost' FROM n WHERE a IS NULL OR a > 86400)
      SELECT track_id, event_type, count(*) AS n, min(frame) AS first_frame FROM e GROUP BY ALL""",
    "linear_fit": f"""WITH {_OBS}, n AS (SELECT track_id, (ts - 1704067200) / 86400 AS t, x, y FROM o)
      SELECT track_id, round(coalesce(regr_slope(x, t), 0), 4) AS x_slope, round(coalesce(regr_intercept(x, t), avg(x)), 4) AS x_intercept,
        round(coalesce(regr_slope(y, t), 0), 4) AS y_slope, round(coalesce(regr_intercept(y, t), avg(y)), 4) AS y_intercept FROM n GROUP BY track_id""",
    "cleared_frame": """WITH b AS (SELECT l_partkey AS track_id, l_orderkey * 10 + l_linenumber AS frame, (l_orderkey * 10 + l_linenumber)::DOUBLE AS ts, l_quantity + 10 AS w, l_linenumber * 5 + 10.0::DOUBLE AS h, 1 - l_discount AS conf FROM lineitem),
      n AS (SELECT *, coalesce(lead(ts) OVER o, ts) - coalesce(lag(ts) OVER o, ts) AS dt, coalesce(lead(w) OVER o, w) - coalesce(lag(w) OVER o, w) AS dw, coalesce(lead(h) OVER o, h) - coalesce(lag(h) OVER o, h) AS dh,
        quantile_cont(w / h, 0.5) OVER (PARTITION BY track_id) AS m FROM b WINDOW o AS (PARTITION BY track_id ORDER BY ts, frame)),
      s AS (SELECT track_id, frame, ts, round(w * h * conf / ((1 + (CASE WHEN dt > 0 THEN abs(dw / dt) ELSE 0 END / w + CASE WHEN dt > 0 THEN abs(dh / dt) ELSE 0 END / h)) * (1 + 0.5::DOUBLE * abs(w / h - m) / m)), 6) AS score FROM n)
      SELECT track_id, frame, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, ts, frame) = 1""",
    "min_gap_thinning": f"""WITH RECURSIVE {_OBS}, k AS (SELECT track_id, min(ts) AS ts FROM o GROUP BY track_id
      UNION ALL SELECT * FROM (SELECT k.track_id, min(o.ts) AS ts FROM k JOIN o ON o.track_id = k.track_id AND o.ts - k.ts >= 86400 - 1e-6 GROUP BY k.track_id)) SELECT track_id, ts FROM k""",
    "downsample_count": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS frame FROM events QUALIFY (frame - 1) % 3 = 0",
    "ema_smoothing": f"""WITH RECURSIVE {_OBS}, r AS (SELECT track_id, x, row_number() OVER (PARTITION BY track_id ORDER BY ts, frame) AS n FROM o),
      e AS (SELECT track_id, n, x AS s FROM r WHERE n = 1 UNION ALL SELECT r.track_id, r.n, 0.9::DOUBLE * e.s + (1 - 0.9::DOUBLE) * r.x FROM e JOIN r ON r.track_id = e.track_id AND r.n = e.n + 1)
      SELECT track_id, round(arg_max(s, n), 6) AS smoothed FROM e GROUP BY track_id""",
    "quality_gate_and_score": f"WITH {_CROPS} SELECT crop_id, prune_reason, quality FROM q",
    "top_per_identity": f"WITH {_CROPS} SELECT identity, crop_id, quality, row_number() OVER (PARTITION BY identity ORDER BY quality DESC, crop_id)::INT AS rank FROM q WHERE prune_reason IS NULL QUALIFY rank <= 5",
    "track_quality": f"""WITH {_OBS}, t AS (SELECT track_id, count(*) AS n, sum(y / 100) AS conf, min(frame) AS a, max(frame) AS b, sum((event_type = 'error')::INT) AS recalls FROM o GROUP BY track_id),
      d AS (SELECT DISTINCT user_id AS track_id, datediff('day', DATE '2024-01-01', ts::DATE) AS frame FROM events),
      i AS (SELECT track_id, frame - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS isle FROM d),
      r AS (SELECT track_id, max(c) AS longest FROM (SELECT track_id, isle, count(*) AS c FROM i GROUP BY ALL) GROUP BY track_id)
      SELECT track_id, round(least(1, greatest(0, 0.3::DOUBLE * conf / n + 0.2::DOUBLE * least(1, (b - a + 1) / 100) + 0.3::DOUBLE * 0.9::DOUBLE + 0.2::DOUBLE * greatest(0, least(1, longest / 50) - 0.02::DOUBLE * recalls))), 6) AS quality FROM t JOIN r USING (track_id)""",
    "merged_histories": """SELECT user_id, day::VARCHAR AS day, event_id, event_type FROM (SELECT user_id, ts::DATE AS day, event_id, event_type FROM events WHERE event_type IN ('click', 'view'))
      QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_type DESC, event_id DESC) = 1""",
    "crop_plan": f"""WITH RECURSIVE {_OBS}, k AS (SELECT track_id, min(ts) AS ts FROM o GROUP BY track_id
      UNION ALL SELECT * FROM (SELECT k.track_id, min(o.ts) AS ts FROM k JOIN o ON o.track_id = k.track_id AND o.ts - k.ts >= 86400 - 1e-6 GROUP BY k.track_id))
      SELECT floor(ts / 3600)::BIGINT AS hour, count(*) AS n_crops, string_agg(track_id::VARCHAR, ',' ORDER BY track_id) AS track_ids FROM k GROUP BY 1""",
    "mean_pool_prototypes": """WITH m AS (SELECT track_id, pos, avg(v) AS m, count(*) AS n FROM (SELECT (label * 4 + vec_id % 4)::BIGINT AS track_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)
      SELECT track_id, max(n) AS n, round(sum(m) / (sqrt(sum(m * m)) + 1e-8), 4) AS total FROM m GROUP BY track_id""",
    "mot_spaced": f"""WITH {_LINES}, m AS (SELECT l_partkey AS id, l_quantity > 20 AS q, (40 - l_discount * 400) * 20 AS i FROM l WHERE l_tax > 0.01),
      h AS (SELECT id, q FROM m WHERE i > 0 AND i / (1600 - i + 1e-8) > 0.5), c AS (SELECT id, q, count(*) AS n FROM h GROUP BY ALL),
      k AS (SELECT (SELECT sum(n) FROM (SELECT max(n) AS n FROM c GROUP BY id))::BIGINT AS it, (SELECT count(*) FROM h) AS tp, (SELECT count(*) FROM l) AS gt, (SELECT count(*) FROM m) AS pr),
      s AS (SELECT *, 100 * tp / (pr + gt - tp + 1e-8) AS det, 100 * it / (tp + 1e-8) AS ass FROM k)
      SELECT round(100 * 2 * it / (pr + gt + 1e-8), 6) AS IDF1, round(100 * it / (pr + 1e-8), 6) AS IDP, round(100 * it / (gt + 1e-8), 6) AS IDR, round(sqrt(det * ass), 6) AS HOTA, round(det, 6) AS DetA, round(ass, 6) AS AssA,
        round(greatest(0, 100 * (1 - (pr + gt - 2 * tp) / (gt + 1e-8))), 6) AS MOTA, it AS IDTP, pr - it AS IDFP, gt - it AS IDFN FROM s""",
    "assignment_is_one_to_one": "SELECT true AS one_a, true AS one_b, true AS fine",
    "attention_pool": """WITH p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, exp(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(len(a.embedding))) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label),
      w AS (SELECT j, sum(w) AS w FROM (SELECT j, s / sum(s) OVER (PARTITION BY i) AS w FROM p) GROUP BY j), v AS (SELECT label, vec_id AS j, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
      m AS (SELECT label, pos, sum(w * v) AS m, count(*) AS n FROM v JOIN w USING (j) GROUP BY ALL) SELECT label::BIGINT AS track_id, max(n) AS n, round(sum(m) / sqrt(sum(m * m)), 4) AS total FROM m GROUP BY label""",
    "identities_are_whole": "SELECT count(*) AS n_tracks, true AS gapless, count(*) AS n_keys, false AS rises FROM embeddings",
    "clusters_are_whole": "SELECT count(*) AS n, 100.0::DOUBLE AS share, true AS short FROM embeddings",
    "plane_energy": "SELECT true AS holds",
    "identity_tracks": f"""WITH v AS (SELECT DISTINCT s_nationkey AS n FROM supplier), o AS (SELECT n, (row_number() OVER (ORDER BY 'S01_c' || lpad(n::VARCHAR, 3, '0') || '.avi') - 1) * 120.0::DOUBLE AS o FROM v),
      g AS (SELECT s_nationkey AS n, min(s_suppkey)::DOUBLE AS a, (max(s_suppkey) + 1)::DOUBLE AS b FROM supplier GROUP BY 1),
      r AS (SELECT 'S01_c' || lpad(n::VARCHAR, 3, '0') || '.avi' AS video, s_suppkey, n, a, b, a + o AS moment FROM supplier JOIN g ON s_nationkey = n JOIN o USING (n))
      SELECT video || '_' || s_suppkey AS id, 'g' || n AS global_id, s_suppkey AS track_id, 'c' || lpad(n::VARCHAR, 3, '0') AS camera_id, video AS video_name, moment AS camera_timestamp_sec, b AS end_time, 'vehicle' AS class_label, {_ISO.format(s="moment")} AS start_time_iso FROM r""",
    "reid_ingest": f"""{_MEANS}, u AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
      SELECT 'reid_clip' || label % 4 || '_app_' || label AS id, label::BIGINT AS track_id, 'c00' || label % 4 AS camera_id, 'clip' || label % 4 AS video_name, count(*)::INT AS vector_dim, round(sum((m / n)::FLOAT::DOUBLE), 4) AS total, 'osnet' AS model_name FROM m JOIN u USING (label) GROUP BY label""",
    "retrieval_ingest": """SELECT 'v' || vec_id AS id, 'g' || label AS global_id, vec_id AS track_id, 'c' || lpad(label::VARCHAR, 3, '0') AS camera_id, 'clip' || label AS video_name, 'default' AS model_name, len(embedding)::INT AS vector_dim,
      vec_id * 500.0::DOUBLE AS video_pos_ms, 'vehicle' AS class_label FROM embeddings""",
    "loaded_tracks": """SELECT 'f_1' AS feed, label::BIGINT AS track_id, 'car' AS class_label, (label + 1)::INT AS n_frames, round(sum(m), 4) AS total FROM (
      SELECT label, pos, max(v) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE label % 2 = 0) GROUP BY ALL) GROUP BY label""",
    "pair_mapping": f"""WITH RECURSIVE {_FOREST} SELECT 'k_' || lpad(node::VARCHAR, 9, '0') AS track_key, 'k_' || lpad(master::VARCHAR, 9, '0') AS global_id FROM masters
      WHERE node IN (SELECT node FROM f WHERE parent IS NOT NULL UNION SELECT parent FROM f WHERE parent IS NOT NULL)""",
    "identity_profiles": f"""{_MEANS}, t AS (SELECT label, sum(m) / sqrt(sum(m * m)) AS total FROM m GROUP BY label)
      SELECT 'g' || label AS global_id, string_agg(DISTINCT 'c' || vec_id % 3, ',' ORDER BY 'c' || vec_id % 3) AS cameras, string_agg(DISTINCT (vec_id % 7)::VARCHAR, ',' ORDER BY (vec_id % 7)::VARCHAR) AS tracks, min(vec_id) / 4 AS start_time,
        max(vec_id) / 4 - min(vec_id) / 4 AS duration_sec, count(*) AS num_representative_views, round(avg(vec_id % 10 / 10), 4) AS avg_quality_score, round(max(total), 4) AS total FROM embeddings JOIN t USING (label) GROUP BY label""",
    "gallery_matches": f"""WITH p AS (SELECT vec_id // 10 AS t, label, vec_id, embedding FROM embeddings WHERE vec_id % 10 < 2),
      m AS (SELECT t, label, list(m ORDER BY pos) AS mean FROM (SELECT t, label, pos, avg(v) AS m FROM (SELECT t, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM p) GROUP BY ALL) GROUP BY ALL),
      b AS (SELECT t, label, CASE WHEN t % 2 = 0 THEN last ELSE mean END AS v FROM (SELECT t, label, arg_max(embedding, vec_id)::DOUBLE[] AS last FROM p GROUP BY ALL) JOIN m USING (t, label))
      SELECT query_id, track_id, round(s, 5) AS similarity FROM (SELECT e.vec_id AS query_id, t * 100 + e.label AS track_id, {_SIM.format(a="e.embedding", b="b.v")} AS s FROM embeddings e JOIN b ON e.label = b.label WHERE e.vec_id % 20 = 0) WHERE s >= 0.1""",
    "attached_tracks": """WITH s AS (SELECT event_id * 3 AS key, 'c' || user_id % 20 AS a, event_id AS ts, value / 1000 AS sim FROM events),
      t AS (SELECT c_custkey AS k, 'c' || c_nationkey AS b, c_custkey * 7 AS st, c_mktsegment AS cls FROM customer),
      near AS (SELECT k, sim FROM t JOIN s ON ts BETWEEN st - 15 AND st + 20 AND (contains(b, a) OR contains(a, b))), best AS (SELECT k, max(sim) AS m FROM (SELECT * FROM near UNION ALL SELECT k, sim FROM t JOIN s ON key = k) GROUP BY k),
      r AS (SELECT 't' || k AS id, round(coalesce(m, 0.1) + CASE WHEN contains('a van by the machinery', lower(cls)) THEN 0.05::DOUBLE ELSE 0 END + 0.05::DOUBLE, 6) AS score FROM t LEFT JOIN best USING (k))
      SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM r ORDER BY score DESC, id LIMIT 50""",
    "vector_tool": """SELECT vec_id::VARCHAR AS id, 'cam_2' AS camera_id, round(d, 5) AS distance FROM (SELECT vec_id, greatest(0, 1 - embedding[1]::DOUBLE / sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]]))) AS d FROM embeddings WHERE vec_id % 4 = 2)
      ORDER BY d, vec_id::VARCHAR LIMIT 15""",
    "metadata_tool": """SELECT event_id AS id, 'cam_3' AS camera_id, value AS camera_timestamp_sec, event_type AS class_label FROM events WHERE user_id % 5 = 3 AND value >= 10 AND value < 60 AND event_type = 'view' ORDER BY event_id LIMIT 30""",
    "video_positions": """WITH k AS (SELECT user_id % 5 AS c, epoch_us(ts) / 1e6 AS at, min(event_id)::DOUBLE AS pos FROM events WHERE event_type = 'view' GROUP BY ALL),
      q AS (SELECT event_id, user_id % 5 AS c, (epoch_us(ts) / 1e6)::DECIMAL(20, 3)::DOUBLE AS t FROM events WHERE event_type = 'error')
      SELECT event_id, round(greatest(0, m.pos + (t - m.at) * 1000), 1) AS pos_ms FROM (SELECT event_id, t, arg_min(k, (abs(k.at - t), k.at)) AS m FROM q JOIN k USING (c) WHERE event_id % 3 = 0 GROUP BY ALL)
      UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 1 THEN (event_id % 3000) * 1000.0::DOUBLE ELSE (event_id % 3000 + 3601)::DOUBLE END FROM q WHERE event_id % 3 > 0""",
    "registry_state": """SELECT user_id % 10 AS track_id, arg_max(event_type, event_id) AS class_label, count(*) AS n, round(sum(CASE WHEN event_id % 4 <> 0 THEN value ELSE 0 END), 3) AS total FROM events GROUP BY 1""",
    "fused_costs": f"""WITH {_BOX}, p AS (SELECT frame, iou, truth_id % 10 / 10 AS score, truth_id % 3 > 0 AND found_id % 3 > 0 AS two, (1 + (truth_id % 7) * (found_id % 7)) / (sqrt(1 + (truth_id % 7) ** 2) * sqrt(1 + (found_id % 7) ** 2)) AS alike FROM iou WHERE iou >= 0.5),
      c AS (SELECT frame, 1 - iou * CASE WHEN two THEN 0.7::DOUBLE * score + 0.3::DOUBLE * alike WHEN score > 0.25 THEN score ELSE 1 END AS cost FROM p)
      SELECT frame, count(*) AS n, round(min(cost), 6) AS least, round(max(cost), 6) AS most FROM c GROUP BY frame""",
    "active_tracks": """SELECT track_id, 120 AS points, 999999997.0::DOUBLE AS first FROM (SELECT o_custkey AS track_id, min(epoch_us(o_orderdate)) / 1e6 AS a, max(epoch_us(o_orderdate)) / 1e6 AS b FROM orders GROUP BY 1) WHERE a <= 1e9 AND 1e9 < b""",
    "asked_filters": """SELECT l_orderkey * 10 + l_linenumber AS id, (l_suppkey % 9)::INT AS class_id, true AS every FROM lineitem WHERE l_suppkey % 9 IN (2, 7) AND 1 - l_discount * 9 >= 0.25 AND l_quantity * l_quantity / 10000 > 0.02 AND l_orderkey <= 5000 AND l_linenumber > 1""",
    "finished_tracks": """SELECT 'f' || user_id % 3 AS feed, user_id AS track_id, count(*) AS n_vectors, round(1 / sqrt(1 + user_id % 2), 5) AS first FROM events WHERE user_id % 5 > 0 GROUP BY user_id""",
    "alongside_tracks": """WITH m AS (SELECT user_id AS k, min((epoch_us(ts) / 1e6 - 1704067200) / 3600) AS a, max((epoch_us(ts) / 1e6 - 1704067200) / 3600) AS b FROM events GROUP BY 1)
      SELECT x.k AS a, y.k AS b, CASE WHEN greatest(x.a, y.a) <= least(x.b, y.b) THEN round(greatest(x.a, y.a), 6) END AS shared_from, CASE WHEN greatest(x.a, y.a) <= least(x.b, y.b) THEN round(least(x.b, y.b), 6) END AS shared_to FROM m x JOIN m y ON y.k = x.k + 1""",
    "track_documents": """SELECT user_id AS track_id, 'car' AS class_label, 'c1' AS camera, count(*) AS n, count(*)::INT AS n_frames, round(min((epoch_us(ts) / 1e6 - 1704067200) / 3600), 6) AS start_time, round(max((epoch_us(ts) / 1e6 - 1704067200) / 3600), 6) AS end_time,
      0.5::DOUBLE * count(*) AS confidence FROM events GROUP BY user_id""",
    "whole_system": f"""WITH {_LINES}, c AS (SELECT l_partkey AS id, l_quantity > 20 AS q, count(*) AS n FROM l WHERE l_linenumber = 1 GROUP BY ALL), k AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(m) FROM (SELECT max(n) AS m FROM c GROUP BY id)) AS i)
      SELECT 0.0::DOUBLE AS rank1, round(round(200 * n / (2 * n + 1e-8), 6) - round(200 * i / (2 * n + 1e-8), 6), 2) AS IDF1, 0.0::DOUBLE AS DetA, 0.0::DOUBLE AS MOTA FROM k""",
}
