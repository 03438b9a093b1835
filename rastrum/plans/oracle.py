"""DuckDB SQL that gives the rows of each query of rastrum.plans.registry."""

from __future__ import annotations

from rastrum.plans import bridge
from rastrum.plans.bridge import GRID_H, GRID_W, IMG_H, IMG_W

_W = "lower(coalesce(scraped_weather, ''))"
_T = "CASE WHEN lower(coalesce(time_of_day, 'day')) LIKE '%night%' THEN 'night' ELSE 'day' END"
_B = f"CASE WHEN {_W} LIKE '%snow%' THEN 'snow' WHEN {_W} LIKE '%rain%' OR {_W} LIKE '%sleet%' OR {_W} LIKE '%hail%' OR {_W} LIKE '%storm%' OR {_W} LIKE '%drizzle%' THEN 'rain' ELSE 'fair' END"
_WEATHER = "CASE WHEN scraped_weather IS NULL THEN 'clear' WHEN lower(scraped_weather) LIKE '%snow%' THEN 'snow' WHEN regexp_matches(lower(scraped_weather), 'rain|drizzle|storm') THEN 'rain' ELSE lower(scraped_weather) END"

FRAMES = f"""f AS ({bridge.FRAMES}),
fc AS (SELECT *, {_B} AS weather, {_T} AS time, CASE WHEN has_metadata THEN CASE WHEN {_B} = 'snow' THEN 'snow' ELSE {_T} || '_' || {_B} END END AS condition FROM f),
fw AS (SELECT frame_id, ord, region, {_WEATHER} AS weather, lower(coalesce(time_of_day, 'day')) AS time FROM f)"""

_IOU_I = "greatest(0, least(k.x1, item[1].x1) - greatest(k.x0, item[1].x0)) * greatest(0, least(k.y1, item[1].y1) - greatest(k.y0, item[1].y0))"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
_HITS = f"list_transform(kept, lambda k: {_IOU_I} / ({_AREA.format('item[1]')} + {_AREA.format('k')} - {_IOU_I}) > 0.3)"

OBJECTS = f"""o AS ({bridge.OBJECTS}),
b0 AS (SELECT frame_id, CAST(seq AS INT) AS seq,
  CASE WHEN name = 'Vehicle' THEN 2 WHEN name = 'VulnerableVehicle' THEN 4 WHEN name = 'Pedestrian' THEN 5 WHEN name IN ('PoleObject', 'TrafficSign', 'TrafficLight', 'TrafficSignal', 'TrafficGuide') THEN 3 END AS class_id,
  greatest(0, CAST(trunc(xmin) AS INT)) AS x0, greatest(0, CAST(trunc(ymin) AS INT)) AS y0, least({IMG_W}, CAST(trunc(xmax) AS INT)) AS x1, least({IMG_H}, CAST(trunc(ymax) AS INT)) AS y1
  FROM o WHERE has_box),
b AS (SELECT *, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area FROM b0 WHERE class_id IS NOT NULL
  AND x1 - x0 >= CASE WHEN class_id = 2 THEN 30 ELSE 15 END AND y1 - y0 >= CASE WHEN class_id = 2 THEN 30 ELSE 15 END
  AND x1 - x0 <= 0.4 * {IMG_W} AND y1 - y0 <= 0.4 * {IMG_H} AND greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) <= 8.0)"""

MERGED = f"""{OBJECTS},
g AS (SELECT frame_id, class_id, min(seq) AS first_seq, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY area DESC, seq) AS items FROM b GROUP BY frame_id, class_id),
m0 AS (SELECT frame_id, class_id, first_seq, list_reduce(list_transform(items, lambda i: [i]), lambda kept, item:
  CASE WHEN list_contains({_HITS}, true)
  THEN list_transform(kept, lambda q, i: CASE WHEN i = list_position({_HITS}, true)
    THEN {{'x0': least(q.x0, item[1].x0), 'y0': least(q.y0, item[1].y0), 'x1': greatest(q.x1, item[1].x1), 'y1': greatest(q.y1, item[1].y1)}} ELSE q END)
  ELSE list_append(kept, item[1]) END) AS kept FROM g),
m1 AS (SELECT frame_id, class_id, first_seq, unnest(kept) AS r, generate_subscripts(kept, 1) - 1 AS pos FROM m0),
m AS (SELECT frame_id, class_id, first_seq, pos, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1, CAST((r.x1 - r.x0) * (r.y1 - r.y0) AS BIGINT) AS area FROM m1)"""


def _capped(k: int) -> str:
    return f"""{MERGED},
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, first_seq, class_id, pos) AS place FROM m QUALIFY place <= {k})"""


CELLS = f"""{_capped(75)},
ky AS (SELECT *, unnest(range(y0 * {GRID_H} // {IMG_H}, (y1 - 1) * {GRID_H} // {IMG_H} + 1)) AS y FROM k),
kx AS (SELECT *, unnest(range(x0 * {GRID_W} // {IMG_W}, (x1 - 1) * {GRID_W} // {IMG_W} + 1)) AS x FROM ky),
cells AS (SELECT frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, max(class_id) AS class_id FROM kx GROUP BY ALL)"""

HIST = f"""{CELLS},
h0 AS (SELECT frame_id, class_id, count(*) AS n FROM cells GROUP BY ALL),
h AS (SELECT frame_id, class_id, n FROM h0 UNION ALL SELECT frame_id, 0, CAST({GRID_H * GRID_W} - sum(n) AS BIGINT) FROM h0 GROUP BY frame_id HAVING sum(n) < {GRID_H * GRID_W}),
st AS (SELECT frame_id, CAST(sum(n) AS BIGINT) AS total_pixels, CAST(sum(CASE WHEN class_id > 0 THEN n ELSE 0 END) AS BIGINT) AS object_pixels, count(*) AS num_classes,
  (list(class_id ORDER BY n DESC, class_id))[1] AS dominant FROM h GROUP BY frame_id)"""

STATS = f"""{FRAMES}, {HIST},
s AS (SELECT frame_id, ord, condition, total_pixels, object_pixels, num_classes, dominant FROM fc JOIN st USING (frame_id)),
p0 AS (SELECT *, row_number() OVER (PARTITION BY condition, dominant ORDER BY md5(frame_id || '42'), frame_id) AS place, count(*) OVER (PARTITION BY condition, dominant) AS n_stratum FROM s WHERE condition IS NOT NULL),
p AS (SELECT *, CASE WHEN place <= n_stratum // 2 THEN 'train' WHEN place <= n_stratum // 2 + n_stratum // 4 THEN 'val' ELSE 'test' END AS split FROM p0)"""

_NAME = "CASE class_id WHEN 0 THEN 'background' WHEN 1 THEN 'ignore' WHEN 2 THEN 'vehicle' WHEN 3 THEN 'sign' WHEN 4 THEN 'cyclist' WHEN 5 THEN 'pedestrian' END"

POINTS = f"""pt AS ({bridge.POINTS_DUCK}),
q0 AS (SELECT frame_id, idx, x + 0.5 AS x, y - 0.25 AS y, z - 1 AS z FROM pt),
q1 AS (SELECT *, sqrt(x * x + y * y) AS r FROM q0 WHERE z > 0),
q2 AS (SELECT *, atan2(r, z) AS th FROM q1),
q3 AS (SELECT *, th * (1 + th * th * (0.05::DOUBLE + th * th * (-0.01::DOUBLE + th * th * (0.002::DOUBLE + th * th * -0.0005::DOUBLE)))) AS td FROM q2 WHERE th <= 1.2::DOUBLE),
q4 AS (SELECT *, CASE WHEN r > 0 THEN 300 * td * x / r + 320 ELSE 320 END AS u, CASE WHEN r > 0 THEN 300 * td * y / r + 240 ELSE 240 END AS v FROM q3),
pr AS (SELECT frame_id, idx, 1 AS camera_id, CAST(round_even(u, 0) AS INT) AS px, CAST(round_even(v, 0) AS INT) AS py, x, y, z FROM q4 WHERE u >= 10 AND u < 630 AND v >= 10 AND v < 470),
r0 AS (SELECT *, CAST(px AS FLOAT) * CAST({GRID_W / 640} AS FLOAT) AS sx, CAST(py AS FLOAT) * CAST({GRID_H / 480} AS FLOAT) AS sy FROM pr),
ra AS (SELECT frame_id, CAST(floor(sy) AS INT) AS y, CAST(floor(sx) AS INT) AS x,
  arg_max({{'xb': CAST(floor(least(1, greatest(0, (x + 50) / 100)) * 255) AS INT), 'yb': CAST(floor(least(1, greatest(0, (y + 50) / 100)) * 255) AS INT), 'zb': CAST(floor(least(1, greatest(0, z / 100)) * 255) AS INT)}}, idx) AS c
  FROM r0 WHERE sx >= 0 AND sx < {GRID_W} AND sy >= 0 AND sy < {GRID_H} GROUP BY frame_id, CAST(floor(sy) AS INT), CAST(floor(sx) AS INT)),
r AS (SELECT frame_id, y, x, c.xb AS xb, c.yb AS yb, c.zb AS zb FROM ra),
cv AS (SELECT * FROM r WHERE (xb > 3 OR yb > 3 OR zb > 3) AND zb < 255),
de AS (SELECT a.frame_id, a.y, a.x, any_value(a.zb) AS zb, count(*) AS cnt FROM cv a JOIN cv n ON a.frame_id = n.frame_id AND abs(a.y - n.y) <= 3 AND abs(a.x - n.x) <= 3 GROUP BY ALL)"""

_FOCUS = """fo AS (SELECT *, 'cyclists' AS category FROM o WHERE type = 'Bicycle' UNION ALL SELECT *, 'pedestrians' FROM o WHERE name = 'Pedestrian'
  UNION ALL SELECT *, 'signs' FROM o WHERE name IN ('TrafficSign', 'TrafficSignal') UNION ALL SELECT *, 'vehicles' FROM o WHERE name = 'Vehicle')"""
_OBJ = f"o AS ({bridge.OBJECTS})"
_FLAGS = """CASE WHEN fl = '' THEN 'normal' ELSE fl END"""
_FL = """fg AS (SELECT CASE WHEN fl = '' THEN 'normal' ELSE fl END AS flags FROM (SELECT concat_ws('+', CASE WHEN weather = 'rain' THEN 'wet_road' END, CASE WHEN weather = 'fog' THEN 'low_visibility' END,
  CASE WHEN weather = 'snow' THEN 'winter_driving' END, CASE WHEN time = 'night' THEN 'night_driving' END, CASE WHEN time = 'night' AND weather IN ('rain', 'snow', 'fog') THEN 'night_adverse_weather' END) AS fl FROM fw)),
fn AS (SELECT flags, count(*) AS n, round(count(*) / (SELECT count(*) FROM fg) * 100, 6) AS pct, flags LIKE '%night_adverse_weather%' OR flags LIKE '%winter_driving%' AS high_risk FROM fg GROUP BY flags)"""
_TITLE = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(flags, '_', ' '), '+', ' + '), 'normal', 'Normal'), 'wet road', 'Wet Road'), 'low visibility', 'Low Visibility'), 'winter driving', 'Winter Driving'), 'night driving', 'Night Driving'), 'night adverse weather', 'Night Adverse Weather'), '', ''), '', '')"
_TR = """t AS (SELECT lag(weather) OVER (ORDER BY ord) AS from_weather, weather AS to_weather FROM fw), tn AS (SELECT from_weather, to_weather, count(*) AS n FROM t WHERE from_weather IS NOT NULL GROUP BY ALL)"""
_SIX = ["clear", "cloudy", "fog", "rain", "snow", "windy"]
_CONDS = "(VALUES ('day_fair'), ('day_rain'), ('night_fair'), ('night_rain'), ('snow')) AS v(condition)"

ORACLE_SQL: dict[str, str] = {
    "frame_condition": f"WITH {FRAMES} SELECT frame_id, weather, time, condition FROM fc",
    "condition_distribution": f"WITH {FRAMES}, n AS (SELECT condition, count(*) AS n FROM fc GROUP BY condition) SELECT v.condition, coalesce(n, 0) AS n_frames, round(coalesce(n, 0) / (SELECT count(*) FROM fc) * 100, 6) AS pct FROM {_CONDS} LEFT JOIN n ON n.condition = v.condition",
    "frame_id_parse": f"WITH l AS ({bridge.PATHS}), p AS (SELECT ord, replace(replace(string_split(trim(line), '/')[-1], 'frame_', ''), '.png', '') AS frame_id FROM l WHERE trim(line) <> '') SELECT ord, frame_id, 'camera/frame_' || frame_id || '.png' AS path FROM p",
    "frame_class_histogram": f"WITH {HIST} SELECT frame_id, class_id, n, round(n / {GRID_H * GRID_W} * 100, 6) AS pct FROM h",
    "frame_object_stats": f"WITH {HIST} SELECT frame_id, total_pixels, object_pixels, num_classes FROM st",
    "dominant_class": f"WITH {HIST} SELECT frame_id, class_id, {_NAME} AS class_name FROM (SELECT frame_id, dominant AS class_id FROM st)",
    "viz_top2_per_condition": f"WITH {STATS} SELECT condition, frame_id, object_pixels, row_number() OVER (PARTITION BY condition ORDER BY object_pixels DESC, ord) AS place FROM s WHERE condition IS NOT NULL QUALIFY place <= 2",
    "stratified_split": f"WITH {STATS} SELECT frame_id, condition, dominant, split FROM p",
    "document_split": """WITH d AS (SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY md5(doc_id || '42'), doc_id) AS place, count(*) OVER (PARTITION BY lang, quality) AS n FROM d WHERE lang IS NOT NULL)
SELECT doc_id, lang, quality, CASE WHEN place <= n // 2 THEN 'train' WHEN place <= n // 2 + n // 4 THEN 'val' ELSE 'test' END AS split FROM r""",
    "split_by_condition": f"""WITH {STATS}, c AS (SELECT condition, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS n FROM p GROUP BY condition)
SELECT condition, train, val, test, round(train / n * 100, 6) AS train_pct, round(val / n * 100, 6) AS val_pct, round(test / n * 100, 6) AS test_pct FROM c""",
    "split_class_representation": f"""WITH {STATS}, a AS (SELECT split, class_id, count(*) AS frames, CAST(sum(n) AS BIGINT) AS pixels FROM h JOIN p USING (frame_id) GROUP BY ALL),
w AS (SELECT split, count(*) AS sf FROM p GROUP BY split), z AS (SELECT split, sum(pixels) AS sp FROM a GROUP BY split)
SELECT w.split, CAST(k.class_id AS INT) AS class_id, {_NAME.replace("class_id", "k.class_id")} AS class_name, coalesce(frames, 0) AS frames, round(coalesce(frames, 0) / sf * 100, 6) AS frames_pct, coalesce(pixels, 0) AS pixels, round(coalesce(pixels, 0) / sp * 100, 6) AS pixels_pct
FROM w JOIN z ON z.split = w.split CROSS JOIN (SELECT unnest(range(6)) AS class_id) k LEFT JOIN a ON a.split = w.split AND a.class_id = k.class_id""",
    "split_class_detail": f"""WITH {STATS}, j AS (SELECT split, condition, class_id, n FROM h JOIN p USING (frame_id)),
a AS (SELECT split, '(all)' AS condition, class_id, count(*) AS frames, CAST(sum(n) AS BIGINT) AS pixels FROM j GROUP BY split, class_id
UNION ALL SELECT split, condition, class_id, count(*), CAST(sum(n) AS BIGINT) FROM j WHERE split = 'test' GROUP BY split, condition, class_id),
w AS (SELECT split, '(all)' AS condition, count(*) AS sf FROM p GROUP BY split UNION ALL SELECT split, condition, count(*) FROM p WHERE split = 'test' GROUP BY split, condition)
SELECT split, condition, class_id, frames, round(frames / sf * 100, 6) AS frames_pct, pixels, round(pixels / sum(pixels) OVER (PARTITION BY split, condition) * 100, 6) AS pixels_pct FROM a JOIN w USING (split, condition)""",
    "condition_pixel_stats": f"""WITH {STATS}, a AS (SELECT condition, class_id, CAST(sum(n) AS BIGINT) AS pixels FROM h JOIN fc USING (frame_id) WHERE condition IS NOT NULL GROUP BY ALL)
SELECT condition, class_id, {_NAME} AS class_name, pixels, round(pixels / sum(pixels) OVER (PARTITION BY condition) * 100, 6) AS pct FROM a""",
    "box_filter": f"WITH {OBJECTS} SELECT frame_id, seq, class_id, x0, y0, x1, y1, area FROM b",
    "frame_status": f"WITH {OBJECTS}, n AS (SELECT frame_id, count(*) AS n FROM b GROUP BY frame_id) SELECT frame_id, coalesce(n, 0) AS n_boxes, CASE WHEN n > 0 THEN 'ok' ELSE 'failed' END AS status FROM (SELECT DISTINCT frame_id FROM o) LEFT JOIN n USING (frame_id)",
    "run_counters": f"WITH {OBJECTS}, n AS (SELECT DISTINCT frame_id FROM b) SELECT CASE WHEN n.frame_id IS NULL THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT DISTINCT frame_id FROM o) x LEFT JOIN n ON n.frame_id = x.frame_id GROUP BY ALL",
    "box_dedup": f"WITH {MERGED} SELECT frame_id, class_id, x0, y0, x1, y1, area FROM m",
    "box_topk": f"WITH {_capped(2)} SELECT frame_id, class_id, x0, y0, x1, y1, area, place FROM k",
    "mask_composite": f"WITH {CELLS} SELECT frame_id, y, x, class_id, {_NAME} AS class_name FROM cells",
    "prompt_masks": f"WITH {CELLS} SELECT frame_id, y, x, class_id FROM cells",
    "camera_labels": f"""WITH {CELLS}, e AS (SELECT frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, 1 AS class_id FROM (SELECT DISTINCT frame_id FROM cells), (SELECT unnest(range({GRID_H})) AS y), (SELECT unnest(range({GRID_W})) AS x) WHERE y < 5 OR y >= {GRID_H} - 5)
SELECT frame_id, y, x, max(class_id) AS class_id FROM (SELECT * FROM cells UNION ALL SELECT * FROM e) GROUP BY ALL""",
    "available_frames": f"WITH {FRAMES}, {_OBJ} SELECT frame_id FROM f INTERSECT SELECT frame_id FROM o",
    "resume_frames": f"WITH {FRAMES}, {OBJECTS} SELECT frame_id FROM f WHERE frame_id NOT IN (SELECT frame_id FROM b)",
    "sweep_neighbours": """SELECT frame_id, sensor, before_1, after_1 FROM (SELECT frame_id, user_id AS sensor, event_type, lag(frame_id) OVER w AS before_1, lead(frame_id) OVER w AS after_1
FROM (SELECT *, lpad(CAST(event_id AS STRING), 9, '0') AS frame_id FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, frame_id)) WHERE event_type = 'view'""",
    "project_points": f"WITH {POINTS} SELECT frame_id, idx, camera_id, px, py, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pr",
    "lidar_raster": f"WITH {POINTS} SELECT frame_id, y, x, xb, yb, zb FROM r",
    "lidar_density": f"WITH {POINTS} SELECT frame_id, y, x, cnt FROM de",
    "lidar_labels": f"""WITH {POINTS}, {CELLS}, l0 AS (SELECT de.*, cells.class_id AS seg, cnt <= 12 OR zb >= 230 OR de.y < 3 OR de.y >= {GRID_H} - 3 AS ig FROM de LEFT JOIN cells ON cells.frame_id = de.frame_id AND cells.y = de.y AND cells.x = de.x),
l1 AS (SELECT *, CASE WHEN seg BETWEEN 2 AND 5 AND NOT ig AND zb <= 153 THEN seg END AS own FROM l0)
SELECT frame_id, y, x, CASE WHEN ig THEN 1 WHEN own IS NOT NULL AND count(own) OVER (PARTITION BY frame_id, own) >= 5 THEN own ELSE 0 END AS label FROM l1""",
    "raster_qa": f"""WITH {POINTS}, l AS (SELECT frame_id, 'x' AS channel, xb AS v FROM r UNION ALL SELECT frame_id, 'y', yb FROM r UNION ALL SELECT frame_id, 'z', zb FROM r),
a AS (SELECT frame_id, channel, CAST(count(*) FILTER (v <> 0) AS BIGINT) AS nonzero, count(DISTINCT v) AS values, min(v) AS least, max(v) AS most FROM l GROUP BY ALL)
SELECT *, round(nonzero / {GRID_H * GRID_W} * 100, 6) AS density_pct, round(least / 255 * 100 - CASE WHEN channel = 'z' THEN 0 ELSE 50 END, 6) AS least_m, round(most / 255 * 100 - CASE WHEN channel = 'z' THEN 0 ELSE 50 END, 6) AS most_m FROM a""",
    "enhanced_points": f"""WITH {POINTS}, e AS (SELECT *, least(3, greatest(0.2::DOUBLE, 3 / (z + 1))) AS w FROM pr)
SELECT frame_id, idx, round(least(255, least(1, greatest(0, (x + 30) / 60)) * 255 * w) * w, 4) AS xe, round(least(255, least(1, greatest(0, (y + 15) / 30)) * 255 * w) * w, 4) AS ye, round(least(255, least(1, greatest(0, ln(z + 1) / ln(121))) * 255 * w) * w, 4) AS ze FROM e""",
    "mask_resized": f"WITH {CELLS} SELECT frame_id, class_id, 4 * count(*) AS n FROM cells GROUP BY ALL",
    "weather_share": f"WITH {FRAMES} SELECT weather, count(*) AS n, round(count(*) / (SELECT count(*) FROM fw) * 100, 6) AS pct FROM fw GROUP BY weather",
    "time_weather_crosstab": f"WITH {FRAMES} SELECT time, {', '.join(f"count(*) FILTER (weather = '{w}') AS {w}" for w in _SIX)} FROM fw GROUP BY time",
    "challenging_by_time": f"WITH {FRAMES}, n AS (SELECT weather, time, count(*) AS n FROM fw WHERE weather IN ('rain', 'snow', 'fog') GROUP BY ALL) SELECT weather, time, n, CAST(sum(n) OVER (PARTITION BY weather) AS BIGINT) AS total, round(n / sum(n) OVER (PARTITION BY weather) * 100, 6) AS pct FROM n",
    "severity_split": f"WITH {FRAMES} SELECT CASE WHEN weather IN ('clear', 'cloudy') THEN 'benign' WHEN weather IN ('rain', 'snow', 'fog') THEN 'challenging' ELSE 'other' END AS severity, count(*) AS n, round(count(*) / (SELECT count(*) FROM fw) * 100, 6) AS pct FROM fw GROUP BY 1",
    "weather_ratios": f"""WITH {FRAMES}, n AS (SELECT count(*) FILTER (time = 'day') AS day, count(*) FILTER (time = 'night') AS night, count(*) FILTER (weather = 'clear') AS clear, count(*) FILTER (weather = 'rain') AS rain FROM fw)
SELECT *, round(CASE WHEN night > 0 THEN day / night ELSE 0 END, 6) AS day_night, round(CASE WHEN rain > 0 THEN clear / rain ELSE 0 END, 6) AS clear_rain FROM n""",
    "challenging_flags": f"WITH {FRAMES}, {_FL} SELECT flags, n, pct, high_risk, {_TITLE} AS title FROM fn",
    "high_risk": f"WITH {FRAMES}, {_FL} SELECT flags, n, pct FROM fn WHERE high_risk",
    "weather_transitions": f"WITH {FRAMES}, {_TR} SELECT * FROM tn",
    "transition_matrix": f"WITH {FRAMES}, {_TR} SELECT from_weather, {', '.join(f"CAST(coalesce(sum(n) FILTER (to_weather = '{w}'), 0) AS BIGINT) AS {w}" for w in _SIX)} FROM tn GROUP BY from_weather",
    "weather_stability": f"WITH {FRAMES}, {_TR} SELECT from_weather AS weather, n, pct FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY from_weather) * 100, 6) AS pct FROM tn) WHERE from_weather = to_weather",
    "region_top_weather": f"WITH {FRAMES}, n AS (SELECT region, weather, count(*) AS n FROM fw GROUP BY ALL) SELECT region, weather, n, round(n / total * 100, 6) AS pct FROM (SELECT *, sum(n) OVER (PARTITION BY region) AS total, row_number() OVER (PARTITION BY region ORDER BY n DESC, weather) AS place FROM n) WHERE place = 1",
    "weather_extremes": f"WITH {FRAMES}, n AS (SELECT weather, count(*) AS n FROM fw GROUP BY weather) SELECT (SELECT weather FROM n ORDER BY n DESC, weather LIMIT 1) AS most, (SELECT weather FROM n ORDER BY n, weather LIMIT 1) AS least",
    "top_classes": f"WITH {_OBJ} SELECT name, count(*) AS n FROM o GROUP BY name ORDER BY n DESC, name LIMIT 10",
    "class_type_rollup": f"WITH {_OBJ} SELECT coalesce(name, '(all)') AS name, coalesce(type, '(all)') AS type, count(*) AS n, round(count(*) / (SELECT count(*) FROM o) * 100, 6) AS pct FROM o GROUP BY GROUPING SETS ((name), (type), (name, type))",
    "focus_per_frame": f"WITH {_OBJ}, {_FOCUS}, n AS (SELECT category, frame_id, count(*) AS n FROM fo GROUP BY ALL) SELECT category, CAST(sum(n) AS BIGINT) AS total, count(*) AS frames, max(n) AS most, round(avg(n), 6) AS mean, round(sum(n) / (SELECT count(*) FROM o) * 100, 6) AS pct FROM n GROUP BY category",
    "size_stats": f"""WITH {_OBJ}, {_FOCUS}, l AS (SELECT category, 'length' AS dimension, length AS v FROM fo UNION ALL SELECT category, 'width', width FROM fo UNION ALL SELECT category, 'height', height FROM fo)
SELECT category, dimension, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most FROM l WHERE v IS NOT NULL GROUP BY ALL""",
    "occlusion_share": f"WITH {_OBJ}, {_FOCUS}, n AS (SELECT category, occlusion, count(*) AS n FROM fo GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY category) * 100, 6) AS pct FROM n",
    "position_share": f"""WITH {_OBJ}, {_FOCUS}, n AS (SELECT category, relative_position, count(*) AS n FROM fo GROUP BY ALL), q AS (SELECT *, round(n / sum(n) OVER (PARTITION BY category) * 100, 6) AS pct FROM n)
SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, relative_position) AS place FROM q WHERE relative_position <> 'unknown' QUALIFY place <= 5""",
    "ego_lane": f"WITH {_OBJ}, {_FOCUS} SELECT category, count(*) FILTER (relative_position IN ('EgoLane', 'LeftAndEgoLane', 'RightAndEgoLane')) AS ego_lane, count(*) FILTER (relative_position NOT IN ('OffRoad', 'unknown')) AS on_road, count(*) FILTER (relative_position = 'OffRoad') AS off_road FROM fo GROUP BY category",
    "objects_histogram": f"WITH {_OBJ} SELECT k, count(*) AS n_frames FROM (SELECT count(*) AS k FROM o GROUP BY frame_id) GROUP BY k",
    "traffic_density": f"WITH {_OBJ}, n AS (SELECT count(*) AS k FROM o GROUP BY frame_id) SELECT count(*) FILTER (k < 5) AS low, count(*) FILTER (k BETWEEN 5 AND 15) AS medium, count(*) FILTER (k > 15) AS high, count(*) FILTER (k > 50) AS very_high FROM n",
    "scene_complexity": f"WITH {_OBJ}, n AS (SELECT CASE WHEN count(DISTINCT name) < 3 THEN 'simple' WHEN count(DISTINCT name) <= 6 THEN 'moderate' ELSE 'complex' END AS complexity FROM o GROUP BY frame_id) SELECT complexity, count(*) AS n, round(count(*) / (SELECT count(*) FROM n) * 100, 6) AS pct FROM n GROUP BY complexity",
    "objects_per_frame": f"WITH {_OBJ}, n AS (SELECT count(*) AS k FROM o GROUP BY frame_id) SELECT count(*) AS frames, CAST(sum(k) AS BIGINT) AS objects, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS std, min(k) AS least, max(k) AS most FROM n",
}
