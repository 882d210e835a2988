"""SQL for DuckDB of the registered queries, written from the rules and apart from the Spark plans.

Common steps are named sub-queries; a query's text holds those that come before it. Greedy rules
are recursive queries here. The court's maps are the same for all videos of the adapter, so their
matrices are solved below as linear systems and stand in the text as numbers.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

_W = "(PARTITION BY video_id ORDER BY frame)"


def _solve(src: list, dst: list) -> list[float]:
    """The nine entries of the projective map between four points, from its 8 x 8 linear system in exact fractions."""
    rows = []
    for p, q in zip(src, dst):
        x, y, u, v = (Fraction(float(np.float32(c))) for c in (*p, *q))
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    for i in range(8):
        pivot = next(k for k in range(i, 8) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [Fraction(c) / rows[i][i] for c in rows[i]]
        rows = [row if k == i else [c - row[i] * d for c, d in zip(row, rows[i])] for k, row in enumerate(rows)]
    return [*(float(row[8]) for row in rows), 1.0]


_SRC = [(1280 * 0.28, 100 * 0.46), (1280 * 0.72, 100 * 0.46), (1280 * 0.85, 100 * 0.97), (1280 * 0.15, 100 * 0.97)]
_DST = [(20, 20), (340, 20), (340, 580), (20, 580)]
_COURT = [(0.46, 13.40), (5.64, 13.40), (5.64, 0.0), (0.46, 0.0)]
_TO_MAP, _TO_UNIT, _TO_COURT = _solve(_SRC, _DST), _solve(_SRC, [(0, 0), (1, 0), (1, 1), (0, 1)]), _solve(_DST, _COURT)


def _project(m: list[float], x: str, y: str) -> tuple[str, str]:
    w = f"({m[6]!r} * {x} + {m[7]!r} * {y} + 1.0)"
    return f"(({m[0]!r} * {x} + {m[1]!r} * {y} + {m[2]!r}) / {w})", f"(({m[3]!r} * {x} + {m[4]!r} * {y} + {m[5]!r}) / {w})"


def _clean(src: str) -> str:
    """One cleaning pass over src(video_id, frame, x, y, typical)."""
    return f"""
  SELECT video_id, frame, x, y, typical FROM (
    SELECT *, max(CASE WHEN NOT spike THEN k END) OVER (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS calm_before,
      coalesce(min(CASE WHEN NOT spike THEN k END) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) AS calm_after
    FROM (
      SELECT *, one OR pair OR coalesce(lag(pair) OVER {_W}, false) OR coalesce(k >= 1 AND k <= n - 2 AND (
          (s_in > usual * (CASE WHEN k < 25 THEN 6 ELSE 4 END) AND s_out > usual * (CASE WHEN k < 25 THEN 6 ELSE 4 END))
          OR greatest(s_in, s_out) > usual * 12), false) AS spike
      FROM (
        SELECT *, two AND (k - max(CASE WHEN NOT two THEN k END) OVER (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS pair,
          coalesce(quantile_cont(CASE WHEN s_in > 0 THEN s_in END, 0.5) OVER (PARTITION BY video_id), 1.0) AS usual
        FROM (
          SELECT *, coalesce(k >= 1 AND k <= n - 3 AND NOT one AND NOT lead(one) OVER {_W} AND d_wide >= 1
              AND (d_in + d_out + d_next) / nullif(d_wide, 0) > 2.5 AND greatest(d_in, d_next) > 2 * typical, false) AS two
          FROM (
            SELECT *, coalesce(k >= 1 AND k <= n - 2 AND d_skip >= 1
                AND (d_in + d_out) / nullif(d_skip, 0) > (CASE WHEN k < 25 THEN 5.0 ELSE 2.5 END) AND greatest(d_in, d_out) > 2 * typical, false) AS one
            FROM (
              SELECT *, sqrt((x - xb) ** 2 + (y - yb) ** 2) AS d_in, sqrt((xa - x) ** 2 + (ya - y) ** 2) AS d_out,
                sqrt((xaa - xa) ** 2 + (yaa - ya) ** 2) AS d_next, sqrt((xa - xb) ** 2 + (ya - yb) ** 2) AS d_skip,
                sqrt((xaa - xb) ** 2 + (yaa - yb) ** 2) AS d_wide,
                sqrt((x - xb) ** 2 + (y - yb) ** 2) / greatest(frame - fb, 1) AS s_in, sqrt((xa - x) ** 2 + (ya - y) ** 2) / greatest(fa - frame, 1) AS s_out
              FROM (
                SELECT *, row_number() OVER {_W} - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n,
                  lag(x) OVER {_W} AS xb, lag(y) OVER {_W} AS yb, lag(frame) OVER {_W} AS fb, lead(x) OVER {_W} AS xa, lead(y) OVER {_W} AS ya,
                  lead(frame) OVER {_W} AS fa, lead(x, 2) OVER {_W} AS xaa, lead(y, 2) OVER {_W} AS yaa
                FROM {src})))))))
  WHERE NOT (spike AND calm_after - calm_before - 1 < 3 AND n >= 4)"""


_STEPS: dict[str, str] = {
    "frames": """
  SELECT user_id::VARCHAR AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame,
    CASE WHEN event_type <> 'error' THEN value + 1.0 ELSE 0.0 END AS x,
    CASE WHEN event_type <> 'error' THEN (json_extract_string(props, '$.k')::INT + 1)::DOUBLE ELSE 0.0 END AS y
  FROM events""",
    "videos": "SELECT video_id, 5.0::DOUBLE AS fps, count(*)::INT AS n_frames FROM frames GROUP BY video_id",
    "points": "SELECT * FROM frames WHERE x > 0 AND y > 0",
    "steps": f"""
  SELECT *, frame - lag(frame) OVER {_W} AS gap, sqrt((x - lag(x) OVER {_W}) ** 2 + (y - lag(y) OVER {_W}) ** 2) AS step FROM points""",
    "typical": """
  SELECT video_id, CASE WHEN count(*) < 4 THEN 1.0 ELSE coalesce(quantile_cont(CASE WHEN step > 0 THEN step END, 0.5), 1.0) END AS typical
  FROM steps GROUP BY video_id""",
    "pass0": "SELECT p.*, t.typical FROM points p JOIN typical t USING (video_id)",
    "pass1": _clean("pass0"),
    "cleaned": _clean("pass1"),
    "stats": f"""
  SELECT video_id, count(*) AS points, quantile_cont(gap, 0.5) AS gap, any_value(typical) AS typical, max(y) - min(y) AS span
  FROM (SELECT *, frame - lag(frame) OVER {_W} AS gap FROM cleaned) GROUP BY video_id""",
    "ratios": """
  SELECT v.video_id, coalesce(points, 0) AS points, coalesce(points >= 5, false) AS adapts, gap, typical, fps / 30 AS scale,
    greatest(1.0, least(4.0, gap / 1.5)) AS ratio, greatest(0.4, least(1.0, span / 100 / 0.7)) AS span
  FROM videos v LEFT JOIN stats s USING (video_id)""",
    "params": """
  SELECT video_id, points::INT AS points, CASE WHEN adapts THEN gap ELSE 0.0 END AS avg_gap, CASE WHEN adapts THEN ratio ELSE 1.0 END AS gap_ratio,
    CASE WHEN adapts THEN greatest(5, trunc(gap * 3.5)::INT) ELSE 5 END AS max_frame_gap,
    CASE WHEN adapts THEN greatest(0.5, least(3.0 / (1.0 + (ratio - 1.0) * 0.4), typical / greatest(gap, 1.0) * 0.25)) ELSE 3.0 END AS min_speed,
    CASE WHEN adapts THEN greatest(20.0, 60.0 / ratio * span) ELSE 60.0 END AS min_flight,
    CASE WHEN adapts THEN greatest(5, trunc(12 * scale * 7 / 12)::INT) ELSE 12 END AS peak_distance,
    CASE WHEN adapts THEN greatest(10, trunc(15 * scale)::INT) ELSE 15 END AS near_future,
    CASE WHEN adapts THEN greatest(0.0, 20.0 / pow(ratio, 1.5)) ELSE 20.0 END AS min_floor_drop,
    CASE WHEN adapts THEN greatest(85.0, least(95.0, 85.0 + (ratio - 1.0) * 5.0)) ELSE 85.0 END AS floor_pct
  FROM ratios""",
    "ranked": """
  SELECT c.video_id, c.y, row_number() OVER (PARTITION BY c.video_id ORDER BY c.y, c.frame) - 1 AS r,
    (count(*) OVER (PARTITION BY c.video_id) - 1) * p.floor_pct / 100.0 AS pos
  FROM cleaned c JOIN params p USING (video_id)""",
    "floor_limits": """
  SELECT video_id, max(CASE WHEN r = floor(pos) THEN y END)
    + (max(CASE WHEN r = ceil(pos) THEN y END) - max(CASE WHEN r = floor(pos) THEN y END)) * max(pos - floor(pos)) AS "limit"
  FROM ranked GROUP BY video_id""",
    "turns": f"""
  SELECT *, (x - x0) / di AS ix, (y - y0) / di AS iy, (x2 - x) / dp AS ox, (y2 - y) / dp AS oy, x2 - x0 AS kx, y2 - y0 AS ky FROM (
    SELECT *, frame - f0 AS di, f2 - frame AS dp FROM (
      SELECT *, row_number() OVER {_W} - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n, lag(frame, 2) OVER {_W} AS f0, lag(x, 2) OVER {_W} AS x0,
        lag(y, 2) OVER {_W} AS y0, lead(frame, 2) OVER {_W} AS f2, lead(x, 2) OVER {_W} AS x2, lead(y, 2) OVER {_W} AS y2,
        last_value(x) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xe,
        last_value(y) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ye
      FROM cleaned) WHERE k >= 2 AND k < n - 2)""",
    "judged": """
  SELECT t.video_id, t.frame, t.x, t.y,
    sqrt((ox - ix) ** 2 + (oy - iy) ** 2) * (CASE WHEN oy - iy > 10 THEN 1.5 ELSE 1.0 END) AS impulse,
    CASE WHEN di > max_frame_gap OR dp > max_frame_gap THEN 'gap'
      WHEN sqrt(ix ** 2 + iy ** 2) < min_speed AND sqrt(ox ** 2 + oy ** 2) < min_speed THEN 'speed'
      WHEN sqrt(kx ** 2 + ky ** 2) > 1e-6 AND sqrt(ix ** 2 + iy ** 2) > 1e-6 AND
        degrees(acos(greatest(-1.0, least(1.0, (ix * kx + iy * ky) / (sqrt(ix ** 2 + iy ** 2) * sqrt(kx ** 2 + ky ** 2)))))) < 15 THEN 'skip'
      WHEN n - 1 - k < 3 THEN 'future'
      WHEN sqrt((xe - t.x) ** 2 + (ye - t.y) ** 2) < min_flight THEN 'flight'
      WHEN t.y > "limit" AND (SELECT min(c.y) FROM cleaned c WHERE c.video_id = t.video_id AND c.frame > t.frame AND c.frame <= t.frame + near_future)
        > t.y - min_floor_drop THEN 'floor'
      WHEN iy < -2 AND oy > 2 AND abs(ox - ix) < 4 THEN 'apex' END AS dropped
  FROM turns t JOIN params USING (video_id) JOIN floor_limits USING (video_id)""",
    "scores": """
  SELECT f.video_id, f.frame, coalesce(j.impulse, 0.0) AS score
  FROM frames f LEFT JOIN (SELECT * FROM judged WHERE dropped IS NULL) j USING (video_id, frame)""",
    "fences": """
  SELECT *, CASE WHEN scored >= 6 AND q3 - q1 > 1e-6 THEN q3 + 3 * (q3 - q1) END AS fence FROM (
    SELECT video_id, count(*) AS scored, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3, max(score) AS top
    FROM scores WHERE score > 0 GROUP BY video_id)""",
    "work": """
  SELECT *, CASE WHEN bool_or(score > fence) OVER (PARTITION BY video_id) THEN fence ELSE max(work) OVER (PARTITION BY video_id) END * 0.15 AS height
  FROM (SELECT s.*, f.fence, CASE WHEN s.score > f.fence THEN 0.0 ELSE s.score END AS work FROM scores s JOIN fences f USING (video_id))""",
}


def _maxima(src: str, value: str) -> str:
    return f"""
  SELECT video_id, ((lo + hi) // 2)::INT AS frame, v AS score FROM (
    SELECT *, lag(v) OVER (PARTITION BY video_id ORDER BY lo) AS before, lead(v) OVER (PARTITION BY video_id ORDER BY lo) AS after FROM (
      SELECT video_id, run, min(frame) AS lo, max(frame) AS hi, any_value({value}) AS v FROM (
        SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER {_W} AS run
        FROM (SELECT *, {value} <> lag({value}) OVER {_W} AS changed FROM {src}))
      GROUP BY video_id, run)) WHERE v > before AND v > after"""


def _apart(name: str, src: str) -> dict[str, str]:
    """Greedy by height with the video's peak_distance."""
    return {
        f"{name}_in": f"SELECT s.*, p.peak_distance AS d, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame DESC) AS i FROM {src} s JOIN params p USING (video_id)",
        f"{name}_walk": f"""
  SELECT video_id, i, [frame] AS kept FROM {name}_in WHERE i = 1
  UNION ALL
  SELECT n.video_id, n.i, CASE WHEN len(list_filter(w.kept, lambda f: abs(f - n.frame) < n.d)) = 0 THEN list_append(w.kept, n.frame) ELSE w.kept END
  FROM {name}_walk w JOIN {name}_in n ON n.video_id = w.video_id AND n.i = w.i + 1""",
        name: f"""
  SELECT s.video_id, s.frame, s.score FROM {src} s JOIN (SELECT video_id, arg_max(kept, i) AS kept FROM {name}_walk GROUP BY video_id) k USING (video_id)
  WHERE list_contains(k.kept, s.frame)""",
    }


def _prominence(src: str, series: str, value: str) -> str:
    return f"""
  SELECT p.*, p.score - greatest(
      (SELECT min(s.{value}) FROM {series} s WHERE s.video_id = p.video_id AND s.frame <= p.frame AND s.frame >
        coalesce((SELECT max(h.frame) FROM {series} h WHERE h.video_id = p.video_id AND h.frame < p.frame AND h.{value} > p.score), -1)),
      (SELECT min(s.{value}) FROM {series} s WHERE s.video_id = p.video_id AND s.frame >= p.frame AND s.frame <
        coalesce((SELECT min(h.frame) FROM {series} h WHERE h.video_id = p.video_id AND h.frame > p.frame AND h.{value} > p.score), 2147483647))) AS prominence
  FROM {src} p"""


def _nms(name: str, src: str) -> dict[str, str]:
    """Of peaks under 9 frames apart the stronger; the walk carries the one that may still be beaten."""
    return {
        f"{name}_in": f"SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS i FROM {src}",
        f"{name}_walk": f"""
  SELECT video_id, i, frame AS cf, score AS cs, NULL::INT AS ef, NULL::DOUBLE AS es FROM {name}_in WHERE i = 1
  UNION ALL
  SELECT n.video_id, n.i, CASE WHEN n.frame - cf >= 9 OR n.score > cs THEN n.frame ELSE cf END, CASE WHEN n.frame - cf >= 9 OR n.score > cs THEN n.score ELSE cs END,
    CASE WHEN n.frame - cf >= 9 THEN cf END, CASE WHEN n.frame - cf >= 9 THEN cs END
  FROM {name}_walk w JOIN {name}_in n ON n.video_id = w.video_id AND n.i = w.i + 1""",
        name: f"""
  SELECT video_id, ef AS frame, es AS score FROM {name}_walk WHERE ef IS NOT NULL
  UNION ALL SELECT video_id, arg_max(cf, i), arg_max(cs, i) FROM {name}_walk GROUP BY video_id""",
    }


_STEPS |= {
    "raw_maxima": _maxima("scores", "score"),
    "work_maxima": _maxima("work", "work"),
    "tall": "SELECT m.* FROM work_maxima m JOIN (SELECT DISTINCT video_id, height FROM work) h USING (video_id) WHERE m.score >= h.height",
    **_apart("raw_apart", "raw_maxima"),
    **_apart("far", "tall"),
    "raw_prominent": _prominence("raw_maxima", "scores", "score"),
    "prominent": _prominence("far", "work", "work"),
    "sure_peaks": "SELECT video_id, frame, score FROM prominent WHERE prominence >= 1.0",
    **_nms("raw_nms", "raw_maxima"),
    **_nms("peaks", "sure_peaks"),
    "hits": """
  SELECT p.video_id, row_number() OVER (PARTITION BY p.video_id ORDER BY p.frame)::INT AS hit_number, greatest(p.frame - 1, 0)::INT AS frame,
    greatest(p.frame - 1, 0) / 5.0::DOUBLE AS time_sec, p.score, CASE WHEN f.y < 50.5 THEN 'top' ELSE 'bottom' END AS owner
  FROM peaks p JOIN frames f USING (video_id, frame)""",
    "changes": f"""
  SELECT video_id, frame AS "trigger", round_even(fb + t * (frame - fb), 0)::INT AS frame, CASE WHEN above THEN 'bottom_to_top' ELSE 'top_to_bottom' END AS direction,
    xb + t * (x - xb) AS cross_x
  FROM (SELECT *, CASE WHEN abs(y - yb) < 1e-6 THEN 0.5 ELSE greatest(0.0, least(1.0, (50.5 - yb) / nullif(y - yb, 0))) END AS t FROM (
    SELECT *, y < 50.5 AS above, lag(y) OVER {_W} AS yb, lag(x) OVER {_W} AS xb, lag(frame) OVER {_W} AS fb FROM points) WHERE above <> (yb < 50.5))""",
    "changes_in": 'SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "trigger") AS i FROM changes',
    "cool_walk": """
  SELECT video_id, i, "trigger" - -15 > 15 AS kept, CASE WHEN "trigger" - -15 > 15 THEN frame ELSE -15 END AS last FROM changes_in WHERE i = 1
  UNION ALL
  SELECT n.video_id, n.i, n."trigger" - w.last > 15, CASE WHEN n."trigger" - w.last > 15 THEN n.frame ELSE w.last END
  FROM cool_walk w JOIN changes_in n ON n.video_id = w.video_id AND n.i = w.i + 1""",
    "crossings": """
  SELECT c.*, c.frame / 5.0::DOUBLE AS time_sec, CASE WHEN direction = 'top_to_bottom' THEN 'top' ELSE 'bottom' END AS hitter_side,
    CASE WHEN direction = 'top_to_bottom' THEN 'bottom' ELSE 'top' END AS receiver_side
  FROM changes_in c JOIN cool_walk w USING (video_id, i) WHERE w.kept""",
    "seekers": 'SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame, "trigger") AS j FROM crossings',
    "hit_lists": "SELECT video_id, list(frame ORDER BY frame) AS fs FROM hits GROUP BY video_id",
    "claim1": """
  SELECT video_id, 0::BIGINT AS j, NULL::INT AS got, NULL::VARCHAR AS side, []::INT[] AS taken FROM hit_lists
  UNION ALL
  SELECT s.video_id, s.j, list_max(free), s.hitter_side, CASE WHEN len(free) > 0 THEN list_append(s.taken, list_max(free)) ELSE s.taken END FROM (
    SELECT c.*, w.taken, list_filter(h.fs, lambda f: f >= c.frame - 60 AND f < c.frame AND NOT list_contains(w.taken, f)) AS free
    FROM claim1 w JOIN seekers c ON c.video_id = w.video_id AND c.j = w.j + 1 JOIN hit_lists h ON h.video_id = w.video_id) s""",
    "claim2": """
  SELECT video_id, 0::BIGINT AS j, NULL::INT AS got, NULL::VARCHAR AS side, arg_max(taken, j) AS taken FROM claim1 GROUP BY video_id
  UNION ALL
  SELECT s.video_id, s.j, list_min(free), s.receiver_side, CASE WHEN len(free) > 0 THEN list_append(s.taken, list_min(free)) ELSE s.taken END FROM (
    SELECT c.*, w.taken, list_filter(h.fs, lambda f: f > c.frame AND f <= c.frame + 60 AND NOT list_contains(w.taken, f)) AS free
    FROM claim2 w JOIN seekers c ON c.video_id = w.video_id AND c.j = w.j + 1 JOIN hit_lists h ON h.video_id = w.video_id) s""",
    "claims": "SELECT video_id, got AS frame, side FROM claim1 WHERE got IS NOT NULL UNION ALL SELECT video_id, got, side FROM claim2 WHERE got IS NOT NULL",
    "crossed": """
  SELECT h.*, coalesce(c.side, h.owner) AS new_owner, CASE WHEN c.side IS NULL THEN h.owner WHEN c.side = 'top' THEN 'pink_top' ELSE 'green_bottom' END AS player,
    CASE WHEN c.side IS NULL THEN 'peaks' ELSE 'peaks_crossed' END AS method FROM hits h LEFT JOIN claims c USING (video_id, frame)""",
    "rallied": f"""
  SELECT *, (sum(CASE WHEN wait > 3.0 THEN 1 ELSE 0 END) OVER {_W} + 1)::INT AS rally
  FROM (SELECT *, (frame - lag(frame) OVER {_W}) / 5.0::DOUBLE AS wait FROM hits)""",
    "alternated": """
  SELECT *, CASE WHEN odd = 1 THEN first_owner WHEN first_owner = 'top' THEN 'bottom' ELSE 'top' END AS side FROM (
    SELECT *, row_number() OVER r % 2 AS odd, first_value(owner) OVER r AS first_owner FROM rallied WINDOW r AS (PARTITION BY video_id, rally ORDER BY frame))""",
    "last_hits": "SELECT video_id, rally, max(frame) AS frame, max(hit_number) AS hit_number, arg_max(side, frame) AS side FROM alternated GROUP BY video_id, rally",
    "flights": """
  SELECT h.video_id, h.rally, h.hit_number, h.side, p.frame, p.x, p.y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY h.video_id, h.rally) AS m,
    lead(p.frame) OVER w - p.frame AS gap,
    (lag(p.x, 1) OVER w - lag(p.x, 3) OVER w) / greatest(lag(p.frame, 1) OVER w - lag(p.frame, 3) OVER w, 1) AS bx,
    (lag(p.y, 1) OVER w - lag(p.y, 3) OVER w) / greatest(lag(p.frame, 1) OVER w - lag(p.frame, 3) OVER w, 1) AS by_,
    (lead(p.x, 3) OVER w - lead(p.x, 1) OVER w) / greatest(lead(p.frame, 3) OVER w - lead(p.frame, 1) OVER w, 1) AS ax,
    (lead(p.y, 3) OVER w - lead(p.y, 1) OVER w) / greatest(lead(p.frame, 3) OVER w - lead(p.frame, 1) OVER w, 1) AS ay
  FROM last_hits h JOIN videos v USING (video_id) JOIN points p ON p.video_id = h.video_id AND p.frame >= h.frame + 3 AND p.frame < least(h.frame + 25, v.n_frames)
  WINDOW w AS (PARTITION BY h.video_id, h.rally ORDER BY p.frame)""",
    "bounces": """
  SELECT *, coalesce(i >= 3 AND i < m - 3 AND m >= 7 AND sb >= 1e-6 AND sa < 0.7 * sb
      AND degrees(acos(greatest(-1.0, least(1.0, (bx * ax + by_ * ay) / (sb * greatest(sa, 1e-6)))))) > 80, false) AS down
  FROM (SELECT *, sqrt(bx ** 2 + by_ ** 2) AS sb, sqrt(ax ** 2 + ay ** 2) AS sa FROM flights)""",
    "picks": """
  SELECT f.video_id, f.rally, coalesce(least((SELECT min(b.i) FROM bounces b WHERE b.video_id = f.video_id AND b.rally = f.rally AND b.i > f.one AND NOT b.down) - 1, f.one + 5), f.cut, f.m - 1) AS i
  FROM (SELECT video_id, rally, min(CASE WHEN down THEN i END) AS one, min(CASE WHEN gap > 4 THEN i END) AS cut, max(m) AS m FROM bounces GROUP BY video_id, rally) f""",
    "landed": "SELECT b.video_id, b.rally, b.frame, b.x AS sx, b.y AS sy, b.hit_number AS last_hit_number, b.side AS last_hit_owner FROM bounces b JOIN picks USING (video_id, rally, i)",
    "marks": """
  SELECT *, trunc(({0})::FLOAT)::INT AS mx, trunc(({1})::FLOAT)::INT AS my, row_number() OVER (PARTITION BY video_id ORDER BY rally)::INT AS rally_idx FROM landed""".format(*_project(_TO_MAP, "sx", "sy")),
    "courted": """
  SELECT *, ({0})::FLOAT::DOUBLE AS cx, ({1})::FLOAT::DOUBLE AS cy, CASE WHEN mx BETWEEN 20 AND 340 AND my BETWEEN 20 AND 300 THEN 'in_top' WHEN mx BETWEEN 20 AND 340 AND my BETWEEN 300 AND 580 THEN 'in_bottom' ELSE 'out' END AS location
  FROM marks""".format(*_project(_TO_COURT, "mx::DOUBLE", "my::DOUBLE")),
    "starts": "SELECT video_id, rally, min(frame) AS start FROM rallied WHERE rally > 1 GROUP BY video_id, rally",
    "spans": """
  SELECT m.video_id, m.frame, m.rally_idx, (SELECT min(s.start) FROM starts s WHERE s.video_id = m.video_id AND s.start > m.frame) AS until FROM marks m""",
    "kp": """
  SELECT (vec_id // 2)::INT AS frame, (vec_id % 2)::INT AS person_idx, unnest(range(17))::INT AS i,
    120 + 400 * unnest([embedding[3 * j + 1]::DOUBLE for j in range(17)]) AS x, 50 + 200 * unnest([embedding[3 * j + 2]::DOUBLE for j in range(17)]) AS y,
    4 * abs(unnest([embedding[3 * j + 3]::DOUBLE for j in range(17)])) AS conf FROM embeddings""",
    "body": """
  SELECT frame, person_idx,
    coalesce(quantile_cont(CASE WHEN i IN (15, 16) THEN sure END, 0.5), quantile_cont(CASE WHEN i IN (13, 14) THEN sure END, 0.5),
      quantile_cont(CASE WHEN i IN (11, 12) THEN sure END, 0.5), quantile_cont(CASE WHEN i IN (0, 5, 6, 7, 8, 9, 10) THEN sure END, 0.5), quantile_cont(sure, 0.5)) AS owner_path,
    CASE WHEN min(CASE WHEN i IN (11, 12) THEN conf END) >= 0.25 THEN avg(CASE WHEN i IN (11, 12) THEN y END)
      ELSE coalesce(quantile_cont(CASE WHEN i IN (0, 5, 6, 7, 8, 9, 10) THEN sure END, 0.5), quantile_cont(sure, 0.5)) END AS rescue_path
  FROM (SELECT *, CASE WHEN conf >= 0.25 AND y > 0 THEN y END AS sure FROM kp) GROUP BY frame, person_idx""",
    "feet": """
  SELECT frame, person_idx, coalesce(avg(x) FILTER (i IN (15, 16) AND conf >= 0.3 AND x > 0 AND y > 0), 0.0) AS x,
    coalesce(avg(y) FILTER (i IN (15, 16) AND conf >= 0.3 AND x > 0 AND y > 0), 0.0) AS y FROM kp GROUP BY frame, person_idx""",
    "people": "SELECT v.video_id, e.frame, e.person_idx FROM videos v JOIN (SELECT DISTINCT frame, person_idx FROM kp) e ON e.frame < v.n_frames",
    "on_map_all": """
  SELECT p.video_id, p.frame, p.person_idx, trunc(({0})::FLOAT)::INT AS mx, trunc(({1})::FLOAT)::INT AS my
  FROM people p JOIN feet f USING (frame, person_idx) WHERE f.x > 0 AND f.y > 0""".format(*_project(_TO_MAP, "f.x", "f.y")),
    "on_map_near": """
  SELECT *, CASE WHEN my < 300 THEN 'top' ELSE 'bottom' END AS side FROM on_map_all
  WHERE sqrt(greatest(20 - mx, 0, mx - 340) ** 2 + greatest(20 - my, 0, my - 580) ** 2) <= 30""",
    "on_map": "SELECT video_id, frame, side, arg_min(mx, abs(mx - 180) * 10 + person_idx) AS mx, arg_min(my, abs(mx - 180) * 10 + person_idx) AS my FROM on_map_near GROUP BY video_id, frame, side",
    "probes": """
  SELECT h.video_id, h.frame AS hit, h.frame + d.d AS frame, d.turn, f.x AS sx, f.y AS sy
  FROM hits h, (VALUES (0, 0), (1, 1), (-1, 2), (2, 3), (-2, 4)) d(d, turn), frames f, (SELECT DISTINCT video_id, frame FROM people) q, videos v
  WHERE v.video_id = h.video_id AND q.video_id = h.video_id AND q.frame = h.frame + d.d AND f.video_id = h.video_id AND f.frame = least(h.frame + d.d, v.n_frames - 1)
    AND (d.turn = 0 OR f.x > 0 AND f.y > 0)""",
    "probed": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, hit ORDER BY turn) AS r FROM probes) WHERE r = 1 AND sx > 0 AND sy > 0",
    "wrists": """
  SELECT video_id, hit AS frame, min(dist) AS dist, arg_min(center_y, o) AS center_y FROM (
    SELECT p.video_id, p.hit, sqrt((k.x - p.sx) ** 2 + (k.y - p.sy) ** 2) AS dist, b.owner_path AS center_y,
      row_number() OVER (PARTITION BY p.video_id, p.hit ORDER BY sqrt((k.x - p.sx) ** 2 + (k.y - p.sy) ** 2), k.person_idx, k.i) AS o
    FROM probed p JOIN kp k ON k.frame = p.frame JOIN body b ON b.frame = k.frame AND b.person_idx = k.person_idx
    WHERE k.i IN (9, 10) AND k.conf >= 0.25 AND k.x > 0 AND b.owner_path IS NOT NULL) GROUP BY video_id, hit HAVING min(dist) <= 150""",
    "misses": """
  SELECT s.video_id, s.frame, s.score FROM scores s JOIN fences f USING (video_id) JOIN params p USING (video_id)
  WHERE s.score > 0 AND s.score >= coalesce(f.fence, f.top) * 0.05 AND s.score < coalesce(f.fence, f.top) * 0.149
    AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.video_id = s.video_id AND (abs(s.frame - h.frame) <= p.peak_distance + 3 OR abs(s.frame - h.frame - 1) <= p.peak_distance + 3))""",
}


# Nets of the calibrated videos; a sloped net's crossings follow the same steps as a level one's.
_STEPS |= {
    "cal": """
  SELECT video_id, (yr - yl) / (xr - xl) AS slope, yl - (yr - yl) / (xr - xl) * xl AS intercept, (xl + xr) / 2 AS center FROM (
    SELECT v.video_id, t.* FROM videos v JOIN (VALUES (0, 200::DOUBLE, 46::DOUBLE, 1080::DOUBLE, 56::DOUBLE), (2, 300, 55, 900, 47)) t(k, xl, yl, xr, yr) ON v.video_id::INT % 4 = t.k)""",
    "s_changes": f"""
  SELECT video_id, frame AS "trigger", round_even(fb + t * (frame - fb), 0)::INT AS frame, CASE WHEN above THEN 'bottom_to_top' ELSE 'top_to_bottom' END AS direction,
    xb + t * (x - xb) AS cross_x
  FROM (SELECT *, CASE WHEN abs((y - yb) - slope * (x - xb)) < 1e-6 THEN 0.5 ELSE greatest(0.0, least(1.0, (nb - yb) / nullif((y - yb) - slope * (x - xb), 0))) END AS t FROM (
    SELECT *, y < net AS above, lag(y) OVER {_W} AS yb, lag(x) OVER {_W} AS xb, lag(frame) OVER {_W} AS fb, lag(net) OVER {_W} AS nb
    FROM (SELECT p.*, slope, slope * x + intercept AS net FROM points p JOIN cal USING (video_id))) WHERE above <> (yb < nb))""",
    "s_changes_in": _STEPS["changes_in"].replace("changes", "s_changes"),
    "s_cool_walk": _STEPS["cool_walk"].replace("changes_in", "s_changes_in").replace("cool_walk", "s_cool_walk"),
    "s_crossings": _STEPS["crossings"].replace("changes_in", "s_changes_in").replace("cool_walk", "s_cool_walk"),
    "faults": """
  SELECT c.video_id, c.frame, c.time_sec, n.center AS crossing_x, f.y AS shuttle_y, n.slope * n.center + n.intercept AS net_top_y_at_x
  FROM s_crossings c JOIN frames f USING (video_id, frame) JOIN cal n USING (video_id)""",
}
_CANVAS = [(20 + x / 6.1 * 320, 580 - y / 13.4 * 560) for x, y in _COURT]
_USER = {k: (_solve(c, _CANVAS), _solve(c, [(0, 0), (1, 0), (1, 1), (0, 1)])) for k, c in (
    (0, [(400, 46), (880, 48), (1050, 96), (200, 94)]), (1, [(360, 44), (920, 44), (1100, 97), (180, 97)]),
)}


def _by_video(which: int, part: int) -> str:
    """A projected coordinate by the map of the video's own corners, rounded for the comparison."""
    own = " ".join(f"WHEN {k} THEN {_project(maps[which], 'x', 'y')[part]}" for k, maps in _USER.items())
    return f"round(CASE video_id::INT % 4 {own} ELSE {_project((_TO_MAP, _TO_UNIT)[which], 'x', 'y')[part]} END, 7) + 0.0::DOUBLE"


def _sql(final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in _STEPS.items()) + "\n" + final


_MX, _MY = _project(_TO_MAP, "x", "y")
_NX, _NY = _project(_TO_UNIT, "x", "y")
_LINE = "CASE least(abs(cx - 0.46), abs(5.64 - cx), abs(13.4 - cy), abs(cy)) WHEN abs(cx - 0.46) THEN {0} WHEN abs(5.64 - cx) THEN {1} WHEN abs(13.4 - cy) THEN {2} ELSE {3} END"

ORACLES: dict[str, str] = {
    name: _sql(text)
    for name, text in {
        "traj_valid": "SELECT * FROM points",
        "traj_step": "SELECT video_id, frame, gap, round(step, 6) AS step FROM steps",
        "typical_step": "SELECT video_id, round(typical, 6) AS typical FROM typical",
        "traj_clean": "SELECT video_id, frame, x, y FROM cleaned",
        "traj_params": """SELECT video_id, points, avg_gap, round(gap_ratio, 6) AS gap_ratio, max_frame_gap, round(min_speed, 6) AS min_speed, round(min_flight, 6) AS min_flight,
            peak_distance, near_future, round(min_floor_drop, 6) AS min_floor_drop, round(floor_pct, 6) AS floor_pct FROM params""",
        "floor_limit": 'SELECT video_id, round("limit", 6) AS "limit" FROM floor_limits',
        "impulse_filters": "SELECT video_id, frame, round(impulse, 6) AS impulse, coalesce(dropped, 'scored') AS dropped FROM judged",
        "impulse_scores": "SELECT video_id, frame, round(score, 6) AS score FROM scores WHERE score > 0",
        "tukey_fence": "SELECT video_id, scored, round(q1, 6) AS q1, round(q3, 6) AS q3, round(top, 6) AS top, round(fence, 6) AS fence FROM fences",
        "local_maxima": "SELECT video_id, frame, round(score, 6) AS work FROM work_maxima",
        "peaks_apart": "SELECT video_id, frame, round(score, 6) AS score FROM raw_apart",
        "peaks_prominence": "SELECT video_id, frame, round(score, 6) AS score, round(prominence, 6) AS prominence FROM raw_prominent",
        "score_nms": "SELECT video_id, frame, round(score, 6) AS score FROM raw_nms",
        "hits": "SELECT video_id, hit_number, frame, round(time_sec, 6) AS time_sec, round(score, 6) AS score, owner, owner AS player, 'peaks' AS method FROM hits",
        "side_changes": 'SELECT video_id, "trigger", frame, direction, round(cross_x, 6) AS cross_x FROM changes',
        "net_crossings": "SELECT video_id, frame, round(time_sec, 6) AS time_sec, direction, hitter_side, receiver_side, false AS is_fault FROM crossings",
        "net_faults": """SELECT video_id, frame, time_sec, 0.0::DOUBLE AS crossing_x, 0.0::DOUBLE AS shuttle_y, 0.0::DOUBLE AS net_top_y_at_x, 0.0::DOUBLE AS clearance_px
            FROM crossings WHERE false""",
        "crossing_owner": "SELECT video_id, frame, new_owner AS owner, player, method FROM crossed",
        "rally_sessions": "SELECT video_id, frame, hit_number, rally FROM rallied",
        "alternate_owner": "SELECT video_id, frame, rally, side AS owner, side AS player FROM alternated",
        "rally_last_hit": "SELECT video_id, rally, frame, hit_number FROM last_hits",
        "landing": "SELECT * FROM landed",
        "drop_verdict": f"""SELECT video_id, rally_idx, frame, mx, my, location, nearest_line, round(margin, 6) AS margin_cm, round(cx, 8) AS court_x, round(cy, 8) AS court_y,
            location <> 'out' AS is_in, nearest_line || CASE WHEN round_even(round(margin, 6), 1) >= 0 THEN '까지 약 ' ELSE ' 밖 약 ' END || printf('%.1fcm', abs(round_even(round(margin, 6), 1))) AS verdict
            FROM (SELECT *, {_LINE.format("'좌측 사이드라인'", "'우측 사이드라인'", "'엔드라인(far)'", "'엔드라인(near)'")} AS nearest_line,
                100 * ({_LINE.format("cx - 0.46", "5.64 - cx", "13.4 - cy", "cy")}) AS margin FROM courted)""",
        "drop_interval": """SELECT f.video_id, f.frame, max(s.rally_idx) AS rally_idx FROM frames f JOIN spans s ON s.video_id = f.video_id AND f.frame >= s.frame
            AND (s.until IS NULL OR f.frame < s.until) GROUP BY f.video_id, f.frame""",
        "homography_apply": f"SELECT video_id, frame, round({_MX}, 4) + 0.0::DOUBLE AS mx, round({_MY}, 4) + 0.0::DOUBLE AS my, round({_NX}, 4) + 0.0::DOUBLE AS nx, round({_NY}, 4) + 0.0::DOUBLE AS ny FROM points",
        "foot_center": "SELECT p.*, round(f.x, 4) AS x, round(f.y, 4) AS y FROM people p JOIN feet f USING (frame, person_idx)",
        "body_center": "SELECT p.*, round(b.owner_path, 4) AS owner_path, round(b.rescue_path, 4) AS rescue_path FROM people p JOIN body b USING (frame, person_idx)",
        "pose_window": "SELECT p.* FROM people p WHERE EXISTS (SELECT 1 FROM hits h WHERE h.video_id = p.video_id AND abs(h.frame - p.frame) <= 2)",
        "wrist_nearest": "SELECT video_id, frame, round(dist, 4) AS dist, round(center_y, 4) AS center_y FROM wrists",
        "pose_owner": """SELECT h.video_id, h.frame, CASE WHEN side IS NULL OR side = owner THEN owner ELSE side END AS owner,
            CASE WHEN side IS NULL OR side = owner THEN owner WHEN side = 'top' THEN 'pink_top' ELSE 'green_bottom' END AS player,
            CASE WHEN side IS NULL OR side = owner THEN 'peaks' ELSE 'peaks_pose' END AS method
            FROM (SELECT h.*, CASE WHEN w.center_y < 50.5 THEN 'top' WHEN w.center_y IS NOT NULL THEN 'bottom' END AS side FROM hits h LEFT JOIN wrists w USING (video_id, frame)) h""",
        "near_miss": "SELECT video_id, frame, round(score, 6) AS score FROM misses",
        "player_select": "SELECT * FROM on_map",
        "player_ghost": """SELECT video_id, frame, side, coalesce(mx, m1, m2, m3) AS mx FROM (
            SELECT f.video_id, f.frame, s.side, o.mx, lag(o.mx, 1) OVER w AS m1, lag(o.mx, 2) OVER w AS m2, lag(o.mx, 3) OVER w AS m3
            FROM frames f CROSS JOIN (VALUES ('top'), ('bottom')) s(side) LEFT JOIN on_map o ON o.video_id = f.video_id AND o.frame = f.frame AND o.side = s.side
            WINDOW w AS (PARTITION BY f.video_id, s.side ORDER BY f.frame))""",
        "player_trail": """SELECT video_id, frame, side, (count(*) OVER w)::INT AS length, (sum(mx) OVER w)::INT AS total_mx, first_value(my) OVER w AS oldest_my FROM on_map
            WINDOW w AS (PARTITION BY video_id, side ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
        "shuttle_trail": """SELECT a.video_id, a.frame, (b.k - a.k + least(a.k, 29))::INT AS i, b.x AS tx, b.y AS ty, round((b.k - a.k + least(a.k, 29) + 1) / (least(a.k, 29) + 1), 6) AS alpha,
            greatest(3, trunc(4 + 6 * ((b.k - a.k + least(a.k, 29) + 1) / (least(a.k, 29) + 1)))::INT) AS radius, trunc(200 * ((b.k - a.k + least(a.k, 29) + 1) / (least(a.k, 29) + 1)))::INT AS shade
            FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS k FROM points) a
            JOIN (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS k FROM points) b ON a.video_id = b.video_id AND b.k BETWEEN a.k - 29 AND a.k""",
        "hit_marker_asof": """SELECT a.video_id, a.frame, a.hit_number, a.side AS owner, o.mx, o.my FROM alternated a ASOF JOIN on_map o
            ON a.video_id = o.video_id AND a.side = o.side AND a.frame >= o.frame""",
        "impact_flag": "SELECT f.video_id, f.frame, EXISTS (SELECT 1 FROM hits h WHERE h.video_id = f.video_id AND abs(h.frame - f.frame) <= 2) AS impact FROM frames f",
        "crossing_flag": "SELECT f.video_id, f.frame, EXISTS (SELECT 1 FROM crossings h WHERE h.video_id = f.video_id AND abs(h.frame - f.frame) <= 3) AS crossing FROM frames f",
        "api_document": """SELECT v.video_id, round_even(v.fps, 2) AS video_fps, count(a.frame) OVER (PARTITION BY v.video_id)::INT AS total_hits,
            a.hit_number, a.frame, round_even(a.time_sec, 3) AS time_sec, a.side AS player FROM videos v JOIN alternated a USING (video_id)""",
        "callback_body": "SELECT v.video_id, round_even(v.fps, 2) AS fps, count(a.frame)::INT AS hits, 0 AS faults FROM videos v LEFT JOIN alternated a USING (video_id) GROUP BY v.video_id, v.fps",
        "draw_commands": """SELECT video_id, frame, 'impact' AS layer, 'IMPACT #' || hit_number AS text, 0 AS x, 0 AS y, '#FFFF00' AS color FROM hits
            UNION ALL SELECT a.video_id, a.frame, 'hit', a.hit_number::VARCHAR, o.mx, o.my, CASE a.side WHEN 'top' THEN '#3B82F6' ELSE '#F59E0B' END
            FROM alternated a ASOF JOIN on_map o ON a.video_id = o.video_id AND a.side = o.side AND a.frame >= o.frame
            UNION ALL SELECT m.video_id, m.frame, 'drop', CASE d.location WHEN 'out' THEN 'OUT' ELSE 'IN' END, d.mx, d.my, CASE d.location WHEN 'out' THEN '#FF0000' ELSE '#00FF00' END
            FROM (SELECT f.video_id, f.frame, max(s.rally_idx) AS rally_idx FROM frames f JOIN spans s ON s.video_id = f.video_id AND f.frame >= s.frame
                AND (s.until IS NULL OR f.frame < s.until) GROUP BY f.video_id, f.frame) m JOIN courted d USING (video_id, rally_idx)""",
        # Metres along and across, in the order of drawing: two fills, lines along, lines across, the net.
        "court_lines": """SELECT 'minimap' AS view, (row_number() OVER () - 1)::INT AS z, primitive, round(20 + a / 6.1::DOUBLE * 320, 6) AS x1, round(580 - b / 13.4::DOUBLE * 560, 6) AS y1,
            round(20 + c / 6.1::DOUBLE * 320, 6) AS x2, round(580 - d / 13.4::DOUBLE * 560, 6) AS y2, color, thickness FROM (VALUES
            ('fill', 0::DOUBLE, 13.4::DOUBLE, 6.1::DOUBLE, 0::DOUBLE, '#1B401A', -1), ('fill', 0.46, 13.4, 5.64, 0, '#327330', -1),
            ('line', 0, 0, 0, 13.4, '#FFFFFF', 1), ('line', 0.46, 0, 0.46, 13.4, '#FFFFFF', 1), ('line', 5.64, 0, 5.64, 13.4, '#FFFFFF', 1), ('line', 6.1, 0, 6.1, 13.4, '#FFFFFF', 1),
            ('line', 3.05, 0, 3.05, 4.72, '#FFFFFF', 1), ('line', 3.05, 8.68, 3.05, 13.4, '#FFFFFF', 1),
            ('line', 0, 0, 6.1, 0, '#FFFFFF', 1), ('line', 0, 0.76, 6.1, 0.76, '#FFFFFF', 1), ('line', 0, 4.72, 6.1, 4.72, '#FFFFFF', 1), ('line', 0, 8.68, 6.1, 8.68, '#FFFFFF', 1),
            ('line', 0, 12.64, 6.1, 12.64, '#FFFFFF', 1), ('line', 0, 13.4, 6.1, 13.4, '#FFFFFF', 1), ('line', 0, 6.7, 6.1, 6.7, '#FF5000', 2)) t(primitive, a, b, c, d, color, thickness)""",
        "timeline_row": """SELECT video_id, trunc(time_sec)::INT AS timestamp, printf('%02d:%02d', trunc(time_sec)::INT // 60, trunc(time_sec)::INT % 60) AS "displayTime",
            'NET_FAULT' AS "eventType", '네트 걸림' AS "eventTitle", '셔틀콕이 네트 상단보다 0.0px 낮은 위치를 통과하려 했습니다.' AS "eventDescription" FROM crossings""",
        "calibrated_points": f"""SELECT video_id, frame, CASE WHEN video_id::INT % 4 < 2 THEN 'user_singles' ELSE 'auto_ratio' END AS coordinate_mode,
            {_by_video(0, 0)} AS mx, {_by_video(0, 1)} AS my, {_by_video(1, 0)} AS nx, {_by_video(1, 1)} AS ny FROM points""",
        "owner_threshold": """SELECT video_id, round(CASE video_id::INT % 4 WHEN 0 THEN ((46 + 48) / 2.0 + (96 + 94) / 2.0) / 2 WHEN 1 THEN ((44 + 44) / 2.0 + (97 + 97) / 2.0) / 2
            WHEN 2 THEN (55 + 47) / 2.0 ELSE 46.0 END::DOUBLE, 6) AS owner_y FROM videos""",
        "sloped_changes": 'SELECT video_id, "trigger", frame, direction, round(cross_x, 6) AS cross_x FROM s_changes',
        "sloped_crossings": "SELECT video_id, frame, round(time_sec, 6) AS time_sec, direction, hitter_side, receiver_side, true AS is_fault FROM s_crossings",
        "fault_rows": """SELECT video_id, frame, round_even(time_sec, 3) AS time_sec, round_even(crossing_x, 1) AS crossing_x, round_even(shuttle_y, 1) AS shuttle_y,
            round_even(net_top_y_at_x, 1) AS net_top_y_at_x, 0.0::DOUBLE AS clearance_px FROM faults""",
        "fault_flag": "SELECT f.video_id, f.frame, EXISTS (SELECT 1 FROM faults h WHERE h.video_id = f.video_id AND abs(h.frame - f.frame) <= 3) AS fault FROM frames f",
        "fault_timeline": """SELECT video_id, trunc(time_sec)::INT AS timestamp, printf('%02d:%02d', trunc(time_sec)::INT // 60, trunc(time_sec)::INT % 60) AS "displayTime",
            'NET_FAULT' AS "eventType", '네트 걸림' AS "eventTitle", '셔틀콕이 네트 상단보다 0.0px 낮은 위치를 통과하려 했습니다.' AS "eventDescription" FROM faults""",
        "fault_callback": """SELECT video_id, frame, round_even(time_sec, 3) AS time_sec, round_even(crossing_x, 1) AS crossing_x, round_even(shuttle_y, 1) AS shuttle_y,
            round_even(net_top_y_at_x, 1) AS net_top_y_at_x FROM faults""",
        "floor_bypass": """SELECT j.video_id, j.frame, round(j.impulse, 6) AS impulse, CASE WHEN j.dropped = 'floor' AND b.frame IS NOT NULL THEN
              CASE WHEN iy < -2 AND oy > 2 AND abs(ox - ix) < 4 THEN 'apex' ELSE 'scored' END ELSE coalesce(j.dropped, 'scored') END AS dropped
            FROM judged j JOIN turns t USING (video_id, frame) LEFT JOIN (
              SELECT DISTINCT q.video_id, q.frame FROM judged q JOIN videos v USING (video_id) JOIN kp k ON k.frame = q.frame AND q.frame < v.n_frames
              WHERE k.i IN (9, 10) AND k.conf >= 0.3 AND k.x > 0 AND k.y > 0 AND sqrt((k.x - q.x) ** 2 + (k.y - q.y) ** 2) < 100) b USING (video_id, frame)""",
        "summary_text": """SELECT v.video_id, repeat('═', 55) || chr(10) || '  ' || v.video_id || chr(10) || repeat('═', 55) || chr(10) || '  타점 수             : ' || coalesce(h.n, 0) || '개' || chr(10)
              || '  네트 걸림           : ' || coalesce(f.n, 0) || '건' || chr(10) || repeat('─', 55) || chr(10) || coalesce(h.told || chr(10), '')
              || coalesce(repeat('─', 55) || chr(10) || '  [NET_FAULT]' || chr(10) || f.told || chr(10), '') || repeat('═', 55) AS summary
            FROM videos v
            LEFT JOIN (SELECT video_id, count(*) AS n, string_agg(printf('    #%02d  %6.2fs  ', hit_number, time_sec) || CASE side WHEN 'top' THEN '상단(블루)' ELSE '하단(골드)' END, chr(10) ORDER BY hit_number) AS told
              FROM alternated GROUP BY video_id) h USING (video_id)
            LEFT JOIN (SELECT video_id, count(*) AS n, string_agg(printf('    %6.2fs  clearance=+0.0px  shuttle_y=%.1f  net_y=%.1f', time_sec, shuttle_y, net_top_y_at_x), chr(10) ORDER BY time_sec, frame) AS told
              FROM faults GROUP BY video_id) f USING (video_id)""",
        "top_scores": "SELECT video_id, frame, round(score, 6) AS score FROM (SELECT * FROM scores WHERE score > 0 ORDER BY score DESC, video_id, frame LIMIT 20)",
        "removed_points": "SELECT video_id, frame FROM points EXCEPT ALL SELECT video_id, frame FROM cleaned",
    }.items()
}


def _away(quad: list[tuple[int, int]], x: str, y: str) -> str:
    """Signed distance of a point to a convex polygon, positive inside, as SQL."""
    edges, sides = [], []
    for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1]):
        ex, ey = float(bx - ax), float(by - ay)
        t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({x} - {ax}) * ({ex}) + ({y} - {ay}) * ({ey})) / {ex * ex + ey * ey}::DOUBLE))"
        edges.append(f"sqrt(({ax} + {t} * ({ex}) - {x}) ** 2 + ({ay} + {t} * ({ey}) - {y}) ** 2)")
        sides.append(f"({ex}) * ({y} - {ay}) - ({ey}) * ({x} - {ax})")
    inside = f"(least({', '.join(sides)}) >= 0 OR greatest({', '.join(sides)}) <= 0)"
    return f"(CASE WHEN {inside} THEN 1 ELSE -1 END * least({', '.join(edges)}))"


_QUAD = [(int(np.float32(x)), int(np.float32(y))) for x, y in _SRC]
_VIEW = _solve(_COURT, [(x, y + 360) for x, y in _SRC])
_NET_VIEW = int((_VIEW[3] * 3.05 + _VIEW[4] * 6.7 + _VIEW[5]) / (_VIEW[6] * 3.05 + _VIEW[7] * 6.7 + 1.0))

_STEPS |= {
    "stood": f"""
  SELECT p.video_id, p.frame, p.person_idx, trunc(f.x)::INT AS tx, trunc(f.y + 360)::INT AS ty FROM people p JOIN feet f USING (frame, person_idx)
  WHERE f.x > 0 AND f.y > 0 AND {_away(_QUAD, "f.x", "f.y")} >= 0""",
    "stood_ranked": f"""
  SELECT *, ty < {_NET_VIEW} AS above, count(*) OVER v AS n, sum((ty < {_NET_VIEW})::INT) OVER v AS up, row_number() OVER (PARTITION BY video_id, frame ORDER BY ty, person_idx) AS high
  FROM stood WINDOW v AS (PARTITION BY video_id, frame)""",
    "stood_top": """
  SELECT * FROM (SELECT *, 'top' AS side, row_number() OVER (PARTITION BY video_id, frame ORDER BY ty, person_idx) AS r FROM stood_ranked
    WHERE CASE WHEN n >= 2 AND (up = 0 OR up = n) THEN high = 1 ELSE above END) WHERE r = 1""",
    "stood_bottom": """
  SELECT * FROM (SELECT *, 'bottom' AS side, row_number() OVER (PARTITION BY video_id, frame ORDER BY ty DESC, CASE WHEN n >= 2 AND up = n THEN -person_idx ELSE person_idx END) AS r
    FROM stood_ranked WHERE CASE WHEN n >= 2 AND up = 0 THEN high > 1 WHEN n >= 2 AND up = n THEN true ELSE NOT above END) WHERE r = 1""",
    "bone_list": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {a - 1}, {b - 1})" for i, (a, b) in enumerate(((16, 14), (14, 12), (17, 15), (15, 13), (12, 13), (6, 12), (7, 13), (6, 7), (6, 8), (7, 9), (8, 10), (9, 11))))
    + ") t(bone, a, b)",
}
# Alternation: each hit is judged against the one before as that one came out; flips are told apart by their target.
_OTHER = "CASE {} WHEN 'top' THEN 'bottom' ELSE 'top' END"
_TURNED = f"CASE w.flips WHEN 'this' THEN {_OTHER.format('w.owner')} ELSE w.owner END"
_STEPS |= {
    "sided": """
  SELECT c.video_id, c.frame, c.time_sec, c.score, c.new_owner AS owner, c.player, c.method, least(1.0, abs(f.y - 50.5) / (0.12::DOUBLE * 100)) AS conf,
    row_number() OVER (PARTITION BY c.video_id ORDER BY c.frame) AS i FROM crossed c JOIN frames f USING (video_id, frame)""",
    "turn_walk": f"""
  SELECT video_id, i, owner, 'none' AS flips FROM sided WHERE i = 1
  UNION ALL
  SELECT n.video_id, n.i, n.owner, CASE WHEN ({_TURNED}) <> n.owner OR n.time_sec - p.time_sec >= 1.0 THEN 'none'
    WHEN p.method = 'peaks_crossed' AND n.method <> 'peaks_crossed' THEN 'this' WHEN n.method = 'peaks_crossed' AND p.method <> 'peaks_crossed' THEN 'prev'
    WHEN n.score / greatest(p.score, 1e-6) >= 3.0 THEN 'prev' WHEN n.score / greatest(p.score, 1e-6) <= 1.0::DOUBLE / 3.0::DOUBLE THEN 'this'
    WHEN n.conf <= p.conf THEN 'this' ELSE 'prev' END
  FROM turn_walk w JOIN sided p ON p.video_id = w.video_id AND p.i = w.i JOIN sided n ON n.video_id = w.video_id AND n.i = w.i + 1""",
    "turned": f"""
  SELECT t.*, CASE WHEN x.flips = 'prev' THEN {_OTHER.format(f"({_TURNED})")} ELSE {_TURNED} END AS final, w.flips = 'this' OR coalesce(x.flips = 'prev', false) AS flipped
  FROM sided t JOIN turn_walk w ON w.video_id = t.video_id AND w.i = t.i LEFT JOIN turn_walk x ON x.video_id = t.video_id AND x.i = t.i + 1""",
    # Rescue: near misses with a wrist within reach, in order of frame, each apart from the last one taken.
    "rescue_misses": _STEPS["misses"].replace("0.149", "0.13"),
    "rescue_near": """
  SELECT m.video_id, m.frame, m.score, b.rescue_path AS center_y, sqrt((k.x - f.x) ** 2 + (k.y - f.y) ** 2) AS dist,
    row_number() OVER (PARTITION BY m.video_id, m.frame ORDER BY sqrt((k.x - f.x) ** 2 + (k.y - f.y) ** 2), k.frame, k.person_idx, k.i) AS nth
  FROM rescue_misses m JOIN frames f ON f.video_id = m.video_id AND abs(f.frame - m.frame) <= 2 AND f.x > 0 AND f.y > 0
  JOIN kp k ON k.frame = f.frame JOIN body b ON b.frame = k.frame AND b.person_idx = k.person_idx
  WHERE k.i IN (9, 10) AND k.conf >= 0.25 AND k.x > 0 AND b.rescue_path IS NOT NULL""",
    "rescue_in": """
  SELECT n.*, p.peak_distance + 5 AS gap, row_number() OVER (PARTITION BY n.video_id ORDER BY n.frame) AS i
  FROM rescue_near n JOIN params p USING (video_id) WHERE nth = 1 AND dist <= 120""",
    "rescue_walk": """
  SELECT video_id, i, frame AS last, true AS kept FROM rescue_in WHERE i = 1
  UNION ALL
  SELECT n.video_id, n.i, CASE WHEN n.frame - w.last >= n.gap THEN n.frame ELSE w.last END, n.frame - w.last >= n.gap
  FROM rescue_walk w JOIN rescue_in n ON n.video_id = w.video_id AND n.i = w.i + 1""",
    "rescued": """
  SELECT video_id, frame, score, owner, owner AS player, 'peaks' AS method FROM hits
  UNION ALL
  SELECT video_id, frame, score, CASE WHEN center_y < 50.5 THEN 'top' ELSE 'bottom' END, CASE WHEN center_y < 50.5 THEN 'pink_top' ELSE 'green_bottom' END, 'rescue_pose'
  FROM rescue_in JOIN rescue_walk USING (video_id, i) WHERE kept""",
}
_BONE = "round(f.{0} + {2} + ({1}.{0} - f.{0}) * 1.2::DOUBLE, 2)"
_PX, _PY = "(x * 6)", "y"


def _long(text: str) -> str:
    """The same rules for the adapter of long videos: its frames, rate, height and net."""
    frames = """
  SELECT l_suppkey::VARCHAR AS video_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1)::INT AS frame,
    l_quantity * 20.0::DOUBLE AS x, l_extendedprice / 150.0::DOUBLE AS y FROM lineitem"""
    for old, new in ((_STEPS["frames"], frames), ("5.0::DOUBLE AS fps", "30.0::DOUBLE AS fps"), ("/ 5.0::DOUBLE", "/ 30.0::DOUBLE"), ("50.5", "350.0"), ("span / 100 /", "span / 720 /")):
        text = text.replace(old, new)
    return text


def _pixel(x: float, y: float, up: int = 0) -> str:
    """A place of the court in metres as a pixel of the view, as text."""
    px, py = _project(_VIEW, f"{x}::FLOAT::DOUBLE", f"{y}::FLOAT::DOUBLE")
    return f"trunc({px}::FLOAT)::INT || ',' || (trunc({py}::FLOAT)::INT - {up})"


def _foot(x: float, up: int = 0) -> str:
    return f"({_pixel(x, 6.7, up)})"


def _court_rows() -> str:
    """The court's floors, outline and lines in the order of drawing, as rows."""
    doubles, singles = ([(a, 13.4), (b, 13.4), (b, 0), (a, 0)] for a, b in ((0, 6.1), (0.46, 5.64)))
    rows = [("fill", doubles, "#1B401A", -1), ("fill", singles, "#327330", -1), ("outline", doubles, "#FFFFFF", 2)]
    lines = [[(x, 13.4), (x, 0)] for x in (0.46, 5.64)] + [[(0, y), (6.1, y)] for y in (0.76, 12.64, 4.72, 8.68)] + [[(3.05, 13.4), (3.05, 8.68)], [(3.05, 4.72), (3.05, 0)]]
    rows += [("line", line, "#FFFFFF", 2) for line in lines]
    return ", ".join(f"({z}, '{kind}', {' || chr(32) || '.join(_pixel(*p) for p in places)}, '{color}', {width})" for z, (kind, places, color, width) in enumerate(rows))


ORACLES |= {
    "point_in_court": _sql(f"SELECT video_id, frame, round({_away(_QUAD, _PX, _PY)}, 4) AS away, {_away(_QUAD, _PX, _PY)} >= 0 AS inside, {_away(_QUAD, _PX, _PY)} >= -30 AS near FROM points"),
    "court_player_select": _sql("SELECT video_id, frame, side, person_idx, tx, ty FROM stood_top UNION ALL SELECT video_id, frame, side, person_idx, tx, ty FROM stood_bottom"),
    "bone_segments": _sql(
        f"""SELECT p.video_id, p.frame, p.person_idx, l.bone, {_BONE.format("x", "a", 0)} AS x1, {_BONE.format("y", "a", 360)} AS y1, {_BONE.format("x", "b", 0)} AS x2, {_BONE.format("y", "b", 360)} AS y2
        FROM people p JOIN feet f USING (frame, person_idx) CROSS JOIN bone_list l JOIN kp a ON a.frame = p.frame AND a.person_idx = p.person_idx AND a.i = l.a
        JOIN kp b ON b.frame = p.frame AND b.person_idx = p.person_idx AND b.i = l.b WHERE f.x > 0 AND f.y > 0 AND a.conf >= 0.3 AND b.conf >= 0.3"""
    ),
    "alternation_fix": _sql(
        """SELECT video_id, frame, final AS owner, CASE WHEN NOT flipped THEN player WHEN final = 'top' THEN 'pink_top' ELSE 'green_bottom' END AS player, method FROM turned"""
    ),
    "rescue": _sql(
        """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame)::INT AS hit_number, frame, round(score, 6) AS score, owner, player, method FROM rescued"""
    ),
    "hits_json": _sql(
        f"""SELECT v.video_id, to_json({{'video_fps': round_even(v.fps, 2), 'total_hits': coalesce(len(h.hits), 0), 'hits_data': coalesce(h.hits, []), 'coordinate_mode': 'auto_ratio',
        'drop_judgments': coalesce(d.drops, [])}})::VARCHAR AS document FROM videos v
        LEFT JOIN (SELECT video_id, list({{'hit_number': hit_number, 'frame': frame, 'time_sec': round_even(time_sec, 3), 'player': side}} ORDER BY hit_number) AS hits
          FROM alternated GROUP BY video_id) h USING (video_id)
        LEFT JOIN (SELECT video_id, list({{'rally_idx': rally_idx, 'frame': frame, 'location': location,
            'margin_cm': round_even(100 * ({_LINE.format("cx - 0.46", "5.64 - cx", "13.4 - cy", "cy")}), 1),
            'nearest_line': {_LINE.format("'좌측 사이드라인'", "'우측 사이드라인'", "'엔드라인(far)'", "'엔드라인(near)'")},
            'bwf_x': round_even(cx, 3), 'bwf_y': round_even(cy, 3), 'last_hit_number': last_hit_number, 'last_hit_owner': last_hit_owner}} ORDER BY rally_idx) AS drops
          FROM courted GROUP BY video_id) d USING (video_id)"""
    ),
    "view_court": _sql(
        f"""SELECT video_id, z::INT AS z, primitive, points, color, thickness FROM videos CROSS JOIN (VALUES {_court_rows()}) s(z, primitive, points, color, thickness)
        UNION ALL SELECT video_id, 11 + i, 'line', CASE i WHEN 0 THEN l || ' ' || r WHEN 1 THEN fl || ' ' || l ELSE fr || ' ' || r END, '#FF5000', CASE i WHEN 0 THEN 6 ELSE 3 END
        FROM (SELECT video_id, {_foot(0)} AS fl, {_foot(6.1)} AS fr,
            CASE video_id::INT % 4 WHEN 0 THEN '200,406' WHEN 2 THEN '300,415' ELSE {_foot(0, 250)} END AS l,
            CASE video_id::INT % 4 WHEN 0 THEN '1080,416' WHEN 2 THEN '900,407' ELSE {_foot(6.1, 250)} END AS r FROM videos) CROSS JOIN (VALUES (0), (1), (2)) n(i)"""
    ),
    "frame_overlays": _sql(
        """SELECT video_id, frame, 'shuttle' AS layer, '' AS text, trunc(x)::INT AS x1, trunc(y)::INT AS y1, -1 AS x2, -1 AS y2, '#FFD700' AS color, 7 AS size FROM frames WHERE x > 0 AND y > 0
        UNION ALL SELECT video_id, frame, 'net', '', 200, 46, 1080, 56, '#3B82F6', 2 FROM frames WHERE video_id::INT % 4 = 0
        UNION ALL SELECT video_id, frame, 'net', '', 300, 55, 900, 47, '#3B82F6', 2 FROM frames WHERE video_id::INT % 4 = 2
        UNION ALL SELECT video_id, frame, layer, text, x1, y1, -1, -1, '#3B82F6', size FROM (
            SELECT DISTINCT f.video_id, f.frame FROM frames f JOIN hits h ON h.video_id = f.video_id AND abs(h.frame - f.frame) <= 2)
          CROSS JOIN (VALUES ('impact', 'IMPACT', 550, 130, 5), ('tint', '', -1, -1, 60)) l(layer, text, x1, y1, size)
        UNION ALL SELECT DISTINCT f.video_id, f.frame, 'fault', 'NET FAULT', 510, 180, -1, -1, '#FF0000', 5 FROM frames f JOIN faults h ON h.video_id = f.video_id AND abs(h.frame - f.frame) <= 3
        UNION ALL SELECT video_id, frame, 'frame', 'F:' || frame, 20, 50, -1, -1, '#C8C8C8', 2 FROM frames"""
    ),
    "player_dots": _sql(
        """SELECT video_id, frame, side, z, coalesce(mx, m1, m2, m3) AS x, coalesce(my, n1, n2, n3) AS y, radius, CASE WHEN z > 0 THEN '#FFFFFF' WHEN side = 'top' THEN '#3B82F6' ELSE '#F59E0B' END AS color, thickness
        FROM (SELECT f.video_id, f.frame, s.side, o.mx, lag(o.mx, 1) OVER w AS m1, lag(o.mx, 2) OVER w AS m2, lag(o.mx, 3) OVER w AS m3, o.my, lag(o.my, 1) OVER w AS n1, lag(o.my, 2) OVER w AS n2, lag(o.my, 3) OVER w AS n3
          FROM frames f CROSS JOIN (VALUES ('top'), ('bottom')) s(side) LEFT JOIN on_map o ON o.video_id = f.video_id AND o.frame = f.frame AND o.side = s.side
          WINDOW w AS (PARTITION BY f.video_id, s.side ORDER BY f.frame)) CROSS JOIN (VALUES (0, 9, -1), (1, 9, 2), (2, 4, -1)) r(z, radius, thickness)
        WHERE coalesce(mx, m1, m2, m3) IS NOT NULL"""
    ),
    "long_crossings": _long(_sql("SELECT video_id, frame, round(time_sec, 6) AS time_sec, direction FROM crossings")),
    "long_hits": _long(_sql("SELECT video_id, hit_number, frame, round(time_sec, 6) AS time_sec, round(score, 6) AS score, owner FROM hits")),
    "split_hits": _long(_sql("SELECT video_id, hit_number, frame, round(time_sec, 6) AS time_sec, round(score, 6) AS score, owner FROM hits")),
}
