"""Planar geometry as column expressions: court mapping, homographies, polygons, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.config import (
    CONFIG,
    CORNER_SHARES,
    COURT_LENGTH,
    COURT_WIDTH,
    END_FAR,
    END_NEAR,
    NET_Y,
    SINGLES_LEFT,
    SINGLES_RIGHT,
)


def single(value: Column) -> Column:
    """Rounded to single precision, as picture libraries keep points."""
    return value.cast("float").cast("double")


def court_to_canvas(x_m: float, y_m: float, w: int = CONFIG.minimap_w, h: int = CONFIG.minimap_h, pad: int = CONFIG.pad) -> tuple[float, float]:
    """Canvas pixels of a place on the court in metres."""
    return pad + x_m / COURT_WIDTH * (w - 2 * pad), (h - pad) - y_m / COURT_LENGTH * (h - 2 * pad)


def points(values: list[tuple[float, float]]) -> Column:
    """An array of constant points, in single precision."""
    return F.array(*(F.struct(single(F.lit(float(x))).alias("x"), single(F.lit(float(y))).alias("y")) for x, y in values))


def corner(array: Column, i: int, axis: str) -> Column:
    return F.get(array, F.lit(i))[axis]


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f mentions it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _at(array: Column) -> list[Column]:
    return [F.get(array, F.lit(i)) for i in range(9)]


def _unit_to_quad(q: Column) -> Column:
    """The nine entries of the map from the unit square (0,0) (1,0) (1,1) (0,1) to a quadrilateral."""

    def entries(quad: Column) -> Column:
        x, y = [corner(quad, i, "x") for i in range(4)], [corner(quad, i, "y") for i in range(4)]
        dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
        dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
        d = dx1 * dy2 - dx2 * dy1
        tilt = F.struct(F.try_divide(sx * dy2 - dx2 * sy, d).alias("g"), F.try_divide(dx1 * sy - sx * dy1, d).alias("h"))
        return let(
            tilt,
            lambda t: F.array(
                x[1] - x[0] + t["g"] * x[1], x[3] - x[0] + t["h"] * x[3], x[0],
                y[1] - y[0] + t["g"] * y[1], y[3] - y[0] + t["h"] * y[3], y[0],
                t["g"], t["h"], F.lit(1.0),
            ),
        )

    return let(q, entries)


def _adjugate(array: Column) -> Column:
    a, b, c, d, e, f, g, h, i = _at(array)
    return F.array(e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)


def homography(src: Column, dst: Column) -> Column:
    """array<double> of 9, last entry 1: the projective map that takes four points to four points, in
    closed form by way of the unit square. Null entries for corners that don't make a quadrilateral."""

    def times(one: Column, two: Column) -> Column:
        a, b = _at(one), _at(two)
        return F.array(*(a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)))

    back = let(_unit_to_quad(src), _adjugate)
    whole = let(_unit_to_quad(dst), lambda d: let(back, lambda s: times(d, s)))
    return let(whole, lambda m: F.transform(m, lambda v: F.try_divide(v, F.get(m, F.lit(8)))))


def project(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography."""
    m = [F.get(matrix, F.lit(i)) for i in range(9)]
    w = m[6] * x + m[7] * y + m[8]
    return F.try_divide(m[0] * x + m[1] * y + m[2], w), F.try_divide(m[3] * x + m[4] * y + m[5], w)


def project_pixel(matrix: Column, x: Column, y: Column, precise: bool = False) -> tuple[Column, Column]:
    """The same in single precision, cut to whole pixels. With `precise` the point itself keeps its double precision, which
    tells where its place is within a hair of a whole pixel."""
    px, py = project(matrix, x, y) if precise else project(matrix, single(x), single(y))
    return px.cast("float").cast("int"), py.cast("float").cast("int")


def homographies(corners: Column, w: Column, h: Column) -> dict[str, Column]:
    """All maps of a video: src_pts, minimap_pts, to_minimap, to_normalized, to_court (minimap to metres), net_y_minimap, coordinate_mode.

    With corners (TL, TR, BR, BL) they are the singles court's; without, fixed shares of the frame
    stand for the whole padded canvas."""
    given = corners.isNotNull()
    auto = F.array(*(F.struct(single(w * sx).alias("x"), single(h * sy).alias("y")) for sx, sy in CORNER_SHARES))
    own = F.transform(corners, lambda p: F.struct(single(p["x"]).alias("x"), single(p["y"]).alias("y")))
    mw, mh, pad = CONFIG.minimap_w, CONFIG.minimap_h, CONFIG.pad
    court = [(SINGLES_LEFT, END_FAR), (SINGLES_RIGHT, END_FAR), (SINGLES_RIGHT, END_NEAR), (SINGLES_LEFT, END_NEAR)]
    src = F.when(given, own).otherwise(auto)
    dst = F.when(given, points([court_to_canvas(*p) for p in court])).otherwise(points([(pad, pad), (mw - pad, pad), (mw - pad, mh - pad), (pad, mh - pad)]))
    return {
        "src_pts": src,
        "minimap_pts": dst,
        "to_minimap": homography(src, dst),
        "to_normalized": homography(src, points([(0, 0), (1, 0), (1, 1), (0, 1)])),
        "to_court": homography(dst, points(court)),
        "net_y_minimap": F.when(given, court_to_canvas(0, NET_Y)[1]).otherwise((pad + mh - pad) / 2),
        "coordinate_mode": F.when(given, "user_singles").otherwise("auto_ratio"),
    }


def normalized_to_minimap(x: Column, y: Column, w: int = CONFIG.minimap_w, h: int = CONFIG.minimap_h, pad: int = CONFIG.pad) -> tuple[Column, Column]:
    """Shares of the court to canvas pixels, clipped into the canvas."""
    at = lambda v, size: F.greatest(F.lit(0), F.least(F.lit(size - 1), (pad + v * (size - 2 * pad)).cast("int")))
    return at(x, w), at(y, h)


def net_line(net: Column) -> tuple[Column, Column]:
    """(slope, intercept) of the net's two points; an upright pair is level at its mean height."""
    x0, y0, x1, y1 = corner(net, 0, "x"), corner(net, 0, "y"), corner(net, 1, "x"), corner(net, 1, "y")
    upright = F.abs(x1 - x0) < 1e-6
    slope = F.when(upright, 0.0).otherwise(F.try_divide(y1 - y0, x1 - x0))
    return slope, F.when(upright, (y0 + y1) / 2).otherwise(y0 - slope * x0)


def edge_x(ax: Column, ay: Column, bx: Column, by: Column, y: Column) -> Column:
    """x on the edge a-b at height y; the middle of a level edge."""
    return F.when(F.abs(by - ay) < 1e-6, (ax + bx) / 2).otherwise(ax + F.try_divide(y - ay, by - ay) * (bx - ax))


def signed_distance(px: Column, py: Column, quad: list[tuple[Column, Column]]) -> Column:
    """Distance of a point to a convex polygon's border, positive inside, 0 on it."""
    edges, sides = [], []
    for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1]):
        ex, ey = bx - ax, by - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * ex + (py - ay) * ey, ex * ex + ey * ey), F.lit(0.0))))
        dx, dy = ax + t * ex - px, ay + t * ey - py
        edges.append(F.sqrt(dx * dx + dy * dy))
        sides.append(ex * (py - ay) - ey * (px - ax))
    inside = (F.least(*sides) >= 0) | (F.greatest(*sides) <= 0)
    return F.when(inside, F.least(*edges)).otherwise(-F.least(*edges))


def quad_of(array: Column, whole: bool = True) -> list[tuple[Column, Column]]:
    """Corners of an array of four points, cut to whole pixels for polygon tests."""
    cut = (lambda c: c.cast("int").cast("double")) if whole else (lambda c: c)
    return [(cut(corner(array, i, "x")), cut(corner(array, i, "y"))) for i in range(4)]


# Names of the court's lines, in the order in which ties are resolved.
LINES = ("좌측 사이드라인", "우측 사이드라인", "엔드라인(far)", "엔드라인(near)")


def drop_place(minimap_pts: Column, to_court: Column, net_y: Column, mx: Column, my: Column) -> dict[str, Column]:
    """What the verdict reads: the place in metres, and the court's sides at the net's height."""
    x, y = [corner(minimap_pts, i, "x") for i in range(4)], [corner(minimap_pts, i, "y") for i in range(4)]
    bx, by = project(to_court, mx.cast("double"), my.cast("double"))
    return {
        "court_x": single(bx),
        "court_y": single(by),
        "net_left": edge_x(x[0], y[0], x[3], y[3], net_y),
        "net_right": edge_x(x[1], y[1], x[2], y[2], net_y),
    }


def half_distances(minimap_pts: Column, net_y: Column, left: Column, right: Column, mx: Column, my: Column) -> dict[str, Column]:
    """Signed distances of a drop to the two halves of the court, whose corners are whole pixels."""
    tl, tr, br, bl = quad_of(minimap_pts)
    cut = lambda c: c.cast("int").cast("double")
    net_l, net_r = (cut(left), cut(net_y)), (cut(right), cut(net_y))
    px, py = mx.cast("double"), my.cast("double")
    return {"top_distance": signed_distance(px, py, [tl, tr, net_r, net_l]), "bottom_distance": signed_distance(px, py, [net_l, net_r, br, bl])}


def drop_verdict(x: Column, y: Column, top: Column, bottom: Column) -> dict[str, Column]:
    """location (in_top, in_bottom, out), nearest_line and margin_cm (positive inside) of a place in metres."""
    margins = F.array(x - SINGLES_LEFT, SINGLES_RIGHT - x, END_FAR - y, y - END_NEAR)
    ranked = F.transform(margins, lambda m, i: F.struct(F.abs(m).alias("away"), i.alias("line"), m.alias("margin")))
    nearest = F.array_min(ranked)
    return {
        "location": F.when(top >= 0, "in_top").when(bottom >= 0, "in_bottom").otherwise("out"),
        "nearest_line": F.get(F.array(*map(F.lit, LINES)), nearest["line"]),
        "margin_cm": nearest["margin"] * 100,
    }
