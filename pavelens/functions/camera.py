"""Camera geometry as column functions. Matrices are row-major ARRAY<DOUBLE>(9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BEV_PIXELS_PER_METER = 50.0
SENSOR_W_MM = 6.17
SENSOR_H_MM = 4.55
DEFAULT_FOCAL_MM = 2.71


def _m(matrix: Column, i: int, j: int) -> Column:
    return matrix[3 * i + j]


def mat(*cells) -> Column:
    return F.array(*[c if isinstance(c, Column) else F.lit(float(c)) for c in cells])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps nested matrix expressions small."""
    return F.transform(F.array(value), body)[0]


def matmul(a: Column, b: Column) -> Column:
    def product(m: Column, n: Column) -> Column:
        return mat(*[_m(m, i, 0) * _m(n, 0, j) + _m(m, i, 1) * _m(n, 1, j) + _m(m, i, 2) * _m(n, 2, j) for i in range(3) for j in range(3)])

    return let(a, lambda m: let(b, lambda n: product(m, n)))


def transpose(a: Column) -> Column:
    return let(a, lambda m: mat(*[_m(m, j, i) for i in range(3) for j in range(3)]))


def apply(a: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [_m(a, i, 0) * x + _m(a, i, 1) * y + _m(a, i, 2) * z for i in range(3)]


def _minor(m: Column, i: int, j: int) -> Column:
    """Signed minor that stands at (i, j) of the adjugate."""
    r = [k for k in range(3) if k != j]
    c = [k for k in range(3) if k != i]
    value = _m(m, r[0], c[0]) * _m(m, r[1], c[1]) - _m(m, r[0], c[1]) * _m(m, r[1], c[0])
    return value if (i + j) % 2 == 0 else -value


def det(a: Column) -> Column:
    return let(a, lambda m: sum((_m(m, 0, k) * _minor(m, k, 0) for k in (1, 2)), _m(m, 0, 0) * _minor(m, 0, 0)))


def inverse(a: Column) -> Column:
    """Adjugate over determinant; null when singular."""
    cells = [(i, j) for i in range(3) for j in range(3)]
    return let(
        a, lambda m: let(det(m), lambda d: F.when(d != 0, mat(*[_minor(m, i, j) / d for i, j in cells])))
    )


def intrinsics(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    return mat(fx, 0, cx, 0, fy, cy, 0, 0, 1)


def intrinsics_from_fov(w: Column, h: Column, fov_deg: Column) -> Column:
    f = F.try_divide(w / 2.0, F.tan(F.radians(fov_deg) / 2))
    return intrinsics(f, f, w / 2.0, h / 2.0)


def intrinsics_from_exif(focal_mm: Column, exif_w: Column, exif_h: Column, w: Column, h: Column) -> Column:
    f = F.coalesce(focal_mm, F.lit(DEFAULT_FOCAL_MM))
    fx = f * (F.coalesce(exif_w, w) / SENSOR_W_MM)
    fy = f * (F.coalesce(exif_h, h) / SENSOR_H_MM)
    return intrinsics(fx, fy, w / 2.0, h / 2.0)


def fov_from_zoom(xfov: Column, zfov: Column, aruw: Column, is_360: Column) -> Column:
    """Horizontal field of view: given, else from zoom FOV and aspect, else 100 for 360 media."""
    ratio = aruw / F.sqrt(aruw * aruw + 1)
    derived = F.degrees(F.atan(F.tan(F.radians(zfov) / 2) * ratio) * 2)
    return F.coalesce(xfov, derived, F.when(is_360, 100.0))


def pitch_roll(gx: Column, gy: Column, gz: Column) -> Column:
    """Camera pitch and roll in degrees from a gravity vector."""
    n = F.sqrt(gx * gx + gy * gy + gz * gz)
    unit = lambda c: F.when(n > 1e-6, c / n).otherwise(c)
    sin_pitch = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -unit(gz)))
    return F.struct(
        F.degrees(F.asin(sin_pitch)).alias("pitch"), F.degrees(F.atan2(unit(gx), unit(gy))).alias("roll")
    )


def bev_homography(
    k: Column, cam_h: Column, gx: Column, gy: Column, gz: Column, yaw_deg: Column, near: Column, far: Column, width: Column
) -> Column:
    """Image-to-top-down homography for the road plane seen by a pitched camera.

    Roll is ignored: with the gravity vector reduced to its y/z part (0, b, c) the
    plane axes are right = (1, 0, 0), forward = (0, -c, b) for b >= 0 and
    down = (0, b, c). Yaw turns right and forward about down.
    """
    n = F.sqrt(gx * gx + gy * gy + gz * gz)
    uy = F.when(n < 1e-6, 1.0).otherwise(gy / n)
    uz = F.when(n < 1e-6, 0.0).otherwise(gz / n)
    yz = F.sqrt(uy * uy + uz * uz)
    down = F.struct(
        F.when(yz > 1e-6, uy / yz).otherwise(1.0).alias("b"), F.when(yz > 1e-6, uz / yz).otherwise(0.0).alias("c"),
        F.cos(F.radians(yaw_deg)).alias("ca"), F.sin(F.radians(yaw_deg)).alias("sa"),
    )

    def axes(v: Column) -> Column:
        b, c = v["b"], v["c"]
        # forward = z minus its part along down, of unit length; straight up when looking along down
        flat = F.abs(b) > 1e-6
        fy = F.when(flat, -c * F.signum(b)).otherwise(-1.0)
        fz = F.when(flat, F.abs(b)).otherwise(0.0)
        rx = F.signum(b * fz - c * fy)
        return mat(
            v["ca"] * rx, v["sa"] * rx, 0,
            -v["sa"] * fy, v["ca"] * fy, cam_h * b,
            -v["sa"] * fz, v["ca"] * fz, cam_h * c,
        )

    px = 1.0 / BEV_PIXELS_PER_METER
    canvas = mat(px, 0, -width / 2, 0, -px, far, 0, 0, 1)
    eye = mat(1, 0, 0, 0, 1, 0, 0, 0, 1)

    def scaled(inv: Column) -> Column:
        whole = F.transform(inv, lambda v: v / F.when(F.abs(inv[8]) > 1e-9, inv[8]).otherwise(1.0))
        return F.coalesce(whole, eye)

    return let(inverse(matmul(matmul(k, let(down, axes)), canvas)), scaled)


def bev_size(near: Column, far: Column, width: Column) -> Column:
    return F.struct(
        (width * BEV_PIXELS_PER_METER).cast("int").alias("w"),
        ((far - near) * BEV_PIXELS_PER_METER).cast("int").alias("h"),
    )


def apply_homography(h: Column, points: Column) -> Column:
    """Project an array of struct(x, y); the scale is left alone when it is zero."""

    def place(m: Column, p: Column) -> Column:
        u, v, w = apply(m, p["x"], p["y"], F.lit(1.0))
        s = F.when(w != 0, w).otherwise(1.0)
        return F.struct((u / s).alias("x"), (v / s).alias("y"))

    return let(h, lambda m: F.transform(points, lambda p: place(m, p)))


def fisheye_project(
    x: Column, z: Column, cam_h: Column, yaw_deg: Column, xfov: Column, yfov: Column, w: Column, h: Column
) -> Column:
    """Ground point to equidistant fisheye pixel; invalid points map to (0, 0)."""
    ca, sa = F.cos(F.radians(yaw_deg)), F.sin(F.radians(yaw_deg))
    xr, zr = ca * x + sa * z, ca * z - sa * x
    r3 = F.sqrt(xr * xr + cam_h * cam_h + zr * zr)
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), zr / r3)))
    rxy = F.greatest(F.sqrt(xr * xr + cam_h * cam_h), F.lit(1e-9))
    u = w / 2.0 + (w / 2.0) / (F.radians(xfov) / 2) * theta * xr / rxy
    v = h / 2.0 + (h / 2.0) / (F.radians(yfov) / 2) * theta * cam_h / rxy
    ok = (zr > 0.1) & (u >= 0) & (u < w) & (v >= 0) & (v < h)
    return F.struct(F.when(ok, u).otherwise(0.0).alias("u"), F.when(ok, v).otherwise(0.0).alias("v"), ok.alias("valid"))


def pixels_to_meters(k: Column, vp_y: Column, cam_h: Column, px: Column, py: Column) -> Column:
    """Pixel to flat ground (X right, Y forward) through a vanishing point row."""
    fx, fy, cx, cy = k[0], k[4], k[2], k[5]
    theta = F.atan2(vp_y - cy, fy)
    den = (py - cy) * F.cos(theta) + fy * F.sin(theta)
    ok = F.abs(den) > 1e-5
    y = F.when(ok, cam_h * fy / den).otherwise(0.0)
    return F.struct(F.when(ok, (px - cx) * y / fx).otherwise(0.0).alias("x"), y.alias("y"))


def vp_to_pitch_yaw(u: Column, v: Column, w: Column, h: Column, fov_deg: Column, is_360: Column) -> Column:
    """Pitch and yaw implied by a vanishing point; 360 media get the correction sign."""
    f = F.try_divide(w / 2.0, F.tan(F.radians(fov_deg) / 2))
    sign = F.when(is_360, 1.0).otherwise(-1.0)
    return F.struct(
        F.degrees(F.atan2(sign * (h / 2.0 - v), f)).alias("pitch"),
        F.degrees(F.atan2(sign * (u - w / 2.0), f)).alias("yaw"),
    )


def rodrigues_matrix(rx: Column, ry: Column, rz: Column) -> Column:
    def turn(v: Column) -> Column:
        x, y, z = v["x"], v["y"], v["z"]
        theta = F.sqrt(x * x + y * y + z * z)
        # sin(t)/t and (1 - cos(t))/t^2; identity below 1e-8
        still = theta < 1e-8
        t = F.when(still, 1.0).otherwise(theta)
        p = F.when(still, 0.0).otherwise(F.sin(t) / t)
        q = F.when(still, 0.0).otherwise((1 - F.cos(t)) / (t * t))
        return let(
            F.struct(p.alias("p"), q.alias("q")),
            lambda f: mat(
                1 - f["q"] * (y * y + z * z), f["q"] * x * y - f["p"] * z, f["q"] * x * z + f["p"] * y,
                f["q"] * x * y + f["p"] * z, 1 - f["q"] * (x * x + z * z), f["q"] * y * z - f["p"] * x,
                f["q"] * x * z - f["p"] * y, f["q"] * y * z + f["p"] * x, 1 - f["q"] * (x * x + y * y),
            ),
        )

    return let(F.struct(rx.alias("x"), ry.alias("y"), rz.alias("z")), turn)


def euler_matrix(pitch_deg: Column, yaw_deg: Column, roll_deg: Column) -> Column:
    """Camera-to-world rotation: yaw, then pitch, then roll (x right, y down, z forward)."""
    cp, sp = F.cos(F.radians(pitch_deg)), F.sin(F.radians(pitch_deg))
    cy, sy = F.cos(F.radians(yaw_deg)), F.sin(F.radians(yaw_deg))
    cr, sr = F.cos(F.radians(roll_deg)), F.sin(F.radians(roll_deg))
    return mat(
        cy * cr + sy * sp * sr, sy * sp * cr - cy * sr, sy * cp,
        cp * sr, cp * cr, -sp,
        cy * sp * sr - sy * cr, sy * sr + cy * sp * cr, cy * cp,
    )


def align_vectors(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Rotation taking direction a to direction b."""
    na, nb = F.sqrt(ax * ax + ay * ay + az * az), F.sqrt(bx * bx + by * by + bz * bz)
    unit = F.struct(*[F.try_divide(c, n).alias(k) for k, c, n in (("ax", ax, na), ("ay", ay, na), ("az", az, na), ("bx", bx, nb), ("by", by, nb), ("bz", bz, nb))])

    def crossed(u: Column) -> Column:
        return F.struct(
            (u["ay"] * u["bz"] - u["az"] * u["by"]).alias("x"), (u["az"] * u["bx"] - u["ax"] * u["bz"]).alias("y"),
            (u["ax"] * u["by"] - u["ay"] * u["bx"]).alias("z"), (u["ax"] * u["bx"] + u["ay"] * u["by"] + u["az"] * u["bz"]).alias("c"),
        )

    def turn(v: Column) -> Column:
        x, y, z, c = v["x"], v["y"], v["z"], v["c"]
        s2 = x * x + y * y + z * z
        q = F.when(s2 == 0, 0.0).otherwise((1 - c) / F.when(s2 == 0, 1.0).otherwise(s2))
        sign = F.when((s2 == 0) & (c <= 0), -1.0).otherwise(1.0)
        return mat(
            sign - q * (y * y + z * z), q * x * y - z, q * x * z + y,
            q * x * y + z, sign - q * (x * x + z * z), q * y * z - x,
            q * x * z - y, q * y * z + x, sign - q * (x * x + y * y),
        )

    return let(let(unit, crossed), turn)


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> Column:
    def turn(q: Column) -> Column:
        x, y, z, w = q["x"], q["y"], q["z"], q["w"]
        s = F.try_divide(F.lit(2.0), x * x + y * y + z * z + w * w)
        return mat(
            1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
            s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
            s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
        )

    return let(F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w")), turn)


def world_to_camera(r: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """Inverse of a camera-to-world pose whose axes are first turned 180 degrees about x."""

    def invert(inv: Column) -> Column:
        x, y, z = apply(inv, tx, ty, tz)
        return F.struct(inv.alias("r"), (-x).alias("tx"), (-y).alias("ty"), (-z).alias("tz"))

    flip = mat(1, 0, 0, 0, -1, 0, 0, 0, -1)
    return let(transpose(matmul(r, flip)), invert)


ROUND_DEFECTS = ("pothole", "puddle", "manhole")
LONG_DEFECTS = ("crack", "patch")


def defect_area(kind: Column, length: Column, width: Column) -> Column:
    """Discs for round defects (length is the diameter), rectangles for long ones."""
    disc = length * length * (3.141592653589793 / 4)
    return F.when(kind.isin(*ROUND_DEFECTS), disc).when(kind.isin(*LONG_DEFECTS), length * width)


def defect_aabb(kind: Column, length: Column, width: Column, x: Column, y: Column, angle_deg: Column) -> Column:
    """Axis-aligned box around a turned defect, as struct(x_min, y_min, x_max, y_max)."""
    hl = F.when(kind.isin(*ROUND_DEFECTS, *LONG_DEFECTS), length / 2)
    hw = F.when(kind.isin(*ROUND_DEFECTS), length / 2).when(kind.isin(*LONG_DEFECTS), width / 2)
    c, s = F.abs(F.cos(F.radians(angle_deg))), F.abs(F.sin(F.radians(angle_deg)))
    hx, hy = hl * c + hw * s, hl * s + hw * c
    return F.struct((x - hx).alias("x_min"), (y - hy).alias("y_min"), (x + hx).alias("x_max"), (y + hy).alias("y_max"))
