"""Geodesic and camera functions over frames."""

from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions import geo as g
from ..operators import points as pts
from . import feeds
from .registry import query, r, rnd, sql_bearing, sql_dest, sql_hav, sql_l2g, sql_mod, table

BASE = ("-32.3995::DOUBLE", "151.75001::DOUBLE")
HEAD = "(value * 0.7)"
X, Z = "(speed - 20)", "(value / 50 + 0.5)"


def _f(spark, sf):
    return feeds.frames(spark, sf)


L = lambda v: F.lit(float(v))


def base():
    return L(-32.3995), L(151.75001)


def head():
    return F.col("value") * 0.7


def _fq(body: str) -> str:
    return "WITH " + feeds.FRAMES_SQL + " " + body


@query("haversine", _fq(f"SELECT frame_idx, {r(sql_hav(*BASE, 'lat', 'lon'), 5)} AS d FROM frames"))
def haversine(spark, sf):
    return _f(spark, sf).select("frame_idx", rnd(g.haversine(*base(), F.col("lat"), F.col("lon")), 5).alias("d"))


@query("bearing", _fq(f"SELECT frame_idx, {r(sql_bearing(*BASE, 'lat', 'lon'))} AS a FROM frames"))
def bearing(spark, sf):
    return _f(spark, sf).select("frame_idx", rnd(g.bearing(*base(), F.col("lat"), F.col("lon"))).alias("a"))


_lat, _lon = sql_l2g("lat", "lon", HEAD, X, Z)


@query("local_to_global", _fq(f"SELECT frame_idx, {r(_lat, 8)} AS la, {r(_lon, 8)} AS lo FROM frames"))
def local_to_global(spark, sf):
    p = g.local_to_global(F.col("lat"), F.col("lon"), head(), F.col("speed") - 20, F.col("value") / 50 + 0.5)
    return _f(spark, sf).select("frame_idx", rnd(p["lat"], 8).alias("la"), rnd(p["lon"], 8).alias("lo"))


_ang = f"radians({sql_bearing(*BASE, 'lat', 'lon')} - {HEAD})"
_d = sql_hav(*BASE, "lat", "lon")


@query("global_to_local", _fq(f"SELECT frame_idx, {r(f'{_d} * sin({_ang})', 4)} AS x, {r(f'{_d} * cos({_ang})', 4)} AS z FROM frames"))
def global_to_local(spark, sf):
    p = g.global_to_local(*base(), head(), F.col("lat"), F.col("lon"))
    return _f(spark, sf).select("frame_idx", rnd(p["x"], 4).alias("x"), rnd(p["z"], 4).alias("z"))


_cl, _co = sql_l2g("lat", "lon", HEAD, "(frame_idx % 2)::DOUBLE", "(frame_idx % 3)::DOUBLE")


@query("camera_offset", _fq(f"""SELECT frame_idx, {r(f'CASE WHEN frame_idx % 6 = 0 THEN lat ELSE {_cl} END', 8)} AS la,
  {r(f'CASE WHEN frame_idx % 6 = 0 THEN lon ELSE {_co} END', 8)} AS lo FROM frames"""))
def camera_offset(spark, sf):
    i = F.col("frame_idx")
    p = g.camera_offset(F.col("lat"), F.col("lon"), head(), (i % 2).cast("double"), (i % 3).cast("double"))
    return _f(spark, sf).select("frame_idx", rnd(p["lat"], 8).alias("la"), rnd(p["lon"], 8).alias("lo"))


@query("decompose_offset", _fq(f"""SELECT frame_idx, {r(f'CASE WHEN {_d} < 1e-9 THEN 0.0 ELSE {_d} * cos({_ang}) END', 4)} AS longitudinal,
  {r(f'CASE WHEN {_d} < 1e-9 THEN 0.0 ELSE {_d} * sin({_ang}) END', 4)} AS lateral FROM frames"""))
def decompose_offset(spark, sf):
    p = g.decompose_offset(*base(), F.col("lat"), F.col("lon"), head())
    return _f(spark, sf).select("frame_idx", rnd(p["longitudinal"], 4).alias("longitudinal"), rnd(p["lateral"], 4).alias("lateral"))


_pb = f"radians({sql_bearing(*BASE, 'lat', 'lon')})"


@query("project_xy", _fq(f"SELECT frame_idx, {r(f'{_d} * sin({_pb})', 4)} AS x, {r(f'{_d} * cos({_pb})', 4)} AS y FROM frames"))
def project_xy(spark, sf):
    p = g.project_xy(F.col("lat"), F.col("lon"), *base())
    return _f(spark, sf).select("frame_idx", rnd(p["x"], 4).alias("x"), rnd(p["y"], 4).alias("y"))


_ul, _uo = sql_dest(*BASE, "atan2(value, speed + 1)", "sqrt(value * value + (speed + 1) * (speed + 1))")


@query("unproject_xy", _fq(f"SELECT frame_idx, {r(_ul, 8)} AS la, {r(_uo, 8)} AS lo FROM frames"))
def unproject_xy(spark, sf):
    p = g.unproject_xy(F.col("value"), F.col("speed") + 1, *base())
    return _f(spark, sf).select("frame_idx", rnd(p["lat"], 8).alias("la"), rnd(p["lon"], 8).alias("lo"))


@query("equirect_xy", _fq(f"""SELECT frame_idx, {r(f'radians(lon - {BASE[1]}) * cos(radians({BASE[0]})) * 6378137.0', 4)} AS x,
  {r(f'radians(lat - {BASE[0]}) * 6378137.0', 4)} AS y, {r('speed - 5.0')} AS z FROM frames"""))
def equirect_xy(spark, sf):
    p = g.enu(F.col("lat"), F.col("lon"), F.col("speed"), *base(), L(5.0))
    return _f(spark, sf).select("frame_idx", rnd(p["x"], 4).alias("x"), rnd(p["y"], 4).alias("y"), rnd(p["z"]).alias("z"))


@query("equirect_latlon", _fq(f"""SELECT frame_idx, {r(f'{BASE[0]} + degrees(speed / 6378137.0)', 8)} AS la,
  {r(f'{BASE[1]} + degrees(value / (6378137.0 * cos(radians({BASE[0]}))))', 8)} AS lo FROM frames"""))
def equirect_latlon(spark, sf):
    p = g.equirect_latlon(F.col("value"), F.col("speed"), *base())
    return _f(spark, sf).select("frame_idx", rnd(p["lat"], 8).alias("la"), rnd(p["lon"], 8).alias("lo"))


@query("view_heading", _fq(f"SELECT frame_idx, {r(sql_mod(HEAD + ' + CASE WHEN frame_idx % 2 = 0 THEN 180 ELSE 0 END + speed', '360.0'))} AS h FROM frames"))
def view_heading(spark, sf):
    view = F.when(F.col("frame_idx") % 2 == 0, "rear").otherwise("front")
    return _f(spark, sf).select("frame_idx", rnd(g.view_heading(head(), view, F.col("speed"))).alias("h"))


_fp = {"c": sql_l2g("lat", "lon", HEAD, "0.0", "(1.2 + 5.0) / 2"), "p0": sql_l2g("lat", "lon", HEAD, "-3.0", "5.0"), "p1": sql_l2g("lat", "lon", HEAD, "3.0", "5.0"),
       "p2": sql_l2g("lat", "lon", HEAD, "3.0", "1.2"), "p3": sql_l2g("lat", "lon", HEAD, "-3.0", "1.2")}


@query("footprint", _fq("SELECT frame_idx, 6.0::DOUBLE AS width_m, " + ", ".join(
    f"{r(v[0], 8)} AS {k}_lat, {r(v[1], 8)} AS {k}_lon" for k, v in _fp.items()) + " FROM frames"))
def footprint(spark, sf):
    fp = g.footprint(F.col("lat"), F.col("lon"), head(), L(1.2), L(5.0), L(6.0))
    cols = [rnd(fp["lat"], 8).alias("c_lat"), rnd(fp["lon"], 8).alias("c_lon"), fp["width_m"].alias("width_m")]
    for k in range(4):
        cols += [rnd(fp["corners"][k][1], 8).alias(f"p{k}_lat"), rnd(fp["corners"][k][0], 8).alias(f"p{k}_lon")]
    return _f(spark, sf).select("frame_idx", *cols)


@query("intrinsics", _fq(f"""SELECT frame_idx, {r('320.0 / tan(radians(60 + speed) / 2)', 4)} AS f,
  {r('CASE WHEN frame_idx % 2 = 0 THEN 3.5 ELSE 2.71 END * (640 / 6.17::DOUBLE)', 4)} AS fx, {r('CASE WHEN frame_idx % 2 = 0 THEN 3.5 ELSE 2.71 END * (400 / 4.55::DOUBLE)', 4)} AS fy FROM frames"""))
def intrinsics(spark, sf):
    k = cam.intrinsics_from_fov(L(640), L(480), F.col("speed") + 60)
    e = cam.intrinsics_from_exif(F.when(F.col("frame_idx") % 2 == 0, 3.5), F.lit(None).cast("double"), L(400), L(640), L(480))
    return _f(spark, sf).select("frame_idx", rnd(k[0], 4).alias("f"), rnd(e[0], 4).alias("fx"), rnd(e[4], 4).alias("fy"))


@query("fov_from_zoom", _fq(f"""SELECT frame_idx, {r('CASE WHEN frame_idx % 3 = 0 THEN 77.0 WHEN frame_idx % 3 = 1 THEN degrees(2 * atan(tan(radians(60 + speed) / 2) * (1.5 / sqrt(1.5 * 1.5 + 1)))) WHEN frame_idx % 2 = 0 THEN 100.0 END')} AS fov FROM frames"""))
def fov_from_zoom(spark, sf):
    i = F.col("frame_idx")
    fov = cam.fov_from_zoom(F.when(i % 3 == 0, 77.0), F.when(i % 3 == 1, F.col("speed") + 60), L(1.5), i % 2 == 0)
    return _f(spark, sf).select("frame_idx", rnd(fov).alias("fov"))


_n = "sqrt(pow(speed - 20, 2) + 100 + pow(value / 100, 2))"


@query("pitch_roll", _fq(f"SELECT frame_idx, {r(f'degrees(asin(-(value / 100) / {_n}))')} AS pitch, {r(f'degrees(atan2((speed - 20) / {_n}, 10 / {_n}))')} AS roll FROM frames"))
def pitch_roll(spark, sf):
    p = cam.pitch_roll(F.col("speed") - 20, L(10), F.col("value") / 100)
    return _f(spark, sf).select("frame_idx", rnd(p["pitch"]).alias("pitch"), rnd(p["roll"]).alias("roll"))


# Gravity (0.1, 1, g): down = (0, b, c) and forward = (0, -c, b), both of unit length.
@query("bev_homography", _fq(f""", a AS (SELECT frame_idx, 1 / sqrt(1 + pow(value / 1000, 2)) AS b, (value / 1000) / sqrt(1 + pow(value / 1000, 2)) AS c,
   cos(radians(speed / 10)) AS ca, sin(radians(speed / 10)) AS sa FROM frames),
m AS (SELECT frame_idx, 500 * ca AS g00, 500 * sa + 320 * 0 AS g01, 0.0 AS g02, sa * c AS ry, -sa * b AS rz, -ca * c AS fy, ca * b AS fz, 1.6 * b AS dy, 1.6 * c AS dz FROM a),
k AS (SELECT frame_idx, g00 + 320 * rz AS a00, g01 + 320 * fz AS a01, 320 * dz AS a02, 500 * ry + 240 * rz AS a10, 500 * fy + 240 * fz AS a11, 500 * dy + 240 * dz AS a12, rz AS a20, fz AS a21, dz AS a22 FROM m),
h AS (SELECT frame_idx, a00 / 50 AS b00, -a01 / 50 AS b01, -3 * a00 + 6 * a01 + a02 AS b02, a10 / 50 AS b10, -a11 / 50 AS b11, -3 * a10 + 6 * a11 + a12 AS b12, a20 / 50 AS b20, -a21 / 50 AS b21, -3 * a20 + 6 * a21 + a22 AS b22 FROM k),
i AS (SELECT *, b00 * b11 - b01 * b10 AS m22 FROM h)
SELECT frame_idx, {r('(b11 * b22 - b12 * b21) / m22', 5)} AS h00, {r('(b02 * b21 - b01 * b22) / m22', 5)} AS h01, {r('(b01 * b12 - b02 * b11) / m22', 3)} AS h02,
  {r('(b12 * b20 - b10 * b22) / m22', 5)} AS h10, {r('(b00 * b22 - b02 * b20) / m22', 5)} AS h11, {r('(b02 * b10 - b00 * b12) / m22', 3)} AS h12,
  {r('(b10 * b21 - b11 * b20) / m22', 7)} AS h20, {r('(b01 * b20 - b00 * b21) / m22', 7)} AS h21 FROM i"""))
def bev_homography(spark, sf):
    k = cam.intrinsics(L(500), L(500), L(320), L(240))
    h = cam.bev_homography(k, L(1.6), L(0.1), L(1.0), F.col("value") / 1000, F.col("speed") / 10, L(1.2), L(6.0), L(6.0))
    digits = [5, 5, 3, 5, 5, 3, 7, 7]
    out = _f(spark, sf).withColumn("h", h)
    return out.select("frame_idx", *[rnd(F.col("h")[n], digits[n]).alias(f"h{n // 3}{n % 3}") for n in range(8)])


@query("apply_homography", _fq(f"""SELECT frame_idx, {r('(1.1 * value + 0.2 * speed + 3) / (0.001 * value + 0.002 * speed + 1)', 5)} AS x,
  {r('(0.1 * value + 0.9 * speed - 2) / (0.001 * value + 0.002 * speed + 1)', 5)} AS y FROM frames"""))
def apply_homography(spark, sf):
    h = cam.mat(1.1, 0.2, 3.0, 0.1, 0.9, -2.0, 0.001, 0.002, 1.0)
    p = cam.apply_homography(h, F.array(F.struct(F.col("value").alias("x"), F.col("speed").alias("y"))))[0]
    return _f(spark, sf).select("frame_idx", rnd(p["x"], 5).alias("x"), rnd(p["y"], 5).alias("y"))


@query("polygon_area", "WITH " + feeds.BOXES_SQL + f" SELECT frame_id, {r('w * h / 2.0::DOUBLE')} AS tri, {r('w * h * 0.02 * 0.02')} AS box FROM boxes")
def polygon_area(spark, sf):
    d = lambda c: F.col(c).cast("double")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = d("x"), d("y"), d("w"), d("h")
    tri = g.polygon_area(F.array(p(x, y), p(x + w, y), p(x, y + h)))
    box = g.polygon_area(F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h), p(x, y)))
    return feeds.boxes(spark, sf).select("frame_id", rnd(tri).alias("tri"), rnd(box * (0.02 * 0.02)).alias("box"))


_xr = "(cos(radians(speed)) * (speed - 20) + sin(radians(speed)) * (value / 50))"
_zr = "(cos(radians(speed)) * (value / 50) - sin(radians(speed)) * (speed - 20))"
_th = f"acos(greatest(-1.0, least(1.0, {_zr} / sqrt({_xr} * {_xr} + 2.56 + {_zr} * {_zr}))))"
_u = f"(320 + 320 / (radians(120.0) / 2) * {_th} * {_xr} / sqrt({_xr} * {_xr} + 2.56))"
_v = f"(240 + 240 / (radians(90.0) / 2) * {_th} * 1.6 / sqrt({_xr} * {_xr} + 2.56))"
_ok = f"({_zr} > 0.1 AND {_u} >= 0 AND {_u} < 640 AND {_v} >= 0 AND {_v} < 480)"


@query("fisheye_project", _fq(f"SELECT frame_idx, {r(f'CASE WHEN {_ok} THEN {_u} ELSE 0.0 END', 4)} AS u, {r(f'CASE WHEN {_ok} THEN {_v} ELSE 0.0 END', 4)} AS v, {_ok} AS valid FROM frames"))
def fisheye_project(spark, sf):
    p = cam.fisheye_project(F.col("speed") - 20, F.col("value") / 50, L(1.6), F.col("speed"), L(120), L(90), L(640), L(480))
    return _f(spark, sf).select("frame_idx", rnd(p["u"], 4).alias("u"), rnd(p["v"], 4).alias("v"), p["valid"].alias("valid"))


_b0 = sql_l2g("lat", "lon", HEAD, "0 * 0.02 - 3.0", "5.0 - 0 * 0.02")
_b1 = sql_l2g("lat", "lon", HEAD, "speed * 0.02 - 3.0", "5.0 - value * 0.02")


@query("bev_px_to_lonlat", _fq(f"SELECT frame_idx, 4::BIGINT AS n, {r(_b0[1], 8)} AS lon0, {r(_b0[0], 8)} AS lat0, {r(_b1[1], 8)} AS lon1, {r(_b1[0], 8)} AS lat1, {r(_b0[0], 8)} AS lat3 FROM frames"))
def bev_px_to_lonlat(spark, sf):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = g.bev_px_to_lonlat(F.array(p(L(0), L(0)), p(F.col("speed"), F.col("value")), p(L(50), L(70))), F.col("lat"), F.col("lon"), head(), L(0.02), L(3.0), L(5.0))
    return _f(spark, sf).withColumn("g", ring).select(
        "frame_idx", F.size("g").cast("long").alias("n"), rnd(F.col("g")[0][0], 8).alias("lon0"), rnd(F.col("g")[0][1], 8).alias("lat0"),
        rnd(F.col("g")[1][0], 8).alias("lon1"), rnd(F.col("g")[1][1], 8).alias("lat1"), rnd(F.col("g")[3][1], 8).alias("lat3"))


_k1 = sql_l2g(*BASE, "30.0", "(speed / 50) * 800 / 50.0 - 10.0", "40.0 - (value / 500) * 600 / 50.0")


@query("corridor_px_to_lonlat", _fq(f"SELECT frame_idx, {r(_k1[1], 8)} AS lon1, {r(_k1[0], 8)} AS lat1, {r('abs(0.5 * (speed / 50) * 16 * 12)', 4)} AS area FROM frames"))
def corridor_px_to_lonlat(spark, sf):
    meta = F.struct(*[L(v).alias(k) for k, v in dict(w_canvas=800, h_canvas=600, ppm=50, min_x_m=-10, max_y_m=40, base_lat=-32.3995, base_lon=151.75001, base_heading=30).items()])
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    pt = F.array(p(F.col("speed") / 50, F.col("value") / 500), p(L(0), L(1)), p(L(0), L(0)))
    tri = F.array(p(F.col("speed") / 50, L(0)), p(L(0), L(1)), p(L(0), L(0)))
    ring = g.corridor_px_to_lonlat(pt, meta)
    area = g.polygon_area(g.corridor_points_m(tri, meta))
    return _f(spark, sf).select("frame_idx", rnd(ring[0][0], 8).alias("lon1"), rnd(ring[0][1], 8).alias("lat1"), rnd(area, 4).alias("area"))


_den = "((value - 240) * cos(atan2(200 - 240, 500.0)) + 500 * sin(atan2(200 - 240, 500.0)))"


@query("pixels_to_meters", _fq(f"SELECT frame_idx, {r(f'CASE WHEN abs({_den}) > 1e-5 THEN (speed * 10 - 320) * (1.6 * 500 / {_den}) / 500 ELSE 0.0 END', 4)} AS x, {r(f'CASE WHEN abs({_den}) > 1e-5 THEN 1.6 * 500 / {_den} ELSE 0.0 END', 4)} AS y FROM frames"))
def pixels_to_meters(spark, sf):
    k = cam.intrinsics(L(500), L(500), L(320), L(240))
    p = cam.pixels_to_meters(k, L(200), L(1.6), F.col("speed") * 10, F.col("value"))
    return _f(spark, sf).select("frame_idx", rnd(p["x"], 4).alias("x"), rnd(p["y"], 4).alias("y"))


@query("vp_to_pitch_yaw", _fq(f"""SELECT frame_idx, {r('CASE WHEN frame_idx % 2 = 0 THEN 1 ELSE -1 END * degrees(atan2(240 - value, 320 / tan(radians(100.0) / 2)))')} AS pitch,
  {r('CASE WHEN frame_idx % 2 = 0 THEN 1 ELSE -1 END * degrees(atan2(speed * 10 - 320, 320 / tan(radians(100.0) / 2)))')} AS yaw FROM frames"""))
def vp_to_pitch_yaw(spark, sf):
    p = cam.vp_to_pitch_yaw(F.col("speed") * 10, F.col("value"), L(640), L(480), L(100), F.col("frame_idx") % 2 == 0)
    return _f(spark, sf).select("frame_idx", rnd(p["pitch"]).alias("pitch"), rnd(p["yaw"]).alias("yaw"))


_t = "sqrt(pow(speed / 20, 2) + 0.25 + 0.01)"


@query("rodrigues_matrix", _fq(f"""SELECT frame_idx, {r(f'1 - (1 - cos({_t})) * (0.25 + 0.01) / ({_t} * {_t})')} AS m00,
  {r(f'(1 - cos({_t})) * (speed / 20) * 0.5 / ({_t} * {_t}) - sin({_t}) * 0.1 / {_t}')} AS m01, {r(f'1 - (1 - cos({_t})) * (pow(speed / 20, 2) + 0.25) / ({_t} * {_t})')} AS m22 FROM frames"""))
def rodrigues_matrix(spark, sf):
    m = cam.rodrigues_matrix(F.col("speed") / 20, L(0.5), L(0.1))
    return _f(spark, sf).select("frame_idx", rnd(m[0]).alias("m00"), rnd(m[1]).alias("m01"), rnd(m[8]).alias("m22"))


_p, _y, _ro = "radians(speed)", "radians(value)", "radians(speed / 3)"


@query("euler_matrix", _fq(f"""SELECT frame_idx, {r(f'cos({_y}) * cos({_ro}) + sin({_y}) * sin({_p}) * sin({_ro})')} AS m00, {r(f'-sin({_p})')} AS m12,
  {r(f'cos({_y}) * cos({_p})')} AS m22, {r(f'cos({_p}) * sin({_ro})')} AS m10, {r(f'sin({_y}) * cos({_p})')} AS m02 FROM frames"""))
def euler_matrix(spark, sf):
    m = cam.euler_matrix(F.col("speed"), F.col("value"), F.col("speed") / 3)
    return _f(spark, sf).select("frame_idx", *[rnd(m[i]).alias(n) for i, n in ((0, "m00"), (5, "m12"), (8, "m22"), (3, "m10"), (2, "m02"))])


# Aligning (g, 1, 0) with (0, -1, 0): the turn is about z only.
_na = "sqrt(pow(speed / 10, 2) + 1)"


@query("align_vectors", _fq(f"SELECT frame_idx, {r(f'-1 / {_na}')} AS m00, {r(f'(speed / 10) / {_na}')} AS m01, 1.0::DOUBLE AS m22 FROM frames WHERE speed > 0.0001"))
def align_vectors(spark, sf):
    m = cam.align_vectors(F.col("speed") / 10, L(1), L(0), L(0), L(-1), L(0))
    return _f(spark, sf).where("speed > 0.0001").select("frame_idx", rnd(m[0]).alias("m00"), rnd(m[1]).alias("m01"), rnd(m[8]).alias("m22"))


@query("world_to_camera", _fq(f"SELECT frame_idx, {r('cos(radians(value))')} AS r00, {r('-(cos(radians(value)) * speed + sin(radians(value)) * 2)')} AS tx, {r('3.0')} AS tz FROM frames"))
def world_to_camera(spark, sf):
    half = F.radians("value") / 2
    p = cam.world_to_camera(cam.quaternion_matrix(L(0), L(0), F.sin(half), F.cos(half)), F.col("speed"), L(2), L(3))
    return _f(spark, sf).withColumn("p", p).select("frame_idx", rnd(F.col("p.r")[0]).alias("r00"), rnd("p.tx").alias("tx"), rnd("p.tz").alias("tz"))


KIND = "list_extract(['crack', 'pothole', 'puddle', 'manhole', 'patch'], CAST(l_partkey % 5 AS INTEGER) + 1)"
_L, _W = "(l_quantity / 10)", "(l_linenumber / 5.0::DOUBLE)"
_round = "(l_partkey % 5 IN (1, 2, 3))"
_hl, _hw = f"({_L} / 2)", f"(CASE WHEN {_round} THEN {_L} ELSE {_W} END / 2)"
_ca, _sa = "abs(cos(radians(l_suppkey * 7.0)))", "abs(sin(radians(l_suppkey * 7.0)))"


@query("defect_area", f"SELECT l_orderkey, {KIND} AS kind, {r(f'CASE WHEN {_round} THEN pi() / 4 * {_L} * {_L} ELSE {_L} * {_W} END')} AS area FROM lineitem")
def defect_area(spark, sf):
    return _defects(spark, sf).select("l_orderkey", "kind", rnd(cam.defect_area(F.col("kind"), F.col("len"), F.col("wid"))).alias("area"))


def _defects(spark, sf):
    c = F.col
    kind = F.element_at(F.array(*[F.lit(k) for k in ("crack", "pothole", "puddle", "manhole", "patch")]), (c("l_partkey") % 5).cast("int") + 1)
    return table(spark, sf, "lineitem").select("l_orderkey", kind.alias("kind"), (c("l_quantity") / 10).alias("len"), (c("l_linenumber") / 5.0).alias("wid"),
                                               (c("l_suppkey") * 7.0).alias("deg"), (c("l_partkey") % 40).cast("double").alias("x"), (c("l_suppkey") % 30).cast("double").alias("y"))


@query("defect_aabb", f"""SELECT l_orderkey, {r(f'l_partkey % 40 - ({_hl} * {_ca} + {_hw} * {_sa})')} AS x_min, {r(f'l_suppkey % 30 - ({_hl} * {_sa} + {_hw} * {_ca})')} AS y_min,
  {r(f'l_partkey % 40 + ({_hl} * {_ca} + {_hw} * {_sa})')} AS x_max, {r(f'l_suppkey % 30 + ({_hl} * {_sa} + {_hw} * {_ca})')} AS y_max FROM lineitem""")
def defect_aabb(spark, sf):
    c = F.col
    b = cam.defect_aabb(c("kind"), c("len"), c("wid"), c("x"), c("y"), c("deg"))
    return _defects(spark, sf).select("l_orderkey", *[rnd(b[n]).alias(n) for n in ("x_min", "y_min", "x_max", "y_max")])


# Depth cells: one frame per order, a cell per line; the camera differs per frame.
def _cells(spark, sf):
    c = F.col
    cells = table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("frame_id"), (c("l_suppkey") % 480).alias("row"), (c("l_partkey") % 640).alias("col"),
        F.when(c("l_linenumber") > 1, c("l_quantity")).otherwise(0.0).alias("depth"), c("l_extendedprice").alias("price"))
    cams = table(spark, sf, "orders").select(c("o_orderkey").alias("frame_id"), cam.intrinsics(
        F.when(c("o_orderkey") % 50 == 0, 0.0).otherwise(500.0 + c("o_orderkey") % 7), L(510), L(320), L(240)).alias("k"))
    return cells, cams


@query("skip_degenerate", "SELECT o_orderkey AS frame_id FROM orders WHERE o_orderkey % 50 <> 0")
def skip_degenerate(spark, sf):
    return pts.skip_degenerate(_cells(spark, sf)[1]).select("frame_id")


@query("unproject_depth", f"""SELECT l_orderkey AS frame_id, {r('l_extendedprice', 2)} AS price, {r('l_quantity * (l_partkey % 640 - 320) / (500.0 + l_orderkey % 7)', 5)} AS x,
  {r('l_quantity * (l_suppkey % 480 - 240) / 510.0', 5)} AS y, l_quantity AS z FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber > 1 AND l_quantity > 0 AND o_orderkey % 50 <> 0""")
def unproject_depth(spark, sf):
    cells, cams = _cells(spark, sf)
    out = pts.unproject_depth(cells, pts.skip_degenerate(cams), ["frame_id"])
    return out.select("frame_id", rnd("price", 2).alias("price"), rnd("x", 5).alias("x"), rnd("y", 5).alias("y"), rnd("z", 6).alias("z"))


def _poses(spark, sf):
    c = F.col
    rot = cam.rodrigues_matrix(L(0), (c("n_nationkey") % 5) * 0.3, L(0))
    t = c("n_nationkey").cast("double")
    return table(spark, sf, "nation").where("n_nationkey < 5").select(c("n_nationkey").cast("long").alias("frame_id"), rot.alias("rot"), t.alias("tx"), (t * 2).alias("ty"), (t * 3).alias("tz"))


_c, _s = "cos(frame_id * 0.3)", "sin(frame_id * 0.3)"


@query("to_world", "WITH " + feeds.POINTS_SQL + f" SELECT idx, {r(f'{_c} * x + {_s} * z + frame_id')} AS x, {r('y + frame_id * 2')} AS y, {r(f'{_c} * z - {_s} * x + frame_id * 3')} AS z FROM points")
def to_world(spark, sf):
    out = pts.to_world(feeds.points(spark, sf), _poses(spark, sf), ["frame_id"])
    return out.select("idx", *[rnd(a).alias(a) for a in "xyz"])


@query("to_camera", "WITH " + feeds.POINTS_SQL + f" SELECT idx, {r(f'{_c} * (x - frame_id) - {_s} * (z - frame_id * 3)')} AS x, {r('y - frame_id * 2')} AS y, {r(f'{_s} * (x - frame_id) + {_c} * (z - frame_id * 3)')} AS z FROM points")
def to_camera(spark, sf):
    out = pts.to_camera(feeds.points(spark, sf), _poses(spark, sf), ["frame_id"])
    return out.select("idx", *[rnd(a).alias(a) for a in "xyz"])
