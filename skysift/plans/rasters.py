"""Queries over pixels and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import colour
from skysift.functions.numeric import half_even
from skysift.operators import frames, raster
from skysift.plans.registry import FX, R, RS, query

KEY = "mission_id, frame_idx"

HSV = """hs AS (SELECT *, greatest(b, g, rd) AS mx, greatest(b, g, rd) - least(b, g, rd) AS span FROM pix),
  hd AS (SELECT *, CASE WHEN span = 0 THEN 0e0 WHEN mx = rd THEN 60e0 * (g - b) / span WHEN mx = g THEN 120e0 + 60e0 * (b - rd) / span
     ELSE 240e0 + 60e0 * (rd - g) / span END AS deg FROM hs),
  hv AS (SELECT * EXCLUDE (mx, span, deg), CAST(floor(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END / 2 + 0.5e0) AS BIGINT) % 180 AS h,
     CASE WHEN mx > 0 THEN CAST(floor(255e0 * span / mx + 0.5e0) AS BIGINT) ELSE 0 END AS s, mx AS v,
     CAST(floor(0.299e0 * rd + 0.587e0 * g + 0.114e0 * b + 0.5e0) AS BIGINT) AS luma FROM hd)"""


@query("f16_to_hsv", "pix", f"{HSV} SELECT {KEY}, r, c, h, s, v, luma FROM hv")
def _(v):
    return colour.to_hsv(v.pix).select("mission_id", "frame_idx", "r", "c", "h", "s", "v", "luma")


ROWW = f"OVER (PARTITION BY {KEY}, r ORDER BY c)"
COLW = f"OVER (PARTITION BY {KEY}, c ORDER BY r)"


def mirror(x: str, w: str) -> tuple[str, str]:
    return (
        f"coalesce(lag({x}) {w}, lead({x}) {w}, {x})",
        f"coalesce(lead({x}) {w}, lag({x}) {w}, {x})",
    )


LAP = f"""lp AS (SELECT *, {mirror('gray', ROWW)[0]} + {mirror('gray', ROWW)[1]} + {mirror('gray', COLW)[0]} + {mirror('gray', COLW)[1]}
  - 4 * gray AS laplacian FROM hv)"""


@query("g02_laplacian", "pix", f"{HSV}, {LAP} SELECT {KEY}, r, c, laplacian FROM lp")
def _(v):
    return raster.laplacian(v.pix).select("mission_id", "frame_idx", "r", "c", "laplacian")


SOB = f"""s1 AS (SELECT *, {mirror('gray', ROWW)[1]} - {mirror('gray', ROWW)[0]} AS dx, {mirror('gray', ROWW)[0]} + 2 * gray + {mirror('gray', ROWW)[1]} AS sx FROM hv),
  s2 AS (SELECT *, {mirror('dx', COLW)[0]} + 2 * dx + {mirror('dx', COLW)[1]} AS gx, {mirror('sx', COLW)[1]} - {mirror('sx', COLW)[0]} AS gy FROM s1),
  sob AS (SELECT *, sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) AS gradient FROM s2)"""


@query("g04_sobel_smooth", "pix", f"{HSV}, {SOB} SELECT {KEY}, r, c, gradient < 120 AS is_smooth FROM sob")
def _(v):
    return raster.smooth_surface(v.pix, 120.0).select("mission_id", "frame_idx", "r", "c", "is_smooth")


WATER = """((h BETWEEN 80 AND 135 AND s >= 25 AND v BETWEEN 30 AND 245 AND b >= rd - 10)
  OR (h BETWEEN 6 AND 35 AND s BETWEEN 15 AND 220 AND v BETWEEN 35 AND 230))"""


@query("j01_water_candidate", "pix", f"{HSV}, {SOB} SELECT {KEY}, r, c, {WATER} AND gradient < 200 AS is_candidate FROM sob")
def _(v):
    return raster.water_candidates(v.pix, 200.0).select("mission_id", "frame_idx", "r", "c", "is_candidate")


@query(
    "g06_edge_density", "pix",
    f"""SELECT a.mission_id, a.frame_idx, a.r, a.c, {R('avg(CAST(b.is_edge AS INT))', 6)} AS edge_density FROM pix a JOIN pix b
    ON a.mission_id = b.mission_id AND a.frame_idx = b.frame_idx AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY ALL""",
)
def _(v):
    out = raster.edge_density(v.pix, 2)
    return out.select("mission_id", "frame_idx", "r", "c", half_even(F.col("edge_density"), 6).alias("edge_density"))


EXPOSURE = f"""ex AS (SELECT {KEY}, {R('avg(gray)', 2)} AS mean_brightness, {RS('stddev_pop(gray)', 2)} AS std_contrast,
  {R('avg(CAST(gray < 12 AS INT))', 4)} AS underexposed_ratio, {R('avg(CAST(gray > 245 AS INT))', 4)} AS overexposed_ratio FROM hv GROUP BY ALL)"""
SHARP = f"sh AS (SELECT {KEY}, var_pop(laplacian) AS sharp FROM lp GROUP BY ALL)"
SKY = f"""sk AS (SELECT {KEY}, {R("avg(CAST(r < 5 AND ((v > 190 AND s < 60) OR (h BETWEEN 85 AND 135 AND v > 140 AND s >= 30)) AS INT))", 4)} AS sky_ratio FROM hv GROUP BY ALL)"""


@query("e04_exposure", "pix", f"{HSV}, {EXPOSURE} SELECT * FROM ex")
def _(v):
    return raster.exposure(raster.frame_rows(v.pix))


@query("e05_sharpness", "pix", f"{HSV}, {LAP}, {SHARP} SELECT {KEY}, {RS('sharp', 4)} AS sharpness FROM sh")
def _(v):
    out = raster.sharpness(raster.frame_rows(v.pix))
    return out.withColumn("sharpness", half_even(half_even(F.col("sharpness"), 9), 4))


@query("e06_sky_ratio", "pix", f"{HSV}, {SKY} SELECT * FROM sk")
def _(v):
    return raster.sky_ratio(raster.frame_rows(v.pix))


QUALITY = f"""{HSV}, {LAP}, {EXPOSURE}, {SHARP}, {SKY}, qj AS (SELECT ex.*, sharp, sky_ratio FROM ex JOIN sh USING (mission_id, frame_idx) JOIN sk USING (mission_id, frame_idx)),
  ql AS (SELECT mission_id, frame_idx, mean_brightness, std_contrast, underexposed_ratio, overexposed_ratio, sky_ratio,
    sharp > 20 AND underexposed_ratio < 0.25e0 AND overexposed_ratio < 0.35e0 AS is_valid, {RS('sharp', 2)} AS sharpness,
    {RS('''least(100e0, greatest(0e0, least(60e0, ln(1e0 + sharp) * 8e0) + 40e0 - (underexposed_ratio + overexposed_ratio) * 50e0
      - abs(mean_brightness - 128e0) / 128e0 * 15e0 - greatest(0e0, sky_ratio - 0.4e0) * 25e0))''', 2)} AS quality_score FROM qj)"""


@query("e07_quality", "pix", f"{QUALITY} SELECT * FROM ql")
def _(v):
    return raster.quality(v.pix)


# Half of the frames are made to fail, so that both branches of the gate run.
STRICT = dict(min_sharpness=20000.0, max_over=0.02, max_sky=0.03)


def judged(v):
    from skysift.config import FrameRules

    marked = raster.quality(v.pix).withColumn(
        "sharpness", F.when(F.col("mission_id") % 3 == 0, 0.0).otherwise(F.col("sharpness"))
    )
    return frames.reject_reason(marked, FrameRules(**STRICT))


JUDGED = f"""{QUALITY}, qm AS (SELECT * REPLACE (CASE WHEN mission_id % 3 = 0 THEN 0e0 ELSE sharpness END AS sharpness) FROM ql),
  jd AS (SELECT *, CASE WHEN sharpness < 20000 THEN 'Blurry (sharpness: ' || {FX('sharpness', 2)} || ' < 20000.0)' WHEN underexposed_ratio > 0.25e0 THEN 'Underexposed (' || {FX('underexposed_ratio * 100e0', 1)} || '%)'
    WHEN overexposed_ratio > 0.02e0 THEN 'Overexposed (' || {FX('overexposed_ratio * 100e0', 1)} || '%)' WHEN mean_brightness < 15 THEN 'Too dark (brightness: ' || {FX('mean_brightness', 2)} || ')'
    WHEN sky_ratio > 0.03e0 THEN 'Sky dominant (' || {FX('sky_ratio * 100e0', 1)} || '%)' END AS reject_reason FROM qm)"""


@query("k03_reject_reason", "pix", f"{JUDGED} SELECT mission_id, frame_idx, sharpness, reject_reason FROM jd")
def _(v):
    return judged(v).select("mission_id", "frame_idx", "sharpness", "reject_reason")


@query(
    "h01_relax_if_few", "pix",
    f"""{JUDGED}, n AS (SELECT mission_id, count(*) FILTER (reject_reason IS NULL) AS p FROM jd GROUP BY 1),
    k AS (SELECT jd.*, p, row_number() OVER (PARTITION BY jd.mission_id ORDER BY quality_score DESC, frame_idx) - 1 AS rk FROM jd JOIN n ON jd.mission_id = n.mission_id)
    SELECT mission_id, frame_idx, CASE WHEN p >= 3 THEN frame_idx ELSE rk END AS seq FROM k WHERE (p >= 3 AND reject_reason IS NULL) OR (p < 3 AND rk < 24)""",
)
def _(v):
    return frames.relax_if_few(judged(v)).select("mission_id", "frame_idx", "seq")


@query(
    "e08_fingerprint", "pix",
    f"""{HSV}, a AS (SELECT {KEY}, CAST(floor(h / 22.5e0) AS BIGINT) * 16 + CAST(floor(s / 64) AS BIGINT) * 4 + CAST(floor(v / 64) AS BIGINT) AS slot, CAST(count(*) AS DOUBLE) AS x FROM hv GROUP BY 1, 2, 3),
    b AS (SELECT {KEY}, 128 + CAST(floor(r / 2) AS BIGINT) * 4 + CAST(floor(c / 2) AS BIGINT) AS slot, avg(gray) / 255e0 AS x FROM hv GROUP BY 1, 2, 3),
    ua AS (SELECT {KEY}, slot, x / sqrt(sum(x * x) OVER (PARTITION BY {KEY})) AS x FROM a),
    ub AS (SELECT {KEY}, slot, x / (sqrt(sum(x * x) OVER (PARTITION BY {KEY})) + 1e-7) AS x FROM b),
    u AS (SELECT * FROM ua UNION ALL SELECT * FROM ub), f AS (SELECT {KEY}, slot, x / (sqrt(sum(x * x) OVER (PARTITION BY {KEY})) + 1e-7) AS x FROM u)
    SELECT mission_id, frame_idx, slot, {R('x', 6)} AS x FROM f WHERE x <> 0""",
)
def _(v):
    prints = raster.fingerprint(v.pix, 4)
    return prints.select("mission_id", "frame_idx", F.posexplode("fingerprint").alias("slot", "x")).filter("x <> 0").select(
        "mission_id", "frame_idx", F.col("slot").cast("long").alias("slot"), half_even(F.col("x"), 6).alias("x")
    )


def _vectors(v):
    """Vectors as fingerprints; near copies of the frame before appear on purpose."""
    base = v.table("embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("mission_id"), (F.col("vec_id") % 50).alias("frame_idx"),
        F.col("embedding").cast("array<double>").alias("e"),
    )
    left = base.select("mission_id", "frame_idx", "e")
    tens = base.filter(F.col("frame_idx") % 5 == 0).select("mission_id", F.col("frame_idx").alias("_a"), F.col("e").alias("_e"))
    joined = left.withColumn("_a", F.col("frame_idx") - F.col("frame_idx") % 5).join(tens, ["mission_id", "_a"])
    mixed = F.zip_with("_e", "e", lambda a, b: a * 4.0 + b * (F.col("frame_idx") % 5).cast("double"))
    return joined.select("mission_id", "frame_idx", mixed.alias("m")).select(
        "mission_id", "frame_idx",
        F.transform("m", lambda x: x / F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, y: a + y * y))).alias("fingerprint"),
        (1.0 + ((F.col("frame_idx") * 7 + F.col("mission_id") * 3) % 10).cast("double")).alias("sharpness"),
    )


VEC = """base AS (SELECT CAST(floor(vec_id / 50) AS BIGINT) AS mission_id, CAST(vec_id % 50 AS BIGINT) AS frame_idx, embedding::DOUBLE[] AS e FROM embeddings),
  mixed AS (SELECT b.mission_id, b.frame_idx, [t.e[i] * 4e0 + b.e[i] * CAST(b.frame_idx % 5 AS DOUBLE) FOR i IN range(1, 65)] AS m
    FROM base b JOIN base t ON b.mission_id = t.mission_id AND t.frame_idx = b.frame_idx - b.frame_idx % 5),
  fp AS (SELECT mission_id, frame_idx, [x / sqrt(list_sum([y * y FOR y IN m])) FOR x IN m] AS f, 1e0 + CAST((frame_idx * 7 + mission_id * 3) % 10 AS DOUBLE) AS sharp FROM mixed)"""


@query(
    "f17_cosine", sql=f"""WITH {VEC} SELECT a.mission_id, a.frame_idx, {R('list_sum([a.f[i] * b.f[i] FOR i IN range(1, 65)])', 6)} AS similarity
    FROM fp a JOIN fp b ON a.mission_id = b.mission_id AND b.frame_idx = a.frame_idx + 1""",
)
def _(v):
    a = _vectors(v).select("mission_id", "frame_idx", F.col("fingerprint").alias("f"))
    b = a.select("mission_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("f").alias("g"))
    return a.join(b, ["mission_id", "frame_idx"]).select(
        "mission_id", "frame_idx", half_even(raster.cosine(F.col("f"), F.col("g")), 6).alias("similarity")
    )


DEDUP = f"""WITH RECURSIVE {VEC},
  walk AS (SELECT mission_id, frame_idx, f AS last, sharp AS last_sharp, frame_idx AS last_at, 'kept' AS verdict, CAST(NULL AS DOUBLE) AS sim, CAST(NULL AS BIGINT) AS against FROM fp WHERE frame_idx = 0
    UNION ALL
    SELECT mission_id, frame_idx, CASE WHEN sim > 0.9e0 AND NOT sharp > last_sharp * 1.25e0 THEN last ELSE f END,
      CASE WHEN sim > 0.9e0 AND NOT sharp > last_sharp * 1.25e0 THEN last_sharp ELSE sharp END,
      CASE WHEN sim > 0.9e0 AND NOT sharp > last_sharp * 1.25e0 THEN last_at ELSE frame_idx END,
      CASE WHEN NOT sim > 0.9e0 THEN 'kept' WHEN sharp > last_sharp * 1.25e0 THEN 'replaces' ELSE 'duplicate' END, sim, last_at
    FROM (SELECT fp.*, w.last, w.last_sharp, w.last_at, list_sum([w.last[i] * fp.f[i] FOR i IN range(1, 65)]) AS sim
      FROM walk w JOIN fp ON fp.mission_id = w.mission_id AND fp.frame_idx = w.frame_idx + 1) s),
  dd AS (SELECT w.mission_id, w.frame_idx, CASE WHEN g.sim IS NOT NULL THEN 'replaced' WHEN w.verdict = 'duplicate' THEN 'duplicate' ELSE 'kept' END AS outcome,
    coalesce(g.sim, w.sim) AS similarity FROM walk w LEFT JOIN walk g ON g.verdict = 'replaces' AND g.mission_id = w.mission_id AND g.against = w.frame_idx)"""


@query("k02_dedup_frames", sql=f"{DEDUP} SELECT mission_id, frame_idx, outcome, {R('similarity', 6)} AS similarity FROM dd")
def _(v):
    out = frames.dedup_frames(_vectors(v), 0.9)
    return out.withColumn("similarity", half_even(F.col("similarity"), 6))


@query(
    "e09_selection_stats",
    sql=f"""{DEDUP} SELECT dd.mission_id, count(*) AS total, count(*) FILTER (outcome = 'kept') AS selected, count(*) FILTER (outcome = 'rejected') AS rejected_quality,
    count(*) FILTER (outcome IN ('duplicate', 'replaced')) AS rejected_redundant, {RS("avg(sharp) FILTER (outcome = 'kept')", 2)} AS average_sharpness,
    {RS("avg(sharp * 10) FILTER (outcome = 'kept')", 2)} AS average_quality FROM dd JOIN fp ON dd.mission_id = fp.mission_id AND dd.frame_idx = fp.frame_idx GROUP BY 1""",
)
def _(v):
    base = _vectors(v)
    marked = frames.dedup_frames(base, 0.9).join(
        base.select("mission_id", "frame_idx", "sharpness", (F.col("sharpness") * 10).alias("quality_score")), ["mission_id", "frame_idx"]
    )
    return frames.selection_stats(marked)


@query(
    "g07_number_frames", "cam",
    "SELECT mission_id, frame_idx, row_number() OVER (PARTITION BY mission_id ORDER BY frame_idx) - 1 AS position FROM cam",
)
def _(v):
    return frames.number_frames(v.cam.select("mission_id", "frame_idx"))


@query(
    "g08_uniform_subsample", "cam",
    """p AS (SELECT mission_id, frame_idx, row_number() OVER (PARTITION BY mission_id ORDER BY frame_idx) - 1 AS position, count(*) OVER (PARTITION BY mission_id) AS n FROM cam),
    hits AS (SELECT DISTINCT mission_id, CAST(round_even(i * ((n - 1) / 15e0), 0) AS BIGINT) AS position FROM p, range(16) t(i) WHERE n > 16)
    SELECT p.mission_id, p.frame_idx, p.position FROM p LEFT JOIN hits ON p.mission_id = hits.mission_id AND p.position = hits.position WHERE n <= 16 OR hits.position IS NOT NULL""",
)
def _(v):
    return frames.uniform_subsample(v.cam.select("mission_id", "frame_idx"), 16)


@query(
    "f18_stretch", "pix",
    f"""q AS (SELECT {KEY}, quantile_cont(depth, 0.02) AS p2, quantile_cont(depth, 0.98) AS p98 FROM pix WHERE depth > 0 GROUP BY ALL)
    SELECT pix.mission_id, pix.frame_idx, r, c, {R('least(1e0, greatest(0e0, (depth - p2) / (p98 - p2 + 1e-6)))', 6)} AS stretched
    FROM pix JOIN q ON pix.mission_id = q.mission_id AND pix.frame_idx = q.frame_idx WHERE depth IS NOT NULL""",
)
def _(v):
    out = raster.stretch(v.pix.filter(F.col("depth").isNotNull()))
    return out.select("mission_id", "frame_idx", "r", "c", half_even(F.col("stretched"), 6).alias("stretched"))


@query(
    "e17_mask_stats", "pix",
    f"""SELECT {KEY}, count(*) AS pixels, count(*) FILTER (is_water) AS flagged, {R('avg(CAST(is_water AS INT))', 6)} AS ratio,
    {RS('avg(r) FILTER (is_water)', 4)} AS centroid_r, {RS('avg(c) FILTER (is_water)', 4)} AS centroid_c FROM pix GROUP BY ALL""",
)
def _(v):
    return raster.mask_stats(v.pix)


@query(
    "j04_fire_ratio", "pix",
    f"{HSV} SELECT {KEY}, {R('avg(CAST(h <= 25 AND s >= 120 AND v >= 200 AS INT))', 6)} AS fire_ratio FROM hv GROUP BY ALL",
)
def _(v):
    return raster.fire_ratio(v.pix)


@query(
    "c09_mask_points", "pix samp",
    f"""SELECT s.mission_id, s.frame_idx, s.r, s.c FROM samp s JOIN pix p ON s.mission_id = p.mission_id AND s.frame_idx = p.frame_idx
    AND p.r = CAST(floor(s.r * 8 / 1080) AS BIGINT) AND p.c = CAST(floor(s.c * 8 / 1920) AS BIGINT) WHERE p.is_water""",
)
def _(v):
    # Nine samples a box are made for frames with water only; optimizers do not carry the join below the grouping of the samples.
    wet = v.pix.filter("is_water").select("mission_id", "frame_idx").distinct()
    points = v.over("samp", "det", v.det.join(wet, ["mission_id", "frame_idx"], "left_semi"))
    return raster.mask_points(v.pix, points, (8, 8), (1080, 1920)).select("mission_id", "frame_idx", "r", "c")
