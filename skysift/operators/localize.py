"""Placing detections in 3D and checking the placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.camera import measure, to_pixel, to_world, unproject
from skysift.functions.numeric import half_even, is_finite, norm, settled, truncate
from skysift.lineage import cut
from skysift.operators.ordering import group_medians, quantiles
from skysift.operators.spatial import box_pixels

FRAME = ["mission_id", "frame_idx"]


def with_frame_context(det: DataFrame, cameras: DataFrame, flood: DataFrame) -> DataFrame:
    """Detections with the camera and the flood state of their frame."""
    return det.join(cameras, FRAME).join(flood, FRAME)


def _finish(df: DataFrame, depth: Column, tolerance: float) -> DataFrame:
    """Unproject, reproject and score; reads ``u, v, conf`` and the camera."""
    sx, sy = F.col("model_w") / F.col("img_w"), F.col("model_h") / F.col("img_h")
    placed = df.withColumn("_d", depth)
    world = to_world(unproject(F.col("u") * sx, F.col("v") * sy, F.col("_d")))
    placed = placed.withColumns({"_x": world[0], "_y": world[1], "_z": world[2]})
    back = to_pixel([F.col("_x"), F.col("_y"), F.col("_z")])
    placed = placed.withColumns({"_ru": back[0], "_rv": back[1], "_rz": back[2]})
    err = norm(F.col("_ru") / sx - F.col("u"), F.col("_rv") / sy - F.col("v"))
    outside = (F.col("_ru") < 0) | (F.col("_rv") < 0) | (F.col("_rz") <= 0)
    placed = placed.withColumn(
        "_err", F.when(F.col("_d").isNotNull(), F.when(outside, F.lit(999.0)).otherwise(err))
    )
    good = F.col("_err") <= tolerance
    loc = F.greatest(F.lit(0.0), 1.0 - F.col("_err") / tolerance)
    geometry = F.when(F.col("_d") > 0.5, F.lit(0.90)).otherwise(F.lit(0.60))
    return placed.withColumns(
        {
            "location_status": F.when(good, F.lit("LOCALIZED_3D")).otherwise(F.lit("UNLOCALIZED")),
            "location_reason": F.when(F.col("_d").isNull(), F.lit("no valid depth")).when(
                ~good, F.lit("reprojection")
            ),
            "x_m": F.when(good, half_even(F.col("_x"), 2)),
            "y_m": F.when(good, half_even(F.col("_y"), 2)),
            "z_m": F.when(good, half_even(F.col("_z"), 2)),
            "depth_m": F.when(good, half_even(F.col("_d"), 2)),
            "reprojection_error_px": half_even(F.col("_err"), 2),
            "localization_conf": F.when(good, half_even(loc, 3)),
            "geometry_conf": F.when(good, geometry),
            "object_conf": F.when(good, half_even(0.40 * F.col("conf") + 0.30 * loc + 0.30 * geometry, 3)),
        }
    ).drop("_d", "_x", "_y", "_z", "_ru", "_rv", "_rz", "_err")


def localize(det: DataFrame, depth: DataFrame, cameras: DataFrame, tolerance: float = 30.0, tile: int = 32) -> DataFrame:
    """3D position from the median depth in the middle of the box.

    The central 40 % is read first, then the whole box; without a valid depth, or
    when the point does not reproject near the box centre, the position is null.
    """
    sx, sy = F.col("model_w") / F.col("img_w"), F.col("model_h") / F.col("img_h")
    scaled = det.join(cameras, FRAME).withColumns(
        {
            "bx1": F.greatest(F.lit(0), truncate(F.col("x1") * sx)),
            "by1": F.greatest(F.lit(0), truncate(F.col("y1") * sy)),
            "bx2": F.least(F.col("model_w"), truncate(F.col("x2") * sx)),
            "by2": F.least(F.col("model_h"), truncate(F.col("y2") * sy)),
        }
    )
    wide, tall = F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")
    scaled = scaled.withColumns(
        {
            "mx1": truncate(F.col("bx1") + wide * 0.30),
            "mx2": truncate(F.col("bx1") + wide * 0.70),
            "my1": truncate(F.col("by1") + tall * 0.30),
            "my2": truncate(F.col("by1") + tall * 0.70),
        }
    ).withColumns(
        {
            "mx2": F.greatest(F.col("mx1") + 1, F.col("mx2")),
            "my2": F.greatest(F.col("my1") + 1, F.col("my2")),
        }
    )
    scaled = scaled.withColumns(
        {"jx2": F.greatest("bx2", "mx2"), "jy2": F.greatest("by2", "my2")}
    )
    valid = depth.filter((F.col("depth") > 0.1) & (F.col("depth") < 150.0) & is_finite(F.col("depth")))
    regions = scaled.select(*FRAME, "det_id", "bx1", "by1", "bx2", "by2", "mx1", "my1", "mx2", "my2", "jx2", "jy2")
    hits = box_pixels(regions, valid.select(*FRAME, "r", "c", "depth"), FRAME, ("bx1", "by1", "jx2", "jy2"), tile)

    def inside(x1: str, y1: str, x2: str, y2: str) -> Column:
        return (F.col("r") >= F.col(y1)) & (F.col("r") < F.col(y2)) & (F.col("c") >= F.col(x1)) & (F.col("c") < F.col(x2))

    middle, whole = inside("mx1", "my1", "mx2", "my2"), inside("bx1", "by1", "bx2", "by2")
    key = [*FRAME, "det_id"]
    # A depth in the middle decides alone; the whole box is read where there is none.
    read = hits.filter(middle | whole).select(*key, F.col("depth").cast("double").alias("depth"), middle.alias("_middle"))
    medians = group_medians(read, key, "depth", "_median", first=F.col("_middle"))
    joined = scaled.join(medians, [*FRAME, "det_id"], "left")
    return _finish(joined, F.col("_median"), tolerance).drop(
        "bx1", "by1", "bx2", "by2", "mx1", "my1", "mx2", "my2", "jx2", "jy2", "_median"
    )


def near_pixels(det: DataFrame, pixels: DataFrame, reach: int = 7, tile: int = 16) -> DataFrame:
    """Pixels of the window around each centre ``ui, vi``, with their ring.

    ``ring`` is the half size of the smallest search window (0, 1, 2, 4 or 7)
    that holds the pixel.
    """
    window = det.withColumns(
        {
            "wx1": F.col("ui") - reach,
            "wy1": F.col("vi") - reach,
            "wx2": F.col("ui") + reach + 1,
            "wy2": F.col("vi") + reach + 1,
        }
    )
    far = F.greatest(F.abs(F.col("r") - F.col("vi")), F.abs(F.col("c") - F.col("ui")))
    ring = F.when(far <= 2, far).when(far <= 4, F.lit(4)).otherwise(F.lit(7)).cast("long")
    hits = box_pixels(window, pixels, FRAME, ("wx1", "wy1", "wx2", "wy2"), tile)
    return hits.withColumn("ring", ring).drop("wx1", "wy1", "wx2", "wy2")


def lookup(
    det: DataFrame,
    points: DataFrame,
    depth: DataFrame,
    cameras: DataFrame,
    min_depth: float = 0.20,
    max_depth: float = 250.0,
    tile: int = 16,
    box: tuple[str, str, str, str] | None = None,
) -> DataFrame:
    """Hierarchical 3D lookup: point map first, then depth; smallest window that hits.

    ``box`` names columns of ``det`` with a box in image pixels (x1, y1, x2, y2); depth is then read inside it alone, both
    edges included.  A detection without a box is not clipped.
    """
    sx, sy = F.col("model_w") / F.col("img_w"), F.col("model_h") / F.col("img_h")
    centred = det.join(cameras, FRAME).withColumns({"us": F.col("u") * sx, "vs": F.col("v") * sy})
    centred = centred.withColumns({"ui": F.rint("us").cast("long"), "vi": F.rint("vs").cast("long")})
    inside = F.col("ui").between(0, F.col("model_w") - 1) & F.col("vi").between(0, F.col("model_h") - 1)
    corners = ["_bx1", "_by1", "_bx2", "_by2"]
    scaled = [(F.col(c) * k).cast("long") for c, k in zip(box, (sx, sy, sx, sy), strict=True)] if box else [F.lit(None).cast("long")] * 4
    probes = centred.filter(inside).select(*FRAME, "det_id", "ui", "vi", *[v.alias(c) for v, c in zip(scaled, corners, strict=True)])

    size = norm(F.col("px"), F.col("py"), F.col("pz"))
    sound = F.coalesce(is_finite(F.col("px"), F.col("py"), F.col("pz")) & (size > 1e-3) & (size < 500.0), F.lit(False))
    usable = F.coalesce(is_finite(F.col("depth")) & F.col("depth").between(max(min_depth, 1e-3), max_depth), F.lit(False))
    values = [F.col(c).cast("double").alias(c) for c in ("px", "py", "pz", "depth")]

    none = F.lit(None).cast("double")
    place = [*FRAME, "r", "c"]
    if points is depth:  # one row a pixel
        stock = depth.filter(sound | usable).select(*place, sound.alias("_point"), usable.alias("_deep"), *values)
    else:
        stock = points.filter(sound).select(*place, F.lit(True).alias("_point"), F.lit(False).alias("_deep"), *values[:3], none.alias("depth")).unionByName(
            depth.filter(usable).select(*place, F.lit(False).alias("_point"), F.lit(True).alias("_deep"), *[none.alias(c) for c in ("px", "py", "pz")], values[3])
        )
    clipped = F.coalesce(F.col("c").between(F.col("_bx1"), F.col("_bx2")) & F.col("r").between(F.col("_by1"), F.col("_by2")), F.lit(True))
    hits = near_pixels(probes, stock, tile=tile).withColumn("_deep", F.col("_deep") & clipped)
    # Both paths meet the windows in one join; each keeps the smallest ring that holds anything, and only that is averaged.
    key = [*FRAME, "det_id"]
    each = Window.partitionBy(*key)
    nearest_of = lambda flag: F.col(flag) & (F.col("ring") == F.min(F.when(F.col(flag), F.col("ring"))).over(each))
    kept = hits.select(*key, "ring", "px", "py", "pz", "depth", nearest_of("_point").alias("_point"), nearest_of("_deep").alias("_deep")).filter("_point OR _deep")
    axis = lambda name, value: F.struct(F.lit(name).alias("axis"), F.col(value).alias("value"))
    some = lambda flag, *axes: F.when(F.col(flag), F.array(*axes)).otherwise(F.array())
    axes = F.explode(F.concat(some("_point", axis("x", "px"), axis("y", "py"), axis("z", "pz")), some("_deep", axis("d", "depth"))))
    read = kept.select(*key, "ring", axes.alias("_a")).select(*key, F.col("_a.axis").alias("axis"), "ring", F.col("_a.value").alias("value"))
    medians = group_medians(read, [*key, "axis", "ring"], "value", "_m")
    of = lambda axis, value="_m": F.max(F.when(F.col("axis") == axis, F.col(value)))
    packed = lambda ring, **values: F.when(F.col(ring).isNotNull(), F.struct(F.col(ring).alias("ring"), *[F.col(v).alias(n) for n, v in values.items()]))
    wide = medians.groupBy(*key).agg(of("x", "ring").alias("_pr"), of("d", "ring").alias("_qr"), *[of(c).alias(f"_m{c}") for c in "xyzd"])
    nearest = wide.select(*key, packed("_pr", px="_mx", py="_my", pz="_mz").alias("_p"), packed("_qr", depth="_md").alias("_q"))
    found = centred.join(nearest, [*FRAME, "det_id"], "left")
    world = to_world(unproject(F.col("us"), F.col("vs"), F.col("_q.depth")))
    by_point, by_depth = F.col("_p").isNotNull(), F.col("_q").isNotNull()
    ring = F.coalesce(F.col("_p.ring"), F.col("_q.ring"))
    span = (ring * 2 + 1).cast("string")

    def pick(point: Column, depth_value: Column) -> Column:
        return half_even(F.when(by_point, point).when(by_depth, depth_value), 3)

    return found.withColumns(
        {
            "location_status": F.when(by_point | by_depth, F.lit("LOCALIZED_3D")).otherwise(F.lit("UNAVAILABLE")),
            "status": F.when(ring == 0, F.lit("DIRECT_HIT"))
            .when(ring > 0, F.concat(F.lit("NEIGHBORHOOD_"), span, F.lit("x"), span))
            .otherwise(F.lit("FAILED")),
            "x_m": pick(F.col("_p.px"), world[0]),
            "y_m": pick(F.col("_p.py"), world[1]),
            "z_m": pick(F.col("_p.pz"), world[2]),
            "sampled_depth_m": pick(F.col("_p.pz"), F.col("_q.depth")),
            "neighborhood_size": F.coalesce(ring * 2 + 1, F.lit(0).cast("long")),
            "source": F.when(by_point, F.lit("points")).when(by_depth, F.lit("depth")),
        }
    ).drop("_p", "_q", "us", "vs", "ui", "vi")


def fuse_positions(obs: DataFrame, outlier_m: float = 2.5) -> DataFrame:
    """Consensus position of each track over its localised observations."""
    keys = ["mission_id", "track_id"]
    needed = [*keys, "frame_idx", "location_status", "x_m", "y_m", "z_m", "reprojection_error_px", "conf"]
    tracked = cut(obs.filter(F.col("track_id").isNotNull()).select(*needed))
    placed = tracked.filter(F.col("location_status").isin("LOCALIZED_3D", "LOCALIZED_GPS") & F.col("x_m").isNotNull())
    axes = placed.select(*keys, F.explode(F.create_map(*[x for a in "xyz" for x in (F.lit(a), F.col(f"{a}_m"))])).alias("axis", "value"))
    medians = quantiles(axes, [*keys, "axis"], "value", {"mid": 0.5}).groupBy(*keys).agg(
        *[F.max(F.when(F.col("axis") == a, F.col("mid"))).alias(f"_m{a}") for a in "xyz"]
    )
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    away = norm(*[F.col(f"{a}_m") - F.col(f"_m{a}") for a in "xyz"])
    judged = placed.join(medians, keys).join(sizes, keys).withColumn("_in", (F.col("_n") < 3) | (away <= outlier_m))

    def mean(col: str, flag: Column | None) -> Column:
        return F.avg(F.when(flag, F.col(col)) if flag is not None else F.col(col))

    fused = judged.groupBy(*keys).agg(
        F.count_if(F.col("_in")).alias("_kept"),
        F.count(F.lit(1)).alias("_placed"),
        *[mean(f"{a}_m", F.col("_in")).alias(f"_i{a}") for a in "xyz"],
        *[mean(f"{a}_m", None).alias(f"_a{a}") for a in "xyz"],
        mean("reprojection_error_px", F.col("_in")).alias("_ie"),
        mean("reprojection_error_px", None).alias("_ae"),
        mean("conf", F.col("_in")).alias("_ic"),
        mean("conf", None).alias("_ac"),
    )
    everyone = tracked.groupBy(*keys).agg(
        F.sort_array(F.collect_set("frame_idx")).alias("source_frames"),
        F.count(F.lit(1)).alias("observation_count"),
    )
    some = F.col("_kept") > 0
    used = F.when(some, F.col("_kept")).otherwise(F.col("_placed"))
    conf = F.when(some, F.col("_ic")).otherwise(F.col("_ac"))
    placed_flag = F.col("_placed").isNotNull()
    return everyone.join(fused, keys, "left").select(
        *keys,
        F.when(placed_flag, F.lit("LOCALIZED_3D")).otherwise(F.lit("UNLOCALIZED")).alias("location_status"),
        *[settled(F.when(some, F.col(f"_i{a}")).otherwise(F.col(f"_a{a}")), 2).alias(f"{a}_m") for a in "xyz"],
        settled(F.when(some, F.col("_ie")).otherwise(F.col("_ae")), 2).alias("reprojection_error_px"),
        F.when(placed_flag, settled(F.least(F.lit(0.98), conf + F.least(F.lit(0.15), used * 0.03)), 3)).alias("confidence"),
        "source_frames",
        "observation_count",
    )


def reprojection_stats(obs: DataFrame, limit: float = 25.0) -> DataFrame:
    """Count, valid share and error statistics of the reprojections of a mission."""
    seen = obs.filter(F.col("reprojection_error_px").isNotNull())
    err = F.col("reprojection_error_px")
    good = err <= limit
    middle = quantiles(seen.filter(good), ["mission_id"], "reprojection_error_px", {"valid_median": 0.5})
    stats = seen.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(good).alias("valid"),
        F.count_if(~good).alias("rejected"),
        F.avg(F.when(good, err)).alias("valid_mean"),
        F.max(F.when(good, err)).alias("valid_max"),
        F.avg(err).alias("all_mean"),
    )
    zero = F.lit(0.0)
    return stats.join(middle, "mission_id", "left").select(
        "mission_id", "evaluated", "valid", "rejected",
        settled(F.coalesce("valid_mean", zero), 4).alias("valid_mean"),
        half_even(F.coalesce("valid_median", zero), 4).alias("valid_median"),
        half_even(F.coalesce("valid_max", zero), 4).alias("valid_max"),
        settled(F.col("all_mean"), 4).alias("all_mean"),
    )


def localization_gate(obs: DataFrame, quality: DataFrame) -> DataFrame:
    """Null every position of a mission whose geometry may not be trusted."""
    gated = obs.join(quality.select("mission_id", "localization_allowed"), "mission_id", "left")
    allowed = F.coalesce(F.col("localization_allowed"), F.lit(False))
    values = {c: F.when(allowed, F.col(c)) for c in ("x_m", "y_m", "z_m", "reprojection_error_px")}
    values["location_status"] = F.when(allowed, F.col("location_status")).otherwise(F.lit("UNLOCALIZED"))
    return gated.withColumns(values).drop("localization_allowed")


def measure_pairs(targets: DataFrame, cameras: DataFrame, wanted: DataFrame, speed: float = 5.0) -> DataFrame:
    """Measurements of the ``wanted`` pairs (``a``, ``b``) of named positions.

    Names come from the targets, the cameras and ``ORIGIN``; only the asked pairs
    are joined, never all of them.
    """
    places = targets.unionByName(cameras)

    def placed(rows: DataFrame, side: str) -> DataFrame:
        """The origin is a constant, so the many pairs that ask for it never meet in one task."""
        known = places.select(F.col("id").alias(side), *[F.col(c).alias(side + c) for c in "xyz"])
        fixed = rows.filter(F.col(side) == "ORIGIN").withColumns({side + c: F.lit(0.0) for c in "xyz"})
        return rows.filter(F.col(side) != "ORIGIN").join(known, side).unionByName(fixed)

    joined = placed(placed(wanted, "a"), "b")
    a, b = [F.col("a" + c) for c in "xyz"], [F.col("b" + c) for c in "xyz"]
    return joined.select("a", "b", *[value.alias(name) for name, value in measure(a, b, speed).items()])
