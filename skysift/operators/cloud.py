"""Point clouds: filters, thinning, outliers, clusters, metrics, scene quality.

``points`` has ``scene_id, point_id, x, y, z`` plus colours and confidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.config import CloudRules
from skysift.functions.camera import camera_centre
from skysift.functions.numeric import clip, half_even, is_finite, norm, settled
from skysift.lineage import cut, fan_out, is_empty
from skysift.operators.neighbours import nearest_means
from skysift.operators.ordering import BLOCK, numbered, previous, quantiles
from skysift.operators.spatial import cells, components, near_weights, radius_pairs, ring

XYZ = ["x", "y", "z"]
COLOURS = ["red", "grn", "blu"]


# ------------------------------------------------------------- simple filters


def valid_points(points: DataFrame, conf: float = 1.1) -> DataFrame:
    size = norm(*[F.col(c) for c in XYZ])
    return points.filter(
        is_finite(*[F.col(c) for c in XYZ]) & (F.col("conf") >= conf) & (size > 1e-4) & (size < 500.0)
    )


def confidence_gate_points(points: DataFrame, conf: float = 0.5, floor: int = 100) -> DataFrame:
    """Drop weak points, unless a scene would keep no more than ``floor``."""
    strong = F.col("conf") >= conf
    kept = points.groupBy("scene_id").agg(F.count_if(strong).alias("_kept"))
    return points.join(kept, "scene_id").filter(strong | (F.col("_kept") <= floor)).drop("_kept")


def cap_points(points: DataFrame, n: int, seed: int = 7, key: str = "point_id") -> DataFrame:
    """``n`` points of each scene without replacement, the same for a given seed.

    Points are ranked by the MD5 of scene, point and seed; the hash range is cut
    into blocks, so no task sorts a whole scene.
    """
    hashed = points.withColumn("_hash", F.md5(F.concat_ws(":", "scene_id", key, F.lit(seed))))
    block = F.conv(F.substring("_hash", 1, 3), 16, 10).cast("long")
    ranked = numbered(hashed, ["scene_id"], block, [F.col("_hash"), F.col(key)], "_rank")
    return ranked.filter(F.col("_rank") <= n).drop("_rank", "_hash")


# ------------------------------------------------------------------ thinning


def effective_sizes(points: DataFrame, rules: CloudRules = CloudRules()) -> DataFrame:
    """Voxel size and outlier radius of each scene from its smallest extent."""
    low = {c: F.min(c).alias(f"min_{c}") for c in XYZ}
    high = {c: F.max(c).alias(f"max_{c}") for c in XYZ}
    bounds = points.groupBy("scene_id").agg(*low.values(), *high.values())
    thin = F.least(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ])
    sized = bounds.withColumn("extent", thin).withColumn(
        "voxel", F.when(F.col("extent") < 1.5, clip(F.col("extent") / 80.0, 0.0035, rules.voxel)).otherwise(F.lit(rules.voxel))
    )
    radius = F.when(F.col("extent") >= 1.5, F.lit(rules.ror_radius)).otherwise(
        clip(F.col("voxel") * 5.0, 0.02, rules.ror_radius)
    )
    return sized.withColumn("radius", radius)


def voxel_downsample(points: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Mean position and colour per voxel; the smallest point id names the voxel."""
    sizes = effective_sizes(points) if sizes is None else sizes
    placed = points.join(sizes.select("scene_id", "voxel", *[f"min_{c}" for c in XYZ]), "scene_id")
    index = {
        f"_i{c}": F.floor((F.col(c) - (F.col(f"min_{c}") - F.col("voxel") / 2.0)) / F.col("voxel")) for c in XYZ
    }
    carried = [c for c in [*XYZ, *COLOURS] if c in points.columns]
    return (
        placed.withColumns(index)
        .groupBy("scene_id", *index)
        .agg(F.min("point_id").alias("point_id"), *[F.avg(c).alias(c) for c in carried])
        .drop(*index)
    )


# ------------------------------------------------------------------ outliers


def neighbour_counts(points: DataFrame, radius: Column, enough: int) -> DataFrame:
    """Neighbours within ``radius`` (the point itself included), per distinct position; exact below ``enough``.

    ``radius`` is one value per scene; one point id stands for all copies.

    Copies count by weight.  A position whose small cell already holds ``enough``
    points gets that count at once; the others meet the boxes of the cells around them, and single positions
    only where a box is cut by the radius.
    """
    weighted = points.withColumn("_radius", radius).groupBy("scene_id", *XYZ).agg(
        F.min("point_id").alias("point_id"), F.count(F.lit(1)).alias("_w"), F.max("_radius").alias("_radius")
    )
    sized = cut(fan_out(weighted, "scene_id", "point_id").withColumn("_size", F.col("_radius") / 1.7321))
    fine = cells(sized, F.col("_size"), XYZ, ["_fx", "_fy", "_fz"])
    crowd = fine.groupBy("scene_id", "_fx", "_fy", "_fz").agg(F.sum("_w").alias("_crowd"))
    fine = cut(fine.join(crowd, ["scene_id", "_fx", "_fy", "_fz"]))
    lonely = fine.filter(F.col("_crowd") < enough)
    columns = [*XYZ, F.col("_w").alias("w"), F.col("_size").alias("size"), F.col("_radius").alias("reach")]
    found = near_weights(
        lonely.select("scene_id", F.col("point_id").alias("id"), *columns),
        fine.select("scene_id", F.xxhash64("_fx", "_fy", "_fz").alias("id"), *columns), ["scene_id", "a"], enough,
    ).select("scene_id", F.col("a").alias("point_id"), F.col("w").alias("neighbours"))
    counted = lonely.join(found, ["scene_id", "point_id"]).select("scene_id", "point_id", *XYZ, "neighbours")
    crowded = fine.filter(F.col("_crowd") >= enough).select(
        "scene_id", "point_id", *XYZ, F.col("_crowd").alias("neighbours")
    )
    return counted.unionByName(crowded)


def radius_outliers(points: DataFrame, sizes: DataFrame, min_neighbours: int = 10) -> DataFrame:
    """Keep points with more than ``min_neighbours`` points around them."""
    sized = points.join(sizes.select("scene_id", "radius"), "scene_id")
    counts = neighbour_counts(sized, F.col("radius"), min_neighbours + 1)
    kept = counts.filter(F.col("neighbours") > min_neighbours).select("scene_id", *XYZ)
    return points.join(kept, ["scene_id", *XYZ], "left_semi")


def knn_distance(points: DataFrame, k: int = 20, cell: Column | float = 0.1) -> DataFrame:
    """Mean distance to the ``k`` nearest points (the point itself included); all points of a scene that has fewer.

    Exact; ``cell`` (one value per scene) decides the work alone, see ``neighbours.nearest_means``.
    """
    cell = cell if isinstance(cell, Column) else F.lit(float(cell))
    base = cut(fan_out(points.withColumn("_cell", cell.cast("double")).select("scene_id", "point_id", *XYZ, "_cell"), "scene_id", "point_id"))
    places = base.groupBy("scene_id", *XYZ).agg(F.count(F.lit(1)).alias("w"), F.max("_cell").alias("size"))
    return base.join(nearest_means(places, k), ["scene_id", *XYZ]).select("scene_id", "point_id", "mean_distance")


def statistical_outliers(
    points: DataFrame, k: int = 20, ratio: float = 2.0, cell: Column | float = 0.1
) -> DataFrame:
    """Keep points whose mean neighbour distance is not far above the scene's."""
    distances = cut(knn_distance(points, k, cell))
    some = F.col("mean_distance") > 0
    limits = distances.groupBy("scene_id").agg(
        F.avg(F.when(some, F.col("mean_distance"))).alias("_mean"),
        F.stddev_samp(F.when(some, F.col("mean_distance"))).alias("_std"),
    )
    kept = distances.join(limits, "scene_id").filter(
        some & (F.col("mean_distance") < F.col("_mean") + ratio * F.coalesce("_std", F.lit(0.0)))
    )
    return points.join(kept.select("scene_id", "point_id"), ["scene_id", "point_id"], "left_semi")


# ------------------------------------------------------------------ clusters


def dbscan(points: DataFrame, eps: Column, min_points: int = 10) -> DataFrame:
    """Density clusters: the smallest core point id names a cluster, noise is null.

    Core points of one small cell always belong together, so clusters are
    components of cells, not of points; a border point joins the smallest
    cluster it touches.
    """
    sized = cut(fan_out(points.withColumn("_eps", eps).select("scene_id", "point_id", *XYZ, "_eps"), "scene_id", "point_id"))
    counts = neighbour_counts(sized.select("scene_id", "point_id", *XYZ, "_eps"), F.col("_eps"), min_points)
    flagged = cut(
        sized.join(counts.filter(F.col("neighbours") >= min_points).select("scene_id", *XYZ, F.lit(True).alias("_core")),
                   ["scene_id", *XYZ], "left")
    )
    fine = ["_fx", "_fy", "_fz"]
    core = cells(flagged.filter("_core"), F.col("_eps") / 1.7321, XYZ, fine)
    named = core.groupBy("scene_id", *fine).agg(F.min("point_id").alias("_cell"))
    core = cut(core.join(named, ["scene_id", *fine]).drop(*fine))
    core_at = core.groupBy("scene_id", *XYZ, "_cell", "_eps").agg(F.min("point_id").alias("point_id"))

    def positions(rows: DataFrame, name: str) -> DataFrame:
        reach = F.col("_eps").alias("reach")
        return rows.select("scene_id", F.col(name).alias("id"), *XYZ, F.lit(1).cast("long").alias("w"), (F.col("_eps") / 1.7321).alias("size"), reach)

    homes = cut(positions(core_at, "_cell"))
    pair = ["scene_id", "a", "b"]
    edges = near_weights(homes, homes, pair, 1, once=True).select(*pair)
    vertices = core.select("scene_id", F.col("_cell").alias("v")).distinct()
    # A cell is named by its smallest point, so the smallest cell names the cluster.
    cell_cluster = cut(components(vertices, edges, ["scene_id"])).select(
        "scene_id", F.col("v").alias("_cell"), F.col("label").alias("cluster")
    )
    core_rows = core.join(cell_cluster, ["scene_id", "_cell"]).select("scene_id", "point_id", "cluster")
    border = (
        near_weights(positions(flagged.filter(F.col("_core").isNull()), "point_id"), homes, pair, 1)
        .join(cell_cluster.withColumnRenamed("_cell", "b"), ["scene_id", "b"])
        .groupBy("scene_id", F.col("a").alias("point_id"))
        .agg(F.min("cluster").alias("cluster"))
    )
    found = core_rows.unionByName(border)
    return points.join(found, ["scene_id", "point_id"], "left")


def keep_clusters(points: DataFrame, valid: DataFrame) -> DataFrame:
    return points.join(valid, ["scene_id", "cluster"], "left_semi")


def cluster_filter(clustered: DataFrame, min_points: int = 50, min_share: float = 0.02, floor: int = 100) -> DataFrame:
    """Drop small clusters and noise, unless a scene would keep too little."""
    clustered = cut(clustered)
    sizes = clustered.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = clustered.filter(F.col("cluster").isNotNull()).groupBy("scene_id", "cluster").agg(F.count(F.lit(1)).alias("_c"))
    large = counts.join(sizes, "scene_id").filter((F.col("_c") >= min_points) | (F.col("_c") >= F.col("_n") * min_share))
    kept = large.groupBy("scene_id").agg(F.sum("_c").alias("_kept"))
    rich = kept.join(sizes, "scene_id").filter((F.col("_kept") > floor) & (F.col("_n") > floor)).select("scene_id")
    chosen = keep_clusters(clustered, large.join(rich, "scene_id", "left_semi").select("scene_id", "cluster"))
    untouched = clustered.join(rich, "scene_id", "left_anti")
    return chosen.unionByName(untouched)


def _beyond(points: DataFrame, least: int, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a stage to scenes of more than ``least`` points; smaller ones pass as they are."""
    rich = points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select("scene_id")
    done = stage(points.join(rich, "scene_id", "left_semi"))
    return done.unionByName(points.join(rich, "scene_id", "left_anti").select(*done.columns))


def filter_cloud(points: DataFrame, rules: CloudRules = CloudRules()) -> dict[str, DataFrame]:
    """All filter stages in order; each stage feeds the next."""
    gated = cut(confidence_gate_points(points, rules.conf))
    sizes = cut(effective_sizes(gated, rules))
    thin = cut(voxel_downsample(gated, sizes))
    with_cell = thin.join(sizes.select("scene_id", "voxel"), "scene_id")
    steady = cut(_beyond(with_cell, rules.sor_k, lambda p: statistical_outliers(p, rules.sor_k, rules.sor_ratio, F.col("voxel") * 5.0)))
    dense = cut(_beyond(steady, rules.ror_points, lambda p: radius_outliers(p, sizes, rules.ror_points)))
    clustered = dbscan(dense, F.col("voxel") * 5.0, rules.cluster_min)
    final = cut(cluster_filter(clustered))
    return {"raw": points, "after_confidence": gated, "after_voxel": thin, "after_sor": steady, "after_ror": dense, "after_dbscan": final}


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Points of each scene after every stage, and the share removed at the end."""
    tagged = None
    for name, rows in stages.items():
        part = rows.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    names = list(stages)
    wide = tagged.groupBy("scene_id").agg(
        *[F.coalesce(F.max(F.when(F.col("stage") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]
    )
    first, last = F.col(names[0]), F.col(names[-1])
    return wide.withColumns(
        {"removed_points": first - last, "reduction_pct": half_even((first - last) / first * 100.0, 2)}
    )


# ------------------------------------------------------------------- metrics


def cloud_stats(points: DataFrame, key: str = "scene_id") -> DataFrame:
    """Variances and extents of each cloud and why it may be unusable."""
    finite = is_finite(*[F.col(c) for c in XYZ])
    stats = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("point_count"),
        F.count_if(~finite).alias("_bad"),
        *[F.var_pop(c).alias(f"var_{c}") for c in XYZ],
        *[(F.max(c) - F.min(c)).alias(f"extent_{c}") for c in XYZ],
    )
    collapsed = F.least(*[F.col(f"var_{c}") for c in XYZ]) < 1e-5
    small = (F.col("extent_x") < 0.05) & (F.col("extent_y") < 0.05)
    issue = (
        F.when(F.col("point_count") < 50, F.lit("INSUFFICIENT"))
        .when(F.col("_bad") > 0, F.lit("NON_FINITE"))
        .when(collapsed, F.lit("DEGENERATE"))
        .when(small, F.lit("TOO_SMALL"))
    )
    return stats.withColumns({"issue": issue, "is_valid": issue.isNull()}).drop("_bad")


def cloud_metrics(points: DataFrame, keys: list[str]) -> DataFrame:
    """Extent, volume, density and confidence of each cloud."""
    middle = quantiles(points, keys, "conf", {"median_confidence": 0.5})
    sums = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("point_count"),
        *[(F.max(c) - F.min(c)).alias(f"extent_{c}") for c in XYZ],
        F.avg("conf").alias("mean_confidence"),
        F.stddev_pop("conf").alias("std_confidence"),
    )
    volume = F.greatest("extent_x", F.lit(1e-3)) * F.greatest("extent_y", F.lit(1e-3)) * F.greatest("extent_z", F.lit(1e-3))
    return sums.join(middle, keys).select(
        *keys, "point_count",
        *[half_even(F.col(f"extent_{c}"), 3).alias(f"extent_{c}") for c in XYZ],
        half_even(volume, 3).alias("volume"),
        half_even(F.col("point_count") / volume, 2).alias("density"),
        settled(F.col("mean_confidence"), 4).alias("mean_confidence"),
        settled(F.col("median_confidence"), 4).alias("median_confidence"),
        settled(F.col("std_confidence"), 4).alias("std_confidence"),
    )


def coherence(points: DataFrame, target: int = 500, key: str = "scene_id") -> DataFrame:
    """Every n-th point of a scene: reach of 95 % from the centre, and spread.

    The sample holds fewer than ``2 * target`` points of a scene.
    """
    sample, extents = sampled(points, target, key)
    centre = sample.groupBy(key).agg(*[F.avg(c).alias(f"_c{c}") for c in XYZ])
    away = norm(*[F.col(c) - F.col(f"_c{c}") for c in XYZ])
    reach = sample.join(centre, key).groupBy(key).agg(F.percentile(away, F.lit(0.95)).alias("r95"))
    total = F.col("extent_x") + F.col("extent_y") + F.col("extent_z")
    score = clip(1.0 - F.col("r95") / F.greatest(F.lit(1.0), total), 0.1, 1.0)
    return reach.join(extents, key).select(key, "r95", score.alias("coherence"))


def sampled(points: DataFrame, target: int = 500, key: str = "scene_id", blocks: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Every n-th point in id order, and the extents of each scene.

    The id range of a scene is cut into equal blocks, so its ids are never sorted
    in one task.
    """
    extents = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("point_id").alias("_lo"), F.max("point_id").alias("_hi"),
        *[(F.max(c) - F.min(c)).alias(f"extent_{c}") for c in XYZ],
    )
    ranged = points.select(key, "point_id", *XYZ).join(extents.select(key, "_n", "_lo", "_hi"), key)
    block = F.floor((F.col("point_id") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * blocks)
    placed = numbered(ranged, [key], block, [F.col("point_id")], "_p", start=0)
    step = F.when(F.col("_n") > target, F.greatest(F.lit(1), F.floor(F.col("_n") / target))).otherwise(F.lit(1))
    return placed.filter(F.col("_p") % step == 0).drop("_p", "_n", "_lo", "_hi"), extents.drop("_lo", "_hi")


def eigen_spread(points: DataFrame, key: str = "scene_id") -> DataFrame:
    """Smallest over largest eigenvalue of the covariance, in closed form."""
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    cov = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.covar_samp(a, b).alias(f"_{a}{b}") for a, b in pairs]
    )
    q = (F.col("_xx") + F.col("_yy") + F.col("_zz")) / 3.0
    df = cov.withColumn("_q", q)
    for c in XYZ:
        df = df.withColumn(f"_d{c}", F.col(f"_{c}{c}") - F.col("_q"))
    off = F.col("_xy") * F.col("_xy") + F.col("_xz") * F.col("_xz") + F.col("_yz") * F.col("_yz")
    p2 = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + F.col("_dz") * F.col("_dz") + 2.0 * off
    df = df.withColumn("_p", F.sqrt(p2 / 6.0))
    det = (
        F.col("_dx") * (F.col("_dy") * F.col("_dz") - F.col("_yz") * F.col("_yz"))
        - F.col("_xy") * (F.col("_xy") * F.col("_dz") - F.col("_yz") * F.col("_xz"))
        + F.col("_xz") * (F.col("_xy") * F.col("_yz") - F.col("_dy") * F.col("_xz"))
    )
    cosine = F.when(F.col("_p") > 0, clip(det / (2.0 * F.pow("_p", F.lit(3.0))), -1.0, 1.0)).otherwise(F.lit(1.0))
    angle = F.acos(cosine) / 3.0
    third = 2.0 * F.pi() / 3.0
    largest = F.col("_q") + 2.0 * F.col("_p") * F.cos(angle)
    smallest = F.col("_q") + 2.0 * F.col("_p") * F.cos(angle + third)
    tiny = F.lit(1e-6)
    spread = F.when(F.col("_n") > 3, F.greatest(tiny, smallest) / F.greatest(tiny, largest)).otherwise(F.lit(1.0))
    return df.select(key, spread.alias("spread"))


# ----------------------------------------------------------------- trajectory


def motion(cameras: DataFrame, key: str = "mission_id") -> DataFrame:
    """Step and change of step of the camera centre, per frame."""
    order = F.floor(F.col("frame_idx") / BLOCK)
    centred = camera_centre(cameras).select(key, "frame_idx", "px", "py", "pz")
    first = previous(centred, [key], ["frame_idx"], {c: f"_{c}" for c in ("px", "py", "pz")}, order)
    steps = first.withColumns({f"v{a}": F.col(f"p{a}") - F.col(f"_p{a}") for a in XYZ}).drop("_px", "_py", "_pz")
    second = previous(steps, [key], ["frame_idx"], {f"v{a}": f"_v{a}" for a in XYZ}, order)
    change = norm(*[F.col(f"v{a}") - F.col(f"_v{a}") for a in XYZ])
    return second.withColumns({"speed": norm(*[F.col(f"v{a}") for a in XYZ]), "acceleration": change}).drop(
        "_vx", "_vy", "_vz"
    )


def trajectory(cameras: DataFrame, key: str = "mission_id") -> DataFrame:
    """Mean speed, mean acceleration and length of each camera path."""
    stats = motion(cameras, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("cameras"), F.avg("speed").alias("_s"), F.avg("acceleration").alias("_a"), F.sum("speed").alias("_l")
    )
    enough = F.col("cameras") >= 3
    return stats.select(
        key, "cameras",
        F.when(enough, settled(F.col("_s"), 4)).otherwise(F.lit(0.0)).alias("mean_velocity"),
        F.when(enough, settled(F.col("_a"), 4)).otherwise(F.lit(0.0)).alias("mean_acceleration"),
        F.when(enough, settled(F.col("_l"), 4)).alias("path_length"),
    )


def baseline(cameras: DataFrame, key: str = "mission_id") -> DataFrame:
    """Extent of the camera path and whether it really moves."""
    moved = motion(cameras, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("cameras"),
        norm(*[F.max(f"p{a}") - F.min(f"p{a}") for a in XYZ]).alias("_b"),
        F.avg("speed").alias("_step"),
        F.coalesce(F.bool_and(is_finite(F.col("speed")) | F.col("vx").isNull()), F.lit(True)).alias("_finite"),
    )
    many = F.col("cameras") > 1
    return moved.select(
        key, "cameras",
        F.when(many, F.col("_b")).otherwise(F.lit(0.05)).alias("camera_baseline"),
        F.col("_step").alias("mean_step"),
        F.when(many, (F.col("_b") >= 0.01) & F.col("_finite") & (F.col("_step") > 1e-4)).otherwise(F.lit(True)).alias("trajectory_valid"),
    )


def interpolate_path(cameras: DataFrame, n: int = 40, key: str = "mission_id") -> DataFrame:
    """``n`` positions between consecutive cameras, the second end left out."""
    centred = camera_centre(cameras).select(key, "frame_idx", "px", "py", "pz")
    pairs = previous(
        centred, [key], ["frame_idx"],
        {"px": "ax", "py": "ay", "pz": "az", "frame_idx": "from_frame"}, F.floor(F.col("frame_idx") / BLOCK),
    ).filter(F.col("from_frame").isNotNull())
    spread = pairs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = F.col("step") / float(n)
    return spread.select(
        key, "from_frame", "step", *[((1.0 - t) * F.col(f"a{a}") + t * F.col(f"p{a}")).alias(a) for a in XYZ]
    )


# --------------------------------------------------------------- scene scores


def _first_camera(cameras: DataFrame, key: str) -> DataFrame:
    from skysift.functions.camera import valid_extrinsics, valid_intrinsics

    judged = cameras.withColumns({"_ki": valid_intrinsics(), "_ke": valid_extrinsics()})
    return judged.groupBy(key).agg(F.min_by(F.col("_ki") & F.col("_ke"), "frame_idx").alias("camera_ok"))


def geometry_score(points: DataFrame, cameras: DataFrame, depth_valid: DataFrame, key: str = "scene_id") -> DataFrame:
    """Four-part geometry score; motion is the extent of the raw translations.

    ``depth_valid`` has one row per depth map: ``key, valid_ratio``.
    """
    stats = cloud_stats(points, key)
    moved = cameras.groupBy(key).agg(norm(*[F.max(c) - F.min(c) for c in ("t0", "t1", "t2")]).alias("_b"))
    ratio = depth_valid.groupBy(key).agg(F.avg("valid_ratio").alias("_v"))
    df = stats.join(moved, key).join(ratio, key, "left").join(_first_camera(cameras, key), key)
    valid = F.coalesce("_v", F.lit(0.0))
    reach = norm(*[F.col(f"extent_{c}") for c in XYZ])
    score = settled(
        F.least(F.lit(30.0), F.col("_b") / 0.5 * 30.0)
        + F.least(F.lit(30.0), F.col("point_count") / 10000.0 * 30.0)
        + F.least(F.lit(20.0), valid / 0.8 * 20.0)
        + F.least(F.lit(20.0), reach / 5.0 * 20.0), 1,
    )
    df = df.withColumns({"_ok": F.col("is_valid") & F.col("camera_ok"), "_score": score})
    status = (
        F.when(~F.col("_ok"), F.lit("INVALID"))
        .when((F.col("_score") >= 70.0) & (F.col("_b") >= 0.1), F.lit("GOOD"))
        .when((F.col("_score") >= 40.0) & (F.col("_b") >= 0.02), F.lit("ACCEPTABLE"))
        .when(F.col("_score") >= 20.0, F.lit("POOR"))
        .otherwise(F.lit("INVALID"))
    )
    return df.withColumn("geometry_status", status).select(
        key, "geometry_status", "point_count",
        F.when(F.col("_ok"), F.col("_score")).otherwise(F.lit(0.0)).alias("geometry_quality_score"),
        half_even(F.col("_b"), 3).alias("camera_baseline_m"),
        settled(valid, 3).alias("mean_depth_valid_ratio"),
        F.col("geometry_status").isin("GOOD", "ACCEPTABLE").alias("localization_allowed"),
    )


def _ramp(value: Column, *parts: tuple[float, float, float, float], last: Column) -> Column:
    """Piecewise-linear score: each part is (from, base, width, gain)."""
    out = None
    for start, base, width, gain in parts:
        piece = F.lit(base) if gain == 0 else base + (value - start) / width * gain
        out = F.when(value >= start, piece) if out is None else out.when(value >= start, piece)
    return out.otherwise(last)


def scene_quality(
    points: DataFrame,
    cameras: DataFrame,
    depth_valid: DataFrame,
    reprojection: DataFrame | None = None,
    key: str = "scene_id",
) -> DataFrame:
    """Ten-metric reconstruction score with its gates.

    ``reprojection`` has ``key, reprojection_error_px`` of points in front of
    their camera; without any the error counts as 2.5 px.
    """
    points = cut(points.select(key, "point_id", *XYZ))
    stats = cloud_stats(points, key)
    sample, _ = sampled(points, 500, key)
    parts = (
        stats.join(_first_camera(cameras, key), key)
        .join(baseline(cameras, key).select(key, "camera_baseline", "trajectory_valid"), key)
        .join(depth_valid.groupBy(key).agg(F.avg("valid_ratio").alias("_v")), key, "left")
        .join(coherence(points, 500, key).select(key, "coherence"), key, "left")
        .join(eigen_spread(cut(sample), key), key, "left")
    )
    if reprojection is None:
        parts = parts.withColumn("_err", F.lit(2.5))
    else:
        errors = reprojection.groupBy(key).agg(F.avg("reprojection_error_px").alias("_e"))
        parts = parts.join(errors, key, "left").withColumn("_err", F.coalesce("_e", F.lit(2.5))).drop("_e")
    parts = cut(parts.withColumn("_v", F.coalesce("_v", F.lit(0.8))))
    n, base, valid, err, spread = (F.col(c) for c in ("point_count", "camera_baseline", "_v", "_err", "spread"))
    extents = F.array_sort(F.array(*[F.col(f"extent_{c}") for c in XYZ]))
    degenerate = (extents[2] < 0.05) | ((extents[1] < 0.005) & (extents[2] > 1.0)) | (spread < 1e-5)
    density = _ramp(n, (50000, 25.0, 1, 0), (10000, 15.0, 40000.0, 10.0), (4000, 8.0, 6000.0, 7.0), last=n / 4000.0 * 8.0)
    moving = _ramp(base, (0.30, 25.0, 1, 0), (0.10, 18.0, 0.20, 7.0), (0.02, 8.0, 0.08, 10.0), last=base / 0.02 * 6.0)
    depth = _ramp(valid, (0.80, 20.0, 1, 0), (0.60, 10.0, 0.20, 10.0), last=valid / 0.60 * 10.0)
    spatial = F.when(degenerate, F.lit(0.0)).otherwise(
        F.least(F.lit(5.0), spread * 50.0) + F.least(F.lit(10.0), extents[2] / 5.0 * 10.0)
    )
    reproj = (
        F.when(err <= 3.0, F.lit(15.0))
        .when(err <= 6.0, 8.0 + (6.0 - err) / 3.0 * 7.0)
        .when(err <= 12.0, 4.0 + (12.0 - err) / 6.0 * 4.0)
        .otherwise(F.lit(1.0))
    )
    scored = parts.withColumns(
        {"_bad": degenerate, "_score": settled(density + moving + depth + spatial + reproj, 1), "_ok": F.col("is_valid") & F.col("camera_ok")}
    )
    weak = (n < 5000) | (base < 0.02) | (valid < 0.50) | (F.col("_score") < 40.0)
    code = (
        F.when(~F.col("_ok") | F.col("_bad") | (n < 800), F.lit(1))
        .when(weak, F.lit(2))
        .when((F.col("_score") >= 70.0) & (base >= 0.08), F.lit(4))
        .otherwise(F.lit(3))
    )
    scored = scored.withColumn("_code", code)
    # Status names of the four gates.
    full = F.array(*[F.lit(f"RECONSTRUCTION_{s}") for s in ("FAILED", "WEAK", "VALID", "GOOD")])
    short = F.array(*[F.lit(s) for s in ("INVALID", "POOR", "ACCEPTABLE", "GOOD")])
    return scored.select(
        key, "point_count",
        F.element_at(full, F.col("_code")).alias("reconstruction_status"),
        F.element_at(short, F.col("_code")).alias("geometry_status"),
        F.when(F.col("_ok"), F.col("_score")).otherwise(F.lit(0.0)).alias("geometry_quality_score"),
        (F.col("_code") >= 3).alias("localization_allowed"),
        settled(base, 3).alias("camera_baseline_m"),
        "trajectory_valid",
        settled(valid, 3).alias("valid_depth_ratio"),
        settled(F.col("coherence"), 3).alias("coherence"),
        settled(spread, 4).alias("geometric_spread"),
    )


def compare(points: DataFrame, cameras: DataFrame | None = None) -> DataFrame:
    """Baseline against refined cloud of each scene: counts and confidence."""
    each = cloud_metrics(points, ["scene_id", "variant"])
    value = lambda name, variant: F.max(F.when(F.col("variant") == variant, F.col(name)))
    wide = each.groupBy("scene_id").agg(
        *[value(n, v).alias(f"{v}_{n}") for v in ("baseline", "refined") for n in ("point_count", "mean_confidence", "density")]
    )
    zero = F.lit(0)
    return wide.withColumns(
        {
            "point_count_diff": F.coalesce("refined_point_count", zero) - F.coalesce("baseline_point_count", zero),
            "confidence_gain": half_even(
                F.coalesce("refined_mean_confidence", F.lit(0.0)) - F.coalesce("baseline_mean_confidence", F.lit(0.0)), 4
            ),
        }
    )


def diagnostic_score(points: DataFrame, cameras: DataFrame, errors: DataFrame, key: str = "scene_id") -> DataFrame:
    """Geometric validity and visual structure, each of 100, and the verdict."""
    centred = camera_centre(cameras)
    ends = centred.groupBy(key).agg(
        F.min_by(F.struct("px", "py", "pz"), "frame_idx").alias("_a"), F.max_by(F.struct("px", "py", "pz"), "frame_idx").alias("_b")
    )
    span = norm(*[F.col(f"_a.p{a}") - F.col(f"_b.p{a}") for a in XYZ])
    size = points.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.var_pop("z").alias("_vz"))
    miss = errors.groupBy(key).agg(F.avg("reprojection_error_px").alias("_err"))
    df = size.join(ends, key).join(miss, key, "left").withColumn("_err", F.coalesce("_err", F.lit(0.0)))
    geometry = F.least(F.lit(100.0), span / 2.0 * 50.0 + F.least(F.lit(50.0), F.col("_n") / 500.0))
    visual = F.least(
        F.lit(100.0),
        F.greatest(F.lit(0.0), 100.0 - F.col("_err") * 2.0) * 0.6 + F.least(F.lit(40.0), F.col("_vz") * 500.0),
    )
    scored = df.select(key, settled(geometry, 4).alias("geometric_score"), settled(visual, 4).alias("visual_score"))
    good = (F.col("geometric_score") > 70) & (F.col("visual_score") > 60)
    return scored.withColumn(
        "status", F.when(good, F.lit("GOOD")).when(F.col("geometric_score") > 40, F.lit("POOR")).otherwise(F.lit("INVALID"))
    )


# ---------------------------------------------------------------- composition


def compose_scene(base: DataFrame, flood: DataFrame, targets: DataFrame, path: DataFrame) -> DataFrame:
    """One cloud of all layers, each with its colour.

    ``targets`` are rescue targets that passed the gate, with ``class_name`` and
    ``rescue_priority``.  Fixed values: the layer and marker colours.
    """
    names = ["scene_id", "layer", *XYZ, *COLOURS]

    def painted(rows: DataFrame, layer: str, red: Column, grn: Column, blu: Column) -> DataFrame:
        return rows.withColumns({"layer": F.lit(layer), "red": red, "grn": grn, "blu": blu}).select(*names)

    person = F.col("class_name").rlike("person|victim")
    vehicle = F.col("class_name").rlike("vehicle|car|truck|boat")
    high, medium = F.col("rescue_priority") == "HIGH", F.col("rescue_priority") == "MEDIUM"

    def marker(a: float, b: float, c: float, d: float, e: float) -> Column:
        return (
            F.when(person & high, F.lit(a)).when(person & medium, F.lit(b)).when(person, F.lit(c)).when(vehicle, F.lit(d)).otherwise(F.lit(e))
        )

    placed = targets.filter(is_finite(*[F.col(c) for c in XYZ]))
    return (
        base.withColumn("layer", F.lit("environment")).select(*names)
        .unionByName(painted(flood, "flood", F.lit(0.05), F.lit(0.65), F.lit(0.85)))
        .unionByName(painted(placed, "target", marker(1.0, 1.0, 0.1, 0.1, 0.9), marker(0.1, 0.65, 0.95, 0.4, 0.9), marker(0.1, 0.0, 0.2, 1.0, 0.1)))
        .unionByName(painted(path, "path", F.lit(0.0), F.lit(0.9), F.lit(1.0)))
    )
