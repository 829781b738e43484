"""Camera mathematics as column expressions.

A pose is world-to-camera and lies in flat columns ``r00 .. r22`` (rotation,
row-major) and ``t0, t1, t2``; intrinsics are ``fx, fy, cx, cy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.numeric import half_even, is_finite, norm

ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]
SHIFT = ["t0", "t1", "t2"]


def unpack_pose(df: DataFrame, column: str = "ext") -> DataFrame:
    """Split a 3x4 row-major ``ext`` array into flat pose columns."""
    flat = {}
    for i in range(3):
        for j in range(3):
            flat[f"r{i}{j}"] = F.col(column)[4 * i + j]
        flat[f"t{i}"] = F.col(column)[4 * i + 3]
    return df.withColumns(flat)


def rescale(u: Column, v: Column, src_w, src_h, dst_w, dst_h) -> tuple[Column, Column]:
    """Pixel position between two resolutions."""
    return u * (dst_w / src_w), v * (dst_h / src_h)


def scale_intrinsics(df: DataFrame) -> DataFrame:
    sx = F.col("img_w") / F.col("model_w")
    sy = F.col("img_h") / F.col("model_h")
    return df.withColumns(
        {
            "fx_img": F.col("fx") * sx,
            "fy_img": F.col("fy") * sy,
            "cx_img": F.col("cx") * sx,
            "cy_img": F.col("cy") * sy,
        }
    )


def unproject(u: Column, v: Column, depth: Column) -> list[Column]:
    """Pixel and depth to camera coordinates."""
    return [
        (u - F.col("cx")) * depth / F.col("fx"),
        (v - F.col("cy")) * depth / F.col("fy"),
        depth,
    ]


def to_world(p: list[Column]) -> list[Column]:
    """Camera coordinates to world: the transposed rotation of ``p - t``."""
    d = [p[k] - F.col(f"t{k}") for k in range(3)]
    return [
        F.col(f"r0{j}") * d[0] + F.col(f"r1{j}") * d[1] + F.col(f"r2{j}") * d[2] for j in range(3)
    ]


def to_camera(p: list[Column]) -> list[Column]:
    return [
        F.col(f"r{i}0") * p[0] + F.col(f"r{i}1") * p[1] + F.col(f"r{i}2") * p[2] + F.col(f"t{i}")
        for i in range(3)
    ]


def to_pixel(p: list[Column]) -> list[Column]:
    """World to pixel and camera depth; behind the camera gives (-1, -1, z)."""
    xc, yc, zc = to_camera(p)
    behind = zc <= 0.001
    safe = F.when(~behind, zc)
    return [
        F.when(behind, F.lit(-1.0)).otherwise(F.col("fx") * xc / safe + F.col("cx")),
        F.when(behind, F.lit(-1.0)).otherwise(F.col("fy") * yc / safe + F.col("cy")),
        zc,
    ]


def camera_centre(df: DataFrame) -> DataFrame:
    """Centre and unit look direction of every camera."""
    zero = [F.lit(0.0)] * 3
    centre = to_world(zero)
    return df.withColumns(
        {
            "px": centre[0] + 0.0,
            "py": centre[1] + 0.0,
            "pz": centre[2] + 0.0,
            "look_x": F.col("r20"),
            "look_y": F.col("r21"),
            "look_z": F.col("r22"),
        }
    )


def check_reprojection(df: DataFrame, tolerance: float = 30.0) -> DataFrame:
    """Image-space reprojection error of ``x, y, z`` against ``u, v``, one bar."""
    u_s, v_s, zc = to_pixel([F.col("x"), F.col("y"), F.col("z")])
    out = df.withColumns({"_u": u_s, "_v": v_s, "_z": zc})
    missing = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    outside = (F.col("_z") <= 0.001) | (F.col("_u") < 0) | (F.col("_v") < 0)
    pu = F.col("_u") * (F.col("img_w") / F.col("model_w"))
    pv = F.col("_v") * (F.col("img_h") / F.col("model_h"))
    err = norm(pu - F.col("u"), pv - F.col("v"))
    return out.withColumns(
        {
            "reprojection_status": F.when(missing, F.lit("UNAVAILABLE"))
            .when(outside, F.lit("REJECTED"))
            .when(err <= tolerance, F.lit("VALID"))
            .otherwise(F.lit("REJECTED")),
            "reprojection_error_px": F.when(missing, F.lit(None).cast("double"))
            .when(outside, F.lit(999.0))
            .otherwise(half_even(err, 2)),
            "projected_u": F.when(~missing & ~outside, half_even(pu, 1)),
            "projected_v": F.when(~missing & ~outside, half_even(pv, 1)),
            "camera_depth_m": F.when(~missing & ~outside, half_even(F.col("_z"), 2)),
        }
    ).drop("_u", "_v", "_z")


def grade_reprojection(df: DataFrame, detect_grid: bool = True) -> DataFrame:
    """Reprojection in three grades; the model grid is guessed from ``cx, cy``."""
    u_s, v_s, zc = to_pixel([F.col("x"), F.col("y"), F.col("z")])
    if detect_grid:
        small = (F.col("cx") > 0) & (F.col("cx") < F.col("img_w") * 0.35)
        grid_w = F.when(small, half_even(F.col("cx") * 2.0)).otherwise(F.col("img_w").cast("double"))
        grid_h = F.when(small, half_even(F.col("cy") * 2.0)).otherwise(F.col("img_h").cast("double"))
    else:
        grid_w, grid_h = F.col("model_w").cast("double"), F.col("model_h").cast("double")
    out = df.withColumns({"_u": u_s, "_v": v_s, "_z": zc, "_gw": grid_w, "_gh": grid_h})
    missing = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    behind = F.col("_z") <= 0.001
    pu = F.col("_u") * F.when(F.col("_gw") > 0, F.col("img_w") / F.col("_gw")).otherwise(1.0)
    pv = F.col("_v") * F.when(F.col("_gh") > 0, F.col("img_h") / F.col("_gh")).otherwise(1.0)
    err = norm(pu - F.col("u"), pv - F.col("v"))
    return out.withColumns(
        {
            "reprojection_status": F.when(missing, F.lit("UNAVAILABLE"))
            .when(behind, F.lit("BEHIND_CAMERA"))
            .when(err < 5.0, F.lit("HIGH_CONFIDENCE"))
            .when(err < 25.0, F.lit("VALID"))
            .otherwise(F.lit("REJECTED")),
            "reprojection_error_px": F.when(missing | behind, F.lit(999.0)).otherwise(
                half_even(err, 2)
            ),
            "is_in_front": F.coalesce(~missing & ~behind, F.lit(False)),
            "camera_depth_m": F.when(~missing & ~behind, half_even(F.col("_z"), 3)),
        }
    ).drop("_u", "_v", "_z", "_gw", "_gh")


def to_gps(df: DataFrame, lat: float, lon: float, alt: float) -> DataFrame:
    """Offset of a local position from a reference coordinate, in degrees."""
    metres = F.lit(111139.0)
    return df.withColumns(
        {
            "latitude": half_even(F.lit(lat) + F.col("y") / metres, 6),
            "longitude": half_even(
                F.lit(lon) + F.col("x") / (metres * F.cos(F.radians(F.lit(lat)))), 6
            ),
            "altitude_m": half_even(F.lit(alt) + F.col("z"), 2),
            "location_status": F.when(F.col("x").isNotNull(), F.lit("LOCALIZED_GPS")).otherwise(
                F.lit("UNLOCALIZED")
            ),
        }
    )


def valid_intrinsics() -> Column:
    w, h = F.col("model_w"), F.col("model_h")
    finite = is_finite(F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    return (
        finite
        & (F.col("fx") > 0)
        & (F.col("fy") > 0)
        & F.col("cx").between(-w * 0.5, w * 1.5)
        & F.col("cy").between(-h * 0.5, h * 1.5)
    )


def rotation_determinant() -> Column:
    c = {name: F.col(name) for name in ROTATION}
    return (
        c["r00"] * (c["r11"] * c["r22"] - c["r12"] * c["r21"])
        - c["r01"] * (c["r10"] * c["r22"] - c["r12"] * c["r20"])
        + c["r02"] * (c["r10"] * c["r21"] - c["r11"] * c["r20"])
    )


def orthogonality_error() -> Column:
    """Largest absolute entry of the transposed rotation times itself, minus identity."""
    errors = []
    for i in range(3):
        for j in range(i, 3):
            dot = sum(
                (F.col(f"r{k}{i}") * F.col(f"r{k}{j}") for k in range(1, 3)),
                F.col(f"r0{i}") * F.col(f"r0{j}"),
            )
            errors.append(F.abs(dot - (1.0 if i == j else 0.0)))
    return F.greatest(*errors)


def valid_extrinsics() -> Column:
    finite = is_finite(*[F.col(c) for c in ROTATION + SHIFT])
    reach = F.greatest(*[F.abs(F.col(c)) for c in SHIFT])
    return (
        finite
        & (orthogonality_error() <= 0.1)
        & (F.abs(rotation_determinant() - 1.0) <= 0.1)
        & (reach <= 1000.0)
    )


def to_quaternion(df: DataFrame) -> DataFrame:
    """Unit quaternion (w, x, y, z) of the rotation, with a non-negative w.

    Each case takes the largest of the four squared components as pivot, so the
    square root is never of a small number.
    """
    m = {name: F.col(name) for name in ROTATION}
    trace = m["r00"] + m["r11"] + m["r22"]
    squares = {
        "w": 1.0 + trace,
        "x": 1.0 + 2.0 * m["r00"] - trace,
        "y": 1.0 + 2.0 * m["r11"] - trace,
        "z": 1.0 + 2.0 * m["r22"] - trace,
    }
    pair = {
        ("w", "x"): m["r21"] - m["r12"],
        ("w", "y"): m["r02"] - m["r20"],
        ("w", "z"): m["r10"] - m["r01"],
        ("x", "y"): m["r01"] + m["r10"],
        ("x", "z"): m["r02"] + m["r20"],
        ("y", "z"): m["r12"] + m["r21"],
    }
    biggest = F.greatest(*squares.values())

    def component(name: str) -> Column:
        value = None
        for pivot, square in squares.items():
            root = F.sqrt(square)
            if name == pivot:
                part = root / 2.0
            else:
                part = pair.get((pivot, name), pair.get((name, pivot))) / (2.0 * root)
            case = square == biggest
            value = F.when(case, part) if value is None else value.when(case, part)
        return value

    raw = df.withColumns({f"q{n}": component(n) for n in "wxyz"})
    sign = F.when(F.col("qw") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return raw.withColumn("_s", sign).withColumns(
        {f"q{n}": F.col(f"q{n}") * F.col("_s") + 0.0 for n in "wxyz"}
    ).drop("_s")


def measure(a: list[Column], b: list[Column], speed: float = 5.0) -> dict[str, Column]:
    """Distance, ground range, climb label, pitch, transit time and range band."""
    dx, dy, dz = (b[k] - a[k] for k in range(3))
    ground = norm(dx, dz)
    dist = norm(dx, dy, dz)
    return {
        "distance_m": half_even(dist, 4),
        "ground_range_m": half_even(ground, 4),
        "climb": F.when(dy < -0.05, F.lit("CLIMB")).when(dy > 0.05, F.lit("DESCENT")).otherwise(
            F.lit("LEVEL")
        ),
        "pitch_deg": half_even(
            F.when(ground > 1e-6, F.degrees(F.atan2(-dy, ground)))
            .when(dy < 0, F.lit(90.0))
            .when(dy > 0, F.lit(-90.0))
            .otherwise(F.lit(0.0)),
            4,
        ),
        "transit_s": half_even(dist / F.lit(speed), 4),
        "band": F.when(dist < 1.0, F.lit("DIRECT CONTACT"))
        .when(dist < 5.0, F.lit("CLOSE HOVER"))
        .when(dist < 25.0, F.lit("LOCAL SECTOR"))
        .otherwise(F.lit("EXTENDED TRANSIT")),
    }
