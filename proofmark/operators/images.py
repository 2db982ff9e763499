"""Images: formats by their first bytes, gates, quality thresholds and region boxes.

Pixels are measured by a provider (see ``sources.providers``); the decisions
here are expressions over the measurements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmark.config import DEFAULT, Settings
from proofmark.functions.text import fixed

# Poor and warning thresholds.
SHORT_SIDE, BLUR, DARK, BRIGHT, CONTRAST, CLIPPING = (200, 400), (40.0, 100.0), (25.0, 45.0), (235.0, 210.0), (15.0, 28.0), (0.15, 0.05)


def sniff(content: Column) -> Column:
    """Format by the first bytes."""
    starts = lambda hexed, at=1: F.substring(content, at, len(hexed) // 2) == F.unhex(F.lit(hexed))
    return (
        F.when(F.octet_length(content) < 12, "UNKNOWN")
        .when(starts("FFD8FF"), "JPEG")
        .when(starts("89504E470D0A1A0A"), "PNG")
        .when(starts("52494646") & starts("57454250", 9), "WEBP")
        .when(starts("25504446"), "PDF")
        .otherwise("UNKNOWN")
    )


def accepted(name: Column) -> Column:
    """The accepted format for a sniffed or decoded name, else null."""
    up = F.upper(name)
    return F.when(up.isin("JPEG", "JPG", "MPO"), "jpeg").when(up == "PNG", "png").when(up == "WEBP", "webp")


def gate(size: Column, sniffed: Column, decoded: Column, width: Column, height: Column, s: Settings = DEFAULT) -> Column:
    """Why an image is refused; null if it is not."""
    return (
        F.when(size == 0, "empty_file")
        .when(size > s.upload_max_bytes, "file_too_large")
        .when(sniffed == "PDF", "pdf_not_supported")
        .when(sniffed == "UNKNOWN", "unsupported_type")
        .when(decoded.isNull(), "corrupt_image")
        .when(accepted(sniffed) != accepted(decoded), "type_mismatch")
        .when((width < s.min_dimension) | (height < s.min_dimension), "image_too_small")
        .when((width > s.max_dimension) | (height > s.max_dimension), "image_too_large")
    )


def _grade(poor: Column, warn: Column) -> Column:
    return F.when(poor, 2).when(warn, 1).otherwise(0)


def quality(side: Column, blur: Column, brightness: Column, contrast: Column, black: Column, white: Column) -> Column:
    """Struct of status (the worst of five) and the names of what is wrong, in order."""
    clipped = F.greatest(black, white)
    grades = {
        "resolution": _grade(side < SHORT_SIDE[0], side < SHORT_SIDE[1]),
        "blur": _grade(blur < BLUR[0], blur < BLUR[1]),
        "brightness": _grade((brightness < DARK[0]) | (brightness > BRIGHT[0]), (brightness < DARK[1]) | (brightness > BRIGHT[1])),
        "contrast": _grade(contrast < CONTRAST[0], contrast < CONTRAST[1]),
        "clipping": _grade(clipped >= CLIPPING[0], clipped >= CLIPPING[1]),
    }
    return F.struct(
        status_of(F.greatest(*grades.values())).alias("status"),
        F.array_compact(F.array(*(F.when(g > 0, name) for name, g in grades.items()))).alias("warnings"),
    )


def status_of(level: Column) -> Column:
    return F.when(level == 2, "POOR").when(level == 1, "WARNING").otherwise("GOOD")


def worst_quality(statuses: Column) -> Column:
    """The worst of an array of statuses; GOOD for none."""
    return F.when(F.array_contains(statuses, "POOR"), "POOR").when(F.array_contains(statuses, "WARNING"), "WARNING").otherwise("GOOD")


def operations(profile: Column, oriented: Column, resized: Column, max_edge: Column, tilt: Column, angle: Column) -> Column:
    """The steps of preparing an image, in order: structs of name, applied and detail.

    ``tilt`` is what ``deskew`` decides.  The fast profile ends before contrast,
    noise, tilt and sharpness are treated.
    """
    step = lambda name, applied, detail: F.struct(F.lit(name).alias("name"), applied.alias("applied"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    yes, no, edge = F.lit(True), F.lit(False), max_edge.cast("string")
    # Names and details.
    first = F.array(
        step("exif_orientation", oriented, F.when(oriented, "Applied EXIF orientation tag").otherwise("No orientation correction needed")),
        step("convert_rgb", yes, "Converted to RGB"),
        step("ocr_max_edge_resize", resized, F.when(resized, F.concat(F.lit("Longest edge limited to "), edge, F.lit("px"))).otherwise(F.concat(F.lit("Within "), edge, F.lit("px; no resize")))),
        step("grayscale", yes, "Converted to 8-bit grayscale"),
    )
    fast = F.array(step("enhanced_skipped", no, "FAST profile: skipped CLAHE, denoise, deskew, unsharp"))
    rotated = F.concat(F.lit("Rotated by "), fixed(angle, 2), F.lit(" degrees"))
    enhanced = F.array(
        step("clahe_contrast", yes, "CLAHE clipLimit=2.0"),
        step("mild_denoise", yes, "Non-local means denoise h=6"),
        step("perspective_correction", no, "Automatic perspective / bottle-curvature correction is not implemented. Conservative planar deskew may still apply when angle confidence is high."),
        step("deskew", tilt == "rotate", F.when(tilt == "rotate", rotated).when(tilt == "skip_few_edges", "insufficient_edge_points").when(tilt == "skip_straight", "angle_below_minimum_threshold").otherwise("angle_above_safe_maximum")),
        step("mild_unsharp", yes, "Mild unsharp amount=0.4"),
    )
    return F.concat(first, F.when(profile == "enhanced", enhanced).otherwise(fast))


def deskew(points: Column, angle: Column) -> Column:
    """What to do about a tilt."""
    return F.when(points < 200, "skip_few_edges").when(F.abs(angle) < 0.5, "skip_straight").when(F.abs(angle) > 12, "skip_implausible").otherwise("rotate")


def union_box(boxes: Column) -> Column:
    """The box round all boxes."""
    part = lambda f, k: f(F.transform(boxes, lambda b: b[k]))
    return F.when(F.size(boxes) > 0, F.struct(part(F.array_min, "x_min").alias("x_min"), part(F.array_min, "y_min").alias("y_min"), part(F.array_max, "x_max").alias("x_max"), part(F.array_max, "y_max").alias("y_max")))


def padded(box: Column, pad: float, width: Column, height: Column, least_w: float, least_h: float) -> Column:
    """A box grown by a margin and kept within the image; null if it is too small then."""
    x0, y0 = F.greatest(F.lit(0.0), box["x_min"] - pad), F.greatest(F.lit(0.0), box["y_min"] - pad)
    x1, y1 = F.least(width.cast("double"), box["x_max"] + pad), F.least(height.cast("double"), box["y_max"] + pad)
    return F.when((x1 - x0 >= least_w) & (y1 - y0 >= least_h), F.struct(x0.alias("x_min"), y0.alias("y_min"), x1.alias("x_max"), y1.alias("y_max")))


def tallest(words: Column, n: int = 4) -> Column:
    """The ``n`` tallest words of the upper part."""
    height = lambda w: w["bbox"]["y_max"] - w["bbox"]["y_min"]
    return F.slice(F.array_sort(words, lambda a, b: F.when(height(a) > height(b), -1).when(height(a) < height(b), 1).otherwise(F.when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0))), 1, n)


def region(status: Column, band: Column, width: Column, height: Column) -> Column:
    """Where to look again: the upper part for an unsure brand, else the brand's band, else the top."""
    top = lambda share: F.struct(F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"), width.cast("double").alias("x_max"), (height * share).cast("double").alias("y_max"))
    return F.when(status.isin("UNCERTAIN", "NOT_FOUND"), top(0.55)).when(band.isNotNull(), band).otherwise(top(0.45))
