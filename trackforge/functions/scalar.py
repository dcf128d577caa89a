"""Row-wise functions: geometry on the pitch, times as text, models, intervals. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def foot_point(kind: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Middle of a box for a ball, of its lower edge for others."""
    return (x1 + x2) / 2, F.when(kind == "ball", (y1 + y2) / 2).otherwise(y2)


def inside(x: Column, y: Column, length: float, width: float, margin: float) -> Column:
    """Strictly within the pitch widened by margin, and finite; false for null."""
    return F.coalesce((x > -margin) & (x < length + margin) & (y > -margin) & (y < width + margin), F.lit(False))


def inside_closed(x: Column, y: Column, length: float, width: float, margin: float) -> Column:
    return F.coalesce(x.between(-margin, length + margin) & y.between(-margin, width + margin), F.lit(False))


def plausible_ball(x: Column, y: Column, length: float, width: float, margin: float = 0.5, goal_half: float = 3.5, behind: float = 2.0) -> Column:
    """On the pitch with a margin, or a little behind a goal line between the posts."""
    field = x.between(-margin, length + margin) & y.between(-margin, width + margin)
    net = x.between(-behind, length + behind) & (F.abs(y - width / 2) <= goal_half)
    return F.coalesce(field | net, F.lit(False))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Common area over joint area of two boxes (x1, y1, x2, y2); 0 where the joint area isn't positive."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def on_upper_body(u: Column, v: Column, box: list[Column], part: float = 0.6, inner: float = 0.7) -> Column:
    """The point lies in the upper part and the inner width of a box."""
    x1, y1, x2, y2 = box
    side = (x2 - x1) * (1 - inner) / 2
    return (u >= x1 + side) & (u <= x2 - side) & (v >= y1) & (v <= y1 + part * (y2 - y1))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def clipped_bin(x: Column, whole: float, bins: int) -> Column:
    """Bin of x, truncated towards 0 and clipped to the first and last."""
    return F.least(F.greatest((x / whole * bins).cast("int"), F.lit(0)), F.lit(bins - 1))


def colour_distance(a: Column, b: Column) -> Column:
    """Distance of two Lab colours (arrays) in which lightness counts half."""
    d = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(d[0] / 2 + d[1] + d[2])


#: Upper bounds of hue (0-180) and the kit's name.
HUES = ((8, "red"), (22, "orange"), (35, "yellow"), (85, "green"), (105, "cyan"), (130, "blue"), (165, "purple"), (181, "red"))


def kit_name(h: Column, s: Column, v: Column) -> Column:
    """Name of a kit's colour from hue (0-180), saturation and value (0-255); null where it is too grey to tell."""
    name = F.when(v < 60, "black").when((s < 35) & (v > 190), "white").when((s < 130) | (v < 90), F.lit(None).cast("string"))
    for most, hue in HUES:
        name = name.when(h < most, hue)
    return name


def kit_pair(a: Column, b: Column) -> Column:
    """Both names if known and different, else dark and light."""
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat_ws(",", a, b)).otherwise("dark,light")


def seconds_of(text: Column) -> Column:
    """[[h:]m:]s as seconds; a comma is a decimal point; null for more than three parts, blanks or signs."""
    clean = F.regexp_replace(F.trim(text), ",", ".")
    parts = F.split(clean, ":")
    number = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double"))
    return F.when(clean.rlike(r"^\d+(\.\d+)?$|^(\d+:){1,2}\d+(\.\d+)?$"), number)


def minutes_text(seconds: Column) -> Column:
    """mm:ss, truncated."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def hours_text(seconds: Column) -> Column:
    """h:mm:ss, rounded."""
    whole = F.floor(seconds + 0.5)
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)))


def clock_minute(t: Column, start: Column, shift: Column, half: Column, half_minutes: float) -> Column:
    """Minute of play, from 1, of a time in seconds."""
    return F.floor(((t - start + shift) + (half - 1) * half_minutes * 60) / 60) + 1


def expected_goal(x: Column, y: Column, length: float, width: float, goal: float) -> Column:
    """Chance of a goal from a place from which the goal at x = length is attacked: distance and angle in a logistic model."""
    d, ahead = F.hypot(length - x, y - width / 2), F.greatest(length - x, F.lit(0.3))
    angle = F.abs(F.atan2(y - (width / 2 - goal / 2), ahead) - F.atan2(y - (width / 2 + goal / 2), ahead))
    return 1 / (1 + F.exp(-(-1.87 - 0.0975 * d + 2.565 * angle)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, within 0 and 1; null for n = 0."""
    p, d = k / F.nullif(n, F.lit(0)), 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.when(n > 0, low), F.when(n > 0, high)


def yes_no(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("y", "yes", "t", "1"), True).when(word.isin("n", "no", "f", "0"), False)


def segment_distance(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    dx, dy = x2 - x1, y2 - y1
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
    return F.hypot(x - (x1 + along * dx), y - (y1 + along * dy))


def circle_distance(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    return F.abs(F.hypot(x - cx, y - cy) - radius)


def sampled_circle(x: Column, y: Column, radius: float, n: int) -> Column:
    """n + 1 points (i, x, y) around a circle, the first one again at the end."""
    angle = lambda i: 2 * F.pi() * i / n
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(i.alias("i"), (x + radius * F.cos(angle(i))).alias("x"), (y + radius * F.sin(angle(i))).alias("y")))


def at_line(x: Column, y: Column, length: float, width: float, distance: float = 1.5, any_line: bool = False) -> Column:
    """In the zone where players change: at the near line, or at any."""
    return F.least(x, length - x, y, width - y) < distance if any_line else y > width - distance


def player_change(gap: Column, at_end: Column, at_start: Column, least_gap: float) -> Column:
    return (gap > least_gap) & at_end & at_start


def mirrored(x: Column, right: Column, whole: float) -> Column:
    """x as seen by a team that attacks to the right."""
    return F.when(right, x).otherwise(whole - x)


def report_value(x: Column, kind: str) -> Column:
    """Text of a figure: pct, int, dec or dec2; a dash for null."""
    text = {"pct": lambda: F.format_string("%.0f%%", x.cast("double")), "int": lambda: F.format_string("%d", F.round(x).cast("long")), "dec": lambda: F.format_string("%.1f", x.cast("double")), "dec2": lambda: F.format_string("%.2f", x.cast("double"))}[kind]()
    return F.when(x.isNull(), "-").otherwise(text)


def share_bar(a: Column, b: Column) -> tuple[Column, Column]:
    """Share of a, and which side leads (0, 1, null on a tie); null where either is null or both are 0."""
    whole = a + b
    return F.when(whole > 0, a / whole), F.when(a > b, 0).when(b > a, 1)


def html_safe(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def script_safe(json: Column) -> Column:
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def linear_score(x: Column, mean: Column, deviation: Column, weights: Column, bias: Column) -> Column:
    """((x - mean) / deviation) . weights + bias on arrays."""
    z = F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), deviation, lambda a, b: a / b)
    return F.aggregate(F.zip_with(z, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) + bias


def lens_distance(u: Column, v: Column, cx: Column, cy: Column, focal: Column) -> Column:
    """How far from the optical centre a point was seen, in focal lengths."""
    return F.hypot(u - cx, v - cy) / focal


def homography(h: list[float], u: Column, v: Column) -> tuple[Column, Column]:
    """Point of the plane for a pixel; h is the matrix row by row."""
    w = h[6] * u + h[7] * v + h[8]
    return (h[0] * u + h[1] * v + h[2]) / w, (h[3] * u + h[4] * v + h[5]) / w
