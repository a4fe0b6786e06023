"""Hierarchical time scales: intervals, interval joins, axes, colours, tiling, figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise, small

#: Axis, tiling and colour parameters.
KNEE, LINEAR_SHARE, BANDS_END = 1.0, 0.07, 4567.0
BAND_PX, SPLIT_SHARE, CHAR_PX, LABEL_PAD = 46.0, 0.7, 7.3, 10.0
DIM_K, PIVOT, ANCHOR, DIM_LOW, DIM_HIGH, DIM_CHROMA = 0.22, 0.72, 0.32, 0.24, 0.40, 0.060
PRESENT = 0.05
#: Halvings of the colour grid: a cell's diagonal is then under half of the sixth decimal.
LEVELS = 22


def intervals(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """Add ``depth`` (chase of parents) and ``place`` (rank row, then oldest begin)."""
    from .tree import lineages

    t = lineages(rows)
    order = F.create_map(*[x for i, r in enumerate(ranks) for x in (F.lit(r), F.lit(i))])[F.col("rank")]
    place = F.row_number().over(Window.orderBy(order, F.desc("begin"), "id"))  # a scale has a few hundred intervals
    return t.withColumn("depth", (F.size("lineage") - 1).cast("long")).withColumn("place", place.cast("long")).drop("lineage")


def containment(scale: DataFrame) -> DataFrame:
    """Intervals not within their parent's bounds."""
    p = scale.select(F.col("id").alias("parent"), F.col("begin").alias("p_begin"), F.col("end").alias("p_end"))
    return scale.join(p, "parent").where("begin > p_begin OR end < p_end").select("id", "parent")


def interval_join(points: DataFrame, scale: DataFrame, x: str, width: float) -> DataFrame:
    """points with the scale intervals that hold them (begin >= x > end).

    Each interval is listed under every bucket of ``width`` it meets and points
    under their own, so the join is an equi-join and then a filter; choose a
    width near the median interval.
    """
    cut = lambda c: F.floor(c / F.lit(width)).cast("long")
    spread = scale.withColumn("_b", F.explode(F.sequence(cut(F.col("end")), cut(F.col("begin")))))
    return points.withColumn("_b", cut(F.col(x))).join(spread, "_b").where((F.col("begin") >= F.col(x)) & (F.col(x) > F.col("end"))).drop("_b")


def symlog(age: Column, oldest: float, share: float = LINEAR_SHARE) -> Column:
    """0..1: linear up to the knee, logarithmic beyond."""
    top = math.log10(max(oldest, KNEE * 1.000001) / KNEE)
    a = F.greatest(age, F.lit(0.0))
    return F.when(a <= KNEE, a / KNEE * share).otherwise(F.lit(share) + F.log10(a / KNEE) / top * (1 - share))


def symlog_inverse(x: Column, oldest: float, share: float = LINEAR_SHARE) -> Column:
    top = math.log10(max(oldest, KNEE * 1.000001) / KNEE)
    return F.when(x <= share, x / share * KNEE).otherwise(KNEE * F.pow(F.lit(10.0), (x - share) / (1 - share) * top))


def channel(colour: Column, k: int) -> Column:
    """Linear light of a '#rrggbb' colour's k-th channel."""
    v = F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("double") / 255
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


#: The OKLab matrices.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def _times(matrix: tuple, v: list[Column]) -> list[Column]:
    return [sum((F.lit(m) * x for m, x in zip(row[1:], v[1:], strict=True)), F.lit(row[0]) * v[0]) for row in matrix]


def oklab(colour: Column) -> list[Column]:
    return _times(TO_LAB, [F.cbrt(c) for c in _times(TO_LMS, [channel(colour, k) for k in range(3)])])


def dim(lab: list[Column]) -> list[Column]:
    """Contract lightness about the pivot to the anchor, within bounds, and cap the chroma."""
    light = F.least(F.greatest(F.lit(ANCHOR) + (lab[0] - PIVOT) * DIM_K, F.lit(DIM_LOW)), F.lit(DIM_HIGH))
    chroma = F.hypot(lab[1], lab[2])
    scale = F.when(chroma > 0, F.least(chroma, F.lit(DIM_CHROMA)) / chroma).otherwise(F.lit(0.0))
    return [light, lab[1] * scale, lab[2] * scale]


def hexadecimal(lab: list[Column]) -> Column:
    cubed = [x * x * x for x in _times(FROM_LAB, lab)]
    out = []
    for v in _times(FROM_LMS, cubed):
        v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        s = F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)
        out.append(F.lpad(F.lower(F.hex(F.round(s * 255).cast("long"))), 2, "0"))
    return F.concat(F.lit("#"), *out)


def sibling_distance(scale: DataFrame) -> DataFrame:
    """(parent, least): least colour distance between siblings (a, b, l columns).

    Not over all pairs: siblings of one colour are 0 apart; distinct colours are
    counted in grids that halve from level to level.  At a parent's last level with
    a shared cell its least distance is at most the cell's diagonal, and cells of
    half the edge hold one colour each, so a search with cells of that diagonal
    compares a colour with a bounded number of others, however many siblings there
    are.  A cell shared at the last ``LEVELS`` is within the rounding of 0.
    """
    xyz = ["l", "a", "b"]
    groups = scale.groupBy("parent", *xyz).agg(F.count_distinct("id").alias("n"))
    points = materialise(groups.where("parent IS NOT NULL"))
    known = points.where("l IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").withColumn("same", F.col("n") > 1)
    cell = lambda edge: [F.floor(F.col(c) / edge).cast("long").alias(f"{c}_") for c in xyz]
    levels = known.select("parent", *xyz, F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("k"))
    shared = levels.groupBy("parent", "k", *cell(F.pow(F.lit(2.0), -F.col("k")))).agg(F.count("*").alias("n")).where("n > 1")
    deepest = shared.groupBy("parent").agg(F.max("k").alias("k"))
    flags = points.groupBy("parent").agg(F.sum("n").alias("n")).where("n > 1").join(known.groupBy("parent").agg(F.max("same").alias("same")), "parent", "left")
    parents = materialise(flags.join(deepest, "parent", "left").select("parent", F.when(F.coalesce("same", F.lit(False)) | (F.col("k") == LEVELS), 0.0).alias("zero"), F.coalesce("k", F.lit(-2)).alias("k")))
    # Colours lie within a cube of edge 4 about 0, the cells of level -2 about the origin: all of them are neighbours.
    edge = F.pow(F.lit(2.0), -F.col("k")) * math.sqrt(3) * (1 + 1e-9)
    able = materialise(known.join(small(parents.where("zero IS NULL")), "parent").select("parent", *xyz, *cell(edge)))
    near = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", o, strict=True)]) for o in near])).alias("o")
    left = able.select("parent", *[F.col(c).alias(f"{c}1") for c in xyz], *[F.col(f"{c}_").alias(f"{c}0") for c in xyz], step)
    left = left.select("parent", *[f"{c}1" for c in xyz], *[(F.col(f"{c}0") + F.col(f"o.{n}")).alias(f"{c}_") for c, n in zip(xyz, "xyz", strict=True)], (F.col("o.x") * 9 + F.col("o.y") * 3 + F.col("o.z") == 0).alias("own"))
    right = able.select("parent", *[F.col(c).alias(f"{c}2") for c in xyz], *[f"{c}_" for c in xyz])
    d = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) ** 2 for c in ("a", "b")), (F.col("l1") - F.col("l2")) ** 2))
    pairs = left.join(right, ["parent", *[f"{c}_" for c in xyz]]).where(~F.col("own") | (F.struct("l1", "a1", "b1") < F.struct("l2", "a2", "b2")))
    found = pairs.groupBy("parent").agg(F.min(d).alias("d"))
    return parents.join(found, "parent", "left").select("parent", F.round(F.coalesce("zero", "d"), 6).alias("least"))


def tiling(scale: DataFrame) -> DataFrame:
    """(id) drawn: from the roots down, an interval gives way to its children if
    at least ``SPLIT_SHARE`` of them is legible (wide enough for band and label).
    scale: (id, parent, lineage, px, name)."""
    wide = F.col("px") >= F.greatest(F.lit(BAND_PX), F.length("name") * CHAR_PX + LABEL_PAD)
    kids = scale.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.avg(F.when(wide, 1.0).otherwise(0.0)).alias("share"))
    split = scale.join(kids, "id", "left").select("id", F.coalesce(F.col("share") >= SPLIT_SHARE, F.lit(False)).alias("split"))
    above = scale.select("id", F.explode(F.slice("lineage", 2, F.size("lineage"))).alias("anc"))
    refused = above.join(split.where("NOT split").select(F.col("id").alias("anc")), "anc", "left_semi").select("id").distinct()
    return scale.select("id").join(split.where("NOT split").select("id"), "id", "left_semi").join(refused, "id", "left_anti")


def nice_step(span: float, count: int) -> float:
    """Least step of the 1-2-5 ladder that cuts ``span`` into at most ``count``."""
    raw = max(span / max(count, 1), 1e-12)
    base = 10 ** math.floor(math.log10(raw))
    return next(m * base for m in (1, 2, 5, 10) if m * base >= raw * (1 - 1e-9))


def ticks(low: float, high: float, count: int, gap: float, scale) -> list[float]:
    """Tick values: candidates of three ladder levels, coarse first, placed
    greedily where ``scale`` keeps them ``gap`` apart."""
    step, placed = nice_step(high - low, count), []
    for s in (step * 10, step, step / 2):
        k = math.ceil(low / s)
        while k * s <= high + 1e-9:
            if all(abs(scale(k * s) - scale(p)) >= gap for p in placed):
                placed.append(k * s)
            k += 1
    return sorted(placed)


def figure(age: Column) -> Column:
    """An age as text: 'present', with one decimal under ten, without from there on."""
    return F.when(age.isNull(), None).when(age < PRESENT, F.lit("present")).when(age >= 10, F.format_string("%.0f", F.round(age))).otherwise(F.format_string("%.1f", F.round(age, 1)))


def gap(distance: Column) -> Column:
    """A distance in time as text: never 'present', a tenth at least."""
    return F.when(distance.isNull(), None).when(distance < 0.1, F.lit("under 0.1 Ma")).when(distance < 10, F.format_string("%.1f Ma", F.round(distance, 1))).otherwise(F.format_string("%.0f Ma", F.round(distance)))


def oklch(lab: list[Column]) -> list[Column]:
    """Lightness, chroma and hue in degrees, 0 to 360."""
    hue = F.degrees(F.atan2(lab[2], lab[1]))
    return [lab[0], F.hypot(lab[1], lab[2]), F.when(hue < 0, hue + 360).otherwise(hue)]


def sibling_drift(scale: DataFrame) -> DataFrame:
    """(parent, drift): how far the distances of dimmed siblings are from ``DIM_K``
    times the plain ones, at most, over every two siblings (parents with two or
    more). scale: (id, parent, l, a, b, dl, da, db). Siblings of one colour count
    once; what two tell is reduced to their parent's maximum where it is made."""
    colours = ["l", "a", "b", "dl", "da", "db"]
    several = scale.groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select("parent")
    own = scale.join(several, "parent", "left_semi").select("parent", *colours).distinct()
    j = own.join(own.select("parent", *[F.col(c).alias(f"{c}2") for c in colours]), "parent")
    d = lambda x, y, z: F.sqrt((F.col(x) - F.col(f"{x}2")) ** 2 + (F.col(y) - F.col(f"{y}2")) ** 2 + (F.col(z) - F.col(f"{z}2")) ** 2)
    return j.groupBy("parent").agg(F.round(F.max(F.abs(d("dl", "da", "db") - DIM_K * d("l", "a", "b"))), 6).alias("drift"))


def index_maps(scale: DataFrame) -> DataFrame:
    """(kind, key, ids): the children of each interval, the intervals of each rank,
    and the roots, oldest first."""
    told = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("begin")).alias("b"), "id"))), lambda x: x["id"].cast("string"))
    ids = F.array_join(told, ",").alias("ids")
    part = lambda df, kind, key: df.groupBy(key.cast("string").alias("key")).agg(ids).select(F.lit(kind).alias("kind"), "key", "ids")
    return part(scale.where("parent IS NOT NULL"), "children", F.col("parent")).unionByName(part(scale, "rank", F.col("rank"))).unionByName(part(scale.where("parent IS NULL"), "roots", F.lit("")))


def scale_gates(scale: DataFrame, ranks: list[str]) -> DataFrame:
    """(rule, violations): intervals without a known parent, with a rank not finer
    than their parent's, that end before they begin, or that leave their parent; and
    places that are no permutation of 1..n. scale: (id, parent, rank, begin, end, place)."""
    order = F.create_map(*[x for i, r in enumerate(ranks) for x in (F.lit(r), F.lit(i))])
    up = scale.select(F.col("id").alias("parent"), order[F.col("rank")].alias("p_rank"), F.col("begin").alias("p_begin"), F.col("end").alias("p_end"))
    j = scale.withColumn("own", order[F.col("rank")]).join(up, "parent", "left")
    rules = {
        "parent_known": F.col("parent").isNotNull() & F.col("p_begin").isNull(),
        "rank_finer": F.col("p_rank") >= F.col("own"),
        "begin_older": F.col("begin") < F.col("end"),
        "inside_parent": (F.col("begin") > F.col("p_begin") + 1e-9) | (F.col("end") < F.col("p_end") - 1e-9),
    }
    got = j.agg(*[F.count_if(c).alias(n) for n, c in rules.items()], (F.count("*") - F.count_distinct(F.when(F.col("place") >= 1, F.col("place")))).alias("lost"), (F.max("place") - F.count("*")).alias("beyond"))
    rows = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules] + [F.struct(F.lit("place_permutation").alias("rule"), (F.col("lost") + F.greatest("beyond", F.lit(0))).alias("violations"))]
    return got.select(F.inline(F.array(*rows)))


def tick_rows(axes: DataFrame) -> DataFrame:
    """(axis, value): ``ticks`` of every axis (axis, low, high, count, gap, oldest) on the symmetric-log scale."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                top = math.log10(max(r.oldest, KNEE * 1.000001) / KNEE)
                place = lambda x, top=top: x / KNEE * LINEAR_SHARE if x <= KNEE else LINEAR_SHARE + math.log10(x / KNEE) / top * (1 - LINEAR_SHARE)
                rows += [(r.axis, float(v)) for v in ticks(r.low, r.high, int(r.count_), r.gap, place)]
            yield pd.DataFrame(rows, columns=["axis", "value"])

    return axes.withColumnRenamed("count", "count_").mapInPandas(run, "axis long, value double")
