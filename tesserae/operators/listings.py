"""Small operators on records: lookups in order, filters, quotas, profiles, boxes.

Defined cases: null keys match nothing; an empty list of values filters
nothing; ties are broken by the columns named; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.paths import file_stem
from tesserae.operators.lineage import guard


def images_of_masks(masks: DataFrame, mask_path: str, images: DataFrame, image_path: str, keys: list[str], suffix: str = "_mask", strict: bool = True) -> DataFrame:
    """``masks`` with ``image``, the first image by path whose stem is the mask's less ``suffix``; a mask without one fails the query if ``strict``."""
    stem = lambda c: F.lower(file_stem(F.trim(F.col(c))))
    named = images.filter(F.col(image_path).isNotNull()).select(*keys, stem(image_path).alias("__stem"), F.col(image_path).alias("__image"))
    first = named.groupBy(*keys, "__stem").agg(F.min("__image").alias("image"))
    rows = masks.withColumn("__stem", F.regexp_replace(stem(mask_path), f"{suffix}$", "")).join(first, [*keys, "__stem"], "left").drop("__stem")
    return guard(rows, F.col("image").isNull(), "a mask has no image") if strict else rows


def first_existing(df: DataFrame, fields: list[str], files: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: the first of the fields that names a file of ``files`` (path)."""
    known = files.select(F.col("path").alias("__path")).filter("__path is not null").distinct().withColumn("__there", F.lit(True))
    out = []
    for i, f in enumerate(fields):
        df = df.join(known.withColumnsRenamed({"__path": f, "__there": f"__there{i}"}), f, "left")
        out.append(F.when(F.col(f"__there{i}"), F.col(f)))
    return df.withColumn(name, F.coalesce(*out)).drop(*[f"__there{i}" for i in range(len(fields))])


def optional_filters(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose columns are among the values asked for; an empty list asks for nothing."""
    tests = [F.col(c).isin(*values) for c, values in wanted.items() if values]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


#: Least area and least longer side of a box that is worth cutting out, by label, and for others. Fixed values.
USEFUL_BOXES = {"Crack": (0.003, 0.18), "resin": (0.0015, 0.06)}
USEFUL_OTHER = (0.006, 0.10)


def useful_box(label: Column, width: Column, height: Column) -> Column:
    """Whether a box (as shares of the image) is large and long enough for its label."""
    area, longest = width * height, F.greatest(width, height)
    fits = lambda least: (area >= least[0]) & (longest >= least[1])
    out = None
    for name, least in USEFUL_BOXES.items():
        out = F.when(label == name, fits(least)) if out is None else out.when(label == name, fits(least))
    return F.coalesce(out.otherwise(fits(USEFUL_OTHER)), F.lit(False))


def per_policy(df: DataFrame, policies: dict[str, str], kind: str, value: str) -> DataFrame:
    """One row per row and policy: ``policies`` names the column each policy takes its value from."""
    entries = F.array(*[F.struct(F.lit(p).alias(kind), F.col(c).alias(value)) for p, c in policies.items()])
    rest = [c for c in df.columns if c not in policies.values()]
    return df.select(*rest, F.explode(entries).alias("__e")).select(*rest, f"__e.{kind}", f"__e.{value}")


def mean_or_zero(value: Column) -> Column:
    """Mean, 0 for a group without any value."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def hash_order(seed: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)


def capped_jobs(df: DataFrame, identity: str, seed: str, most: int) -> DataFrame:
    """The first ``most`` rows in a seeded order; the cap is what is asked for."""
    return df.orderBy(hash_order(seed, identity), identity).limit(most)


def quota_fill(df: DataFrame, label: str, identity: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """So many rows of each label, in a seeded order; an unfilled quota is an error."""
    order = Window.partitionBy(label).orderBy(hash_order(seed, identity), identity)
    wanted = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    rows = df.filter(F.col(label).isin(*quotas)).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= wanted[F.col(label)])
    counted = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per quota
    missing = {k: n - counted.get(k, 0) for k, n in quotas.items() if counted.get(k, 0) < n}
    if missing:
        raise RuntimeError(f"quotas are not met: {missing}")
    return rows


def described(df: DataFrame, descriptions: DataFrame, keys: list[Column], default: Column, name: str = "description") -> DataFrame:
    """``df`` with the description of the first of the keys that has one.

    ``descriptions``: (key, text). Keys that agree in their places meet in one
    join each, so nothing is gathered per row.
    """
    known = descriptions.filter("key is not null and text <> ''").groupBy("key").agg(F.max("text").alias("text"))
    for i, key in enumerate(keys):
        df = df.withColumn(f"__k{i}", key).join(known.withColumnsRenamed({"key": f"__k{i}", "text": f"__t{i}"}), f"__k{i}", "left")
    found = F.coalesce(*[F.col(f"__t{i}") for i in range(len(keys))], default)
    return df.withColumn(name, found).drop(*[f"__{c}{i}" for i in range(len(keys)) for c in "kt"])


#: Profiles of generation with the morphologies they suit, and the profile each morphology has by default. Fixed values.
PROFILES = {
    "scuff_soft_low_strength": ("multi_scuff",),
    "scratch_ridge_balanced": ("scratch_band", "crack_band"),
    "scratch_thin_detail": ("scratch_band", "crack_band", "single_stroke"),
    "single_stroke_clean": ("single_stroke",),
}
DEFAULT_PROFILES = {"multi_scuff": "scuff_soft_low_strength", "single_stroke": "single_stroke_clean"}
DEFAULT_PROFILE = "scratch_ridge_balanced"
MANY_WORDS, SINGLE_WORDS = ("scuff", "many", "multiple", "rubbed"), ("single", "one long", "one narrow")


def morphology(given: list[Column], text: Column, defect: Column) -> Column:
    """The first morphology that is given, else what text and defect type speak of."""
    said = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(said, F.lit(w)) for w in words])
    spoken = F.when(any_of(MANY_WORDS), "multi_scuff").when(any_of(SINGLE_WORDS), "single_stroke").when(F.lower(defect) == "crack", "crack_band").otherwise("scratch_band")
    return F.coalesce(*[F.when(g != "", g) for g in given], spoken)


def profiles_for(kind: Column, requested: list[str]) -> Column:
    """The requested profiles that suit a morphology, or its default one."""
    unknown = [p for p in requested if p not in PROFILES]
    if unknown:
        raise ValueError(f"unknown profile {unknown[0]}")
    suits = F.array_compact(F.array(*[F.when(kind.isin(*PROFILES[p]), p) for p in requested]))
    default = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_PROFILES.items() for x in kv]), kind), F.lit(DEFAULT_PROFILE))
    return F.when(F.size(suits) > 0, suits).otherwise(F.array(default))


#: How much a retry boosts mask noise and contrast by morphology; 1 for others. Fixed values.
RETRY_BOOST = {"micro_chip": 1.25, "tooth_break": 1.15, "scratch_band": 1.0, "single_stroke": 0.9, "crack_band": 1.0, "multi_scuff": 0.7}


@dataclass(frozen=True)
class RetrySettings:
    """Steps by which each further attempt of a generation goes, and where they end."""

    strength_step: float = 0.05
    guidance_step: float = 0.4
    step_increment: int = 2
    extra_strength: float = 0.03
    extra_guidance: float = 0.2
    extra_steps: int = 2
    max_strength: float = 0.85
    max_guidance: float = 10.0
    max_steps: int = 40
    noise_step: float = 0.035
    max_noise: float = 0.08
    contrast_step: float = 0.08
    max_contrast: float = 0.16
    seed_stride: int = 97_531


def retry_settings(attempt: Column, refused: Column, kind: Column, strength: Column, guidance: Column, steps: Column, seed: Column, s: RetrySettings) -> Column:
    """struct<strength, guidance, steps, noise, contrast, seed, reason> of attempt number ``attempt``; the first (0) is as given.

    A retry for too little coverage of the mask, or for no reason that was
    noted, goes further and boosts the mask; ``refused`` are the reasons.
    """
    again = F.coalesce(attempt, F.lit(0)) > 0
    bare = again & ((F.coalesce(F.size(refused), F.lit(0)) <= 0) | F.coalesce(F.array_contains(refused, "low_mask_coverage"), F.lit(False)))
    more = F.when(bare, 1).otherwise(0)
    moved = lambda value, step, extra, most: F.when(again, F.least(F.lit(most), value + step * attempt + extra * more)).otherwise(value)
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RETRY_BOOST.items() for x in kv]), kind), F.lit(1.0))
    boost = lambda step, most: F.when(bare, F.least(F.lit(most), step * attempt * factor)).otherwise(0.0)
    return F.struct(
        moved(strength, s.strength_step, s.extra_strength, s.max_strength).alias("strength"), moved(guidance, s.guidance_step, s.extra_guidance, s.max_guidance).alias("guidance"),
        moved(steps, s.step_increment, s.extra_steps, s.max_steps).alias("steps"), boost(s.noise_step, s.max_noise).alias("noise"), boost(s.contrast_step, s.max_contrast).alias("contrast"),
        F.when(again, seed + s.seed_stride * attempt).otherwise(seed).alias("seed"), F.when(bare, "low_mask_coverage").alias("reason"),
    )


def united_box(boxes: Column, width: int, height: int, padding: float) -> Column:
    """[x1, y1, x2, y2] around all boxes, padded by a share of its sides and kept inside the image; null without boxes."""
    side = lambda i, pick: pick(F.transform(boxes, lambda b: b[i]))
    x1, y1, x2, y2 = side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)
    px, py = (F.bround((b - a) * max(0.0, padding), 0).cast("int") for a, b in ((x1, x2), (y1, y2)))
    inside = F.array(F.greatest(F.lit(0), x1 - px), F.greatest(F.lit(0), y1 - py), F.least(F.lit(width), x2 + px), F.least(F.lit(height), y2 + py))
    return F.when(F.size(boxes) > 0, inside)


def clearance(box: Column, width: int, height: int) -> Column:
    """Least distance of a box to the image's border, as a share of the shorter side."""
    return F.least(box[0], box[1], width - box[2], height - box[3]) / max(1, min(width, height))


def overlapping(a: Column, b: Column) -> Column:
    """Whether one path is the other or lies below it, either way."""
    p, q = (F.rtrim(F.translate(x, "\\", "/"), F.lit("/")) for x in (a, b))
    return (p == q) | F.startswith(p, F.concat(q, F.lit("/"))) | F.startswith(q, F.concat(p, F.lit("/")))


def carried_rows(wanted: DataFrame, existing: DataFrame, keys: list[str], output: str, files: DataFrame, overwrite: bool = False) -> DataFrame:
    """``wanted`` with ``action``: rows to ``compute``, and done ones to ``carry`` with their stored values.

    A row whose output file is there is done: it is carried if it has a stored
    row and left out otherwise. With ``overwrite`` every row is computed.
    """
    stored = [c for c in existing.columns if c not in keys]
    if overwrite:
        return wanted.select("*", F.lit("compute").alias("action"), *[F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in stored])
    there = files.select(F.col("path").alias(output)).distinct().withColumn("__there", F.lit(True))
    marked = wanted.join(there, output, "left").join(existing.withColumn("__stored", F.lit(True)), keys, "left")
    action = F.when(F.col("__there").isNull(), "compute").when(F.col("__stored"), "carry")
    kept = [F.when(F.col("__there"), F.col(c)).alias(c) for c in stored]
    return marked.withColumn("action", action).filter("action is not null").select(*wanted.columns, "action", *kept)
