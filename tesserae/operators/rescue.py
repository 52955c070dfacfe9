"""Drifting JSON records read into one table, and what changed from file to file.

Rescue-column ingestion: ``line_fields`` reads every line once into its fields
with their JSON types and values. From these the file-to-file changes are
found, renames among them (``schema_changes``); names that were renamed from
or to a target field are promoted to further spellings of it
(``promoted_names``); and ``ingest`` enforces the target schema: fields that
are unknown, or whose value will not take the target type, are kept as JSON in
``_rescued``, and rescued values of promoted names are replayed into the typed
columns they belong to.

Defined cases: lines that are null, empty, damaged or no JSON object are
ignored; of a repeated key the last value counts; a settings string that is no
JSON object is an unknown value of ``settings``; an unknown field that is null
is kept as such; an object or array is no value of a text column; an empty
table gives empty results; lines without feed or file number are read but have
no changes.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.session import cut

#: Target types per record type; ``settings.x`` stands directly in settings.
TARGETS = {
    "auto_mask": {
        "category": "string", "defect_type": "string", "image_path": "string", "mask_path": "string", "confidence": "double",
        "region_xyxy": "array<int>", "eval_mask_path": "string", "uncertainty_mask_path": "string", "training_mask_path": "string", "seed": "bigint",
        "settings.auto_mask_run_id": "string", "settings.selected_refinement": "string",
    },
    "generation": {
        "category": "string", "defect_type": "string", "background_path": "string", "output_path": "string", "model": "string", "seed": "bigint",
        "latency_sec": "double", "error": "string", "insertion_mask_path": "string", "settings.guidance_scale": "double",
        "settings.num_inference_steps": "int", "settings.negative_prompt": "string", "settings.placement_mode": "string",
        "settings.target_bbox_xyxy": "array<int>", "settings.inpaint_mask_path": "string",
    },
}

#: Members that hold the value of a target field in wrapped objects, besides "value".
INNER = {"region_xyxy": ("xyxy",), "settings.target_bbox_xyxy": ("xyxy",)}

#: Numbers of one run of files that are put in order by one task.
RUN_FILES = 4096

#: Pairs of renamed fields, counted over all feeds, that names are promoted from.
MAX_PAIRS = 100_000

#: Least likeness of contents for a field that goes and one that comes to be one.
SAME_CONTENT = 0.8
#: Least likeness if besides no word that all values of one have is missing from the other: few values of a kind vary by chance.
LIKE_CONTENT = 0.6
#: Share of values from which on a word counts as one that all have.
ALL_VALUES = 0.95


def _object(text: str) -> str:
    """SQL: the members of a text that is exactly one JSON object, else null."""
    whole = f"transform(array(try_cast(try_parse_json(concat('[', {text}, ']')) AS array<variant>)), "
    return whole + f"w -> CASE WHEN size(w) = 1 AND rtrim({text}) LIKE '%}}' THEN try_cast(get(w, 0) AS map<string,variant>) END)[0]"


def allow_repeated_keys(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


#: SQL: JSON type of the JSON text ``j``; null for a null.
_KIND = (
    "CASE left(j, 1) WHEN '{' THEN 'object' WHEN '[' THEN 'array' WHEN '\"' THEN 'string' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' "
    "WHEN 'n' THEN NULL ELSE 'number' END"
)


def line_fields(lines: DataFrame, *keep: str) -> DataFrame:
    """(*keep, fields): per readable line an array of (name, kind, value as JSON).

    ``kind`` is string, number, boolean, array or object, null for a JSON null.
    A line is parsed once: what an explode gives out is not computed again.
    """
    allow_repeated_keys(lines.sparkSession)
    rows = lines.select(*keep, F.expr(f"explode(filter(array({_object('payload')}), m -> m IS NOT NULL))").alias("m"))
    entry = "transform(map_entries(MAP), e -> transform(array(to_json(e.value)), j -> struct(concat('PREFIX', e.key) AS name, " + _KIND + " AS kind, j AS value))[0])"
    inner = "CASE WHEN map_contains_key(m, 'settings') THEN coalesce(try_cast(m['settings'] AS map<string,variant>), " + _object("try_cast(m['settings'] AS string)") + ") END"
    top, low = entry.replace("MAP", "m").replace("PREFIX", ""), entry.replace("MAP", "i").replace("PREFIX", "settings.")
    return rows.select(*keep, F.expr(f"explode(array(concat({top}, transform(array({inner}), i -> coalesce({low}, array()))[0])))").alias("fields"))


def ingest(lines: DataFrame, record_type: str, renames: dict[str, str] | None = None) -> DataFrame:
    """One typed row per readable line of a record type, with ``_rescued``.

    ``renames``: further spelling -> target field. Dots in target names become
    underscores.
    """
    target = TARGETS[record_type]
    keep = ["line_id", "feed_id", "file_no", "line_no"]
    rows = line_fields(lines.filter(F.col("record_type") == record_type), *keep)
    named = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"], f["value"])))
    rows = rows.select(*keep, F.explode(F.array(named)).alias("json"))
    aliases: dict[str, list[str]] = {f: [f] for f in target}
    for written, field in (renames or {}).items():
        if field in aliases and written not in target:
            aliases[field].append(written)
    chosen = {field: _chosen({name: F.col("json")[name] for name in aliases[field]}, kind, INNER.get(field, ())) for field, kind in target.items()}
    out = rows.select(*keep, "json", *[c.alias(f"__{field}") for field, c in chosen.items()])
    parts = [F.col(f"`__{field}`") for field in target]
    taken = F.array_compact(F.array(*[p["name"] for p in parts]))
    known = F.array(*[F.lit(n) for names in aliases.values() for n in names])
    left = F.map_filter("json", lambda k, v: ~F.array_contains(F.col("taken"), k) & (k != "settings") & ((v != "null") | ~F.array_contains(known, k)))
    lone = F.map_filter("json", lambda k, v: (k == "settings") & ~v.startswith("{") & ~v.startswith('"{') & (v != "null"))
    rests = F.map_from_entries(F.filter(F.array(*[F.struct(p["name"], p["rest"]) for p in parts]), lambda e: e["rest"].isNotNull()))
    out = out.withColumn("taken", taken)
    rescued = F.when((F.size(left) + F.size(lone) + F.size(rests)) > 0, F.to_json(F.map_concat(left, lone, rests)))
    typed = [p["typed"].alias(field.replace(".", "_")) for field, p in zip(target, parts)]
    return out.select(*keep, *typed, rescued.alias("_rescued"))


def _chosen(values: dict[str, Column], kind: str, inner: tuple[str, ...]) -> Column:
    """(name, typed, rest): the first of the named JSON texts that takes the type; null if none does.

    Wrapped ones (one-element array, {"value": x} or an ``inner`` member) are
    opened; ``rest`` has, as JSON, what of the wrapping is not in ``typed``.
    An array of which an element would be lost is not taken.
    """
    nothing = F.lit(None).cast("string")
    options = []
    for name, value in values.items():
        members = F.when(value.startswith("{"), F.try_parse_json(value).try_cast("map<string,variant>"))
        ways = [(value, nothing)]
        for m in ("value", *inner):
            ways.append((F.to_json(members[m]), _others(members, m)))
        if not kind.startswith("array"):
            lone = F.when(value.startswith("[") & (F.json_array_length(value) == 1), F.try_parse_json(value).try_cast("array<variant>"))
            ways.append((F.to_json(F.get(lone, F.lit(0))), nothing))
        for text, rest in ways:
            typed = _cast(text, kind)
            options.append(F.when(typed.isNotNull(), F.struct(F.lit(name).alias("name"), typed.alias("typed"), rest.alias("rest"))))
    return F.coalesce(*options)


def _others(members: Column, member: str) -> Column:
    """The other members as JSON, null if there are none."""
    return F.nullif(F.to_json(F.map_filter(members, lambda k, v: k != member), {"ignoreNullFields": "false"}), F.lit("{}"))


def _cast(text: Column, kind: str) -> Column:
    """A JSON text as a value of the type, null if it is none."""
    if kind.startswith("array"):
        cast, each = F.from_json(text, kind), F.from_json(text, "array<string>")
        lost = F.exists(F.arrays_zip(cast.alias("a"), each.alias("b")), lambda p: p["a"].isNull() & p["b"].isNotNull())
        return F.when(text.startswith("[") & ~lost, cast)
    plain = F.when(~text.startswith("{") & ~text.startswith("["), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"))
    return plain if kind == "string" else plain.try_cast(kind)


def field_inventory(lines: DataFrame) -> DataFrame:
    """(feed_id, file_no, field_name, kind, n): which fields a file has, with the type of its non-null values.

    Should a file mix types, the commonest counts, then the first by name.
    """
    placed = lines.filter("feed_id is not null and file_no is not null")
    each = line_fields(placed, "feed_id", "file_no").select("feed_id", "file_no", F.explode("fields").alias("f"))
    kinds = each.groupBy("feed_id", "file_no", F.col("f.name").alias("field_name"), F.col("f.kind").alias("kind")).agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("kind").isNotNull(), F.struct((-F.col("n")).alias("rank"), "kind")))["kind"]
    return kinds.groupBy("feed_id", "file_no", "field_name").agg(best.alias("kind"), F.sum("n").alias("n"))


def _steps(inventory: DataFrame) -> DataFrame:
    """(feed_id, file_no, before): each file with the feed's preceding file.

    Runs of ``RUN_FILES`` numbers are ordered by themselves; only the last
    file of each run meets the other runs of its feed.
    """
    files = inventory.select("feed_id", "file_no", _run().alias("run")).distinct()
    own = Window.partitionBy("feed_id", "run").orderBy("file_no")
    last = files.groupBy("feed_id", "run").agg(F.max("file_no").alias("last"))
    last = last.select("feed_id", "run", F.lag("last").over(Window.partitionBy("feed_id").orderBy("run")).alias("earlier"))
    ordered = files.withColumn("near", F.lag("file_no").over(own)).join(last, ["feed_id", "run"])
    return ordered.select("feed_id", "file_no", F.coalesce("near", "earlier").alias("before"))


def _run() -> Column:
    return F.floor(F.col("file_no") / RUN_FILES)


def _with_known_kind(inventory: DataFrame) -> DataFrame:
    """``known_kind``: the type of the field's latest values up to the file, in runs as above."""
    rows = inventory.withColumn("run", _run())
    own = Window.partitionBy("feed_id", "field_name", "run").orderBy("file_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("file_no")))
    runs = rows.groupBy("feed_id", "field_name", "run").agg(latest.alias("kind"))
    earlier = Window.partitionBy("feed_id", "field_name").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("feed_id", "field_name", "run", F.last("kind", ignorenulls=True).over(earlier).alias("earlier"))
    ordered = rows.withColumn("near", F.last("kind", ignorenulls=True).over(own)).join(runs, ["feed_id", "field_name", "run"])
    return ordered.withColumn("known_kind", F.coalesce("near", "earlier")).drop("near", "earlier", "run")


def content_profile(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(feed_id, file_no, field_name, token, weight): what values look like.

    Values are opened if wrapped, then cut into words; words with digits stand
    for their shape, so running names and ids become alike. A numeric value
    counts as itself, as its number of decimals and as its size in powers of ten.
    ``weight`` is the share of the field's values that have the token.
    """
    # only files with a wanted field are read again, and only wanted fields go on
    files = wanted.groupBy("feed_id", "file_no").agg(F.collect_set("field_name").alias("names"))
    each = line_fields(lines.join(files, ["feed_id", "file_no"]), "feed_id", "file_no", "names")
    asked = F.filter("fields", lambda f: F.array_contains(F.col("names"), f["name"]) & (f["value"] != "null"))
    each = each.select("feed_id", "file_no", F.explode(asked).alias("f")).select("feed_id", "file_no", F.col("f.name").alias("field_name"), F.col("f.value").alias("value"))
    opened = F.expr(
        "coalesce(CASE WHEN value LIKE '{%' THEN get_json_object(value, '$.value') END, "
        "CASE WHEN value LIKE '[%' AND get_json_object(value, '$[1]') IS NULL THEN get_json_object(value, '$[0]') END, "
        "get_json_object(concat('{\"v\":', value, '}'), '$.v'))"
    )
    shape = "regexp_replace(w, '^(?=.*[0-9]).*$', concat('#', CASE WHEN length(w) > 4 THEN 'id' ELSE 'n' END))"
    words = f"transform(filter(split(lower(v), '[^a-z0-9]+'), w -> w <> ''), w -> {shape})"
    number = (
        "array(concat('=', cast(v AS double)), concat('decimals:', length(regexp_extract(v, '[.]([0-9]+)$', 1))), "
        "concat('size:', CASE WHEN abs(cast(v AS double)) <= 1 THEN 'unit' ELSE cast(floor(log10(abs(cast(v AS double)))) AS string) END))"
    )
    boxes = "array('box', concat('parts:', size(split(v, ','))))"
    tokens = F.expr(
        f"array_distinct(CASE WHEN try_cast(v AS double) IS NOT NULL THEN {number} WHEN v LIKE '[%' THEN {boxes} "
        f"WHEN v LIKE '{{%' THEN concat(array('object'), transform(json_object_keys(v), k -> concat('key:', k))) ELSE {words} END)"
    )
    keys = ["feed_id", "file_no", "field_name"]
    spoken = each.withColumn("v", opened).filter("v is not null").select(*keys, tokens.alias("tokens"))
    counted = spoken.select(*keys, F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("c"))
    total = F.max(F.when(F.col("token") == "", F.col("c"))).over(Window.partitionBy(*keys))
    return counted.withColumn("weight", F.col("c") / total).filter("token <> ''").drop("c")


def schema_changes(lines: DataFrame, same_content: float = SAME_CONTENT, like_content: float = LIKE_CONTENT) -> DataFrame:
    """(feed_id, file_no, change_kind, field_name, old_name) against the preceding file."""
    inventory = cut(field_inventory(lines))
    inventory = _with_known_kind(inventory)
    steps = _steps(inventory)
    # each field as of a file, laid beside the same field as of the file before
    now = inventory.join(steps.filter("before is not null"), ["feed_id", "file_no"]).select("feed_id", "file_no", "field_name", F.col("known_kind").alias("kind"))
    old = inventory.join(steps.filter("before is not null").select("feed_id", F.col("file_no").alias("at"), F.col("before").alias("file_no")), ["feed_id", "file_no"])
    old = old.select("feed_id", F.col("at").alias("file_no"), "field_name", F.col("known_kind").alias("old_kind"), F.col("file_no").alias("before"))
    both = now.withColumn("here", F.lit(True)).join(old.withColumn("there", F.lit(True)), ["feed_id", "file_no", "field_name"], "full_outer")
    kind = (
        F.when(F.col("there").isNull(), "added")
        .when(F.col("here").isNull(), "removed")
        .when(F.col("kind") != F.col("old_kind"), "retyped")
    )
    changed = both.withColumn("change_kind", kind).filter("change_kind is not null").select("feed_id", "file_no", "field_name", "change_kind", "before")
    changed = cut(changed)

    pairs = cut(_renames(lines, changed, same_content, like_content))
    gone = pairs.select("feed_id", "file_no", F.explode(F.array(F.struct(F.lit("added").alias("change_kind"), F.col("field_name")),
                                                                F.struct(F.lit("removed").alias("change_kind"), F.col("old_name").alias("field_name")))).alias("g"))
    plain = changed.join(gone.select("feed_id", "file_no", "g.*"), ["feed_id", "file_no", "change_kind", "field_name"], "left_anti")
    plain = plain.select("feed_id", "file_no", "change_kind", "field_name", F.lit("").alias("old_name"))
    renamed = pairs.select("feed_id", "file_no", F.lit("renamed").alias("change_kind"), "field_name", "old_name")
    return plain.unionByName(renamed)


def _renames(lines: DataFrame, changed: DataFrame, same_content: float, like_content: float) -> DataFrame:
    """(feed_id, file_no, field_name, old_name): pairs alike in content, best first, each name once."""
    level = F.when(F.col("field_name").startswith("settings."), "inner").otherwise("top")
    came = changed.filter("change_kind = 'added'").select("feed_id", "file_no", "field_name", level.alias("level"))
    went = changed.filter("change_kind = 'removed'").select("feed_id", "file_no", "before", "field_name", level.alias("level"))
    step = ["feed_id", "file_no", "level"]
    came = came.join(went.select(*step).distinct(), step, "left_semi")
    went = went.join(came.select(*step).distinct(), step, "left_semi")
    wanted = came.select("feed_id", "file_no", "field_name").unionByName(went.select("feed_id", F.col("before").alias("file_no"), "field_name"))
    profile = content_profile(lines, wanted.distinct())
    field = Window.partitionBy("feed_id", "file_no", "field_name")
    common = (F.col("weight") >= ALL_VALUES).cast("int")
    profile = profile.select(
        "feed_id", "file_no", "field_name", "token", (F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(field))).alias("unit"),
        common.alias("common"), F.sum(common).over(field).alias("commons"),
    )
    profile = cut(profile)  # it stands on both sides of the pairs
    sides = ["unit", "common", "commons"]
    new = came.join(profile, ["feed_id", "file_no", "field_name"]).withColumnsRenamed({c: f"{c}_new" for c in sides})
    old = went.join(profile.withColumnRenamed("file_no", "before"), ["feed_id", "before", "field_name"])
    old = old.select(*step, F.col("field_name").alias("old_name"), "token", *[F.col(c).alias(f"{c}_old") for c in sides])
    at_one = lambda c: F.sum(f"common_{c}") == F.first(f"commons_{c}")
    like = new.join(old, [*step, "token"]).groupBy("feed_id", "file_no", "field_name", "old_name").agg(
        F.sum(F.col("unit_new") * F.col("unit_old")).alias("like"), (at_one("new") & at_one("old")).alias("at_one")
    )
    like = like.filter((F.col("like") >= same_content) | (F.col("at_one") & (F.col("like") >= like_content))).drop("at_one")
    like = like.withColumn("order", F.struct((-F.round("like", 6)).alias("d"), "field_name", "old_name"))
    like = cut(like)
    # the best pair of both names is taken; what is then still free is matched again
    taken, free = [], like
    while not free.isEmpty():
        best = free.withColumn("a", F.min("order").over(Window.partitionBy("feed_id", "file_no", "field_name"))).withColumn(
            "b", F.min("order").over(Window.partitionBy("feed_id", "file_no", "old_name"))
        )
        won = cut(best.filter("order = a and order = b").select("feed_id", "file_no", "field_name", "old_name"))
        taken.append(won)
        free = cut(
            free.join(won.select("feed_id", "file_no", "field_name"), ["feed_id", "file_no", "field_name"], "left_anti").join(
                won.select("feed_id", "file_no", "old_name"), ["feed_id", "file_no", "old_name"], "left_anti"
            )
        )
    return reduce(DataFrame.unionByName, taken, like.select("feed_id", "file_no", "field_name", "old_name").limit(0))


def promoted_names(lines: DataFrame, changes: DataFrame) -> dict[str, dict[str, str]]:
    """Per record type: further spelling -> target field, from the renames that were found.

    A name stands for the target field it was most often renamed from or to,
    over names already promoted if need be; of equal ones the first by name. Only
    counts per pair of names come to the driver, which must name every column of
    a schema anyway; more than ``MAX_PAIRS`` of them are an error.
    """
    feeds = lines.select("feed_id", "record_type").distinct()
    pairs = changes.filter("change_kind = 'renamed'").join(feeds, "feed_id").groupBy("record_type", "field_name", "old_name").agg(F.count("*").alias("n"))
    rows = pairs.limit(MAX_PAIRS + 1).collect()
    if len(rows) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of renamed fields")
    found: dict[str, dict[str, str]] = {}
    for kind, target in TARGETS.items():
        links: dict[str, Counter[str]] = {}
        for r in rows:
            if r["record_type"] == kind:
                for a, b in ((r["field_name"], r["old_name"]), (r["old_name"], r["field_name"])):
                    links.setdefault(a, Counter())[b] += r["n"]
        stands = {t: t for t in target}
        while True:
            votes = {a: Counter() for a in links if a not in stands}
            for a, own in votes.items():
                for b, n in links[a].items():
                    if b in stands:
                        own[stands[b]] += n
            new = {a: min(own, key=lambda t: (-own[t], t)) for a, own in votes.items() if own}
            if not new:
                break
            stands |= new
        found[kind] = {a: t for a, t in sorted(stands.items()) if a != t}
    return found
