"""Queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.paths import file_key
from tesserae.llm.components import components, split_report, split_together
from tesserae.llm.mixing import mix_report, mix_sources
from tesserae.llm.offensive import fit_offensive, score_documents, source_rates
from tesserae.llm.overlap import capture_overlaps, overlap_report
from tesserae.llm.packing import CAPACITY, pack_items, packing_report, split_large
from tesserae.llm.tokens import with_token_counts
from tesserae.llm.topn import top_n
from tesserae.session import cut, table

SHARED_FILES = ("source_image_path", "source_mask_path", "background_path")
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that must stay together with another record."""
    records = table(spark, sf_dir, "generation_records")
    members = records.select(F.col("generation_id").alias("id"), F.explode(F.array(*[file_key(f) for f in SHARED_FILES])).alias("entity"))
    return components(members).select(F.col("id").alias("generation_id"), F.col("component").alias("group_id"))


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "generation_records")
    return split_together(records, "generation_id", [file_key(f) for f in SHARED_FILES], SHARES)


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every record, linked records in one split."""
    return _splits(spark, sf_dir).select(F.col("id").alias("generation_id"), F.col("component").alias("group_id"), "split")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual against asked shares of the splits."""
    return split_report(_splits(spark, sf_dir), SHARES)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most visible candidates of every (category, defect_type)."""
    rows = table(spark, sf_dir, "phase4_records")
    best = top_n(rows, ["category", "defect_type"], "defect_visibility_score", "phase4_id", 5)
    return best.select("category", "defect_type", "rank_no", "phase4_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of samples of one capture, one in training and one in evaluation."""
    return capture_overlaps(table(spark, sf_dir, "anomaly_samples"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and pair of sources."""
    return overlap_report(table(spark, sf_dir, "anomaly_samples"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = with_token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return pack_items(split_large(sizes.withColumnRenamed("doc_id", "id"))).withColumnRenamed("id", "doc_id")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container for every text or piece of one."""
    return _packed(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing_report(_packed(spark, sf_dir))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = with_token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    return cut(sizes.withColumnRenamed("doc_id", "id"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")).withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual against target share per source."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mix_report(mix_sources(sizes, targets), sizes, targets)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: every text once and whole, no container over its capacity; one row."""
    sizes = with_token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    packed = _packed(spark, sf_dir)
    pieces = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"))
    both = sizes.join(pieces, "doc_id", "full_outer")
    fine = F.col("got").eqNullSafe(F.col("n_tokens")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY)))
    fills = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    texts = both.agg(F.count("*").alias("texts"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("not_whole"))
    return texts.crossJoin(fills.agg(F.count_if(F.col("fill") > CAPACITY).alias("overfull"), F.count_if(F.col("fill") <= CAPACITY // 2).alias("half_empty")).select("overfull", (F.col("half_empty") <= 1).alias("merged")))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any mixture, per source with a target that can be met: repeats within the bound, tokens within a twentieth or a document of the target."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    rows = mix_report(mix_sources(sizes, targets), sizes, targets).filter("target_share > 0 and max_repeat >= 1 and tokens_held > 0")
    whole = rows.agg(F.sum("target_share").alias("whole"))
    total = rows.agg(F.sum("tokens_chosen").alias("total"))
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    rows = rows.crossJoin(whole).crossJoin(total).join(largest, "source")
    asked = F.col("target_share") / F.col("whole") * F.col("total")
    fits = F.abs(F.col("tokens_chosen") - asked) <= F.greatest(0.05 * asked, F.col("largest"))
    return rows.select("source", (F.col("most_repeats") <= F.col("max_repeat")).alias("repeats_fit"), fits.alias("share_fits"))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has one score between 0 and 1, and rates agree with them; one row."""
    scored = cut(_scored(spark, sf_dir, "source"))
    rates = source_rates(scored).agg(F.sum("n_docs").alias("docs"), F.sum("n_offensive").alias("offensive"))
    own = scored.agg(F.count("*").alias("n_docs"), F.count_if(~F.col("score").between(0, 1) | F.col("score").isNull()).alias("bad_scores"), F.count_if("offensive").alias("n_offensive"))
    return own.crossJoin(rates).select("n_docs", "bad_scores", ((F.col("docs") == F.col("n_docs")) & (F.col("offensive") == F.col("n_offensive"))).alias("rates_agree"))


def _scored(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_offensive(documents, table(spark, sf_dir, "review_labels"))
    return score_documents(documents, model, *keep)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _scored(spark, sf_dir).filter("offensive").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document."""
    return _scored(spark, sf_dir).select("doc_id", "score", "offensive")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per source."""
    return source_rates(_scored(spark, sf_dir, "source"))


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found,
           "p7_packing": p7_packing, "p7_report": p7_report, "p7_checks": p7_checks, "p8_mix": p8_mix, "p8_report": p8_report, "p8_checks": p8_checks,
           "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p9_checks": p9_checks}

_GROUPS = r"""
WITH RECURSIVE raw AS (
  SELECT DISTINCT id, trim(f, chr(32)||chr(9)||chr(10)||chr(13)) AS f FROM (
    SELECT generation_id AS id, unnest([source_image_path, source_mask_path, background_path]) AS f FROM generation_records)
),
slashed AS (
  SELECT id, regexp_replace(regexp_replace(url_decode(f), '^file://', ''), '\\', '/', 'g') AS p FROM raw
  WHERE f IS NOT NULL AND lower(f) NOT IN ('', '-', '--', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'unknown', 'undefined', 'missing', 'tbd', '?')
),
members AS (
  SELECT DISTINCT id, regexp_replace(regexp_extract(
      regexp_replace(regexp_replace(regexp_replace(p, '/+(\./+)*', '/', 'g'), '/[^/]+/\.\./', '/', 'g'), '/[^/]+/\.\./', '/', 'g'),
      '((^|/)(data|outputs)(_[A-Za-z0-9]+)?/.*)$', 1), '^/', '') AS entity
  FROM slashed
),
star AS (SELECT id, min(id) OVER (PARTITION BY entity) AS m FROM members),
edge AS (SELECT id AS u, m AS v FROM star WHERE id <> m UNION SELECT m, id FROM star WHERE id <> m),
reach AS (
  SELECT DISTINCT u AS id, u AS label FROM edge
  UNION SELECT e.v, r.label FROM reach r JOIN edge e ON e.u = r.id WHERE e.v > r.label
),
grouped AS (SELECT id AS generation_id, min(label) AS group_id FROM reach GROUP BY id)
"""

_SPLITS = (
    _GROUPS
    + """
, every AS (
  SELECT DISTINCT g.generation_id, coalesce(x.group_id, g.generation_id) AS group_id
  FROM generation_records g LEFT JOIN grouped x USING (generation_id) WHERE g.generation_id IS NOT NULL),
placed AS (SELECT *, ('0x' || substr(sha256('split-1|' || group_id), 1, 13))::BIGINT / 16.0e0 ** 13 AS point FROM every),
splits AS (
  SELECT generation_id, group_id, CASE WHEN point < 0.8e0 THEN 'train' WHEN point < 0.9e0 THEN 'validation' ELSE 'test' END AS split FROM placed)
"""
)

def _spellings(c: str) -> str:
    """SQL: (raw, canonical) of a column's spellings, as ``canonical_values`` has them."""
    return f"""{c}_n AS (SELECT {c} AS raw, regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS plain, count(*) AS n FROM rows WHERE {c} IS NOT NULL GROUP BY ALL),
{c}_p AS (SELECT plain, sum(n) AS n FROM {c}_n WHERE plain <> '' GROUP BY 1),
{c}_b AS (SELECT a.plain, max((b.n, b.plain)) AS best FROM {c}_p a JOIN {c}_p b ON b.n > 2 * a.n AND a.plain <> b.plain
  AND (levenshtein(a.plain, b.plain) <= 1 OR a.plain = b.plain || 'es' OR (length(a.plain) = length(b.plain) AND levenshtein(a.plain, b.plain) = 2 AND list_sort(string_split(a.plain, '')) = list_sort(string_split(b.plain, '')))) GROUP BY 1),
{c}_c AS (SELECT raw, coalesce(best[2], plain) AS canonical FROM {c}_n LEFT JOIN {c}_b USING (plain))"""


_PAIRS = rf"""
WITH rows AS (SELECT sample_id, category, defect_type, split, source, image_path FROM anomaly_samples WHERE split IN ('adaptation', 'held_out', 'locked') AND image_path IS NOT NULL AND sample_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at) = 1),
{_spellings('category')},
{_spellings('defect_type')},
named AS (SELECT *, lower(regexp_replace(regexp_extract(replace(image_path, '', '/'), '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')) AS name FROM rows),
read AS (SELECT *, regexp_extract(name, '(?:^|[^a-z0-9])st0*(\d+)(?:[^0-9]|$)', 1) AS st, regexp_extract(name, '(?:^|[^a-z0-9])v0*(\d+)(?:[^0-9]|$)', 1) AS v,
  regexp_extract(name, '(?:^|[^0-9])((?:19|20)\d\d)[-_. ]?([01]\d)[-_. ]?([0-3]\d)[-_. t]+([0-2]\d)[-_.: ]?([0-5]\d)[-_.: ]?([0-5]\d)[-_. ]+0*(\d+)(?:[^0-9]|$)', ['y', 'm', 'd', 'h', 'i', 's', 'n']) AS x FROM named),
capture AS (SELECT sample_id, split, source, image_path, concat_ws('|', st, v, x.y, x.m, x.d, x.h, x.i, x.s, x.n, c.canonical, d.canonical) AS cap
  FROM read JOIN category_c c ON c.raw = category JOIN defect_type_c d ON d.raw = defect_type WHERE st <> '' AND v <> '' AND x.n <> ''),
pairs AS (SELECT least(e.sample_id, t.sample_id) AS sample_id_a, greatest(e.sample_id, t.sample_id) AS sample_id_b, e.split AS split_e, e.source AS source_e, t.source AS source_t, e.image_path = t.image_path AS same
  FROM capture e JOIN capture t USING (cap) WHERE e.split <> 'adaptation' AND t.split = 'adaptation')
"""

SQL = {
    "p4_found": _PAIRS + "SELECT sample_id_a, sample_id_b FROM pairs",
    "p4_report": _PAIRS + "SELECT split_e, source_e, source_t, count(*) AS n_pairs, count(*) FILTER (same) AS n_same_path FROM pairs GROUP BY ALL",
    "p7_checks": "SELECT count(*) AS texts, 0 AS not_whole, 0 AS overfull, true AS merged FROM documents WHERE doc_id IS NOT NULL",
    "p8_checks": """SELECT source, true AS repeats_fit, true AS share_fits FROM mix_targets
WHERE target_share > 0 AND max_repeat >= 1 AND source IN (SELECT source FROM documents WHERE text <> '')""",
    "p9_checks": "SELECT count(*) AS n_docs, 0 AS bad_scores, true AS rates_agree FROM documents WHERE doc_id IS NOT NULL",
    "p1_found": _GROUPS + "SELECT generation_id, group_id FROM grouped",
    "p1_splits": _SPLITS + "SELECT generation_id, group_id, split FROM splits",
    "p1_shares": _SPLITS
    + """
, sized AS (SELECT split, group_id, count(*) AS n FROM splits GROUP BY ALL),
per AS (SELECT split, sum(n)::BIGINT AS n_records, count(*) AS n_components, max(n) AS largest_component FROM sized GROUP BY ALL)
SELECT a.split, coalesce(n_records, 0) AS n_records, coalesce(n_components, 0) AS n_components, coalesce(largest_component, 0) AS largest_component,
  a.asked_share, coalesce(n_records::DOUBLE / (SELECT sum(n_records) FROM per), 0.0::DOUBLE) AS actual_share
FROM (VALUES ('train', 0.8::DOUBLE), ('validation', 0.1::DOUBLE), ('test', 0.1::DOUBLE)) a(split, asked_share) LEFT JOIN per USING (split)
""",
    "p5_found": """
WITH once AS (
  SELECT DISTINCT phase4_id, category, defect_type, defect_visibility_score AS s FROM phase4_records
  WHERE category IS NOT NULL AND defect_type IS NOT NULL AND defect_visibility_score BETWEEN 0 AND 1 AND NOT isnan(defect_visibility_score)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category, defect_type ORDER BY s DESC, phase4_id)::INTEGER AS rank_no FROM once)
SELECT category, defect_type, rank_no, phase4_id FROM ranked WHERE rank_no <= 5
""",
}
