"""Same or near-same records across splits.

Method: distinct evaluation texts are spread over shards; each shard holds a
compressed full-text index of its texts. The distinct training texts that may
be in the shard are streamed through backward search, which gives their
matches; the spans of a pair of texts are merged and their bytes counted. Equal
texts are one text with many members, so a group of copies costs one search.

Pictures are compared by their names as written (in lower case), with the
common spelling of category and defect type behind them. Day, time and number
are searched backward as one run of digits, branching where writers put
separators or leading zeros; station, view and the two values are further
spans. Two pictures show one capture if the spans cover every byte with which
the training name says these.

Defined cases: rows without split, id or path take no part; a row delivered
twice counts once; empty tables give an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.paths import file_stem
from tesserae.llm.fm_index import FMIndex
from tesserae.session import broadcast_if_small, cut

#: Distinct evaluation texts one index holds, and training texts streamed at it in one task, about.
SHARD_TEXTS = 20_000
#: Least bytes of a maximal match of texts without fields.
LEAST_MATCH = 24
#: Training texts of one batch of backward searches.
BATCH = 20_000
#: Places of moments compared at once, about: many stations may share a moment.
PLACES = 500_000


def shard_overlaps(evaluation: DataFrame, training: DataFrame, least: int = LEAST_MATCH, find=None) -> DataFrame:
    """(text_e, text_t, matched, spans, whole) of distinct texts that share spans.

    Both sides are (route, text) with distinct texts; texts of a pair asked for
    have equal routes, and few texts have the same. ``matched`` is the number of
    bytes of the training text covered by merged spans, ``spans`` their number,
    ``whole`` the number of bytes that could be. ``find(known, asked)`` yields
    the spans; without it they are maximal matches of at least ``least`` bytes.
    """
    sizes = evaluation.count(), training.count()
    shards = max(1, math.ceil(max(sizes) / SHARD_TEXTS))
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int").alias("shard")
    find = find or (lambda known, asked: _verbatim(known, asked, least))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(left["text"].tolist(), right["text"].tolist(), find)

    # the alias tells the sides apart if both come from one table; a given number of partitions stays as it is, so that small shards are not put into one task
    ev, tr = [side.select(shard, F.col("text").alias("text")).repartition(shards, "shard").groupBy("shard") for side in (evaluation, training)]
    return ev.cogroup(tr).applyInPandas(search, "text_e string, text_t string, matched int, spans int, whole int")


def _search(known: list[str], asked: list[str], find) -> pd.DataFrame:
    parts = []
    if known and asked:
        for spans, sayable in find([t.encode() for t in known], [t.encode() for t in asked]):
            whole = _merged(sayable.assign(e=0)).set_index("q")["matched"]
            merged = _merged(spans)
            parts.append(merged.assign(whole=merged["q"].map(whole)))
    found = pd.concat(parts) if parts else pd.DataFrame(columns=["q", "e", "matched", "spans", "whole"])
    texts = {"text_e": [known[i] for i in found["e"]], "text_t": [asked[i] for i in found["q"]]}
    return pd.DataFrame({**texts, **{c: found[c].to_numpy("int32") for c in ("matched", "spans", "whole")}})


def _merged(spans: pd.DataFrame) -> pd.DataFrame:
    """(q, e, matched, spans): bytes covered by the merged spans of a pair, and how many are left."""
    spans = spans.drop_duplicates().sort_values(["q", "e", "start"])
    reach = spans.groupby(["q", "e"])["stop"].cummax().groupby([spans["q"], spans["e"]]).shift(fill_value=0)
    spans["new"] = (spans["stop"] - np.maximum(spans["start"], reach)).clip(lower=0)
    spans["apart"] = (spans["start"] >= reach).astype("int32")
    return spans.groupby(["q", "e"], as_index=False).agg(matched=("new", "sum"), spans=("apart", "sum"))


def _verbatim(known: list[bytes], asked: list[bytes], least: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Maximal matches that end where a word ends, and whole texts as what can match."""
    index = FMIndex(known)
    for first in range(0, len(asked), BATCH):
        chunk = asked[first : first + BATCH]
        ends = [np.array([*(m.end() for m in re.finditer(rb"[a-z0-9]+", t) if least <= m.end() < len(t)), len(t)], np.int64) for t in chunk]
        query, start, stop, low, high = index.maximal_matches(chunk, ends, least)
        match, text = index.texts_of(low, high)
        spans = pd.DataFrame({"q": query[match] + first, "e": text, "start": start[match], "stop": stop[match]})
        yield spans, pd.DataFrame({"q": np.arange(len(chunk)) + first, "start": 0, "stop": [len(t) for t in chunk]})


# --- names of pictures ---------------------------------------------------------------------------------------------

_STATION = r"(?:^|[^a-z0-9])(st0*)(\d+)(?=[^0-9]|$)"
_VIEW = r"(?:^|[^a-z0-9])(v0*)(\d+)(?=[^0-9]|$)"
_MOMENT = r"(?:^|[^0-9])((?:19|20)\d\d)[-_. ]?([01]\d)[-_. ]?([0-3]\d)[-_. t]+([0-2]\d)[-_.: ]?([0-5]\d)[-_.: ]?([0-5]\d)[-_. ]+0*(\d+)(?=[^0-9]|$)"


#: What may stand between the digits of a capture's day, time and number, by the digits left of it (see ``_MOMENT``).
_GAPS = {14: [(b"0", True, True), (b"-_. ", True, False)], 8: [(b"-_. t", True, False)]}
_GAPS |= {at: [(b"-_.: ", False, True)] for at in (12, 10)} | {at: [(b"-_. ", False, True)] for at in (6, 4)}
#: Ends a name, before the spellings of its values.
_NAME_END = "\n"
#: Bytes the index keeps for itself; in a name they are as good as any other separator.
_RESERVED = bytes([2, 2, *range(2, 256)])


def capture_moment(name: Column) -> Column:
    """Digits of day, time and number in a lower-case name: ``2024012706574424686``; null where it does not say them."""
    digits = F.regexp_replace(F.regexp_extract(name, _MOMENT, 0), r"[^0-9]+", "")
    number = lambda d: F.regexp_replace(F.substring(d, 15, 1 << 30), r"^0+(?=\d)", "")
    # named, so that it is computed once
    return F.transform(F.array(digits), lambda d: F.when(d != "", F.concat(F.substring(d, 1, 14), number(d))))[0]


_PATTERNS = [re.compile(p.encode()) for p in (_MOMENT, _STATION, _VIEW)]


def _fields(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(texts that say all, spans of moment, station, view and values in each, digits of its moment).

    A span is (start, where what counts begins, stop): letters and leading
    zeros belong to station and view, so none lies within another.
    """
    at, spans, moments = [], [], []
    for i, text in enumerate(texts):
        end = text.rindex(_NAME_END.encode())
        moment, station, view = [p.search(text, 0, end) for p in _PATTERNS]
        if moment and station and view:
            at.append(i)
            letters = [(m.start(1), m.start(2), m.end(2)) for m in (station, view)]
            spans.append([(moment.start(1), moment.start(1), moment.end(7)), *letters, (end + 1, end + 1, len(text))])
            moments.append(b"".join(moment.groups()))
    return np.array(at, np.int64), np.array(spans, np.int64).reshape(-1, 4, 3), moments


def _captures(known: list[bytes], asked: list[bytes]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Spans in which names say the same of a capture, and all spans in which the asked names say it.

    The moment is found anywhere in the indexed names and must be the one its
    name says; other spans are looked for in the names found by it.
    """
    known, asked = [[t.translate(_RESERVED) for t in side] for side in (known, asked)]
    (known_at, own, _), (asked_at, said, moments) = _fields(known), _fields(asked)
    if not len(known_at):
        return
    index = FMIndex([known[i] for i in known_at], own[:, 1:, 1])
    for first in range(0, len(asked_at), BATCH):
        query, *ways = index.gapped_matches(moments[first : first + BATCH], _GAPS)
        portion = np.cumsum(ways[1] - ways[0]) // PLACES
        for some in (portion == p for p in np.unique(portion)):
            low, high, size = [w[some] for w in ways]
            match, e, offset = index.places_of(low, high)
            there = (offset == own[e, 0, 0]) & (offset + size[match] == own[e, 0, 2])
            q, e = query[some][match[there]] + first, e[there]
            if len(q):
                yield _spans(index, asked, asked_at, known_at, own, said, q, e)


def _spans(index: FMIndex, asked: list[bytes], asked_at, known_at, own, said, q, e) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The frames of ``_captures`` for names q and e of one moment each."""
    found = [(q, e, said[q, 0])]
    for field in (1, 2, 3):
        _, core, stop = said[q, field].T
        which, pieces = pd.factorize(np.array([asked[i][a:b] for i, a, b in zip(asked_at[q], core, stop)], object))
        rows = np.zeros((2, len(pieces)), np.int64)
        piece, begin, _, low, high = index.maximal_matches(list(pieces), [np.array([len(p)]) for p in pieces], 1)
        rows[:, piece[begin == 0]] = low[begin == 0], high[begin == 0]
        row = index.mark_rows[e, field - 1]
        same = (rows[0, which] <= row) & (row < rows[1, which]) & (stop - core == own[e, field, 2] - own[e, field, 1])
        found.append((q[same], e[same], said[q[same], field]))
    q, e, span = [np.concatenate(c) for c in zip(*found)]
    every = np.unique(q)
    sayable = pd.DataFrame({"q": np.repeat(asked_at[every], 4), "start": said[every, :, 0].ravel(), "stop": said[every, :, 2].ravel()})
    return pd.DataFrame({"q": asked_at[q], "e": known_at[e], "start": span[:, 0], "stop": span[:, 2]}), sayable


def plain_spelling(value: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def canonical_values(df: DataFrame, *columns: str) -> DataFrame:
    """(column, raw, canonical): every spelling of the columns' values and what it stands for.

    Spellings are reduced to letters and digits. One that is a plural, or one
    typing slip (a letter added, lost, changed or two swapped), away from
    commoner ones of its column stands for the commonest of these. Spellings
    one slip apart share a text with one letter taken out, so they meet in an
    equi-join of these texts; no pair of spellings is formed beyond that.
    """
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("raw")) for c in columns]))
    counts = df.select(named.alias("s")).groupBy("s.column", "s.raw").agg(F.count("*").alias("n")).filter("raw is not null")
    counts = cut(counts.withColumn("plain", plain_spelling(F.col("raw"))))
    plain = counts.groupBy("column", "plain").agg(F.sum("n").alias("n")).filter("plain <> ''")
    cuts = F.expr(
        "array_distinct(concat(array(plain), transform(sequence(1, length(plain)), i -> concat(substring(plain, 1, i - 1), substring(plain, i + 1))),"
        " CASE WHEN plain LIKE '%es' THEN array(substring(plain, 1, length(plain) - 2)) ELSE array() END))"
    )
    keyed = plain.withColumn("key", F.explode(cuts))
    other = keyed.select("column", "key", F.col("plain").alias("other"), F.col("n").alias("m"))
    swapped = "(length(plain) = length(other) AND levenshtein(plain, other) = 2 AND array_sort(split(plain, '')) = array_sort(split(other, '')))"
    near = f"(levenshtein(plain, other) <= 1 OR {swapped} OR plain = concat(other, 'es'))"
    pairs = keyed.join(other, ["column", "key"]).filter("m > 2 * n AND plain <> other").filter(near).select("column", "plain", "other", "m").distinct()
    best = pairs.groupBy("column", "plain").agg(F.max(F.struct("m", "other"))["other"].alias("better"))
    return counts.join(best, ["column", "plain"], "left").select("column", "raw", F.coalesce("better", "plain").alias("canonical"))


def capture_rows(samples: DataFrame) -> DataFrame:
    """(sample_id, side, split, source, image_path, route, text) of samples that take part; side e or t.

    ``text`` is the picture's name as written, in lower case, with the common
    spellings of its category and type behind it; ``route`` is its moment.
    """
    rows = samples.filter("split in ('adaptation', 'held_out', 'locked') and image_path is not null and sample_id is not null")
    rows = cut(rows.select("sample_id", "category", "defect_type", "split", "source", "image_path").dropDuplicates(["sample_id"]))
    # spellings are few beside rows, but not bounded: counted before they are broadcast
    known = cut(canonical_values(rows, "category", "defect_type"))
    count = known.count()
    for column, short in (("category", "c"), ("defect_type", "d")):
        own = known.filter(F.col("column") == column).select(F.col("raw").alias(column), F.col("canonical").alias(short))
        rows = rows.join(broadcast_if_small(own, count), column)
    side = F.when(F.col("split") == "adaptation", "t").otherwise("e")
    # inlined, so that the filter does not compute them a second time
    said = F.transform(F.array(F.lower(file_stem(F.col("image_path")))), lambda n: F.struct(n.alias("name"), capture_moment(n).alias("route")))
    rows = rows.select("sample_id", side.alias("side"), "split", "source", "image_path", "c", "d", F.inline(said)).filter("route is not null")
    text = F.concat("name", F.lit(_NAME_END), "c", F.lit("|"), "d", F.lit("|"))
    return cut(rows.select("sample_id", "side", "split", "source", "image_path", "route", text.alias("text")))


def same_captures(rows: DataFrame) -> DataFrame:
    """(text_e, text_t) of names on both sides that say one capture, as found by the index."""
    texts = cut(rows.select("side", "route", "text").distinct())
    found = shard_overlaps(*[texts.filter(F.col("side") == s).select("route", "text") for s in "et"], find=_captures)
    return cut(found.filter("matched = whole").select("text_e", "text_t"))


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.filter(F.col("side") == side).withColumnRenamed("text", f"text_{side}").drop("side")


def capture_overlaps(samples: DataFrame) -> DataFrame:
    """(sample_id_a, sample_id_b): pairs of samples of one capture across splits."""
    rows = capture_rows(samples)
    ids = rows.select("side", "text", "sample_id")
    pairs = same_captures(rows).join(_side(ids, "e").withColumnRenamed("sample_id", "e"), "text_e").join(_side(ids, "t").withColumnRenamed("sample_id", "t"), "text_t")
    return pairs.select(F.least("e", "t").alias("sample_id_a"), F.greatest("e", "t").alias("sample_id_b"))


def overlap_report(samples: DataFrame) -> DataFrame:
    """(split_e, source_e, source_t, n_pairs, n_same_path) from counts per name, without writing out any pair."""
    rows = capture_rows(samples)
    same = same_captures(rows)
    keys, one = ["split", "source"], F.count("*").alias("n")
    name = {"split": "split_e", "source": "source_e"}
    e = _side(rows.groupBy("side", "text", *keys).agg(one), "e").withColumnsRenamed({**name, "n": "ne"})
    t = _side(rows.groupBy("side", "text", "source").agg(one), "t").withColumnsRenamed({"source": "source_t", "n": "nt"})
    pairs = same.join(e, "text_e").join(t, "text_t").select("split_e", "source_e", "source_t", (F.col("ne") * F.col("nt")).alias("pairs"), F.lit(0).alias("same"))
    e = _side(rows.groupBy("side", "text", "image_path", *keys).agg(one), "e").withColumnsRenamed({**name, "n": "ne"})
    t = _side(rows.groupBy("side", "text", "image_path", "source").agg(one), "t").withColumnsRenamed({"source": "source_t", "n": "nt"})
    alike = same.join(e, "text_e").join(t, ["text_t", "image_path"]).select("split_e", "source_e", "source_t", F.lit(0).alias("pairs"), (F.col("ne") * F.col("nt")).alias("same"))
    return pairs.unionByName(alike).groupBy("split_e", "source_e", "source_t").agg(F.sum("pairs").alias("n_pairs"), F.sum("same").alias("n_same_path"))
