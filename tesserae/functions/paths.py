"""File names as written by many writers, reduced to one name per file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for "no file", compared in lower case after trimming.
STAND_INS = ("", "-", "--", "n/a", "na", "nan", "nil", "none", "null", "unknown", "undefined", "missing", "tbd", "?")

#: Pattern of the directories that names below the project root begin with.
TOP_DIRS = r"(?:data|outputs)(?:_[A-Za-z0-9]+)?"

_EDGE_SPACE = r"^[\s\u00A0\uFEFF\u200B]+|[\s\u00A0\uFEFF\u200B]+$"

# One SQL text instead of some sixty Column calls: building it costs one call,
# and transform(array(x), v -> ...)[0] names a value that is computed once.
# A name that is its own place already (most are) is told by a scan without any rewriting.
_FILE_KEY = r"""
CASE WHEN {value} RLIKE r'^{top_dirs}/[A-Za-z0-9_./ -]*[A-Za-z0-9_]\z' AND NOT contains({value}, '//') AND NOT contains({value}, '/.') THEN {value} ELSE
transform(array(regexp_replace({value}, r'{edge}', '')), t -> CASE WHEN lower(t) NOT IN ({stand_ins}) THEN
  nullif(regexp_replace(transform(array(
    regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(
      CASE WHEN contains(t, '%') THEN coalesce(try_url_decode(replace(t, '+', '%2B')), t) ELSE t END,
      r'^(?i:file:)(//[^/\\]*)?', ''), r'\', '/'),
      r'^/?[A-Za-z]:/', '/'), r'/+(?:\./+)*(?:\.$)?', '/'), r'^(?:\./)+', '')
  ), p -> transform(array(
    CASE WHEN p RLIKE r'(?:^|/)\.\.(?:/|$)' THEN concat('/', array_join(aggregate(split(p, '/'), cast(array() AS array<string>),
      (acc, x) -> CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) ELSE concat(acc, array(x)) END), '/'))
    ELSE p END
  ), q -> CASE WHEN t RLIKE r'^(?i:file:|[a-z]:[\\/])|^[\\/]' THEN regexp_replace(q, r'^/.*?(?<=/)(?={top_dirs}/)', '') ELSE q END)[0])[0],
  r'^/+', ''), '')
END)[0] END
"""


def file_key(value: str, top_dirs: str = TOP_DIRS) -> Column:
    """The place below the project root a written file name leads to, else null.

    ``value`` is a column name or SQL expression. Understands ``file:`` URLs,
    percent escapes, back-slashes, drive letters, absolute names under any
    project root, ``.``, ``..`` and doubled slashes. Letter case and extension
    are kept. Null, blank and stand-ins give null. An absolute name is cut
    before its first directory matching ``top_dirs``; one without such a
    directory is kept from its first segment. ``..`` above the root is dropped.
    """
    named = ", ".join(f"'{x}'" for x in STAND_INS)
    return F.expr(_FILE_KEY.format(value=value, edge=_EDGE_SPACE, stand_ins=named, top_dirs=top_dirs))


def file_name(value: Column) -> Column:
    """Last segment of a path in either slash notation."""
    return F.substring_index(F.translate(value, "\\", "/"), "/", -1)


def file_stem(value: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(value), r"(?<=.)\.[^.]*$", "")


def file_suffix(value: Column) -> Column:
    """Lower-case last extension with its dot, or ''."""
    return F.lower(F.regexp_extract(file_name(value), r".(\.[^.]*)$", 1))


def parent_dir(value: Column) -> Column:
    """Path without its last segment, '' when there is none."""
    return F.regexp_replace(value, r"[/\\]?[^/\\]*$", "")
