"""Names, urls and file slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def app_name(url: Column) -> Column:
    """The last segment of a url."""
    return F.element_at(F.split(url, "/"), -1)


def latest_version(versions: Column) -> Column:
    """The first entry of the first pair; the list is trusted to be newest first. 'unknown' where there is none."""
    return F.coalesce(F.get(F.get(versions, F.lit(0)), F.lit(0)), F.lit("unknown"))


def missing_as_null(x: Column) -> Column:
    """Empty strings count as missing."""
    return F.when(x != "", x)


def display_name(name: Column, url: Column, node_id: Column) -> Column:
    """A node's name, else the last segment of its url, else its id; empty counts as missing."""
    return F.coalesce(missing_as_null(name), missing_as_null(app_name(url)), node_id)


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def title(text: Column) -> Column:
    """Each letter that follows no letter in upper case, each other one in lower case (initcap only looks at spaces)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    after = F.zip_with(F.concat(F.array(F.lit("")), F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0)))), chars, lambda before, c: F.when(before.rlike(r"^\p{L}$"), F.lower(c)).otherwise(F.upper(c)))
    return F.when(F.length(text) > 0, F.array_join(after, "")).otherwise(text)


def pipeline_title(file_name: Column) -> Column:
    """The listed name of a pipeline file: without its ending, '_' as space, in title case. It does not undo slug()."""
    return title(F.replace(F.regexp_replace(file_name, r"\.yaml$", ""), F.lit("_"), F.lit(" ")))


def url_join(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def session_stamp(prefix: str, at: Column) -> Column:
    """A session id from a time in milliseconds."""
    return F.concat(F.lit(prefix), F.unix_millis(at).cast("string"))
