"""Manifests of files and the difference between two, releases, and integrity attributes of pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.digests import integrity


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """(sha256, path) of the lines that have that form."""
    form = r"^([0-9a-f]{64})  (.+)$"
    return lines.where(F.col(line).rlike(form)).select(F.regexp_extract(line, form, 1).alias("sha256"), F.regexp_extract(line, form, 2).alias("path"))


def compare(published: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): match, mismatch, missing (published only) or extra (found only)."""
    a = published.select("path", F.col("sha256").alias("a"))
    b = found.select("path", F.col("sha256").alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "match").otherwise("mismatch")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def new_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings that a cleaned copy no longer has."""
    keys = ["path", "section", "name", "value"]
    return before.join(after.select(*keys), keys, "left_anti")


def references(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, tag, ref, external) of scripts and links in pages."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"<((?:script|link)\b[^>]*?\s(?:src|href)=\"[^\"]+\")"), F.lit(1))
    each = pages.select(key, F.explode(tags).alias("t"))
    ref = F.regexp_extract("t", r"\s(?:src|href)=\"([^\"]+)\"", 1)
    return each.select(key, F.regexp_extract("t", r"^(\w+)", 1).alias("tag"), ref.alias("ref"), ref.rlike("^(?:https?:|//)").alias("external"))


def listing(paths: DataFrame) -> DataFrame:
    """(path, place) of the files of a release, each once: rows (path, rank) of several lists, in the order of lists and of paths in them."""
    first = paths.groupBy("path").agg(F.min("rank").alias("rank"))
    return first.select("path", F.struct("rank", "path").alias("place"))


def release(tool: str, version: str, built: str, files: DataFrame) -> DataFrame:
    """(order, line) of a release's manifest: a heading, and a line for each row (path, sha256, place) of files in their order."""
    heading = [f"{tool} {version}", f"Built {built}", "", "SHA-256 of the files of this release:", ""]
    place = files.schema["place"].dataType.simpleString()
    order = lambda n, p: F.struct(n.alias("n"), p.cast(place).alias("place"))
    head = files.sparkSession.createDataFrame(list(enumerate(heading)), "n int, line string").select(order(F.col("n"), F.lit(None)).alias("order"), "line")
    return head.unionAll(files.select(order(F.lit(len(heading)), F.col("place")).alias("order"), F.concat("sha256", F.lit("  "), "path").alias("line")))


def normal_path(folder: Column, ref: Column) -> Column:
    """A reference from a folder as a path, without . and .. parts."""
    parts = F.filter(F.split(F.when(folder == "", ref).otherwise(F.concat(folder, F.lit("/"), ref)), "/"), lambda x: (x != "") & (x != "."))
    up = lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


#: A script or link tag with a reference, up to its end.
_REFERRING = r"<(?:script|link)\b[^>]*?\s(?:src|href)=\"[^\"]+\"[^>]*"


def with_integrity(pages: DataFrame, files: DataFrame, key: str = "path", html: str = "html", algorithm: str = "sha384", strict: bool = True) -> DataFrame:
    """(key, html, problems): pages whose script and link tags carry the integrity of the files (path, content) that they refer to.

    A page's references start from its folder. Old integrity attributes go. A reference to another host, or to a file that
    isn't there, is a problem; with ``strict``, any problem fails the query. Pages without references stay as they are.
    """
    folder = F.regexp_replace(F.regexp_extract(F.col(key).cast("string"), "^(.*)/[^/]*$", 1), "^/+", "")
    refs = references(pages.select(key, html), key, html).select(key, "ref", "external").distinct()
    refs = refs.withColumn("target", normal_path(folder, F.col("ref")))
    known = files.select(F.col("path").alias("target"), integrity(F.col("content"), algorithm).alias("integrity"))
    found = refs.join(known, "target", "left")
    problem = F.when(F.col("external"), F.concat(F.lit("refers to another host: "), F.col("ref"))).when(F.col("integrity").isNull(), F.concat(F.lit("refers to no file: "), F.col("ref")))
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat(F.col(key).cast("string"), F.lit(" "), problem)).cast("string"))
    found = found.withColumn("problem", problem)
    by_page = found.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("problem").isNull(), F.struct("ref", "integrity")))).alias("known"),
        F.array_sort(F.collect_set("problem")).alias("problems"),
    )

    @pandas_udf("string")
    def written(pages: pd.Series, known: pd.Series) -> pd.Series:
        def one(page, own):
            own = dict(own) if own is not None else {}

            def tag(m):
                ref = re.search(r"\s(?:src|href)=\"([^\"]+)\"", m[0])[1]
                if ref not in own:
                    return m[0]
                bare = re.sub(r"\s+integrity=\"[^\"]*\"", "", m[0])
                closed = re.search(r"\s*/?$", bare)
                return f'{bare[: closed.start()]} integrity="{own[ref]}"{closed[0]}'

            return None if page is None else re.sub(_REFERRING, tag, page)

        return pd.Series([one(p, k) for p, k in zip(pages, known)], dtype=object)

    out = pages.select(key, html).join(by_page, key, "left")
    nothing = F.array().cast("array<string>")
    return out.select(key, F.when(F.col("known").isNull(), F.col(html)).otherwise(written(F.col(html), F.col("known"))).alias(html), F.coalesce("problems", nothing).alias("problems"))


def violations(events: DataFrame, directive: str = "directive", blocked: str = "blocked") -> DataFrame:
    """(directive, blocked): each pair once; a missing directive is ?, a missing source empty."""
    return events.select(F.coalesce(F.col(directive), F.lit("?")).alias("directive"), F.coalesce(F.col(blocked), F.lit("")).alias("blocked")).distinct()


def finished(files: DataFrame) -> DataFrame:
    """The files that a receipt lists: those that are done without an error."""
    return files.where(F.col("done") & F.col("error").isNull())
