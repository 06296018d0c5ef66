"""Boilerplate lines: those on too many of a host's pages are dropped.

Only digests of lines are shuffled, and each task adds up its own lines first, so a line on every page of a
large host costs one row a task. What goes back to the texts is small: the sum of all lines' page ratios is
a page's mean number of lines, so at most (mean lines / ratio) lines of a host can exceed the ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import HOT_KEYS, cut, free_name, join_with_hot, named, own_names, plain_names

#: A line goes if it is on more than this share of a host's pages, and on at least so many of them: on a host of one page every line is on all pages.
MAX_RATIO, MIN_LINE_PAGES = 0.05, 3
#: Most boilerplate lines that are broadcast (about 100 bytes each); beyond it texts are shuffled to their host's lines.
BROADCAST_LINES = 200_000
_EDGES = "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, _EDGES, "")


def _digest(line: Column) -> Column:
    """128 bits of a line, as text: two hashes of different seeds."""
    bare = _bare(line)
    return F.when(bare != "", F.concat_ws(".", F.xxhash64(F.lit(1), bare), F.xxhash64(F.lit(2), bare)))


def _host(name: str) -> Column:
    """A host as a text that is never null: null is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def boilerplate_lines(docs: DataFrame, host_column: str = "source", text_column: str = "text", max_ratio: float = MAX_RATIO, min_line_pages: int = MIN_LINE_PAGES) -> DataFrame:
    """(host, pages, boilerplate: array of line digests) of the hosts that have any; a host is "=" and its name, or empty for null."""
    rows = docs.select(_host(host_column).alias("host"), F.col(text_column).cast("string").alias("text"))
    pages = cut(rows.groupBy("host").agg(F.count("*").alias("pages")).withColumn("of", F.col("pages")), "host-pages")
    total = pages.agg(F.sum("pages")).first()[0] or 0
    lines = rows.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _bare))).alias("line")).where("line != ''")
    lines = lines.select("host", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))
    often = lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_line_pages)
    over = join_with_hot(often, pages, ["host"], "of", total).where(F.col("n") > max_ratio * F.col("pages"))
    return over.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list(F.concat_ws(".", "h1", "h2")).alias("boilerplate"))


def _with_boilerplate(docs: DataFrame, host: str, hosts: DataFrame, total: int) -> DataFrame:
    """docs with its host's larkspur_boilerplate, if any; rows of large hosts are dealt to several copies of the host's lines."""
    hosts = hosts.select(F.col("host").alias("larkspur_host"), "pages", F.col("boilerplate").alias("larkspur_boilerplate"))
    if total <= BROADCAST_LINES:
        rows = docs.join(F.broadcast(hosts.drop("pages")), _host(host) == F.col("larkspur_host"), "left")
        return rows.drop("larkspur_host")
    most = max(1, (hosts.agg(F.sum("pages")).first()[0] or 0) // HOT_KEYS)
    # no more than HOT_KEYS hosts have more pages than that
    hot = F.broadcast(hosts.where(F.col("pages") > most).select(F.col("larkspur_host").alias("larkspur_hot"), F.ceil(F.col("pages") / most).cast("int").alias("larkspur_copies")))
    rows = docs.withColumn("larkspur_of", _host(host)).join(hot, F.col("larkspur_of") == F.col("larkspur_hot"), "left")
    rows = rows.withColumn("larkspur_copy", F.pmod(F.monotonically_increasing_id(), F.coalesce("larkspur_copies", F.lit(1))).cast("int"))
    copies = F.greatest(F.lit(1), F.ceil(F.col("pages") / most).cast("int"))
    copied = hosts.withColumn("larkspur_no", F.explode(F.sequence(F.lit(0), copies - 1))).drop("pages")
    rows = rows.join(copied, (F.col("larkspur_of") == F.col("larkspur_host")) & (F.col("larkspur_copy") == F.col("larkspur_no")), "left")
    return rows.select(*docs.columns, "larkspur_boilerplate")


def drop_boilerplate(docs: DataFrame, host_column: str = "source", text_column: str = "text", max_ratio: float = MAX_RATIO, min_line_pages: int = MIN_LINE_PAGES, counts: tuple[str, str] = ("lines_before", "lines_dropped")) -> DataFrame:
    """docs with its boilerplate lines dropped from the texts, and two columns more, named by counts: a text's lines, and those dropped.

    A host is a value of host_column; null is one of its own. Every row counts as a page, also repeated ones. A
    page's lines are what \\n separates, without white space at their ends; lines of white space alone
    are never dropped. A line goes, from all pages of the host, if the pages that have it are more than
    max_ratio of all the host's pages, and at least min_line_pages. Null texts stay null, without lines; a very long text is split
    whole. Columns of docs that are named as in counts are left out for these. An empty table gives an empty result.
    """
    docs, of = plain_names(docs.select(*named([c for c in docs.columns if c.lower() not in {n.lower() for n in counts}])))
    host_column, text_column = of[host_column], of[text_column]
    hosts = cut(boilerplate_lines(docs, host_column, text_column, max_ratio, min_line_pages), "boilerplate")
    total = hosts.agg(F.sum(F.size("boilerplate"))).first()[0] or 0
    text = F.col(text_column).cast("string")
    rows = _with_boilerplate(docs, host_column, hosts, total)
    digests = F.filter(F.transform(F.split(text, "\n"), _digest), lambda d: d.isNotNull())
    hit = F.when(F.col("larkspur_boilerplate").isNotNull(), F.array_intersect(digests, "larkspur_boilerplate"))
    rows = rows.withColumn("larkspur_hit", hit)
    found = F.size("larkspur_hit") > 0  # null where the host has none
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains("larkspur_hit", _digest(x)), F.lit(False)))
    rows = rows.withColumn("larkspur_kept", F.when(found, kept)).withColumn("larkspur_before", F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long"))
    rows = rows.withColumn("larkspur_dropped", F.when(found, F.col("larkspur_before") - F.size("larkspur_kept")).otherwise(0).cast("long"))
    rows = rows.withColumn(text_column, F.when(found, F.array_join("larkspur_kept", "\n")).otherwise(F.col(text_column)))
    return own_names(rows, of | {counts[0]: "larkspur_before", counts[1]: "larkspur_dropped"})


def without_boilerplate(docs: DataFrame, host_column: str = "source", text_column: str = "text", length_column: str | None = None, **more) -> DataFrame:
    """docs without its boilerplate lines, as drop_boilerplate() has it, and with the columns of docs alone, whatever their names.

    length_column: one that holds a text's length, which is counted anew where lines went.
    """
    counts = free_name(docs, "larkspur_before"), free_name(docs, "larkspur_dropped")
    rows = drop_boilerplate(docs, host_column, text_column, counts=counts, **more)
    if length_column:
        kind = docs.schema[length_column].dataType
        text, length = named([text_column, length_column])
        rows = rows.withColumn(length_column, F.when(F.col(counts[1]) > 0, F.length(text).cast(kind)).otherwise(length))
    return rows.select(*named(docs.columns))


#: DuckDB SQL for (doc_id, n_lines, n_dropped, text_md5) of documents with the source as host
ORACLE = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT source, count(*) AS pages FROM rows GROUP BY source),
line AS (SELECT DISTINCT r, source, trim(unnest(lines), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM rows),
boilerplate AS (
  SELECT l.source, list(l.line) AS gone FROM (SELECT source, line, count(*) AS n FROM line WHERE line != '' GROUP BY source, line) l
  JOIN pages p ON l.source IS NOT DISTINCT FROM p.source WHERE l.n > {MAX_RATIO} * p.pages AND l.n >= {MIN_LINE_PAGES} GROUP BY l.source),
kept AS (
  SELECT rows.doc_id, rows.lines, list_filter(rows.lines, lambda x: NOT coalesce(list_contains(b.gone, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), false)) AS rest
  FROM rows LEFT JOIN boilerplate b ON rows.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(rest), 0) AS BIGINT) AS n_dropped,
  md5(array_to_string(rest, chr(10))) AS text_md5 FROM kept
"""
