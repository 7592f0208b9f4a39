"""Line de-duplication by content-defined chunks (operator 9).

A text is a list of lines (split at line feeds).  Each line has a 28-bit
hash (of its MD5); a polynomial rolling hash over the last ``window`` line
hashes ends a chunk where it is divisible by ``divisor``.  The boundary
depends on the lines around it only, so lines put in or taken out elsewhere
do not shift it.  Chunks of at least ``min_lines`` lines that occur more than
once in the corpus are removed, all but the first occurrence in (doc_id,
file, row, chunk) order; occurrences are the same only if their bytes are.

Everything is DataFrame expressions.  The first pass counts chunk keys; the
texts of the chunks whose key repeats are then grouped by key *and* bytes.

Defined results: null text has no lines and stays null; an empty text is one
empty line; repeated rows count as further documents; a null doc_id sorts
first; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outagekit.llm.common import barrier, cut, located, table
from outagekit.operators.joins import broadcast_bounded

# Fixed values of the rolling hash: a prime modulus and a base below it.
MODULUS = 2147483647
BASE = 1000003
WINDOW, DIVISOR, MIN_LINES = 2, 4, 2


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _rolling(h: Column, i: Column, window: int) -> Column:
    acc = F.lit(0).cast("long")
    for back in range(window - 1, -1, -1):
        acc = (acc * BASE + F.when(i >= back, F.element_at(h, i - back + 1)).otherwise(F.lit(0))) % MODULUS
    return acc


def chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` (from ``located``) as doc_id, __file, __row, lines and
    ``cuts``: per chunk its first line (from 1) and number of lines."""
    ids = ["doc_id", "__file", "__row"]
    one = barrier(docs, *ids, lines=F.split("text", "\n"))
    two = barrier(one, *ids, "lines", h=F.transform("lines", line_hash))
    n = F.size("h")
    ends = F.filter(F.sequence(F.lit(0), n - 1),
                    lambda i: (i == n - 1) | (_rolling(F.col("h"), i, window) % divisor == 0))
    three = barrier(two, *ids, "lines", ends=F.when(n > 0, ends))

    def piece(e: Column, j: Column) -> Column:
        first = F.when(j == 0, F.lit(1)).otherwise(F.element_at("ends", j) + 2)  # element j is the chunk before
        return F.struct(first.alias("first"), (e + 2 - first).alias("n"))

    return barrier(three, *ids, "lines", cuts=F.transform("ends", piece))


def remove_repeated_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES,
                           key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, __file, __row, n_lines, n_chunks,
    n_removed (chunks), removed_lines, text (what is left)."""
    docs = located(docs.select("doc_id", "text"))
    ids = ["doc_id", "__file", "__row"]
    cut_docs = chunks(docs, window, divisor)
    rows = (cut_docs.select(*ids, "lines", F.posexplode("cuts").alias("j", "c")).where(F.col("c.n") >= min_lines)
            .select(*ids, "j", F.array_join(F.slice("lines", F.col("c.first"), F.col("c.n")), "\n").alias("chunk")))
    keyed = rows.select("*", key(F.col("chunk")).alias("key"))
    repeated = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    found = cut(keyed.join(broadcast_bounded(repeated), "key", "left_semi"))
    place = F.struct("doc_id", "__file", "__row", "j")
    # occurrences are the same if their bytes are: classes of a key by its texts
    classes = cut(found.groupBy("key", "chunk").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")))
    keys = cut(classes.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.min("head").alias("head")))
    # nearly always a key has one text, and its occurrences need not be shuffled by their text
    one = found.drop("chunk").join(broadcast_bounded(keys.where("texts = 1 and n > 1").select("key", "head")), "key")
    several = keys.where("texts > 1").select("key")
    if several.take(1):
        clash = classes.where("n > 1").join(broadcast_bounded(several), "key", "left_semi").select("key", "chunk", "head")
        one = one.unionByName(found.join(clash, ["key", "chunk"]).drop("chunk"))
    gone = (one.where(~((F.col("head.__file") == F.col("__file")) & (F.col("head.__row") == F.col("__row"))
                        & (F.col("head.j") == F.col("j"))))
            .groupBy("__file", "__row").agg(F.collect_set("j").alias("gone")))
    out = cut_docs.join(gone, ["__file", "__row"], "left")
    none = F.array().cast("array<int>")
    out = barrier(out, *ids, "lines", "cuts", gone=F.coalesce("gone", none))
    left = F.flatten(F.transform("cuts", lambda c, j: F.when(F.array_contains("gone", j), F.array().cast("array<string>"))
                                 .otherwise(F.slice("lines", c["first"], c["n"]))))
    lost = F.aggregate("gone", F.lit(0), lambda acc, j: acc + F.element_at("cuts", j + 1)["n"])
    return out.select(
        *ids, F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("cuts"), F.lit(0)).cast("long").alias("n_chunks"),
        F.size("gone").cast("long").alias("n_removed"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("removed_lines"),
        F.array_join(left, "\n").alias("text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_chunks(table(spark, sf_dir, "documents"))
    return out.drop("__file", "__row")


OP9_SQL = f"""
WITH l AS (SELECT doc_id, i, lines[i] AS line, len(lines) AS n FROM (
        SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
r AS (SELECT *, (coalesce(lag(h) OVER w, 0) % {MODULUS} * {BASE} + h) % {MODULUS} AS roll
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, (i = n OR roll % {DIVISOR} = 0)::INT AS is_end FROM r),
c AS (SELECT *, coalesce(sum(is_end) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j
      FROM e),
k AS (SELECT doc_id, j, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM c GROUP BY doc_id, j),
m AS (SELECT *, n >= {MIN_LINES} AND row_number() OVER (PARTITION BY chunk, n >= {MIN_LINES} ORDER BY doc_id, j) > 1 AS gone FROM k),
o AS (SELECT doc_id, sum(n) AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed,
             coalesce(sum(n) FILTER (gone), 0) AS removed_lines,
             coalesce(string_agg(chunk, chr(10) ORDER BY j) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0)::BIGINT AS n_lines, coalesce(o.n_chunks, 0)::BIGINT AS n_chunks,
       coalesce(o.n_removed, 0)::BIGINT AS n_removed, coalesce(o.removed_lines, 0)::BIGINT AS removed_lines, o.text
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
