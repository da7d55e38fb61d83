"""Removal of repeated passages by overlapping windows of three lines.

A text is cut at line feeds.  Each three consecutive lines are a window, known
by 128 bits of hashes; a window of blank lines does not count.  The first
occurrence of a window in the order of (doc_id, text hash, line) stays; the
lines that later occurrences cover are removed together.  The first occurrence
of every line is never inside a later occurrence, so no line is lost
altogether.

Counting is a partial aggregation, so a window that a third of the documents
share arrives as one row from each task; finding its later occurrences is a
join whose hot side adaptive execution splits.  Native expressions only.

Defined cases: null texts stay null with no lines; texts of fewer than three
lines stay; null ids come first in the order; rows equal in doc_id and text
count as one document and are all treated alike; empty tables stay empty;
further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import fingerprint, need
from strataline.session import Scratch


def windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """wa long, wb long (the window), doc_id, print, line int: a row for each window."""
    lines = need(docs, "doc_id", "text").select("doc_id", fingerprint(F.col("text")).alias("print"), F.split("text", "\n").alias("lines"))
    keyed = lines.where(F.size("lines") >= size).select("doc_id", "print", F.expr("transform(lines, x -> struct(xxhash64(x) as a, xxhash64(x, 'second') as b, trim(x) = '' as blank))").alias("l"))
    part = lambda f, how: how.join(f"get(l, i + {k}).{f}" for k in range(size))
    each = F.expr(f"inline(transform(sequence(0, size(l) - {size}), i -> struct(i as line, xxhash64({part('a', ', ')}) as wa, xxhash64({part('b', ', ')}) as wb, {part('blank', ' and ')} as blank)))")
    return keyed.select("doc_id", "print", each).where("not blank").select("wa", "wb", "doc_id", "print", "line")


def covered(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, print, gone (array of line numbers): what later occurrences cover."""
    scratch = Scratch(docs.sparkSession, "lines")
    seen = scratch.save(windows(docs, size), "windows")
    here = F.struct("doc_id", "print", "line")
    first = seen.groupBy("wa", "wb").agg(F.min(here).alias("first"), F.max(here).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = seen.join(first, ["wa", "wb"]).where(~here.eqNullSafe(F.col("first")))
    lines = later.select("doc_id", "print", F.expr(f"explode(sequence(line, line + {size - 1}))").alias("line")).distinct()
    return scratch.save(lines.groupBy("doc_id", "print").agg(F.collect_set("line").alias("gone")), "covered")


def dedup(docs: DataFrame, size: int = 3) -> DataFrame:
    """`docs` with `text` rid of later occurrences, and after its columns n_lines and n_removed (prefixed with line_ where df has such names)."""
    new = [f"line_{n}" if n in {c.lower() for c in docs.columns} else n for n in ("n_lines", "n_removed")]
    gone = covered(docs, size).select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), F.col("gone").alias("__gone"))
    # a merge join at every size: what is covered grows with the corpus
    joined = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (fingerprint(F.col("text")) == F.col("__print")), "left")
    # the lines are bound once a row; as a column they would be split anew for each line where a filter on the text is pushed down
    left = F.expr("get(transform(array(split(text, '\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), __gone), i -> get(l, i)), '\n')), 0)")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))), F.lit(0)).cast("long")
    n_gone = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long")
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], n_lines.alias(new[0]), n_gone.alias(new[1]))
