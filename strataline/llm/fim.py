r"""Fill-in-the-middle transformation by counted-quantifier patterns.

A text is a run of units: a run of letters or one other character.  How many
there are, regexp_count() tells.  Two numbers drawn from the row's id cut them
into prefix, middle and suffix, and a pattern made for the row,

    \A((?:unit){a}+)((?:unit){b-a}+)(.*)\z

captures the three parts in one match; the replacement puts them in the order
of the row's form, with a mark before each.  The quantifiers are possessive:
what a group has taken is never given back, so a match is one walk over the
text, without recursion, whatever its length.  Built-in functions only, no
shuffle.

Marks must not overlap one another, and a text that holds one stays as it is,
so the text can be rebuilt from the output and its form alone.

Defined cases: a null text counts as empty; an empty text is plain; a null id
draws as if it were the empty string; rows equal in id are cut at the same
numbers; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import need

#: One unit of a text.
UNIT = "[A-Za-z]++|[^A-Za-z]"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    for (i, x), (j, y) in product(enumerate(marks), repeat=2):
        meet = any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y))))
        if not x or meet or (i != j and x in y):
            raise ValueError(f"marks overlap: {x!r} and {y!r}")
    return marks


def _said(mark: str) -> str:
    """The mark as a replacement text has it."""
    return re.sub(r"([\\$])", r"\\\1", mark)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 for a row."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, text, n, form (plain, psm, spm), prefix_chars, middle_chars, output for every row of docs.

    `percent` of the rows are cut, and `spm_percent` of these have the suffix
    first.  Lengths are in code points, null for plain rows.
    """
    before, after, between = _checked(marks)
    p, s, m = map(_said, marks)
    rows = need(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = draws(F.col("doc_id"), seed)
    drawn = rows.select("*", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), *[x.alias(f"__h{i}") for i, x in enumerate(h)])
    whole = F.lit(False)
    for mark in marks:
        whole = whole | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | whole | (F.col("__h2") % 100 >= percent), "plain").when(F.col("__h3") % 100 < spm_percent, "spm").otherwise("psm")
    x, y = F.col("__h0") % (F.col("n") + 1), F.col("__h1") % (F.col("n") + 1)
    cut = drawn.select("doc_id", "text", "n", form.alias("form"), F.least(x, y).alias("__a"), F.abs(x - y).alias("__b"))
    pattern = F.format_string(rf"(?s)\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*)\z", "__a", "__b")
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    out = cut.select("doc_id", "text", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)).alias("output"))
    at = lambda mark: F.instr("output", mark)
    ahead = F.when(F.col("form") == "psm", at(after) - len(before) - 1).when(F.col("form") == "spm", at(between) - at(before) - len(before))
    middle = F.when(F.col("form") != "plain", F.length("output") - at(between) - len(between) + 1)
    return out.select("doc_id", "text", "n", "form", ahead.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that transform() has made `output` of."""
    p, s, m = (re.escape(x) for x in _checked(marks))
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(docs: DataFrame, **how) -> DataFrame:
    """transform() with hashes of the output and of the text rebuilt from it in place of the texts."""
    out = transform(docs, **how)
    marks = how.get("marks", MARKS)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form"), marks), 256).alias("restored_sha256"),
    )
