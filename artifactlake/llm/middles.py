"""Fill-in-middle transformation by one regular expression per row.

A text is a row of units, ``[A-Za-z]+|[^A-Za-z]`` over code points. ``regexp_count`` gives their number
n, hashes of the document's id give two cuts ``a <= b``, and the pattern
``\\A((?:unit){a}+)((?:unit){b-a}+)(.*)\\z`` captures prefix, middle and suffix in a single match, whose
replacement text puts them into the order of the row's form. Possessive groups never give back a unit, so
the match is linear in the text, needs no stack, and also fits a text of one unit.

Everything is a DataFrame expression: no shuffle, no Python, one pass.

Definitions. Null text: the empty text. A text is left as it is (form ``plain``) if it is empty, holds one of
the three marks, or is dealt to the plain share. Null id: hashed as the empty text; equal ids give equal cuts.
A column of the table with the name of a result column is replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _hashes(id_col: str, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a row's id."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(code, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cutting(a: Column, b: Column) -> Column:
    """Pattern with the text up to unit ``a``, from there to unit ``b``, and the rest as groups."""
    unit = "(?:[A-Za-z]++|[^A-Za-z])"
    return F.concat(
        F.lit(rf"(?s)\A({unit}{{"), a.cast("string"), F.lit(rf"}}+)({unit}{{"), (b - a).cast("string"), F.lit(r"}+)(.*)\z")
    )


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    seed: str = "1",
    plain_from: int = 90,
    spm_below: int = 20,
) -> DataFrame:
    """Add ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``; the other columns stay.

    Of 100 rows about ``100 - plain_from`` stay plain; of the rest about ``spm_below`` in 100 put the suffix
    first (spm), the others the prefix (psm).
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in docs.columns if c not in made]
    whole, codes, first, last = (spare(keep + made, c) for c in ("whole", "codes", "first", "last"))
    hashes = F.struct(*[h.alias(f"h{i}") for i, h in enumerate(_hashes(id_col, seed), 1)])
    source = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(whole), hashes.alias(codes))
    counted = source.withColumn("n", F.regexp_count(whole, F.lit(UNIT)).cast("long"))
    t, h, size = F.col(whole), F.col(codes), F.col("n") + 1
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = (
        F.when((t == "") | marked | (h.h3 % 100 >= plain_from), F.lit("plain"))
        .when(h.h4 % 100 < spm_below, F.lit("spm"))
        .otherwise(F.lit("psm"))
    )
    cut = counted.select(
        *keep, whole, "n", form.alias("form"),
        F.least(h.h1 % size, h.h2 % size).alias(first), F.greatest(h.h1 % size, h.h2 % size).alias(last),
    )
    order = F.when(F.col("form") == "spm", F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")).otherwise(F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"))
    moved = F.regexp_replace(t, _cutting(F.col(first), F.col(last)), order)
    done = cut.select(*keep, "n", "form", F.when(F.col("form") == "plain", t).otherwise(moved).alias("output"))
    return done.select(*keep, "n", "form", *_lengths(), "output")


def _parts() -> tuple[Column, Column, Column]:
    """Code points before the first of the two inner marks, between them, and after the second.

    Marks cannot stand in the text and a mark starts with a sign that it holds only once, so none can arise
    where a part meets a mark.
    """
    out, spm = F.col("output"), F.col("form") == "spm"
    inner = F.when(spm, F.locate(PREFIX, out)).otherwise(F.locate(SUFFIX, out))
    last = F.locate(MIDDLE, out)
    return inner - 1 - len(PREFIX), last - inner - len(SUFFIX), F.length(out) - last - len(MIDDLE) + 1


def _lengths() -> list[Column]:
    first, second, third = _parts()
    prefix = F.when(F.col("form") == "spm", second).when(F.col("form") == "psm", first)
    return [prefix.cast("long").alias("prefix_chars"), F.when(F.col("form") != "plain", third).cast("long").alias("middle_chars")]


def restore(moved: DataFrame, name: str = "restored") -> DataFrame:
    """Add the original text, rebuilt from ``output`` and ``form`` alone."""
    spm = F.col("form") == "spm"
    pattern = F.when(spm, F.lit(rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z")).otherwise(
        F.lit(rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z")
    )
    order = F.when(spm, F.lit("$2$3$1")).otherwise(F.lit("$1$3$2"))
    text = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.regexp_replace("output", pattern, order))
    return moved.withColumn(name, text)
