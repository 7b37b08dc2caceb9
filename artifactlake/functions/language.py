"""Language detection by marker words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import LANGUAGE_ACCENTS, LANGUAGE_MARKERS

MIN_ALPHA = 20
MIN_TOKENS = 4
MIN_CONFIDENCE = 0.35
MIXED_RATIO = 0.55
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match a character class."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))


def _one_of(words: list[str]):
    return lambda token: token.isin(*words)


def detect_language(
    df: DataFrame, text_col: str, sample_chars: int | None = None, out: str = "language"
) -> DataFrame:
    """Add a struct (status, primary_language, confidence, scores, sample_size, warnings).

    Whole texts are read by default; ``sample_chars`` limits the text to its first characters for
    callers that want a bounded sample.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if sample_chars is not None:
        text = F.substring(text, 1, sample_chars)
    # letters and apostrophes only, lower-case; a token is a run between spaces with two letters or more
    words = F.lower(F.regexp_replace("__t", f"[^{_LETTERS}']+", " "))
    staged = df.withColumn("__t", text).withColumn("__w", words)
    bare = F.when(
        F.contains("__w", F.lit("'")), F.regexp_replace("__w", "(?<![^ ])'+|'+(?![^ ])", "")
    ).otherwise(F.col("__w"))
    staged = staged.withColumn("__a", F.split(bare, " "))
    alpha = _count(F.col("__t"), r"\p{L}")
    all_marks = sorted({w for words_ in LANGUAGE_MARKERS.values() for w in words_.split()})
    # only marker words are kept, so the arrays below stay small
    marks = F.filter("__a", _one_of([m for m in all_marks if len(m) > 1]))
    tokens = F.size(F.filter("__a", lambda w: F.length(w) > 1))
    staged = staged.select(
        *df.columns,
        "__t",
        "__w",
        tokens.alias("__tokens"),
        marks.alias("__marks"),
        alpha.alias("__alpha"),
    )
    alpha = F.col("__alpha")
    digits = _count(F.col("__t"), r"\p{Nd}")
    punctuation = F.length(F.regexp_replace("__t", r"(?U)[\p{L}\p{N}\s]+", ""))
    # where half of the text is letters the rest cannot outweigh them
    outweighed = F.when(alpha * 2 < F.length("__t"), (digits > alpha) | (punctuation > alpha * 2)).otherwise(F.lit(False))
    staged = staged.select(
        "*",
        F.array_distinct("__marks").alias("__kinds"),
        (~F.col("__t").rlike(r"(?U)\S") | outweighed).alias("__noise"),
        F.greatest(F.lit(4), F.least(F.col("__tokens"), F.lit(20))).alias("__base"),
    )
    scores = []
    for lang, words in LANGUAGE_MARKERS.items():
        terms = sorted(set(words.split()))
        hits = F.size(F.filter("__marks", _one_of(terms)))
        seen = F.filter(
            F.array(*[F.lit(w) for w in terms]), lambda w: F.array_contains("__kinds", w)
        )
        accents = LANGUAGE_ACCENTS.get(lang)
        bonus = (
            F.when(
                F.col("__w").rlike(f"[{accents}]")
                & F.col("__w").rlike(f"[{accents}][^ ]*[^' ]|[^' ][^ ]*[{accents}]"),
                F.lit(1),
            ).otherwise(F.lit(0))
            if accents
            else F.lit(0)
        )
        score = F.bround(F.least(F.lit(1.0), (hits + bonus) / F.col("__base")), 2)
        scores.append(
            F.struct(
                (-score).alias("rank"),
                F.lit(lang).alias("language"),
                score.alias("confidence"),
                seen.alias("matched_terms"),
            )
        )
    ranked = staged.withColumn("__s", F.array_sort(F.array(*scores)))
    first, second = F.col("__s")[0], F.col("__s")[1]
    none = F.array().cast("array<string>")
    mixed = second["confidence"] >= first["confidence"] * MIXED_RATIO
    reason = (
        F.when(F.col("__noise"), "low_language_signal")
        .when((F.col("__alpha") < MIN_ALPHA) | (F.col("__tokens") < MIN_TOKENS), "short_text")
        .when(first["confidence"] < MIN_CONFIDENCE, "low_confidence_language")
    )
    noise_words = F.contains("__w", F.lit("ocr")) | F.contains("__w", F.lit("confidence"))
    known = ranked.withColumn("__why", reason)
    clean = F.col("__why").isNull()
    return known.withColumn(
        out,
        F.struct(
            F.when(clean, "complete").otherwise("unknown").alias("status"),
            F.when(~clean, "unknown")
            .when(mixed, "mixed")
            .otherwise(first["language"])
            .alias("primary_language"),
            F.when(clean, first["confidence"]).otherwise(0.0).alias("confidence"),
            F.when(
                clean,
                F.transform(
                    "__s",
                    lambda s: F.struct(s["language"], s["confidence"], s["matched_terms"]),
                ),
            ).alias("scores"),
            F.col("__alpha").alias("sample_size"),
            F.when(~clean, F.array("__why"))
            .otherwise(
                F.concat(
                    F.when(
                        mixed,
                        F.array(
                            F.concat(
                                F.lit("mixed_language:"),
                                first["language"],
                                F.lit("+"),
                                second["language"],
                            )
                        ),
                    ).otherwise(none),
                    F.when(noise_words, F.array(F.lit("ocr_noise_tolerated"))).otherwise(none),
                )
            )
            .alias("warnings"),
        ),
    ).select(*df.columns, out)
