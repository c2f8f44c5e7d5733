"""License detection by ordered signature rules, with DataFrame functions only.

Texts become lower-case words parted by single spaces.  A cheap test for a few words lets most texts
pass; in the others only rules whose keyword occurs are matched.  Every match becomes a row with its
word interval, and one pass over a text's matches in order of their place drops each that lies
inside a match of higher priority, or of the same priority that is longer or comes earlier in the list.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayspark.llm.license_rules import GATES, LicenseRule, rules

# What parts words, before and after A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_array(found: Sequence[LicenseRule]) -> Column:
    # A look ahead finds every place, also where matches overlap; group 1 is the match.
    return F.array(
        *[
            F.struct(
                F.lit(number).alias("rule"),
                F.lit(r.label).alias("label"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(f"(?=( {r.pattern}) )").alias("pattern"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.worth).alias("worth"),
                F.lit(r.phrase).alias("phrase"),
            )
            for number, r in enumerate(found)
        ]
    )


def detections(
    docs: DataFrame, found: Sequence[LicenseRule], gates: Sequence[str] | None = GATES
) -> DataFrame:
    """Rows ``row``, ``doc_id``, ``n_words``, then a detection, or nulls for a text without any.

    A detection is ``rule``, ``label``, ``phrase``, ``worth``, ``start`` and ``end`` in words, and ``stays``:
    whether no other contains and outranks it.  ``row`` numbers the rows of ``docs``.  ``gates`` are
    words of which one stands in every text that a rule can match; None tests all rules on all texts.
    """
    split = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), BREAKS, " "))
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", split.alias("words")
    ).withColumn("n_words", F.when(F.col("words") == "", 0).otherwise(spaces(F.col("words")) + 1).cast("bigint"))
    lowered = F.lower("words")  # lower-cases more than A-Z, which lets no text pass wrongly
    passes = F.lit(True)
    if gates is not None:
        passes = F.lit(False)
        for gate in gates:
            passes = passes | F.contains(F.col("lowered"), F.lit(gate))
    exact = F.translate("words", string.ascii_uppercase, string.ascii_lowercase)
    # Matches are places before a space; the first sign keeps the first of them off the text's edge.
    gated = words.withColumn("lowered", lowered).withColumn(
        "words", F.when(passes, F.concat(F.lit("# "), exact, F.lit(" ")))
    )
    listed = _rule_array(found)
    likely = F.when(
        F.col("words").isNotNull(),
        F.filter(listed, lambda r: F.contains(F.col("words"), r["keyword"])),
    )
    tried = gated.select("row", "doc_id", "n_words", "words", F.explode_outer(likely).alias("r"))
    matches = F.when(
        F.col("r").isNotNull(), F.regexp_extract_all("words", F.col("r.pattern"), F.lit(1))
    )
    matched = tried.select("row", "doc_id", "n_words", "words", "r", matches.alias("matches"))
    pieces = F.when(F.size("matches") > 0, F.split("words", F.col("r.pattern"), F.lit(-1)))
    # The words between a match's place and the one before it, and the words it takes.
    gaps = F.transform(F.slice(pieces, 1, F.size("matches")), spaces)
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform("matches", spaces).alias("length"))
    placed = matched.select(
        "row", "doc_id", "n_words", "r.rule", "r.label", "r.phrase", "r.priority", "r.worth",
        F.posexplode_outer(F.when(F.size("matches") > 0, zipped)).alias("k", "place"),
    )
    slim = placed.select(
        "row", "doc_id", "n_words", "rule", "label", "phrase", "priority", "worth", "k",
        F.col("place.gap").alias("gap"), F.col("place.length").alias("length"),
    ).repartition("row")
    so_far = W.partitionBy("row", "rule").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    # Where a match begins: the spaces before it, without the one it starts with.
    starts = slim.withColumn("start", F.sum("gap").over(so_far)).withColumn(
        "end", F.col("start") + F.col("length")
    )
    order = W.partitionBy("row").orderBy(
        F.col("start").asc_nulls_last(), F.col("end").desc(), "priority", "rule"
    )
    before = order.rowsBetween(W.unboundedPreceding, -1)
    reach = F.lit(None).cast("int")
    for level in sorted({r.priority for r in found}):
        outranks = F.when(F.col("priority") <= level, F.col("end"))
        reach = F.when(F.col("priority") == level, F.max(outranks).over(before)).otherwise(reach)
    hidden = F.coalesce(reach >= F.col("end"), F.lit(False))
    held = F.col("start").isNotNull()
    return starts.withColumn("stays", held & ~hidden).select(
        "row", "doc_id", "n_words",
        *[F.when(held, F.col(c)).alias(c) for c in ("rule", "label", "phrase", "worth", "start", "end")],
        "stays",
    )


def scan(
    docs: DataFrame,
    found: Sequence[LicenseRule] | None = None,
    gates: Sequence[str] | None = GATES,
) -> DataFrame:
    """One row per row of ``docs``: what licenses its text names.

    ``doc_id``, ``n_words``; ``n_base``, ``first_word``, ``last_word``: places of the phrases, and the smallest and
    largest word at which one starts (from 0, null without any); ``base_labels`` of the phrases;
    ``labels`` of these and of all detections that stay, both sorted and comma-joined (empty without any);
    ``score``: the worth of the best detection, 0 without any.

    A null text is empty; repeated rows are scanned each; an empty table gives no rows; other columns
    are not read.  The rows of a text meet in one task; texts themselves are not shuffled.
    """
    hits = detections(docs, rules() if found is None else found, gates)
    base = F.col("phrase") & F.col("start").isNotNull()
    kept = base | F.col("stays")

    def labels(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        hits.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(kept).alias("labels"),
            F.coalesce(F.max(F.when(kept, F.col("worth"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
