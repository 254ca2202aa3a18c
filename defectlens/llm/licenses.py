"""License scans: ordered signature rules behind a keyword filter; overlapping detections are settled by priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from defectlens.llm.common import ascii_lower
from defectlens.llm.license_rules import PHRASES, SCORES, STEMS, Rule, rules

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OPEN, SHUT = "\x01", "\x02"  # never in normalised text


def normalized(text: Column) -> Column:
    """Words with one space before, between and after them: A-Z lower-cased, other ASCII than letters and digits is space."""
    body = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, " "))
    return F.concat(F.lit(" "), body, F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_count(norm: Column) -> Column:
    return F.when(F.length(norm) == 2, F.lit(0)).otherwise(_spaces(norm) - 1)


def phrase_places(norm: Column, phrase: str) -> Column:
    """(n, first, last) of the places where the phrase's words stand, overlapping ones too; places count words from 0."""
    parts = F.split(F.regexp_replace(norm, f"(?<= )(?={phrase} )", OPEN), OPEN, -1)
    n = F.size(parts) - 1
    first = _spaces(F.element_at(parts, 1)) - 1
    last = _spaces(norm) - _spaces(F.element_at(parts, -1)) - 1
    found = F.struct(n.cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), found).otherwise(none)


def _tried(norm: Column, given: list[Rule]) -> Column:
    """Per rule that fires: its number and the text cut at its matches, which are the elements at odd places from 0."""
    table = F.array(*[
        F.struct(
            F.lit(i).alias("rule"), F.lit(r.stem).alias("stem"), F.lit(r.keyword).alias("keyword"),
            F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"),
        )
        for i, r in enumerate(given)
    ])
    gated = F.filter(table, lambda r: F.contains(norm, r["stem"]) & F.contains(norm, r["keyword"]))

    def cut_up(rule: Column) -> Column:
        marked = F.call_function("regexp_replace", norm, rule["pattern"], F.lit(f"{OPEN}$0{SHUT}"))
        return F.struct(rule["rule"].alias("rule"), F.split(marked, f"[{OPEN}{SHUT}]", -1).alias("parts"))

    hits = F.filter(F.transform(gated, cut_up), lambda h: F.size(h["parts"]) > 1)
    some = reduce(lambda a, b: a | b, [F.contains(norm, F.lit(s)) for s in STEMS])
    return F.when(some, hits)


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", given: list[Rule] | None = None, phrases: dict[str, str] = PHRASES
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, base (n, first and last place and labels of the phrases), detections, labels, score.

    A detection is (start, end, rule, tier, label) in words, from 0, the end excluded. It is dropped if it lies within another of the
    same or a better tier; of equal spans the better tier, then the earlier rule stays. ``labels`` are those of the detections
    and of the base phrases, sorted; ``score`` is that of the best tier among them, 0 for none.

    Null, empty and wordless texts have no words and no labels. Rows may repeat, ids may be null; no rows give no rows; other
    columns are ignored. The rows of one document's matches meet in one task, as the document did.
    """
    given = rules() if given is None else given
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), normalized(F.col(text)).alias("norm"))
    places = [phrase_places(F.col("norm"), p).alias(f"p{i}") for i, p in enumerate(phrases.values())]
    tried = read.select("row", "id", word_count(F.col("norm")).cast("long").alias("n_words"), *places, _tried(F.col("norm"), given).alias("hits"))
    spots = F.array(*[F.col(f"p{i}") for i in range(len(phrases))])
    labels = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"p{i}.n") > 0, F.lit(label)) for i, label in enumerate(phrases)])))
    base = F.named_struct(
        F.lit("n"), F.aggregate(spots, F.lit(0).cast("long"), lambda n, p: n + p["n"]),
        F.lit("first"), F.array_min(F.transform(spots, lambda p: p["first"])),
        F.lit("last"), F.array_max(F.transform(spots, lambda p: p["last"])), F.lit("labels"), F.array_sort(labels),
    )
    parts = tried.select("row", "id", "n_words", base.alias("base"), F.explode_outer("hits").alias("hit"))
    parts = parts.select("row", "id", "n_words", "base", F.col("hit.rule").alias("rule"), F.posexplode_outer("hit.parts").alias("part", "cut"))
    own = Window.partitionBy("row", "rule").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.repartition("row").withColumn("start", F.coalesce(F.sum(_spaces(F.col("cut"))).over(own), F.lit(0)) - 1)
    # The parts between matches go, but each document keeps a row.
    matches = placed.where((F.col("part") % 2 == 1) | F.coalesce(F.col("part") == 0, F.lit(True))).withColumn("is", F.coalesce(F.col("part") % 2 == 1, F.lit(False)))
    tiers = F.get(F.array(*[F.lit(r.tier) for r in given]), F.col("rule"))
    names = F.get(F.array(*[F.lit(r.label) for r in given]), F.col("rule"))
    spans = matches.withColumns({"end": F.col("start") + _spaces(F.col("cut")) + 1, "tier": tiers, "label": names})
    before = Window.partitionBy("row").orderBy(
        F.col("is").desc(), "start", F.col("end").desc(), "tier", "rule"
    ).rowsBetween(Window.unboundedPreceding, -1)
    best = range(len(SCORES))
    reach = {f"reach{t}": F.max(F.when(F.col("is") & (F.col("tier") <= t), F.col("end"))).over(before) for t in best}
    # Sorted by start, then the longer first: a span lies within an earlier one that reaches its end.
    inside = reduce(lambda a, b: a | b, [(F.col("tier") == t) & F.coalesce(F.col(f"reach{t}") >= F.col("end"), F.lit(False)) for t in best])
    kept = spans.withColumns(reach).withColumn("found", F.when(F.col("is") & ~inside, F.struct("start", "end", "rule", "tier", "label")))
    whole = kept.groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("base").alias("base"), F.array_sort(F.collect_list("found")).alias("detections"),
    )
    scores = F.array(*[F.lit(s) for s in SCORES])
    best_tier = F.array_min(F.transform("detections", lambda d: d["tier"]))
    all_labels = F.array_sort(F.array_union(F.col("base.labels"), F.transform("detections", lambda d: d["label"])))
    return whole.select(
        "id", "n_words", "base", "detections", all_labels.alias("labels"),
        F.when(F.col("base.n") > 0, F.lit(SCORES[0])).otherwise(F.coalesce(F.get(scores, best_tier), F.lit(0.0))).alias("score"),
    )
