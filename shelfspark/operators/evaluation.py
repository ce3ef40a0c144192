"""Offline relevance metrics over rows (case_id, position, ...)."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scoring

DEPTH = 10


def ndcg(results: DataFrame, ideal: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(case_id, ndcg) of results (case_id, position from 1, grade) against an assumed ideal list (case_id, grade)."""
    gained = results.where(F.col("position") <= depth).groupBy("case_id").agg(F.sum(scoring.dcg_gain(F.col("grade"), F.col("position"))).alias("dcg"))
    order = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade")))
    best = ideal.withColumn("position", order).where(F.col("position") <= depth).groupBy("case_id").agg(F.sum(scoring.dcg_gain(F.col("grade"), F.col("position"))).alias("ideal"))
    return best.join(gained, "case_id", "left").select("case_id", F.when(F.col("ideal") > 0, F.least(F.lit(1.0), F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"))).otherwise(0.0).alias("ndcg"))


def precision_and_leakage(results: DataFrame, at: int = 5, depth: int = DEPTH) -> DataFrame:
    """(case_id, precision, leakage, duplicates, entities, sources) of results with relevant, leaked, entity and source.

    Precision always divides by `at`; leakage and duplicates by the results within the depth.
    """
    top = results.where(F.col("position") <= depth)
    hit = F.sum(F.when((F.col("position") <= at) & F.col("relevant"), 1).otherwise(0)) / at
    n = F.count("*")
    return top.groupBy("case_id").agg(
        hit.alias("precision"),
        (F.sum(F.col("leaked").cast("int")) / n).alias("leakage"),
        (1 - F.countDistinct("entity") / n).alias("duplicates"),
        F.countDistinct("entity").alias("entities"),
        F.countDistinct("source").alias("sources"),
    )


def source_entropy(results: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(case_id, entropy): normalised Shannon entropy of sources; 0 below two rows or two sources."""
    by = results.where(F.col("position") <= depth).groupBy("case_id", "source").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("case_id"))
    shares = by.withColumn("p", F.col("n") / total)
    return shares.groupBy("case_id").agg(F.when((F.count("*") > 1) & (F.sum("n") > 1), F.sum(-F.col("p") * F.log("p")) / F.log(F.count("*"))).otherwise(0.0).alias("entropy"))


def repeatability(runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(case_id, repeatability): mean Jaccard of the result sets of all pairs of runs; two empty sets are equal."""
    sets = runs.where(F.col("position") <= depth).groupBy("case_id", "run_id").agg(F.collect_set("result_id").alias("ids"))
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.run_id") < F.col("b.run_id")))
    return pairs.groupBy(F.col("a.case_id").alias("case_id")).agg(F.avg(scoring.jaccard(F.col("a.ids"), F.col("b.ids"), 1.0)).alias("repeatability"))


def slice_summary(cases: DataFrame, metric: str) -> DataFrame:
    """(slice, cases, mean) of a metric over cases that are in several slices (array column slices)."""
    return cases.select(F.explode("slices").alias("slice"), metric).groupBy("slice").agg(F.count("*").alias("cases"), F.coalesce(F.avg(metric), F.lit(0.0)).alias("mean"))


def slot_coverage(results: DataFrame, slots: DataFrame) -> DataFrame:
    """(case_id, coverage): share of a case's required slots (case_id, slot_id) that a result fills."""
    filled = results.select("case_id", "slot_id").distinct().withColumn("filled", F.lit(1))
    return slots.join(filled, ["case_id", "slot_id"], "left").groupBy("case_id").agg(F.avg(F.coalesce("filled", F.lit(0))).alias("coverage"))


def complete_bundles(items: DataFrame, slots: DataFrame) -> DataFrame:
    """(case_id, rate): share of a case's bundles (case_id, bundle_id, slot_id) that fill every required slot."""
    need = slots.groupBy("case_id").agg(F.countDistinct("slot_id").alias("need"))
    got = items.join(slots, ["case_id", "slot_id"], "left_semi").groupBy("case_id", "bundle_id").agg(F.countDistinct("slot_id").alias("got"))
    every = items.select("case_id", "bundle_id").distinct().join(got, ["case_id", "bundle_id"], "left").join(need, "case_id")
    return every.groupBy("case_id").agg(F.avg((F.coalesce("got", F.lit(0)) >= F.col("need")).cast("int")).alias("rate"))


def missing_and_unknown(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, problem): expected keys that weren't found, and found ones that weren't expected."""
    missing = expected.select(key).join(found.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(found.select(key).join(expected.select(key), key, "left_anti").select(key, F.lit("unknown").alias("problem"))).distinct()


def relevance_label(title, rules: list[dict], explicit=None) -> object:
    """Label of the first rule that a title with its evidence meets, else irrelevant; an explicit label wins.

    A rule asks for any of its phrases, all of its terms and none of its forbidden phrases, and has phrases or terms; a
    term of one word may be in the plural.
    """
    hay = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), F.lit(" "))
    plain = lambda value: " ".join(re.findall("[a-z0-9]+", value.lower()))
    has = lambda value: F.contains(hay, F.lit(f" {plain(value)} ")) if plain(value) else F.lit(False)

    def term(value: str):
        own = plain(value)
        if not own or " " in own:
            return has(own)
        return reduce(or_, map(has, (own, f"{own}s", f"{own}es", *([f"{own[:-1]}ies"] if own.endswith("y") else []))))

    met = []
    for rule in rules:
        phrases, terms = rule.get("any_phrases") or [], rule.get("all_terms") or []
        parts = [reduce(or_, map(has, phrases))] if phrases else []
        parts += [*map(term, terms), *(~has(p) for p in rule.get("none_phrases") or [])]
        if phrases or terms:
            met.append(F.when(reduce(and_, parts), F.lit(rule["label"])))
    return F.coalesce(*([] if explicit is None else [explicit]), *met, F.lit("irrelevant"))


#: A benchmark file as far as its rules look at it; nested parts stay text, so that their kind can be told.
BENCHMARK = "version string, cases string, _broken string"
CASE = "id string, query string, slices string, expectedIntent string, relevanceRules string, idealRelevance string, mission struct<requiredSlots: string>"
INTENTS = ("product", "mission")


def benchmark_violations(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """(file, path, rule): every rule that a benchmark file breaks, with the place. Files that are no JSON object are kept as `object`.

    Rules: a whole version and a list of cases; each case with id, query and a list of slices; no id twice in a file; a known
    intent; a list of relevance rules and ideal relevance; required slots for a mission.
    """
    top = files.select(F.col(file).alias("file"), F.trim(body).alias("body"), F.from_json(body, BENCHMARK, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("b"))
    whole = F.col("body").startswith("{") & F.col("b").isNotNull() & F.col("b._broken").isNull()
    a_list = lambda c: F.coalesce(c.startswith("["), F.lit(False))
    filled = lambda c: F.coalesce(~c.isin("", "0", "false"), F.lit(False))
    found = lambda path, rule: F.struct(path.alias("path"), F.lit(rule).alias("rule"))
    broken = lambda *pairs: F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), found(path, rule)) for good, path, rule in pairs)))
    top = top.withColumn("whole", F.coalesce(whole, F.lit(False)))
    header = F.when(~F.col("whole"), F.array(found(F.lit("$"), "object"))).otherwise(broken((F.col("b.version").rlike(r"^-?\d+(\.0+)?$"), F.lit("$.version"), "version"), (a_list(F.col("b.cases")), F.lit("$.cases"), "cases")))
    heads = top.select("file", F.explode(header).alias("v")).select("file", "v.*")
    cases = top.where(F.col("whole") & a_list(F.col("b.cases"))).select("file", F.posexplode(F.from_json("b.cases", f"array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in CASE.split(', '))}>>")).alias("k", "c"))
    # the first case with an id, by place, keeps it; a grouped minimum, no file's cases meet in one task
    firsts = cases.where(filled(F.col("c.id"))).groupBy("file", F.col("c.id").alias("id")).agg(F.min("k").alias("first"))
    cases = cases.withColumn("id", F.col("c.id")).join(firsts, ["file", "id"], "left")
    at = lambda name: F.concat(F.lit("$.cases["), F.col("k").cast("string"), F.lit(f"]{name}"))
    mission = F.coalesce(F.col("c.expectedIntent") == "mission", F.lit(False))
    slots = F.col("c.mission.requiredSlots")
    rules = broken(
        (filled(F.col("c.id")), at(".id"), "id"),
        (filled(F.col("c.query")), at(".query"), "query"),
        (a_list(F.col("c.slices")), at(".slices"), "slices"),
        (F.col("first").isNull() | (F.col("first") == F.col("k")), at(".id"), "duplicate id"),
        (F.col("c.expectedIntent").isin(*INTENTS), at(".expectedIntent"), "intent"),
        (a_list(F.col("c.relevanceRules")), at(".relevanceRules"), "relevance rules"),
        (filled(F.col("c.idealRelevance")), at(".idealRelevance"), "ideal relevance"),
        (~mission | (a_list(slots) & ~slots.rlike(r"^\[\s*\]$")), at(".mission.requiredSlots"), "required slots"),
    )
    return heads.unionByName(cases.select("file", F.explode(rules).alias("v")).select("file", "v.*"))
