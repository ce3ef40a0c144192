"""Matching of offers to products against the order of a batch worked off one by one."""

import random

from pyspark.sql import functions as F

from shelfspark.operators import matching

CHAIN = "listing_id long, source int, ord int, place int, product_id long, step int, score double, pair_key string, title string, price_minor long, p_title string, p_price double"


def one_by_one(chain, said):
    """(listing -> product, reason): every source's offers in order."""
    out = {}
    for source in {r[1] for r in chain}:
        taken = set()
        for listing in sorted({(r[2], r[0]) for r in chain if r[1] == source}):
            for r in sorted((r for r in chain if r[0] == listing[1]), key=lambda r: r[3]):
                if r[4] in taken:
                    continue
                step, score, answer = r[5], r[6], said.get(r[7])
                attach = step < 3 or score >= 0.86 or (answer if answer is not None else score >= 0.82)
                reason = "number" if step == 1 else "image" if step == 2 else "judge-yes" if answer else "judge-no" if answer is False else "cosine" if attach else "no-match"
                out[listing[1]] = (r[4] if attach else None, reason)
                if attach:
                    taken.add(r[4])
                break
            else:
                out[listing[1]] = (None, "no-match")
    return out


def random_chain(rng, listings, products):
    rows = []
    for i in range(listings):
        liked = rng.sample(range(products), rng.randrange(1, products))
        steps = sorted((rng.choice([1, 2, 3, 3, 3]) for _ in liked))
        scores = sorted((rng.choice([0.79, 0.81, 0.83, 0.85, 0.9]) for _ in liked), reverse=True)
        for place, (p, step, score) in enumerate(zip(liked, steps, scores, strict=True), 1):
            key = f"t{min(i % 5, p)}||t{max(i % 5, p)}" if step == 3 and score < 0.86 else None
            rows.append((i, i % 2, rng.randrange(4), place, p, step, score if step == 3 else 1.0, key, f"t{i % 5}", 100, f"t{p}", 100.0))
    order = {i: rng.randrange(4) for i in range(listings)}
    return [(*r[:2], order[r[0]], *r[3:]) for r in rows]


def test_rounds_give_the_result_of_the_order(spark):
    rng = random.Random(3)
    for n in (3, 12, 25):
        chain = random_chain(rng, n, 6)
        said = {k: rng.choice([True, False, None]) for k in sorted({r[7] for r in chain if r[7]})}
        answers = spark.createDataFrame([*said.items()] or [("", None)], "pair_key string, same boolean")
        asked = []

        def judge(pairs, answers=answers, asked=asked):
            asked.extend(r.pair_key for r in pairs.collect())
            return pairs.join(answers, "pair_key", "left").select("pair_key", "same")

        found, verdicts = matching.claimed(spark.createDataFrame(chain, CHAIN), judge)
        assert {r.listing_id: (r.product_id, r.reason) for r in found.collect()} == one_by_one(chain, said)
        firm = [k for k in asked if said[k] is not None]
        assert len(firm) == len(set(firm))  # each pair is judged once
        assert {r.pair_key for r in verdicts.collect()} == set(firm)


def test_verdicts_are_kept_for_a_day(spark):
    now = F.timestamp_seconds(F.lit(200_000))
    chain = spark.createDataFrame([(1, 1, 0, 1, 7, 3, 0.8, "a||b", "a", 1, "b", 1.0), (2, 1, 1, 1, 8, 3, 0.8, "a||c", "a", 1, "c", 1.0)], CHAIN)
    old = spark.createDataFrame([("a||b", True, 190_000), ("a||c", True, 100_000)], "pair_key string, same boolean, at long").select("pair_key", "same", F.timestamp_seconds("at").alias("judged_at"))
    judge = matching.batched_judge(lambda batch: [False for _ in batch["title"]])
    found, verdicts = matching.claimed(chain, judge, old, now)
    assert {r.listing_id: r.reason for r in found.collect()} == {1: "judge-yes", 2: "judge-no"}
    assert {r.pair_key: r.same for r in verdicts.collect()} == {"a||b": True, "a||c": False}


def test_empty_batch_and_silence(spark):
    found, verdicts = matching.claimed(spark.createDataFrame([], CHAIN))
    assert found.count() == verdicts.count() == 0
    chain = spark.createDataFrame([(1, 1, 0, 1, 7, 3, 0.83, "a||b", "a", 1, "b", 1.0), (2, 1, 1, 1, 8, 3, 0.8, "a||c", "a", 1, "c", 1.0)], CHAIN)
    found, verdicts = matching.claimed(chain)
    assert {r.listing_id: (r.product_id, r.reason) for r in found.collect()} == {1: (7, "cosine"), 2: (None, "no-match")} and verdicts.count() == 0


def test_title_pairs_have_one_key(spark):
    df = spark.createDataFrame([(" A  b", "c"), ("C", "a B ")], "x string, y string")
    assert {r[0] for r in df.select(matching.title_pair_key(F.col("x"), F.col("y"))).collect()} == {"a b||c"}
