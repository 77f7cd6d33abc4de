import itertools
import re

import pytest
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.functions.patterns import found, match_matrix, with_tags
from threadweave.functions.weak_intent import label_from_mask, with_weak_intent
from threadweave.operators import profile as E
from threadweave.operators import sampling as L
from threadweave.operators import weak_training as W
from threadweave.sources.tables import check_golden_set

LABELS = {
    "@AcmeHelp percent drops all morning": "battery_drain",
    "@AcmeHelp the lightning port is loose": "charging_issue",
    "@AcmeHelp verifying update for two hours": "software_update_issue",
    "Power button stuck, who mends it": "hardware_issue",
    "@AcmeHelp no internet in the whole house": "network_connectivity",
    "@AcmeHelp icloud hacked last night": "account_access",
    "@AcmeHelp app store spinning": "app_store_issue",
    "@AcmeHelp maps crashing at every turn": "app_issue",
    "@AcmeHelp payment declined once more": "payment_or_refund",
    "@AcmeHelp where is the subscription button": "subscription_management",
    "@AcmeHelp out of storage": "storage_issue",
    "hello, where can I see my points": "howto_or_feature",
    "@AcmeHelp ok.": "other_or_unclear",
    "@AcmeHelp fix everything!": "other_or_unclear",
    "@AcmeHelp nothing helps": "other_or_unclear",
    "@AcmeHelp same problem as before": "other_or_unclear",
    "@AcmeHelp same problem as before with the camera": None,
    "@AcmeHelp battery dying since the upgrade": "battery_drain",
    "@AcmeHelp not charging after the upgrade": "charging_issue",
    "@AcmeHelp draining quickly and the charger faulty": None,
    "@AcmeHelp battery draining plus slow charging": "battery_drain",
    "@AcmeHelp battery dead, lightning cable torn": "charging_issue",
    "@AcmeHelp boot loop after the upgrade": "hardware_issue",
    "@AcmeHelp camera issue since the update": "software_update_issue",
    "@AcmeHelp notes crashing after the upgrade": "app_issue",
    "@AcmeHelp every app hangs since the update, mail issue": "software_update_issue",
    "the courier came early": None,
    " \n ": None,
}


def test_weak_labels(spark):
    rows = spark.createDataFrame([(t,) for t in LABELS], "customer_text string")
    got = {r["customer_text"]: r["weak_intent"] for r in with_weak_intent(rows).collect()}
    assert got == LABELS


def model_label(matched, power, money, app, physical):
    """The decision in its seven steps, on plain sets."""
    matched = set(matched)
    table = {frozenset(x[:2]): x[2] or None for x in FV.TWO_LABEL_WINNERS}
    pay, up = {"payment_or_refund", "subscription_management"}, "software_update_issue"
    if not matched:
        return None
    if len(matched) == 1:
        return min(matched)
    duo = {"battery_drain", "charging_issue"}
    if duo <= matched:
        if power is None:
            return None
        if matched in (duo, duo | {up}):
            return power
        matched = (matched - duo) | {power}
    for again in (False, True):
        if again:
            if "howto_or_feature" not in matched:
                break
            matched = matched - {"howto_or_feature"}
            if len(matched) == 1:
                return min(matched)
        if matched == pay:
            return money
        if matched == {"app_issue", up}:
            return app
        if matched == {"hardware_issue", up}:
            return physical
        if frozenset(matched) in table:
            return table[frozenset(matched)]
    if up in matched:
        for symptom in duo:
            if symptom in matched and not duo <= matched:
                return symptom
    return None


def test_decision_for_every_matched_set(spark):
    outcomes = [
        [None, "battery_drain", "charging_issue"], [None, "payment_or_refund", "subscription_management"],
        [None, "software_update_issue", "app_issue"], [None, "hardware_issue", "software_update_issue"],
    ]
    combos = list(itertools.product(*outcomes))
    cases = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(combos)], "combo int, p string, m string, a string, h string"
    )
    labels = spark.range(1 << 13).withColumn("mask", F.col("id").cast("int")).crossJoin(F.broadcast(cases)).select(
        "combo", "mask", label_from_mask(F.col("mask"), F.col("p"), F.col("m"), F.col("a"), F.col("h")).alias("label")
    ).toPandas()
    for combo, mask, label in labels.itertuples(index=False):
        matched = [n for i, n in enumerate(FV.TAXONOMY) if mask >> i & 1]
        assert model_label(matched, *combos[combo]) == (label if isinstance(label, str) else None), (matched, combos[combo])


def test_patterns_behave_like_python_ignorecase(spark):
    texts = [
        "Battery Life", "WI FI not", "ſafari crash", "can’t connect", "can't connect to wifi", "éapp store down",
        "app store blank page", "line\nbreak how do i", "thanks \n", "ÅSIM card", "5G", "please article?", "DM", "",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [p for s in (FV.STRONG_PATTERNS, FV.STRATIFY_PATTERNS, FV.THEME_PATTERNS, FV.RESPONSE_PATTERNS, FV.DISCOVERY_PATTERNS) for _, p in s]
    got = rows.select("t", F.array(*[found("t", p) for p in patterns]).alias("hits")).collect()
    for row in got:
        want = [bool(re.search(p, row["t"], re.I)) for p in patterns]
        assert row["hits"] == want, row["t"]


def pairs_frame(spark, extra=10):
    texts = [  # one for each label, in the order of the labels
        "battery performance got poor", "slow charging by any plug", "stuck since the update", "boot loop every morning",
        "hotspot gone on the train", "two-factor sends me nothing", "app store spinning for hours", "the podcast list is empty",
        "an invoice without a number", "renewal shows the wrong day", "out of storage once more", "where do i turn off the sounds", "help please",
    ]
    bodies = [f"@AcmeHelp {t} #{i}" for t in texts for i in range(20)]
    bodies += [f"@AcmeHelp since the update the battery dies fast and my calendar is gone #{i}" for i in range(extra)]
    bodies += [f"the weather is fine #{i}" for i in range(40)]
    rows = [(str(1000 + i), str(2000 + i), b, "@user ok") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "customer_tweet_id string, agent_tweet_id string, customer_text string, agent_text string")


def model_candidates(rows, target, per_intent, seed):
    """Fill the strata one after another from whole pools."""
    import hashlib

    hit = {k: [n for n, p in FV.STRATIFY_PATTERNS if re.search(p, t, re.I)] for k, t in rows.items()}
    plan = L._strata(per_intent, target)
    sim, pw, lock = (re.compile(p, re.I) for p in (FV.SIM_PATTERN, FV.PASSWORD_PATTERN, FV.LOCK_PATTERN))

    def pool(number):
        tag, intent, _ = plan[number]
        for k, t in rows.items():
            h = hit[k]
            if tag.startswith("stratified:"):
                ok = intent in h and (number % 2 == 1 or len(h) == 1)
            elif tag.startswith("boundary:") and tag.split(":")[1] in [b[0] for b in FV.BOUNDARY_POOLS]:
                _, a, b = next(x for x in FV.BOUNDARY_POOLS if x[0] == tag.split(":")[1])
                ok = a in h and b in h
            else:
                ok = {
                    "boundary:connectivity_vs_sim": bool(sim.search(t)),
                    "boundary:account_lock": bool(lock.search(t)) and not pw.search(t),
                    "boundary:password_reset": bool(pw.search(t)) and not lock.search(t),
                    "vague_or_unclear": "other_or_unclear" in h and len(h) <= 1,
                    "multi_problem": len(h) >= 2, "residual_unmatched": not h, "random_fill": True,
                }[tag]
            if ok:
                yield hashlib.md5(f"{seed}:{number}:{k}".encode()).hexdigest(), k

    used, chosen = set(), []
    for number, (tag, _, quota) in enumerate(plan):
        want = quota
        if tag.startswith("stratified:") and number % 2 == 1:
            want = quota - got
        elif tag in ("residual_unmatched", "random_fill"):
            want = max(target - len(chosen), 0)
        picks = [k for _, k in sorted(pool(number)) if k not in used][:want]
        got = len(picks)
        used.update(picks)
        chosen += [(k, tag) for k in picks]
    if len(chosen) > target + 20:
        chosen = sorted(chosen, key=lambda c: c[1] in ("residual_unmatched", "random_fill"))[:target]
    return chosen


@pytest.mark.parametrize("target,per_intent,seed", [(80, 5, 0), (200, 14, 42), (20, 14, 1)])
def test_annotation_candidates_match_plain_filling(spark, target, per_intent, seed):
    pairs = pairs_frame(spark)
    got = L.annotation_candidates(pairs, target, per_intent, seed).toPandas()
    rows = {f"{r['customer_tweet_id']}:{r['agent_tweet_id']}": r["customer_text"] for r in pairs.collect()}
    want = sorted((k.split(":")[0], tag) for k, tag in model_candidates(rows, target, per_intent, seed))
    assert sorted(zip(got["customer_tweet_id"], got["sampling_tag"])) == want
    assert got["example_id"].is_unique and got["annotator_label"].eq("").all()
    assert got["proposed_intent"].str.startswith("MACHINE_CANDIDATE: ").all()


def test_candidate_sheet(spark):
    rows = L.annotation_candidates(pairs_frame(spark), 80, 5, 0)
    assert L.export_columns(rows).columns == FV.CANDIDATE_COLUMNS
    summary = {(r["measure"], r["name"]): r["n"] for r in L.candidate_summary(rows).collect()}
    assert summary[("n_examples", "all")] == rows.count()
    exported = L.primary_of(L.export_columns(rows)).join(rows.select("example_id", F.col("proposed_primary").alias("want")), "example_id")
    assert exported.filter("proposed_primary <> want").isEmpty()


def test_split_equals_a_full_ranking(spark):
    rows = spark.range(5000).select(
        F.col("id").cast("string").alias("k"),
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "warm").otherwise(F.concat(F.lit("rare"), (F.col("id") % 70).cast("string"))).alias("weak_intent"),
    )
    got = L.stratified_split(rows, "weak_intent", "k", 0.2, 42, bucket_digits=1).collect()
    assert len(got) == 5000
    import hashlib
    groups = {}
    for r in got:
        groups.setdefault(r["weak_intent"], []).append((hashlib.md5(f"42:{r['weak_intent']}:{r['k']}".encode()).hexdigest(), r["k"], r["split"]))
    for members in groups.values():
        members.sort()
        n = int(0.2 * len(members) + 0.5)
        assert [m[2] for m in members] == ["validation"] * n + ["train"] * (len(members) - n)


def test_cut_is_narrowed_until_few_rows_are_ranked(spark):
    """One class of all rows: the radix steps go down to buckets of at most ten rows, the split stays a full ranking."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") > 0, "one").alias("weak_intent"))
    cuts = L.split_cuts(rows, "weak_intent", "k", 0.2, 42, bucket_digits=1, most_ranked=10).collect()
    assert len(cuts) == 1 and cuts[0]["n"] <= 10 and 0 < cuts[0]["_left"] <= cuts[0]["n"]
    got = {(r["k"], r["split"]) for r in L.stratified_split(rows, "weak_intent", "k", 0.2, 42, bucket_digits=1, most_ranked=10).collect()}
    import hashlib
    ranked = sorted((str(k) for k in range(1, 3000)), key=lambda k: (hashlib.md5(f"42:one:{k}".encode()).hexdigest(), k))
    n = int(0.2 * len(ranked) + 0.5)
    assert got == {(k, "validation" if at < n else "train") for at, k in enumerate(ranked)} | {("0", "train")}
    same = spark.range(40).select(F.lit("x").alias("k"), F.lit("one").alias("weak_intent"))
    assert L.stratified_split(same, "weak_intent", "k", 0.2, most_ranked=10).filter("split = 'validation'").count() == 8
    assert L.stratified_split(rows.limit(0), "weak_intent", "k").count() == 0


def test_weak_training_excludes_reserved_ids(spark):
    text = "@AcmeHelp my battery drains overnight"
    pairs = spark.createDataFrame(
        [("1", "a1", text), ("2", "a2", text), ("3", "a3", "hello world no intent here")],
        "customer_tweet_id string, agent_tweet_id string, customer_text string",
    )
    reserved = spark.createDataFrame([("1",), (None,)], "customer_tweet_id string")
    labelled = W.weak_labels(pairs, reserved)
    assert [tuple(r) for r in W.weak_training_rows(labelled).collect()] == [("2", "a2", text, "battery_drain")]
    assert tuple(W.weak_training_summary(pairs, reserved, labelled).first()) == (3, 1, 2, 1, 1)
    counts = W.weak_intent_counts(labelled).orderBy("ord").collect()
    assert [r["weak_intent"] for r in counts] == FV.TAXONOMY and sum(r["n"] for r in counts) == 1
    loose = W.expand_labels(labelled, [("other_or_unclear", "hello")]).filter("customer_tweet_id = '3'").first()
    assert loose["weak_intent"] == "other_or_unclear"


def test_golden_set_checks(spark):
    schema = "example_id string, customer_tweet_id string, customer_text string, annotator_label string"
    good = spark.createDataFrame([("G1", "1", " hi ", "app_issue ")], schema)
    assert tuple(check_golden_set(good).first())[2:] == ("hi", "app_issue")
    for row, problem in ((("G", "1", "x", None), "empty_label"), (("G", "1", " ", "app_issue"), "empty_text"),
                         (("G", "1", "x", "nope"), "unknown_label nope")):
        with pytest.raises(ValueError, match=problem):
            check_golden_set(spark.createDataFrame([row], schema))
    with pytest.raises(ValueError, match="missing required columns"):
        check_golden_set(good.drop("annotator_label"))


def test_profiles(spark):
    rows = spark.createDataFrame(
        [("1", "my battery and wifi"), ("2", "nothing here"), ("3", "refund")], "k string, t string"
    )
    themes = {r["theme"]: (r["n"], r["n_primary"]) for r in E.theme_counts(rows, "t").collect()}
    assert themes["battery_charging"] == (1, 1) and themes["connectivity"] == (1, 0) and themes["other"] == (1, 1)
    assert tuple(E.match_count_summary(rows, "t", FV.THEME_PATTERNS).first()) == (3, 1, 1, 1)
    empty = E.pattern_overlap(rows.filter("false"), "t", FV.DISCOVERY_PATTERNS)
    assert empty.count() == 105 and empty.agg(F.sum("n_both")).first()[0] == 0
    # no text is within the length band, so the theme falls back to any row
    assert {r["theme"] for r in E.representative_rows(rows, "t", "k").collect()} >= {"other", "payments_refunds"}
    tags = with_tags(rows, "t", FV.THEME_PATTERNS).orderBy("k").first()["tags"]
    assert tags == ["battery_charging", "connectivity"]
    assert match_matrix(rows, "t", None).columns[2:15] == FV.TAXONOMY
