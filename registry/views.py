"""Input views: posts, messages, evidence and judge answers derived from the given tables.

The given texts are invented prose, so a sentence with support vocabulary, picked by the
row's own ids, goes in front of conversation texts and stands for the body of an event.
Every view has a Spark form here and a SQL form in ``registry.oracles``; all of them grow
with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.sources.posts import normalize_posts
from threadweave.sources.tables import deal, spread

BRAND = "helpdesk"
DRAFTED_A_TASK = 25_000  # messages with their evidence
EPOCH = 1_704_067_200  # 2024-01-01 00:00:00 UTC

MESSAGES = [
    "by noon the percent drops to nothing and battery performance is poor",
    "the lightning port is loose so it will not charge overnight",
    "verifying update has been shown for two hours",
    "power button stuck and a microphone broken from one fall",
    "hotspot won't start on the train and there is no internet",
    "somebody got in, my icloud hacked and two-factor sends nothing",
    "app store keeps asking on every single tap",
    "podcasts freezing on the second episode each morning",
    "payment declined at the till though the bank says yes",
    "the plan page is empty and family sharing shows nobody",
    "out of storage although every picture is gone",
    "where do i turn off the keyboard sound",
    "thx",
    "@helpdesk fix everything",
    "same problem as before over here",
    "draining quickly and now the charger faulty as well",
    "battery draining all night plus slow charging",
    "battery dead and the lightning cable is torn",
    "battery dying since the upgrade on friday",
    "not charging after the upgrade at all",
    "i want my money back for family sharing",
    "refund me and let me manage subscription by myself",
    "billing error and no subscription button anywhere",
    "app store down and maps crashing too",
    "boot loop after the upgrade finished",
    "camera issue since the update came",
    "microphone issue with the latest update",
    "bluetooth drop after the ios upgrade in the car",
    "cannot log in after upgrading last week",
    "out of storage for the new update once more",
    "every app hangs since the update and mail issue on top",
    "notes crashing after the upgrade was done",
    "watch app broken since the update today",
    "how do i get more battery life out of it",
    "how to clean a lightning port",
    "where can i change my password",
    "how do i stop app store spinning",
    "is it possible to get a refund",
    "where do i cancel my subscription",
    "how can i free up space",
    "how to swap a sim card",
    "is it possible to mend a display cracked in two",
    "how do i stop calendar crashing",
    "how to skip the latest update",
    "where do i get a refund or cancel my subscription",
    "how can i stop battery dying since the update",
    "bluetooth issue, out of storage and billing problem at once",
    "screen black, camera dead, trusted device number lost",
    "airdrop issue again, and no sim since noon",
    "the courier left it at the wrong door",
    "lovely colours on the new strap",
    "help!",
    "what is wrong over there",
]

REPLIES = [
    "We are sorry to hear that. Send us a DM with the serial number. https://t.co/q1",
    "There is more room in a private chat: https://t.co/q2",
    "Go to the network page and forget the network, then join it anew. Tell us what happens.",
    "Follow these steps: open Settings and look for a newer release. What iOS is on it?",
    "Thanks for reaching out today. Select General and tap Reset twice. Did you see this last week?",
    "We would love to help you. When did it begin? Have you tried another outlet?",
    "Hello, update to the current release and check out this page! Details: https://t.co/q3",
    "Hi there! What country was it bought in? Direct message us which model it is.",
    "How odd.\nBack up the phone and slide to power off\n\nThen force quit the two apps.",
    "We're glad to look. Meet us in DM, and restart the tablet before that.",
    "An article on this is here: https://t.co/q4",
    "Noted. Somebody will call you.",
    "Can you tell us the colour? can you tell us the colour? CAN YOU TELL US THE COLOUR?",
    "Go to the last page of the list of all devices that were ever used with this profile, pick the one that "
    "has the oldest date beside it, hold it down until a small cross is shown in the corner, and then tap that "
    "cross as often as needed - the list may take a minute to come back.",
    "Force quit it. Force quit the mail program. FORCE QUIT THE MAIL PROGRAM. Select the wheel - ",
    "Which iPad is it, what colour has it, who set it up for you at the start, and were there any other "
    "people near it on the evening on which all of this was noticed by you for the very first time?",
    "",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """For views that feed patterns and tokenisers."""
    return spread(table(spark, folder, name))


def pick(words: list[str], position: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), (position % len(words)).cast("int"))


def raw_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts as they would lie in a file: every column but the sequence number is text."""
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    ident = conv * 1_000_000 + turn
    number = ident.cast("string")
    assistant = role == "assistant"
    when = F.timestamp_seconds(F.lit(EPOCH) + conv * 3600 + turn * 60)
    written = F.date_format(when, "EEE MMM dd HH:mm:ss Z yyyy")
    parent = (
        F.when(turn == 0, "nan")
        .when(assistant & (F.length("text") % 13 == 0), F.concat(F.lit("lost"), number))
        .when(assistant & (conv % 19 == 0) & (turn >= 3), (ident - 2).cast("string"))
        .otherwise((ident - 1).cast("string"))
    )
    answer = (ident + 1).cast("string")
    body = (
        F.when((conv % 17 == 0) & (turn == 1), "  ")
        .when(role == "user", F.concat(pick(MESSAGES, conv * 3 + turn), F.lit(" "), F.col("text")))
        .when(assistant, F.concat(pick(REPLIES, conv + turn * 5), F.lit(" "), F.col("text")))
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "conversations").select(
        F.when(turn % 3 == 0, F.concat(number, F.lit(".0"))).otherwise(number).alias("tweet_id"),
        F.when(assistant, BRAND).when(role == "system", "other_brand")
        .otherwise(F.concat(F.lit("u"), conv.cast("string"))).alias("author_id"),
        F.when(role == "user", "True").otherwise("False").alias("inbound"),
        F.when((conv % 23 == 7) & (turn == 2), "2024-01-01 00:00:00").otherwise(written).alias("created_at"),
        body.alias("text"),
        F.when(conv % 2 == 0, F.concat(answer, F.lit(".0, "), answer, F.lit("-x")))
        .otherwise(answer).alias("response_tweet_id"),
        parent.alias("in_response_to_tweet_id"),
        ident.alias("ingest_seq"),
    )


# Letters and what unfolds to them: ligatures, an ellipsis, a mathematical letter.
LIGATURES = [("ffi", "\ufb03"), ("fi", "\ufb01"), ("st", "\ufb06"), ("...", "\u2026"), ("a", "\U0001d41a")]


def circular_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as a chain of replies; in every third one the first turn answers the last."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ident = F.col("conv_id") * 1_000_000
    parent = F.when(F.col("turn") > 0, ident + F.col("turn") - 1).when(F.col("conv_id") % 3 == 0, ident + F.col("last"))
    return turns.join(last, "conv_id").select(
        (ident + F.col("turn")).cast("string").alias("tweet_id"), parent.cast("string").alias("in_response_to_tweet_id"),
        (ident + F.col("turn")).alias("ingest_seq"),
    )


def posts(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_posts(raw_posts(spark, folder))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Customer messages with a reply: events, whole documents, customer turns."""
    event = F.col("event_id")
    from_events = spread_table(spark, folder, "events").select(
        F.concat(F.lit("e"), event.cast("string")).alias("customer_tweet_id"),
        F.concat(F.lit("a"), event.cast("string")).alias("agent_tweet_id"),
        F.concat(pick(MESSAGES, event), F.lit(" #"), F.col("user_id").cast("string")).alias("customer_text"),
        pick(REPLIES, event * 5 + F.col("user_id")).alias("agent_text"),
    )
    doc = F.col("doc_id")
    from_documents = spread_table(spark, folder, "documents").select(
        F.concat(F.lit("d"), doc.cast("string")), F.concat(F.lit("ad"), doc.cast("string")),
        F.col("text"), pick(REPLIES, doc),
    )
    ident = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    from_turns = table(spark, folder, "conversations").filter("role = 'user'").select(
        F.concat(F.lit("c"), ident), F.concat(F.lit("ac"), ident), F.col("text"),
        pick(REPLIES, F.col("conv_id") + F.col("turn")),
    )
    return from_events.union(from_documents).union(from_turns)


def reserved(spark: SparkSession, folder: str) -> DataFrame:
    """Message ids set aside for evaluation: labelled documents and error events."""
    labelled = table(spark, folder, "labels").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("customer_tweet_id")
    )
    errors = table(spark, folder, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string"))
    )
    return labelled.union(errors)


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with the labels of two simple rules beside the true one."""
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    text = F.col("text")
    return rows.select(
        F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("example_id"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("ok").alias("truth"),
        F.when(text.contains("worthless"), "toxic").when(text.contains("|"), "low").otherwise("ok").alias("pred_a"),
        F.when(F.col("n_chars") < 300, "low").when(F.col("n_chars") > 9000, "long").otherwise("ok").alias("pred_b"),
    )


def policy_inputs(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, folder, "events").select(
        event.cast("string").alias("example_id"),
        F.when(event % 29 == 0, F.lit(None)).otherwise(pick(FV.TAXONOMY, event)).alias("predicted_intent"),
        ((event % 101) / 100.0).alias("classifier_confidence"),
        F.when(event % 11 != 0, (event * 7 % 100) / 100.0).alias("top_similarity"),
        pick(STATUSES, F.floor(event / 13)).alias("reply_status"),
    )


def drafting_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with their evidence array. Five rows per message come from one event row,
    so the array is built in that row."""
    event = F.col("event_id")

    def item(r: Column) -> Column:
        return F.struct(
            F.concat(F.lit("c"), event.cast("string"), F.lit("-"), r.cast("string")).alias("customer_tweet_id"),
            F.concat(F.lit("a"), event.cast("string"), F.lit("-"), r.cast("string")).alias("agent_tweet_id"),
            pick(MESSAGES, event + r).alias("customer_text"),
            F.when(F.col("event_type") == "view", "").otherwise(
                pick(REPLIES, event * 7 + r * r * 3 + F.col("user_id"))
            ).alias("agent_text"),
            ((event * 7 + r * 13) % 100 / 100.0).alias("similarity_score"),
        )

    five = F.transform(F.sequence(F.lit(0), F.lit(4)), item)
    none = F.filter(five, lambda e: F.lit(False))
    return deal(table(spark, folder, "events"), DRAFTED_A_TASK).select(
        event.cast("string").alias("example_id"), pick(MESSAGES, event).alias("customer_text"),
        pick(FV.TAXONOMY, event).alias("predicted_intent"),
        F.when(F.col("event_type") == "signup", none).otherwise(five).alias("evidence"),
    )


# A reply status may be missing, blank or padded.
STATUSES = ["instructional", "dm_redirect", "insufficient_evidence", " dm_redirect  ", "", None, " ", "instructional "]

JUDGE_ANSWERS = [
    # {s} score, {c} cited id
    '{"scores": {"relevance": {s}, "groundedness": 4, "helpfulness": 4, "safety_appropriateness": 5}, '
    '"serious_failure_detected": false, "serious_failure_type": null, "cited_evidence_ids": ["{c}"], "reasoning": " fine "}',
    '```json\n{"scores": {"relevance": 5.0, "groundedness": {s}, "helpfulness": 3, "safety_appropriateness": 3}, '
    '"serious_failure_detected": false, "cited_evidence_ids": []}\n```',
    '{"scores": {"relevance": 5, "groundedness": 5, "helpfulness": {s}, "safety_appropriateness": 5}, '
    '"serious_failure_detected": true, "serious_failure_type": "false_guarantee", "reasoning": "promise"}',
    '{"scores": {"relevance": true, "groundedness": 4, "helpfulness": 4, "safety_appropriateness": 5}, '
    '"serious_failure_detected": false, "cited_evidence_ids": []}',
    '{"scores": {"relevance": 4, "groundedness": 4, "helpfulness": "five", "safety_appropriateness": 5}, '
    '"serious_failure_detected": false, "cited_evidence_ids": []}',
    '{"scores": {"relevance": 4, "groundedness": 4, "helpfulness": {s}}, "serious_failure_detected": false}',
    '{"scores": {"relevance": 4, "groundedness": 4, "helpfulness": 3.5, "safety_appropriateness": 5}, '
    '"serious_failure_detected": false}',
    '{"scores": {"relevance": 4, "groundedness": 4, "helpfulness": 3, "safety_appropriateness": {s}}, '
    '"serious_failure_detected": "no", "cited_evidence_ids": []}',
    '{"scores": {"relevance": 4, "groundedness": 4, "helpfulness": 3, "safety_appropriateness": 5}, '
    '"serious_failure_detected": false, "cited_evidence_ids": "{c}"}',
    '{"scores": {"relevance": 4, "groundedness": 4, ',
    '[1, 2, 3]',
    '{"serious_failure_detected": false}',
    '{"scores": {"relevance": 4, "groundedness": {s}, "helpfulness": 3, "safety_appropriateness": 3}, '
    '"serious_failure_detected": false, "cited_evidence_ids": ["ok1", "{c}"]}',
]


def judge_answers(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    score = (event % 7).cast("string")
    cited = F.when(event % 5 == 0, F.concat(F.lit("bad"), event.cast("string"))).otherwise("ok1")
    template = pick(JUDGE_ANSWERS, F.floor(event / 2))
    answer = F.replace(F.replace(template, F.lit("{s}"), score), F.lit("{c}"), cited)
    return spread_table(spark, folder, "events").select(
        event.cast("string").alias("example_id"),
        F.when(F.col("event_type") != "signup", answer).alias("response"),
        F.when(event % 9 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("ok1"), F.lit("ok2"))).alias("valid_evidence_ids"),
    )
