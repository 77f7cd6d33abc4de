import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.functions import normalize as N
from threadweave.operators.pairs import pair_examples, pair_quality_counters, support_pairs
from threadweave.plans.runs import prepare_conversations, prepare_pairs
from threadweave.sources import posts as S
from threadweave.sources.sinks import write_table
from threadweave.sources.tables import read_table, reserved_ids

POST = "tweet_id string, author_id string, inbound boolean, created_at timestamp, text string, " \
       "response_tweet_id string, in_response_to_tweet_id string, ingest_seq bigint"
DAY = "2017-10-01 10:00:00"
BRAND = "AcmeHelp"


def posts_frame(spark, rows):
    """Rows: id, author, inbound, text, responses, parent."""
    data = [(r[0], r[1], r[2], DAY, r[3], r[4], r[5], i) for i, r in enumerate(rows)]
    text_time = POST.replace("created_at timestamp", "created_at string")
    return spark.createDataFrame(data, text_time).withColumn("created_at", F.to_timestamp("created_at"))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


ID_CASES = [
    (None, None), ("", None), (" \t", None), ("NULL", None), ("Nan", None), ("<na>", None), ("nat", None), ("none", None),
    ("55", "55"), ("55.0", "55"), (" 55 ", "55"), ("55.00", "55.00"), ("5.5", "5.5"), ("0.0", "0"), ("1234567890123456789", "1234567890123456789"),
    ("1234567890123456789.0", "1234567890123456789"), ("post-7", "post-7"), ("post.0", "post.0"), ("7;8", "7;8"), ("Desk", "Desk"), ("nanny", "nanny"),
]
LIST_CASES = [
    (None, []), ("", []), (" , ,", []), ("null", []), ("4", ["4"]), ("4.0", ["4"]), ("4,5.0,six", ["4", "5", "six"]),
    (" 4 ,none, 4", ["4", "4"]), ("1234567890123456789.0,2", ["1234567890123456789", "2"]),
]


@pytest.mark.parametrize("rule,cases", [(N.normalize_id, ID_CASES), (N.parse_response_ids, LIST_CASES)])
def test_ids(spark, rule, cases):
    rows = spark.createDataFrame([(k, given) for k, (given, _) in enumerate(cases)], "k int, v string")
    assert [r["n"] for r in rows.orderBy("k").select(rule("v").alias("n")).collect()] == [want for _, want in cases]


def test_flags_times_and_phrases(spark):
    assert [value(spark, N.parse_inbound(F.lit(v))) for v in ("True", "YES", "1", "0", "no", None)] == \
        [True, True, True, False, False, False]
    stamp = value(spark, F.unix_timestamp(N.parse_created_at(F.lit("Tue Oct 31 16:10:58 +0000 2017"))))
    assert stamp == 1509466258
    assert value(spark, N.parse_created_at(F.lit("2017-10-31 00:00:00"))) is None
    assert value(spark, N.has_text(F.lit(" \t\n"))) is False
    assert value(spark, N.intent_phrase(F.lit(""))) == "your issue"
    assert value(spark, N.intent_phrase(F.lit("app_store_issue"))) == "app store issue"
    assert value(spark, N.thread_line(F.lit(False), F.lit("a"), F.lit("hi"))) == "[agent | a] hi"
    proposal = N.proposed_intent(F.lit("a"), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    assert value(spark, proposal) == "MACHINE_CANDIDATE: a (also_matched: b,c)"
    assert value(spark, N.proposed_primary(proposal)) == "a"
    assert value(spark, N.proposed_primary(F.lit("junk"))) == "other_or_unclear"


HEAD = "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
# Two threads of the brand (one branching, one with a text over three lines), one of another desk, a
# reply to a post that is not in the file, and a second row of an id.
SHOP = HEAD + (
    "7001,maria,True,Mon Jan 08 09:00:00 +0000 2018,The kettle leaks,\"7002,7003\",\n"
    "7002.0,AcmeHelp,False,Mon Jan 08 09:04:00 +0000 2018,Which model is it?,7004,7001\n"
    "7003,AcmeHelp,False,Mon Jan 08 09:05:00 +0000 2018,Is it still under guarantee?,,7001.0\n"
    "7004,maria,True,Mon Jan 08 09:30:00 +0000 2018,the round one,,7002\n"
    "7010,jun,True,Mon Jan 08 10:00:00 +0000 2018,\"Three things:\nno lid,\n\"\"no\"\" plug\",7011,\n"
    "7011,AcmeHelp,False,Mon Jan 08 10:10:00 +0000 2018,\"Oh dear.\nWe send both.\",,7010\n"
    "7020,ola,True,Mon Jan 08 11:00:00 +0000 2018,Where is the bus?,7021,\n"
    "7021,CityBus,False,Mon Jan 08 11:01:00 +0000 2018,Two stops away,,7020\n"
    "7030,AcmeHelp,False,not a time,We look into it,,6999\n"
    "7001,maria,True,Mon Jan 08 12:00:00 +0000 2018,said again,,\n"
    ",nobody,True,,no id,,\n"
)


@pytest.fixture
def shop(tmp_path):
    path = tmp_path / "shop.csv"
    path.write_text(SHOP, encoding="utf-8")
    return str(path)


def test_file_to_conversations(spark, shop):
    threads, table = prepare_conversations(spark, shop, BRAND)
    assert {r["author_id"] for r in threads.collect()} == {"maria", "jun", BRAND}
    rows = {r["conversation_id"]: r for r in table.collect()}
    assert set(rows) == {"7001", "7010", "7030"}
    kettle = rows["7001"]
    assert (kettle["num_tweets"], kettle["num_customer_tweets"], kettle["num_agent_tweets"]) == (4, 2, 2)
    assert kettle["customer_text"] == "The kettle leaks ||| the round one"
    assert kettle["agent_text"] == "Which model is it? ||| Is it still under guarantee?"
    assert (kettle["first_customer_tweet_id"], kettle["first_agent_tweet_id"]) == ("7001", "7002")
    assert rows["7010"]["customer_text"] == 'Three things:\nno lid,\n"no" plug'
    alone = rows["7030"]
    assert alone["first_customer_tweet_id"] is None and alone["customer_text"] == "" and alone["created_at"] is None


def test_file_to_pairs(spark, shop):
    pairs, counters = prepare_pairs(spark, shop, BRAND)
    assert {(r["customer_tweet_id"], r["agent_tweet_id"]) for r in pairs.collect()} == {("7001", "7002"), ("7001", "7003"), ("7010", "7011")}
    assert {r["agent_text"] for r in pairs.collect()} >= {"Oh dear.\nWe send both."}
    figures = counters.first()
    assert (figures["final_pairs"], figures["dropped_missing_parent"], figures["brand_linked_tweet_rows"]) == (3, 1, 7)
    assert pair_examples(pairs, 2).count() == 2
    everything = {r["tweet_id"]: r for r in S.load_posts(spark, shop).collect()}
    assert len(everything) == 9 and everything["7001"]["text"] == "The kettle leaks" and everything["7004"]["created_at"].minute == 30


def test_csv_is_parsed_once_for_a_brand(spark, shop):
    plan = S.load_posts(spark, shop, BRAND)._jdf.queryExecution().optimizedPlan().toString()
    assert "csv" not in plan and "parquet" in plan
    raw = S.read_posts_csv(spark, shop)._jdf.queryExecution().optimizedPlan().toString()
    assert raw.count("csv") == 1


def test_torn_records_fail_loudly_without_multiline(spark, shop, tmp_path):
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        prepare_pairs(spark, shop, BRAND, multiline=False)
    flat = tmp_path / "flat.csv"
    flat.write_text(SHOP.replace("\nno lid,\n", " ").replace("dear.\nWe", "dear. We"), encoding="utf-8")
    assert prepare_pairs(spark, str(flat), BRAND, multiline=False)[0].count() == 3


def test_missing_words_of_a_file(spark, tmp_path):
    path = tmp_path / "words.csv"
    path.write_text(HEAD + "1,a,True,,N/A,,\n2,a,True,,nullify,NaN,-nan\n", encoding="utf-8")
    rows = {r["tweet_id"]: r for r in S.load_posts(spark, str(path)).collect()}
    assert rows["1"]["text"] == "" and rows["2"]["text"] == "nullify"
    assert rows["2"]["response_tweet_id"] is None and rows["2"]["in_response_to_tweet_id"] is None


def test_csv_errors(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("tweet_id,text\n1,x\n")
    with pytest.raises(ValueError, match="missing required columns"):
        S.read_posts_csv(spark, str(bad))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        S.read_posts_csv(spark, str(tmp_path / "nowhere.csv"))
    assert reserved_ids(spark, str(tmp_path / "nowhere.csv")).count() == 0


def test_first_occurrence_wins_in_file_order(spark, tmp_path):
    for name, text in (("a.csv", "first"), ("b.csv", "second")):
        (tmp_path / name).write_text(
            ",".join(FV.POST_COLUMNS) + f"\n5,u,True,,{text},,\n5,u,True,,again,,\n"
        )
    rows = S.load_posts(spark, str(tmp_path)).collect()
    assert [r["text"] for r in rows] == ["first"]


# id, author, inbound, text, responses, parent; and the pairs they give
PAIR_CASES = {
    "a question and two answers": (
        [("q", "ada", True, "the lamp hums", "r1", None), ("r1", BRAND, False, "since when?", None, "q"), ("r2", BRAND, False, "is it new?", None, "q")],
        {("q", "r1"): "agent_parent+customer_response_id", ("q", "r2"): "agent_parent"},
    ),
    "an answer to an answer pairs with its own parent": (
        [("q", "ada", True, "it hums", "r", None), ("r", BRAND, False, "how loud?", "s", "q"), ("s", "ada", True, "very", "t", "r"), ("t", BRAND, False, "thanks", None, "s")],
        {("q", "r"): "agent_parent+customer_response_id", ("s", "t"): "agent_parent+customer_response_id"},
    ),
    "customers among themselves": ([("q", "ada", True, "odd", "x", None), ("x", "bo", True, "here too", None, "q")], set()),
    "another desk answers": ([("q", "ada", True, "odd", "x", None), ("x", "OtherDesk", False, "we know", None, "q")], set()),
    "the brand answers itself": ([("n", BRAND, False, "news", "m", None), ("m", BRAND, False, "more news", None, "n")], set()),
    "the parent is not loaded": ([("r", BRAND, False, "hello?", None, "gone")], set()),
    "the agent's text is blank": ([("q", "ada", True, "odd", "r", None), ("r", BRAND, False, " \n", None, "q")], set()),
    "listed as an answer but answering elsewhere": (
        [("q", "ada", True, "odd", "r", None), ("p", "bo", True, "even", None, None), ("r", BRAND, False, "yes", None, "p")], {("p", "r"): "agent_parent"},
    ),
}


@pytest.mark.parametrize("name", PAIR_CASES)
def test_pair_rules(spark, name):
    rows, want = PAIR_CASES[name]
    got = support_pairs(posts_frame(spark, rows), BRAND).collect()
    assert {(r["customer_tweet_id"], r["agent_tweet_id"]): r["link_source"] for r in got} == dict(want)


def test_pair_counters(spark):
    rows = [
        ("q1", "ada", True, "it hums", "r1,zz", None), ("r1", BRAND, False, "since when?", None, "q1"),
        ("r2", BRAND, False, "to nobody here", None, "gone"),
        ("d1", "OtherDesk", False, "notice", "r3", None), ("r3", BRAND, False, "seen", None, "d1"),
        ("q2", "bo", True, "\t", "r4", None), ("r4", BRAND, False, "your text was empty", None, "q2"),
        ("q3", "cy", True, "and mine?", "r1", None),
        ("n1", BRAND, False, "opening hours", None, None), ("n2", BRAND, True, "marked wrongly", None, None),
    ]
    got = pair_quality_counters(posts_frame(spark, rows), BRAND).first().asDict()
    assert got == {
        "brand_tweets": 6, "brand_outbound_tweets": 5, "candidate_pairs": 6, "final_pairs": 1,
        "dropped_missing_parent": 1, "dropped_parent_not_inbound_customer": 1, "dropped_empty_text": 2,
        "dropped_not_direct_reply": 1, "added_via_agent_parent": 1, "added_via_customer_response_id": 0,
        "brand_linked_tweet_rows": 10,
    }


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a,\"b\"\nc", ["x"])], "customer_tweet_id string, t string, l array<string>")
    write_table(rows, str(tmp_path / "t"), ["customer_tweet_id", "l"])
    assert read_table(spark, str(tmp_path / "t")).columns == ["customer_tweet_id", "l"]
    write_table(rows.drop("t"), str(tmp_path / "t.csv"))
    assert read_table(spark, str(tmp_path / "t.csv")).first()["l"] == '["x"]'
    assert reserved_ids(spark, str(tmp_path / "t.csv")).count() == 1
