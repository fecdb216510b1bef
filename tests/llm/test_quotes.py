from shardloom.llm import quotes as Q
from shardloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, _m string, level int"


def linked(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {(r["conv_id"], r["turn"]): r for r in Q.linked(frame).collect()}


def test_replies_follow_their_originals(spark):
    rows = [
        (1, 0, "u", "How do I sort?\nAnd how fast is it?"),
        (1, 1, "a", "Which language do you use?"),
        (1, 2, "u", "On Monday the helper wrote:\n> Which  LANGUAGE do you use?\n\nPython."),
        (1, 3, "a", "> How do I sort?\nWith sorted()."),
        (1, 4, "u", ">> Which language do you use?\n> Python.\nThen use sorted()."),
        (2, 0, "u", "> How do I sort?\nNobody said that here."),
    ]
    got = linked(spark, rows)
    assert {k: r["reply_turn"] for k, r in got.items()} == {(1, 0): None, (1, 1): None, (1, 2): 1, (1, 3): 0, (1, 4): 2, (2, 0): None}
    assert got[1, 4]["n_ancestors"] == 2 and got[1, 4]["thread_turn"] == 1
    order = sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["position"])
    assert [t for _, t in order] == [0, 3, 1, 2, 4]
    assert got[1, 2]["body"] == "Python." and got[1, 3]["body"] == "With sorted()." and got[1, 4]["body"] == "Then use sorted()."
    assert got[1, 0]["body"] == rows[0][3]
    chat = Q.conversations(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).where("conv_id = 1").orderBy("position").collect()
    assert [r["position"] for r in chat] == [0, 1, 2, 3, 4]


def test_most_votes_then_latest(spark):
    rows = [(1, 0, "u", "alpha\nbeta"), (1, 1, "a", "gamma"), (1, 2, "u", "> alpha\n> beta\n> gamma\nyes"), (1, 3, "u", "> alpha\n> gamma\nno")]
    got = linked(spark, rows)
    assert got[1, 2]["reply_turn"] == 0 and got[1, 3]["reply_turn"] == 1


def test_long_chains(spark):
    rows = [(1, i, "u", f"> line {i - 1}\nline {i}") for i in range(40)]
    got = linked(spark, rows)
    assert all(got[1, i]["reply_turn"] == (i - 1 if i else None) for i in range(40))
    assert all(got[1, i]["thread_turn"] == 0 and got[1, i]["position"] == i for i in range(40))


def test_odd_rows(spark):
    rows = [(None, 0, "u", "x"), (1, None, "u", "> x"), (1, 0, None, None), (1, 1, "u", ""), (1, 1, "u", ""), (1, 2, "u", ">" * 70000), (1, 3, "u", "> \n>>\nz")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = Q.linked(frame).collect()
    assert len(got) == 7 and all(r["reply_turn"] is None for r in got)
    assert sorted(r["position"] for r in got if r["position"] is not None) == [0, 1, 2, 3, 4]
    assert Q.linked(frame.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").collect()]
    got = QUERIES["op10_quotes"](spark, sf_dir).collect()
    assert sorted((r["conv_id"], r["turn"]) for r in got) == sorted(rows)
    place = {}
    for conv, turn in sorted(rows):
        place[conv, turn] = place.get((conv, "n"), 0)
        place[conv, "n"] = place[conv, turn] + 1
    assert all(r["position"] == place[r["conv_id"], r["turn"]] for r in got)  # no quotes here: turn order


def test_repeated_lines_link_to_the_latest(spark):
    rows = [
        (1, 1, "u", "Yes."), (1, 2, "a", "What else?"), (1, 5, "u", "Yes."), (1, 6, "a", "> Yes.\nFine."), (1, 7, "u", "Yes."),
        (1, 2000, "a", "> yes.\nStill fine."),  # beyond a block of turns
        (2, 0, "u", "Yes.\nUse sorted()."), (2, 1, "a", "Yes."), (2, 2, "u", "> Yes.\n> Use sorted().\nok"), (2, 3, "a", "> Yes.\nYes."),
        (3, 4, "u", "> Yes.\nYes."),  # stated in its own turn and in other conversations only
    ]
    got = linked(spark, rows)
    wanted = {(1, 6): 5, (1, 2000): 7, (2, 2): 0, (2, 3): 1}
    assert {k: r["reply_turn"] for k, r in got.items() if r["reply_turn"] is not None} == wanted
    assert got[1, 6]["thread_turn"] == 5 and got[1, 2000]["thread_turn"] == 7
    order = sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["position"])
    assert [t for _, t in order] == [1, 2, 5, 6, 7, 2000]


def test_quotes_wrapped_anew(spark):
    rows = [
        (1, 0, "u", "one two three four five six\n\nseven eight nine"), (1, 1, "a", "something else"),
        (1, 2, "u", "> One two three\n> four five six\nfirst"), (1, 3, "a", "> one two\n> three four five six\n>\n> seven\n> eight nine\nboth"),
        (1, 4, "u", "> four five six\nnot a line"), (1, 5, "a", "a b\nc d"), (1, 6, "u", ">> one two three four\n>> five six\n> a b c d\nthird"),
    ]
    got = linked(spark, rows)
    assert {t: r["reply_turn"] for (_, t), r in got.items()} == {0: None, 1: None, 2: 0, 3: 0, 4: None, 5: None, 6: 5}
    assert got[1, 6]["n_ancestors"] == 2
