from paperloom.llm.queries import quoting_messages
from paperloom.llm.quotes import link_quotes, parse

SCHEMA = "conv_id long, turn long, text string, id string"


def linked(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["__row"]["id"]: r for r in link_quotes(df).collect()}


def test_nested_quotes_lead_to_parents(spark):
    got = linked(spark, [
        (1, 0, "Hello there\nsecond line\n\nAnother paragraph", "a"),
        (1, 1, "On Monday someone wrote:\n> hello   there\n>second line\nI agree", "b"),
        (1, 2, ">> Another paragraph\n> I agree\nMe too\n> unknown words", "c"),
        (1, 3, "> > Hello there\n> > second line\nBack to the start", "d"),
        (1, 4, "No quote", "e"),
        (2, 1, "> I agree", "f"),
        (2, 2, "> later words", "g"),
        (2, 3, "later words", "h"),
    ])
    assert {k: (r["parent"], r["root"], r["depth"], r["n_quotes"], r["n_linked"]) for k, r in got.items()} == {
        "a": (None, 0, 0, 0, 0), "b": (0, 0, 1, 1, 1), "c": (1, 0, 2, 3, 2), "d": (0, 0, 1, 1, 1),
        "e": (None, 4, 0, 0, 0), "f": (None, 1, 0, 1, 0), "g": (None, 2, 0, 1, 0), "h": (None, 3, 0, 0, 0)}
    assert [got[k]["reply"] for k in "bcd"] == ["I agree", "Me too", "Back to the start"]
    assert [got[k]["position"] for k in "abdc"] == [1, 2, 3, 4]


def test_a_long_chain_and_a_repeated_passage(spark):
    rows = [(1, 0, "m0", "0")] + [(1, i, f"> m{i - 1}\nm{i}", str(i)) for i in range(1, 40)]
    rows += [(3, i, "> thanks\nthanks" if i else "thanks", f"t{i}") for i in range(30)]
    got = linked(spark, rows)
    assert all(got[str(i)]["depth"] == i and got[str(i)]["root"] == 0 and got[str(i)]["position"] == i + 1 for i in range(40))
    assert all(got[f"t{i}"]["parent"] == 0 for i in range(1, 30))  # the earliest that says it


def test_nulls_empties_and_repeated_rows(spark):
    got = linked(spark, [(None, 0, "x", "a"), (None, 1, "> x\ny", "b"), (1, None, None, "c"), (1, None, "", "d"), (1, 5, "> > >", "e")])
    assert got["b"]["parent"] == 0 and [got[k]["reply"] for k in "cde"] == ["", "", ""]
    twice = spark.createDataFrame([(1, 0, "x", "a")] * 2, SCHEMA).withColumnRenamed("id", "hash")
    assert link_quotes(twice).count() == 2 and link_quotes(twice.limit(0)).count() == 0


def test_a_long_message(spark):
    text = "\n".join(f"> line {i}\nanswer {i}" for i in range(3000))
    row = parse(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert len(row["__passages"]) == 6000 and row["reply"].count("\n") == 2999


def test_derived_mail_links_every_turn_to_the_one_before(spark, sf):
    """Against the conversations themselves: the quoted turn, unless an earlier one says the same."""
    raw = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        raw.setdefault(r["conv_id"], {})[r["turn"]] = r["text"]
    got = {(r["__row"]["conv_id"], r["__row"]["turn"]): r for r in link_quotes(quoting_messages(spark, sf)).collect()}
    assert len(got) == sum(map(len, raw.values()))
    for (conv, turn), r in got.items():
        turns = sorted(raw[conv])
        k = turns.index(turn)
        says = {t: raw[conv][t] for t in turns}
        if k and len(set(says.values())) == len(says):
            assert r["parent"] == turns[k - 1] and r["root"] == turns[0] and r["depth"] == k
        assert r["reply"] == raw[conv][turn].strip()


def test_parts_of_a_passage_and_messages_of_other_conversations(spark):
    rows = [
        (1, 0, "First line here.\nSecond line. It has two sentences.", "a"),
        (1, 1, "Unrelated words\nFirst line here.", "b"),
        (1, 2, "> second LINE. It has two sentences.\none line", "c"),
        (1, 3, "> It has two sentences.\none sentence", "d"),
        (1, 4, "> Unrelated words\n> First line here.\nwhole passage", "e"),
        (1, 5, "> Unrelated words\n> It has two sentences.\n> Second line.\nmost characters", "f"),
        (2, 6, "> one sentence\nfrom elsewhere", "g"),
    ]
    got = linked(spark, rows)
    assert {k: (r["parent"], r["n_linked"]) for k, r in got.items()} == {
        "a": (None, 0), "b": (None, 0), "c": (0, 1), "d": (0, 1), "e": (1, 1), "f": (1, 1), "g": (None, 0)}
    df = spark.createDataFrame(rows, SCHEMA)
    all_ = {r["__row"]["id"]: r for r in link_quotes(df, conv_col=None).collect()}
    assert (all_["g"]["parent"], all_["g"]["root"], all_["g"]["depth"]) == (3, 0, 2)
