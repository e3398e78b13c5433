from pyspark.sql import functions as F

from lodeframe.llm.chat import formatted, preference_pairs, swapped_conversations, swapped_pairs
from lodeframe.llm.common import sums_before

SCHEMA = "pair_id long, side string, turn long, role string, text string, chosen string"


def pairs(spark, *rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA).repartition(2)
    return {r["pair_id"]: r for r in preference_pairs(df).collect()}


def test_common_turns_are_the_prompt(spark):
    got = pairs(
        spark,
        (1, "chosen", 2, "assistant", "good"), (1, "chosen", 1, "user", "hi"), (1, "rejected", 1, "user", "hi"), (1, "rejected", 2, "assistant", "bad"),
        (1, "rejected", 3, "user", "no"), (1, "rejected", 4, "assistant", "é"),
    )[1]
    assert got["prompt"] == "<|user|>\nhi<|end|>\n" and got["prompt_turns"] == 1
    assert got["chosen"] == "<|assistant|>\ngood<|end|>\n"
    assert [got["chosen"][a:b] for a, b in got["chosen_mask"]] == ["good<|end|>"]
    assert [got["rejected"][a:b] for a, b in got["rejected_mask"]] == ["bad<|end|>", "é<|end|>"]


def test_edges(spark):
    got = pairs(
        spark,
        (1, "chosen", 1, "user", "a"), (1, "rejected", 1, "user", "a"),  # equal
        (2, "chosen", 1, "user", "a"), (2, "chosen", 2, "assistant", "b"), (2, "rejected", 1, "user", "a"),  # one begins the other
        (3, "chosen", 1, "user", None), (3, "rejected", 1, None, None),  # nulls
        (4, "chosen", 1, "assistant", "x"),  # one side
        (5, "other", 1, "user", "a"),
        (None, "chosen", None, "user", "a"), (None, "rejected", 1, "user", "b"),
        (6, "chosen", 1, "user", "a"), (6, "chosen", 1, "user", "a"), (6, "rejected", 1, "user", "a"),  # repeated rows
    )
    assert (got[1]["chosen"], got[1]["rejected"], got[1]["prompt_turns"]) == ("", "", 1)
    assert got[2]["rejected"] == "" and got[2]["rejected_turns"] == 0 and got[2]["chosen_turns"] == 1
    assert got[3]["prompt"] == "" and got[3]["chosen"] == "<|user|>\n<|end|>\n" and got[3]["rejected"] == "<|" + "|>\n<|end|>\n"
    assert got[4]["prompt"] == "" and got[4]["rejected"] is None and got[4]["rejected_mask"] is None and got[4]["chosen_turns"] == 1
    assert 5 not in got and got[None]["prompt_turns"] == 0
    assert got[6]["prompt_turns"] == 1 and got[6]["chosen_turns"] == 1
    assert preference_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_swapped_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "assistant", "b0"), (1, 0, "user", "r"), (1, 1, "assistant", "a1"), (2, 0, "assistant", "z"), (3, 0, "user", "no")]
    out = swapped_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    rejected = sorted((r["pair_id"], r["turn"], r["text"]) for r in out if r["side"] == "rejected")
    assert rejected == [(0, 0, "q"), (0, 1, "a0"), (0, 2, "a1"), (1, 0, "r"), (1, 1, "b0")]
    assert sum(r["side"] == "chosen" for r in out) == len(rows)


def test_rows_without_ids_are_conversations_of_their_own(spark):
    rows = [(None, t % 3, "assistant" if t % 2 else "user", f"t{t}") for t in range(2000)] + [(4, 0, "assistant", "a"), (5, 0, "assistant", "b")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = formatted(swapped_conversations(talk)).collect()
    alone = [r for r in out if r["pair_id"] is None]
    assert len(out) == 2002 and len(alone) == 2000
    assert all(r["prompt"] == "" and r["chosen_turns"] == 1 and r["rejected"] is None for r in alone)
    assert {r["chosen"] for r in alone} == {f"<|{role}|>\n{text}<|end|>\n" for i, _, role, text in rows if i is None}
    sides = talk.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    got = [r for r in preference_pairs(sides).collect() if r["pair_id"] is None]
    assert len(got) == 2000 and all(r["chosen"] is None and r["rejected_turns"] == 1 for r in got)


def test_text_ids(spark):
    rows = [(c, 0, "assistant", f"said by {c}") for c in ("6", "7", "07", "x", "y", "", " 8", "9")]
    out = formatted(swapped_conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))).collect()
    rejected = {r["pair_id"]: r["rejected"] for r in out}
    assert len(out) == 8 and {k for k, v in rejected.items() if v} == {"6", "7"}
    assert rejected["6"] == "<|assistant|>\nsaid by 7<|end|>\n"


def test_both_ways_give_the_same(spark):
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], None if t == 4 else f"{c % 4} é{t}") for c in range(-3, 40) for t in range(c % 6)]
    rows += [(None, 1, "assistant", "x"), (7, 3, "assistant", "twice"), (7, 3, "assistant", "twice"), (8, None, "assistant", "null turn")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    one, other = formatted(swapped_conversations(talk)), preference_pairs(swapped_pairs(talk))
    assert one.columns == other.columns and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_a_conversation_of_very_many_turns(spark):
    turns = 20_000
    talk = spark.range(turns * 2).select((F.col("id") / turns).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("ab").alias("text"))
    talk = talk.withColumn("text", F.when(F.col("turn") % turns == 0, F.concat("text", F.col("conv_id").cast("string"))).otherwise(F.col("text")))
    talk = talk.withColumn("turn", F.when(F.col("turn") % turns == 0, turns).otherwise(F.col("turn") % turns))  # the odd one comes last
    rows = formatted(swapped_conversations(talk)).collect()
    for r in rows:
        assert r["prompt_turns"] == turns - 1 and r["chosen"] != r["rejected"] and len(r["chosen_mask"]) == 1
    chosen = talk.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    (row,) = preference_pairs(chosen.where("pair_id = 0")).collect()
    assert len(row["chosen_mask"]) == turns and all(row["chosen"][a:b].endswith("<|end|>") for a, b in row["chosen_mask"])


def test_sums_before(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        (row,) = spark.range(1).select(sums_before(F.transform(F.slice(F.sequence(F.lit(0), F.lit(1000)), 1, n), lambda x: x.cast("long"))).alias("s")).collect()
        assert row["s"] == [i * (i - 1) // 2 for i in range(n + 1)]
