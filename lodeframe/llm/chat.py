"""Preference formatting of conversation pairs.

A pair is a chosen and a rejected conversation. The turns at their beginnings that agree in role and text are rendered
once, as the prompt; what follows on either side is rendered as its completion, with a mask of the parts that a
training loss may count: what the assistant says there, with the mark that ends its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, quoted, sums_before

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(MIDDLE))


def rendered(turns: Column) -> Column:
    """Text of an array of turns (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def mask(turns: Column, role: str = "assistant") -> Column:
    """Spans (start, stop) of code points in the rendered turns that are the role's words and end marks."""
    length = F.transform(turns, lambda t: (F.length(_head(t)) + F.length(t["text"]) + len(END)).cast("long"))

    def spans(s: Column) -> Column:
        span = lambda t, i: F.struct(
            (t["role"] == role).alias("own"),
            (F.get(s["at"], i) + F.length(_head(t))).alias("start"),
            (F.get(s["at"], i + 1) - 1).alias("stop"),
        )
        own = F.filter(F.transform(s["turns"], span), lambda x: x["own"])
        return F.transform(own, lambda x: F.struct(x["start"], x["stop"]))

    return let(F.struct(turns.alias("turns"), sums_before(length).alias("at")), spans)


def _turn(text: Column) -> Column:
    """A turn as it is ordered: by turn (null first), role, text."""
    return F.struct(
        quoted("turn").alias("turn"), F.coalesce(quoted("role").cast("string"), F.lit("")).alias("role"), text.alias("text")
    )


def formatted(pairs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """pairs (pair_id, chosen, rejected: arrays of turns (turn, role, text) in any order; empty or null where the side is
    missing), formatted as preference_pairs() says. Row by row, without a shuffle."""
    sides = {"c": "chosen", "r": "rejected"}
    said = lambda c: F.transform(F.array_sort(F.coalesce(quoted(c), F.array())), lambda t: F.struct(t["role"], t["text"]))
    pairs = pairs.select("pair_id", *[said(name).alias(side) for side, name in sides.items()])
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, least), F.slice("r", 1, least), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    first_other = F.array_position(same, F.lit(False)).cast("int")
    pairs = pairs.withColumn("n", F.when(first_other == 0, least).otherwise(first_other - 1))
    columns = [
        F.col("pair_id"),
        rendered(F.slice("c", 1, F.col("n"))).alias("prompt"),
        F.col("n").cast("long").alias("prompt_turns"),
    ]
    for side, name in sides.items():
        rest = F.slice(side, F.col("n") + 1, F.size(side))
        there = F.size(side) > 0
        columns += [
            F.when(there, rendered(rest)).alias(name),
            F.when(there, F.size(rest)).cast("long").alias(f"{name}_turns"),
            F.when(there, mask(rest, trained_role)).alias(f"{name}_mask"),
        ]
    return pairs.select(*columns)


def preference_pairs(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Formats pairs given by their turns: pair_id, side ('chosen' or 'rejected'), turn, role, text.

    Returns pair_id, prompt, prompt_turns, and for either side its completion, its turns there (``_turns``) and mask
    (``_mask``, spans of code points in the completion). Turns are ordered by turn, then role, then text, so that rows
    in any order give one result and repeated rows are repeated turns; null texts are empty, null roles are '' and null
    turns come first. A pair of which one side is missing has a null completion there, an empty prompt and the other side
    whole. Where one conversation is the beginning of the other, its completion is empty; where both are equal, both are.
    A row with a null pair_id belongs to no other: each is a pair of its own with that one turn, so that such rows, however
    many, never meet. Other sides and columns are not read, whatever their names; an empty table gives an empty
    one. A conversation of any length has to fit into one row, as its rendering does.
    """
    turn = _turn(F.coalesce(quoted("text").cast("string"), F.lit("")))
    of = lambda side: F.collect_list(F.when(quoted("side") == side, turn)).alias(side)
    turns = turns.where(quoted("side").isin("chosen", "rejected"))
    pairs = turns.where(quoted("pair_id").isNotNull()).groupBy("pair_id").agg(of("chosen"), of("rejected"))
    alone = lambda side: F.when(quoted("side") == side, F.array(turn)).otherwise(F.array()).alias(side)
    single = turns.where(quoted("pair_id").isNull()).select("pair_id", alone("chosen"), alone("rejected"))
    return formatted(pairs.unionByName(single), trained_role)


def swapped_conversations(conversations: DataFrame) -> DataFrame:
    """Pairs out of plain conversations (conv_id, turn, role, text): pair_id, chosen and rejected, for formatted().

    Each conversation is chosen. Its rejected side has the same turns, but what the assistant says last comes from the
    other conversation of the same two (ids 2k and 2k + 1). A conversation without such a turn, or whose other one has
    none, has no rejected side. Both conversations of two are brought together once. Ids may be texts: those that aren't
    whole numbers as they are written have no other conversation. A row with a null conv_id is a conversation of its own,
    without other turns and without a rejected side, so that such rows, however many, never meet.
    """
    text = F.coalesce(quoted("text").cast("string"), F.lit(""))
    conv, number = quoted("conv_id"), quoted("conv_id").try_cast("long")
    half = F.when(number.cast("string") == conv.cast("string"), F.shiftright(number, 1))
    row = F.struct(conv.alias("conv_id"), _turn(text).alias("turn"))
    named = conversations.where(conv.isNotNull()).groupBy(half.alias("half"), F.when(half.isNull(), conv).alias("own"))
    two = named.agg(F.collect_list(row).alias("rows")).select("rows")
    two = two.unionByName(conversations.where(conv.isNull()).select(F.array(row).alias("rows")))
    each = two.select("rows", F.explode(F.array_distinct(F.transform("rows", lambda x: x["conv_id"]))).alias("pair_id"))

    def last_said(turns: Column) -> Column:
        said = F.filter(turns, lambda t: t["role"] == "assistant")
        return F.array_max(F.transform(said, lambda t: F.struct(t["turn"], t["text"])))

    def both(s: Column) -> Column:
        """From turns, other turns: the turns and, if there is such a pair, the swapped ones. Every value that a lambda uses
        for each turn is bound, as an expression would be worked out for each."""
        last = F.struct(s["turns"].alias("turns"), last_said(s["turns"]).alias("last"), last_said(s["others"]).alias("other"))

        def placed(x: Column) -> Column:
            is_last = lambda t: (t["role"] == "assistant") & F.struct(t["turn"], t["text"]).eqNullSafe(x["last"])
            place = F.array_position(F.transform(x["turns"], is_last), F.lit(True))
            return F.struct(x["turns"].alias("turns"), x["last"].alias("last"), x["other"].alias("other"), place.alias("place"))

        def swapped(x: Column) -> Column:
            text = lambda t, i: F.when(i + 1 == x["place"], x["other"]["text"]).otherwise(t["text"])
            instead = lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), text(t, i).alias("text"))
            rejected = F.when(x["last"].isNotNull() & x["other"].isNotNull(), F.transform(x["turns"], instead))
            return F.struct(x["turns"].alias("chosen"), rejected.alias("rejected"))

        return let(let(last, placed), swapped)

    turns_of = lambda same: F.transform(
        F.filter("rows", lambda x: x["conv_id"].eqNullSafe(F.col("pair_id")) == F.lit(same)), lambda x: x["turn"]
    )
    sides = let(F.struct(turns_of(True).alias("turns"), turns_of(False).alias("others")), both)
    return each.select("pair_id", sides.alias("s")).select("pair_id", "s.chosen", "s.rejected")


def swapped_pairs(conversations: DataFrame) -> DataFrame:
    """The pairs of swapped_conversations() by their turns, for preference_pairs()."""
    pairs = swapped_conversations(conversations)
    of = lambda side: pairs.select("pair_id", F.lit(side).alias("side"), F.explode(side).alias("t")).select("pair_id", "side", "t.*")
    return of("chosen").unionByName(of("rejected"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    pairs = formatted(swapped_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return pairs.withColumnRenamed("pair_id", "conv_id").withColumns(
        {c: spans_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")}
    )


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY coalesce((role = 'assistant')::INT, 0) DESC, turn DESC, text DESC) = 1
           AND coalesce(role = 'assistant', false) AS last
  FROM conversations
), o AS (
  SELECT a.conv_id, b.text FROM t a JOIN t b
  ON a.last AND b.last AND b.conv_id = a.conv_id + CASE WHEN a.conv_id % 2 = 0 THEN 1 ELSE -1 END
), s AS (
  SELECT conv_id, 'chosen' AS side, turn, role, text FROM t
  UNION ALL
  SELECT conv_id, 'rejected', turn, role, CASE WHEN last THEN o.text ELSE t.text END FROM t JOIN o USING (conv_id)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role, text) AS pos FROM s
), n AS (
  SELECT c.conv_id, count(c.pos) FILTER (c.pos < coalesce(f.pos, 1000000000) AND r.pos IS NOT NULL) AS prompt_turns
  FROM (SELECT * FROM p WHERE side = 'chosen') c
  LEFT JOIN (SELECT * FROM p WHERE side = 'rejected') r ON r.conv_id = c.conv_id AND r.pos = c.pos
  LEFT JOIN (SELECT a.conv_id, min(a.pos) AS pos FROM p a JOIN p b
             ON a.side = 'chosen' AND b.side = 'rejected' AND a.conv_id = b.conv_id AND a.pos = b.pos
               AND (a.role <> b.role OR a.text <> b.text) GROUP BY 1) f ON f.conv_id = c.conv_id
  GROUP BY 1
), q AS (
  SELECT p.*, n.prompt_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r,
         length('<|' || role || '|>' || chr(10)) AS head
  FROM p JOIN n USING (conv_id)
), z AS (
  SELECT *, coalesce(sum(length(r)) OVER (PARTITION BY conv_id, side, pos > prompt_turns ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM q
)
SELECT conv_id,
       coalesce(string_agg(r, '' ORDER BY pos) FILTER (side = 'chosen' AND pos <= prompt_turns), '') AS prompt,
       max(prompt_turns)::BIGINT AS prompt_turns,
       coalesce(string_agg(r, '' ORDER BY pos) FILTER (side = 'chosen' AND pos > prompt_turns), '') AS chosen,
       count(*) FILTER (side = 'chosen' AND pos > prompt_turns) AS chosen_turns,
       coalesce(string_agg((begins + head) || ':' || (begins + head + length(text) + 7), ',' ORDER BY pos)
         FILTER (side = 'chosen' AND pos > prompt_turns AND role = 'assistant'), '') AS chosen_mask,
       CASE WHEN count(*) FILTER (side = 'rejected') > 0 THEN
         coalesce(string_agg(r, '' ORDER BY pos) FILTER (side = 'rejected' AND pos > prompt_turns), '') END AS rejected,
       CASE WHEN count(*) FILTER (side = 'rejected') > 0 THEN
         count(*) FILTER (side = 'rejected' AND pos > prompt_turns) END AS rejected_turns,
       CASE WHEN count(*) FILTER (side = 'rejected') > 0 THEN
         coalesce(string_agg((begins + head) || ':' || (begins + head + length(text) + 7), ',' ORDER BY pos)
           FILTER (side = 'rejected' AND pos > prompt_turns AND role = 'assistant'), '') END AS rejected_mask
FROM z GROUP BY conv_id
"""
