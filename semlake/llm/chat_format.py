"""Preference formatting: paired, masked completions that share one prompt.

The longest common prefix of turns (same role, same text) of a chosen and a rejected conversation is rendered once as the
prompt; what follows on each side is that side's completion, a list of segments of which only the assistant's are
trained on.

Defined results: turns go by (turn, role, text), nulls first, and a repeated row is a turn of its own; null roles and
texts are rendered as empty and are equal to each other only; an empty table has an empty result; rows with a null conversation belong to none and are left
out; a pair without a rejected (or chosen) side has an empty prefix and a null completion there; other columns, whatever
their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
SEGMENTS = "array<struct<text:string,trained:boolean>>"


def rendered(turn: Column) -> Column:
    """<|role|> on a line of its own, then the text and a line end."""
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("\n"))


def format_preferences(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """turns (pair_id, chosen: boolean, turn, role, text) to (pair_id, n_common, prompt, chosen, rejected): a row for each pair.

    Both sides come together in one aggregation by pair; a conversation is the unit that is formatted, so its turns meet
    in one task, and no key gathers more than two conversations.
    """
    one = F.struct("turn", "role", "text")
    pairs = turns.where(F.col("pair_id").isNotNull() & F.col("chosen").isNotNull()).groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), one))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("chosen"), one))).alias("r"),
    )
    return formatted(pairs, trained_role)


def formatted(pairs: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """The same from pairs (pair_id, c, r), whose sides are turns in order."""
    differs = F.filter(
        F.sequence(F.lit(1), F.least(F.size("c"), F.size("r"))),
        lambda i: ~(
            F.element_at("c", i)["role"].eqNullSafe(F.element_at("r", i)["role"])
            & F.element_at("c", i)["text"].eqNullSafe(F.element_at("r", i)["text"])
        ),
    )
    shorter = F.least(F.size("c"), F.size("r"))
    common = F.when(shorter == 0, 0).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, shorter))

    def completion(side: str) -> Column:
        rest = F.slice(side, F.col("n_common") + 1, F.size(side))
        trained = lambda t: F.coalesce(t["role"] == trained_role, F.lit(False))
        segments = F.transform(rest, lambda t: F.struct(rendered(t).alias("text"), trained(t).alias("trained")))
        return F.when(F.size(side) > 0, segments)

    # sequence(1, 0) would count downwards, so an empty side never gets there.
    return pairs.withColumn("n_common", common).select(
        "pair_id",
        "n_common",
        F.array_join(F.transform(F.slice("c", 1, F.col("n_common")), rendered), "").alias("prompt"),
        completion("c").alias("chosen"),
        completion("r").alias("rejected"),
    )


def replies_as_pairs(conversations: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """(pair_id, c, r) for a table without preferences of its own: every conversation is chosen; rejected are its turns
    before its last reply (turn of that role), followed by the last reply of its neighbour (2n for 2n + 1, and the other way
    round). Where either has no reply, nothing is rejected."""
    one = F.struct("turn", "role", "text")
    mine = F.struct(F.col("conv_id").alias("pair_id"), F.lit(True).alias("own"))
    theirs = F.when(F.col("role") == role, F.struct(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.lit(False).alias("own")))
    rows = conversations.where("conv_id is not null").select(F.explode(F.array_compact(F.array(mine, theirs))).alias("p"), one.alias("one"))
    sides = rows.groupBy("p.pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("p.own"), F.col("one")))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("p.own"), F.col("one")))).alias("o"),
    )
    last = F.array_max(F.transform(F.filter("c", lambda t: t["role"] == role), lambda t: t["turn"]))
    sides = sides.where(F.size("c") > 0).withColumn("last", last)
    reply = F.filter("o", lambda t: t["turn"] == F.array_max(F.transform("o", lambda t: t["turn"])))
    sides = sides.withColumn("reply", F.when(F.col("last").isNotNull(), reply).otherwise(F.slice("o", 1, 0)))
    before = F.filter("c", lambda t: t["turn"] < F.col("last"))
    return sides.select("pair_id", "c", F.when(F.size("reply") > 0, F.concat(before, "reply")).otherwise(F.slice("c", 1, 0)).alias("r"))


def digest(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask): completions as text, and their masks as
    runs start:end of trained characters."""

    def text(side: str) -> Column:
        return F.array_join(F.transform(side, lambda s: s["text"]), "")

    def mask(side: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("runs"))
        step = lambda a, s: F.struct(
            (a["at"] + F.char_length(s["text"])).alias("at"),
            F.when(
                s["trained"],
                F.array_append(a["runs"], F.concat(a["at"].cast("string"), F.lit(":"), (a["at"] + F.char_length(s["text"])).cast("string"))),
            ).otherwise(a["runs"]).alias("runs"),
        )
        return F.aggregate(side, start, step, lambda a: F.array_join(a["runs"], ","))

    return pairs.select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"), "prompt", text("chosen").alias("chosen"), text("rejected").alias("rejected"),
        mask("chosen").alias("chosen_mask"), mask("rejected").alias("rejected_mask"),
    )


ORACLE = """
    WITH o AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
    la AS (SELECT conv_id, max(turn) AS la FROM o WHERE role = 'assistant' GROUP BY conv_id),
    y AS (SELECT l.conv_id AS pair_id, l.la AS turn, o.role, o.text FROM la l JOIN la n ON n.conv_id = xor(l.conv_id, 1) AND l.la IS NOT NULL
          JOIN o ON o.conv_id = n.conv_id AND o.turn = n.la AND o.role = 'assistant'),
    x AS (SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM o UNION ALL SELECT pair_id, 1, turn, role, text FROM y UNION ALL
          SELECT conv_id, 1, turn, role, text FROM o JOIN la USING (conv_id) WHERE turn < la AND conv_id IN (SELECT pair_id FROM y)),
    t AS (SELECT pair_id, side, role, text, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS s,
                 row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM x),
    n AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY pair_id),
    d AS (SELECT a.pair_id, min(a.i) AS i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.i = b.i
          AND (a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) GROUP BY a.pair_id),
    p AS (SELECT pair_id, nc, nr, coalesce(d.i - 1, least(nc, nr)) AS n_common FROM n LEFT JOIN d USING (pair_id)),
    u AS (SELECT t.*, n_common, CASE WHEN t.i > n_common THEN length(s) ELSE 0 END AS l FROM t JOIN p USING (pair_id)),
    v AS (SELECT *, sum(l) OVER (PARTITION BY pair_id, side ORDER BY i) AS e FROM u),
    g AS (SELECT pair_id,
            coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i <= n_common), '') AS prompt,
            coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i > n_common), '') AS chosen,
            coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 1 AND i > n_common), '') AS rejected,
            coalesce(string_agg((e - l)::BIGINT || ':' || e::BIGINT, ',' ORDER BY i) FILTER (side = 0 AND i > n_common AND role = 'assistant'), '') AS chosen_mask,
            coalesce(string_agg((e - l)::BIGINT || ':' || e::BIGINT, ',' ORDER BY i) FILTER (side = 1 AND i > n_common AND role = 'assistant'), '') AS rejected_mask
          FROM v GROUP BY pair_id)
    SELECT pair_id, n_common, prompt, CASE WHEN nc > 0 THEN chosen END AS chosen, CASE WHEN nr > 0 THEN rejected END AS rejected,
           CASE WHEN nc > 0 THEN chosen_mask END AS chosen_mask, CASE WHEN nr > 0 THEN rejected_mask END AS rejected_mask
    FROM g JOIN p USING (pair_id)"""
