"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of at most ``budget`` tokens. A window holds the system turn (a first
turn of that role), some of the turns before it as history, and its own span of turns. Prefix sums of the turns'
tokens choose all of that: the line of tokens is cut every ``stride``; turns that lie within a cut belong to its
span, a turn that crosses a cut is a span of its own, and history are the turns that end at most ``history``
tokens before the span begins, fewer where the span and the system turn leave less of the budget. Where the system turn leaves less
than a stride, cuts are that much closer. Each turn is in exactly one span; its text is a target there, if it is the
assistant's, and masked wherever it is repeated. Turns and the system turn are never cut: a window is over the budget
only if one turn is, alone or together with the system turn. A system turn as long as the budget is not repeated.

Written form: ``### role\\n text </turn>\\n``. Inside roles and texts the letters of that frame are written as
codes (``ESCAPES``), so no text can contain a control string, and reading back is exact.

Prefix sums are taken per block of turn numbers and over the blocks' totals, and spans are grouped one by one,
so a conversation of any length is spread over tasks until its digest is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitlens.llm.common import text_of, word_count
from hitlens.session import land

BUDGET, HISTORY, STRIDE = 1024, 256, 512
BLOCK_TURNS = 256
OPEN, CLOSE = "### ", "</turn>\n"
# In this order when writing, in the reverse order when reading: the code of the backslash comes first and last.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(text: Column, codes=ESCAPES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=ESCAPES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, role, piece, tokens, system, begin: turns in order with the tokens before them.

    ``system`` are the tokens of the conversation's system turn, null without one.

    Order is by turn (null last), then role and text, so repeated rows keep a place each. Null role or text: empty.
    Tokens are words of the written turn, at least one.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text")
    ).withColumns(
        {
            "block": F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(2**62)),
            "piece": F.concat(
                F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE)
            ),
        }
    )
    rows = rows.withColumn("tokens", word_count(F.col("piece")))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {"inside": F.sum("tokens").over(upto) - F.col("tokens"), "number": F.row_number().over(order) - 1}
    )
    first = (F.col("number") == 0) & (F.col("role") == "system")
    totals = rows.groupBy("conv_id", "block").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("turns"), F.max(F.when(first, F.col("tokens"))).alias("system")
    )
    blocks = Window.partitionBy("conv_id").orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"),
        F.first("system").over(blocks.rowsBetween(Window.unboundedPreceding, 0)).alias("system"),
    )
    placed = rows.join(totals, rows["conv_id"].eqNullSafe(totals["c"]) & (rows["block"] == totals["b"]))
    return placed.select(
        "conv_id",
        (F.col("turns_before") + F.col("number")).alias("at"),
        "role",
        "piece",
        "tokens",
        "system",
        (F.col("tokens_before") + F.col("inside")).alias("begin"),
    )


def windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, stride: int = STRIDE
) -> DataFrame:
    """One row per window: conv_id, span, text, own (turns of the span), tokens, loss.

    ``loss`` lists the parts of ``text`` that are targets as (begin, length) in code points. ``stride`` and
    ``history`` are the most, and must leave room for a short system turn in ``budget``.
    """
    if history > stride or history + stride >= budget:
        raise ValueError("history may not exceed stride, and both must leave room in the budget")
    rows = land(turns(conversations), "chat-turns")
    system_tokens = F.coalesce(F.when(F.col("system") < budget, F.col("system")), F.lit(0))
    stride = F.least(F.lit(stride), budget - system_tokens)
    end = F.col("begin") + F.col("tokens")
    cell = F.floor(F.col("begin") / stride)
    crosses = F.floor((end - 1) / stride) > cell
    # Even numbers: spans within a cut; odd ones: a turn that crosses the end of that cut.
    rows = rows.withColumn("span", cell * 2 + crosses.cast("long"))

    spans = rows.groupBy("conv_id", "span").agg(
        F.min("begin").alias("first"),
        F.min("at").alias("first_at"),
        F.greatest(
            F.lit(0), F.least(F.lit(history), F.min(stride), budget - F.max(system_tokens) - F.sum("tokens"))
        ).alias("history"),
    )
    # History is at most a stride long, so a turn can be history of spans up to the next cut only.
    may = rows.withColumn("later", F.explode(F.sequence(F.col("span") + 1, cell * 2 + 3)))
    heads = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "first", "first_at", "history")
    repeated = (
        may.join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("later") == F.col("s")))
        .where((F.col("begin") < F.col("first")) & (F.col("begin") >= F.col("first") - F.col("history")))
        .select("conv_id", "later", "at", "role", "piece", "tokens")
    )
    # Where history reaches back to the first turn, the system turn is part of it already.
    system = rows.where((F.col("at") == 0) & (F.col("role") == "system") & (F.col("tokens") < budget))
    later = heads.where((F.col("first_at") > 0) & (F.col("first") > F.col("history")))
    retained = system.drop("span").join(later, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", F.col("s").alias("span"), "at", "role", "piece", "tokens"
    )
    own = rows.select("conv_id", "span", "at", "role", "piece", "tokens").withColumn("own", F.lit(True))
    pieces = own.unionByName(
        repeated.withColumnRenamed("later", "span").unionByName(retained).withColumn("own", F.lit(False))
    )

    upto = Window.partitionBy("conv_id", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    head = F.lit(len(OPEN)) + F.length(escape(F.col("role"), ROLE_ESCAPES)) + 1
    pieces = pieces.withColumns(
        {
            "from": F.coalesce(F.sum(F.length("piece")).over(upto), F.lit(0)) + head,
            "size": F.length("piece") - head - len(CLOSE),
        }
    )
    target = F.col("own") & (F.col("role") == "assistant")
    grouped = pieces.groupBy("conv_id", "span").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.count_if("own").alias("own"),
        F.sum("tokens").alias("tokens"),
        F.array_sort(
            F.collect_list(F.when(target, F.struct(F.col("from").alias("begin"), F.col("size").alias("length"))))
        ).alias("loss"),
    )
    return grouped.withColumn("text", F.array_join(F.col("pieces")["piece"], "")).select(
        "conv_id", "span", "text", "own", "tokens", "loss"
    )


def read_turns(text: Column) -> Column:
    """Turns of a window's text: array of (role, text)."""
    written = F.split(text, CLOSE.replace("\n", "\\n"))
    written = F.slice(written, 1, F.size(written) - 1)

    def one(piece):
        line = F.locate("\n", piece)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(OPEN) + 1), line - 1 - len(OPEN)), ROLE_ESCAPES).alias("role"),
            unescape(F.substring(piece, line + 1, F.length(piece))).alias("text"),
        )

    return F.transform(written, one)


def read_back(window_rows: DataFrame) -> DataFrame:
    """Per conversation, from windows alone: conv_id, n_turns, role and text of every turn, targets, characters.

    A window's own turns are its last ones.
    """
    masked = F.transform("loss", lambda m: unescape(F.substring(F.col("text"), m["begin"] + 1, m["length"])))
    parts = window_rows.select(
        "conv_id",
        "span",
        "own",
        F.length("text").cast("long").alias("chars"),
        F.slice(read_turns(F.col("text")), -F.col("own").cast("int"), F.col("own").cast("int")).alias("turns"),
        F.array_join(masked, "").alias("targets"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = parts.withColumn("said", said)
    grouped = parts.groupBy("conv_id").agg(
        F.sum("own").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("span", "said", "targets"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select(
        "conv_id",
        "n_turns",
        F.array_join(F.col("parts")["said"], "").alias("turns"),
        F.array_join(F.col("parts")["targets"], "").alias("targets"),
        "formatted_chars",
    )


def digests(window_rows: DataFrame) -> DataFrame:
    back = read_back(window_rows)
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2("targets", 256).alias("loss_sha256"),
        "formatted_chars",
    )
