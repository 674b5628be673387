"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens deal the turns of a conversation to spans: a turn belongs to the
span in which its first token falls, so spans begin and end with turns. A last turn with which
a span would be too long is a span of its own. A window is a span led by the conversation's system turn and by the last turns before the span, as far as the
history allowance goes. Repeated turns are marked as such and lie outside the loss mask.

Prefix sums are taken in runs of turn numbers first and then over the runs' totals, so a
very long conversation is spread over many tasks; spans are bounded by the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 256
#: Tokens that a turn's marks count for, and characters of UTF-8 that make a token, about.
TURN_TOKENS, BYTES_PER_TOKEN = 4, 4
#: Turn numbers in a run.
RUN = 1024
#: Fixed values of the template: marks of a new and a repeated turn, before its text, and after it.
NEW, AGAIN, TEXT, END = "<turn>", "<again>", "<text>", "</turn>\n"


def escape(text: Column) -> Column:
    """Text without ``<``; undone by ``unescape``."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def turn_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / F.lit(BYTES_PER_TOKEN)) + TURN_TOKENS


def _spans(df: DataFrame, budget: int, history: int) -> DataFrame:
    """Every turn with its place, span, the system turn, and the span it is history of, or null.

    Texts are shuffled twice, by run and by span; the runs' totals are narrow, and their join
    keeps the partitioning by run.
    """
    turns = df.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns(
        {
            "tokens": turn_tokens(F.coalesce("text", F.lit(""))),
            "key": F.coalesce("conv_id", F.lit(0)),
            "known": F.col("conv_id").isNotNull(),
            "run": F.coalesce(F.floor(F.col("turn") / F.lit(RUN)), F.lit(-(1 << 62))),
        }
    )
    run = ["key", "known", "run"]
    within = Window.partitionBy(*run).orderBy(F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    inside = turns.withColumn("before", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "place", F.row_number().over(within)
    )
    lead = F.struct("turn", "role", F.when(F.col("role") == "system", F.col("text")).alias("text"))
    totals = turns.groupBy(*run).agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"), F.min(lead).alias("lead"))
    over = Window.partitionBy("key", "known").orderBy("run")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *run,
        F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows"),
        F.first("lead").over(over)["text"].alias("system"),
        F.sum("sum").over(Window.partitionBy("key", "known")).alias("all"),
    )
    stride = F.col("stride")
    room = F.greatest(F.lit(budget - history) - F.coalesce(turn_tokens(F.col("system")), F.lit(0)), F.lit(1))
    spanned = inside.join(totals, run).select(
        "conv_id",
        "role",
        "text",
        (F.col("place") + F.col("rows")).alias("place"),
        (F.coalesce("before", F.lit(0)) + F.col("base")).alias("before"),
        "tokens",
        "all",
        "system",
        room.alias("stride"),
    ).withColumn("span", F.floor(F.col("before") / stride) * 2)
    over_span = Window.partitionBy("conv_id", "span")
    end = F.col("before") + F.col("tokens")
    headed = spanned.withColumn("head", F.min("before").over(over_span))
    late = headed.withColumn("late", (F.col("before") > F.col("head")) & (end - F.col("head") > stride))
    cut = late.withColumns({"cut": F.max(F.when(F.col("late"), F.col("before"))).over(over_span), "end": F.max(end).over(over_span)})
    stop = F.when(F.col("late"), end).otherwise(F.coalesce("cut", "end"))
    following = F.when(~F.col("late") & F.col("cut").isNotNull(), F.col("span") + 1).otherwise(F.floor(F.col("stop") / stride) * 2)
    kept = (F.col("stop") < F.col("all")) & (F.col("stop") - F.col("before") <= history)
    kept = kept & ~((F.col("place") == 1) & F.col("system").isNotNull())
    told = cut.withColumn("stop", stop).withColumn("next_span", F.when(kept, following))
    return told.withColumn("span", F.col("span") + F.col("late").cast("long"))


def format_conversations(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, learned: str = "assistant") -> DataFrame:
    """conv_id, window, formatted and loss (array of start, stop) for every window of all conversations.

    Rows are turns (conv_id, turn, role, text), ordered by turn (null first), role and text;
    null roles and texts are empty, a null conv_id is a conversation like any other, repeated
    rows are turns of their own, other columns are not looked at. The texts of ``learned``
    turns are in the loss mask of the one window where they are new. A window of more than one
    new turn holds at most ``budget`` tokens, history and system turn counted; a single turn is
    never cut, so alone it may exceed that. Only a first turn is a system turn that is retained.
    """
    turns = _spans(df, budget, history)
    own = F.struct(F.col("span").alias("window"), F.lit(True).alias("new"))
    old = F.struct(F.col("next_span").alias("window"), F.lit(False).alias("new"))
    places = F.when(F.col("next_span").isNull(), F.array(own)).otherwise(F.array(own, old))
    parts = turns.select("conv_id", "place", "role", "text", "system", F.explode(places).alias("w"))
    part = F.struct("place", F.col("w.new").alias("new"), "role", "text")
    windows = parts.groupBy("conv_id", F.col("w.window").alias("window")).agg(
        F.array_sort(F.collect_list(part)).alias("turns"), F.first("system").alias("system")
    )
    first = F.get("turns", F.lit(0))["place"] == 1
    lead = F.when(
        F.col("system").isNotNull() & ~first,
        F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(False).alias("new"), F.lit("system").alias("role"), F.col("system").alias("text"))),
    ).otherwise(F.array())
    led = windows.withColumn("turns", F.concat(lead.cast("array<struct<place:bigint,new:boolean,role:string,text:string>>"), "turns"))

    def written(t: Column) -> Column:
        head = F.concat(F.when(t["new"], NEW).otherwise(AGAIN), escape(t["role"]), F.lit(TEXT))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), (t["new"] & (t["role"] == learned)).alias("learn"))

    pieces = led.select("conv_id", "window", F.transform("turns", written).alias("p"))
    state = "struct<at:bigint,loss:array<struct<start:bigint,stop:bigint>>>"

    def advance(s: Column, p: Column) -> Column:
        start = s["at"] + F.char_length(p["head"])
        stop = start + F.char_length(p["body"])
        mask = F.when(p["learn"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(
            F.array().cast("array<struct<start:bigint,stop:bigint>>")
        )
        return F.struct((stop + len(END)).alias("at"), F.concat(s["loss"], mask).alias("loss"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("loss"))
    loss = F.aggregate("p", zero.cast(state), lambda s, p: advance(s, p).cast(state), lambda s: s["loss"])
    text = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return pieces.select("conv_id", "window", text.alias("formatted"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id and digests of what the windows hold, from formatted and loss alone.

    n_turns and turns_sha256 are of the new turns, loss_chars and loss_sha256 of the unescaped
    text under the loss masks, formatted_chars of all windows.
    """
    turns = F.filter(F.split("formatted", END), lambda x: F.startswith(x, F.lit(NEW)))

    def shown(x: Column) -> Column:
        role, body = F.split_part(F.substr(x, F.lit(len(NEW) + 1)), F.lit(TEXT), F.lit(1)), F.split_part(x, F.lit(TEXT), F.lit(2))
        return F.concat(unescape(role), F.lit("\n"), unescape(body), F.lit("\n"))

    under = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    read = windows.select(
        "conv_id",
        F.struct("window", F.array_join(F.transform(turns, shown), "").alias("turns"), F.array_join(under, "").alias("loss")).alias("w"),
        F.size(turns).cast("long").alias("n"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    told = F.array_join(F.transform("w", lambda w: w["turns"]), "")
    loss = F.array_join(F.transform("w", lambda w: w["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
