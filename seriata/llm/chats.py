"""Chat formatting with quotation linking, in DataFrame functions alone.

A line's quote level is the number of > before its text. Runs of lines of one
level, between empty lines, are passages. Normalised passages, lines and
sentences of level 0 are what a message says itself; a deeper one quotes
somebody: the latest earlier message of the conversation that says the same. The
message that most of a message's quotes lead to is what it answers. Messages lose
their quotes and get the start of their thread and their depth in it: in the
order of threads and turns, answers follow what they answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

#: Turn numbers of thread starts, and turns after a thread's start, that make one row of a transcript.
PART, CUT = 64, 1024
#: Turn numbers in which quotes are looked up together.
SPAN = 256


def normalised(text: Column) -> Column:
    """Lower case, white space made single, ends stripped."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse_lines(messages: DataFrame) -> DataFrame:
    """A row per line: message, place, level, body."""
    lines = messages.select("message", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("place", "line"))
    marks = F.regexp_extract("line", r"^((?:[ \t]{0,3}>)*)", 1)
    return lines.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", ""))).withColumn("body", F.when(F.col("level") > 0, F.ltrim(F.expr("substring(line, length(regexp_extract(line, '^((?:[ \\\\t]{0,3}>)*)', 1)) + 1)"))).otherwise(F.col("line"))).drop("line")


def passages_of(lines: DataFrame) -> DataFrame:
    """message, conv_id, turn, level, said, weight: passages weigh 2, their lines and sentences 1."""
    inside = Window.partitionBy("message").orderBy("place")  # one message's lines
    new = (F.col("level") != F.lag("level").over(inside)) | (F.trim("body") == "") | (F.trim(F.lag("body").over(inside)) == "")
    run = lines.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    whole = run.groupBy("message", "conv_id", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("lines"))
    bodies = F.transform("lines", lambda x: x["body"])
    passage = F.array_join(bodies, " ")
    parts = F.array_union(F.array_union(bodies, F.split(passage, r"(?<=[.!?])\s+")), F.array())
    told = F.concat(F.array(F.struct(passage.alias("said"), F.lit(2).alias("weight"))), F.transform(parts, lambda x: F.struct(x.alias("said"), F.lit(1).alias("weight"))))
    return whole.select("message", "conv_id", "turn", "level", F.explode(told).alias("t")).select("message", "conv_id", "turn", "level", "t.said", "t.weight")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, root, depth, body, chat for every row of messages (conv_id, turn, role, text).

    A quoted passage, line or sentence leads to the latest earlier turn that says
    it. reply_to is the turn that the quotes of the lowest level lead to: the one
    with most weight, the latest of equals; null if no earlier message says so.
    Levels below point further back and do not change it. root is the turn that
    starts the thread, depth how many answers lie between. Null and empty texts
    are messages with an empty body; rows that repeat a turn are kept, each
    linked alike; rows with a null conv_id or turn are kept without links. Very
    long texts are cut into their lines; without rows there are none in the
    result. Other columns do not matter.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("message", F.xxhash64("conv_id", "turn", "role", "text"))
    quoting = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]{0,3}>"), F.lit(False))
    # Conversations without any quote have nothing to look up: their texts are not cut into lines.
    quoters = durable(rows.where(quoting & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id").distinct())
    lines = parse_lines(rows.join(quoters, "conv_id", "left_semi").where("turn is not null").dropDuplicates(["message"]))
    said = passages_of(lines).withColumn("said", normalised(F.col("said"))).where("said <> ''")
    said = durable(said.select("conv_id", "turn", "message", "level", F.xxhash64("said").alias("hash"), "weight").groupBy("conv_id", "turn", "message", "level", "hash").agg(F.max("weight").alias("weight")))
    led = _latest(said.where("level = 0").select("conv_id", "hash", "turn").distinct(), said.where("level > 0").select("conv_id", "hash", "turn").distinct())
    by = said.where("level > 0").join(led, ["conv_id", "hash", "turn"]).groupBy("message", "conv_id", "turn", "level", "first").agg(F.sum("weight").alias("weight"))
    parent = durable(by.groupBy("message", "conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("shallow"), "weight", "first")).alias("best")).select("message", "conv_id", "turn", F.col("best.first").alias("reply_to")))
    roots = _roots(parent.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to")))
    body = F.when(~quoting, F.coalesce("text", F.lit(""))).otherwise(F.regexp_replace(F.regexp_replace("text", r"(?m)^[ \t]{0,3}>.*(?:\n|\z)", ""), r"\A\s*\n|\s+\z", ""))
    out = rows.withColumn("body", body).join(parent.select("message", "reply_to"), "message", "left").join(roots, ["conv_id", "turn"], "left")
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n"))
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), "body", chat.alias("chat"))


def _latest(own: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, hash, turn, first: for each asked (conv_id, hash, turn) the latest earlier turn that has it among its own.

    Turns meet in spans of SPAN numbers, and spans tell the next ones their
    latest, so no task holds all sayers of a common phrase.
    """
    span = F.floor(F.col("turn") / SPAN).alias("span")
    both = own.select("conv_id", "hash", "turn", span, F.lit(True).alias("says")).unionByName(asked.select("conv_id", "hash", "turn", span, F.lit(False).alias("says")))
    before = Window.partitionBy("conv_id", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("first", F.max(F.when(F.col("says"), F.col("turn"))).over(before)).where("not says")
    spans = both.groupBy("conv_id", "hash", "span").agg(F.max(F.when(F.col("says"), F.col("turn"))).alias("last"))
    earlier = Window.partitionBy("conv_id", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row for SPAN turns
    spans = spans.withColumn("before", F.max("last").over(earlier)).drop("last")
    return near.join(spans, ["conv_id", "hash", "span"]).select("conv_id", "hash", "turn", F.coalesce("first", "before").alias("first")).where("first is not null")


def _roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth of every turn that answers another, by doubling."""
    known = durable(links.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")))
    while True:
        up = known.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        grown = durable(known.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        if grown.where("moved").isEmpty():
            return grown.drop("moved")
        known = durable(grown.drop("moved"))


def transcripts(linked: DataFrame) -> DataFrame:
    """conv_id, part, cut, turns, replies, depths, chat: conversations in reply order, thread by thread.

    Threads that start within PART turn numbers make a part; what is more than
    CUT turns after its thread's start goes to the part's next cut, so a row has
    at most PART + CUT turn numbers however long a thread is. replies has for
    each of turns the turn that it answers, or null; depths how deep it lies.
    """
    keyed = linked.withColumn("part", F.floor(F.col("root") / PART)).withColumn("cut", F.floor((F.col("turn") - F.col("root")) / CUT))
    told = keyed.groupBy("conv_id", "part", "cut").agg(F.array_sort(F.collect_list(F.struct("root", "turn", "chat", "reply_to", "depth"))).alias("m"))
    each = lambda c: F.transform("m", lambda x: x[c])
    return told.select("conv_id", "part", "cut", each("turn").alias("turns"), each("reply_to").alias("replies"), each("depth").alias("depths"), F.array_join(each("chat"), "").alias("chat"))
