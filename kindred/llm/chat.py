"""Chat formatting from reply trees, with DataFrame functions only.

Messages name the message that they answer.  Iterative self-joins with pointers
that double at every step add up the scores from every message to its root, and
so rank all root-to-leaf paths without listing them; the same pointers then
list the messages of the chosen paths only.  Each is written in a template:

    <|turn|>role<|text|>text<|end|>

Control strings inside roles and texts cannot occur in the output, since `&`,
`<` and `[` are written as references; reading back undoes this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What is escaped, in this order; undone from the last to the first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
#: The role whose texts are learned.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _pointers(messages: DataFrame, tables: Tables) -> tuple[list[DataFrame], DataFrame]:
    """(tables of pointers (conv, id, far), each twice as long as the one before; a row for each message).

    The rows have `total` and `depth`, the scores and the number of messages
    from the message to its root, and `rooted`, false on or under a cycle.
    """
    known = messages.select("conv", F.col("id").alias("parent")).distinct().withColumn("has", F.lit(True))
    linked = messages.join(known, ["conv", "parent"], "left")
    score = F.coalesce("score", F.lit(0.0)).cast("double")
    now = tables.keep(linked.select("conv", "id", F.when(F.col("has"), F.col("parent")).alias("far"), score.alias("total"), F.lit(1).cast("long").alias("depth")))
    levels, reach, most = [], 1, now.count()
    while reach <= most and now.where("far is not null").limit(1).count():
        levels.append(now.where("far is not null").select("conv", "id", "far"))
        there = now.select("conv", F.col("id").alias("far"), F.col("far").alias("further"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        met = now.join(there, ["conv", "far"], "left")
        now = tables.keep(met.select("conv", "id", F.col("further").alias("far"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth")))
        reach *= 2
    return levels, now.select("conv", "id", "total", "depth", F.col("far").isNull().alias("rooted"))


def _listed(leaves: DataFrame, levels: list[DataFrame], tables: Tables) -> DataFrame:
    """(conv, leaf, id, depth) for each message between the leaves and their roots; a leaf has depth 0."""
    paths = leaves.select("conv", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("depth"))
    for k, jumps in enumerate(levels):
        added = paths.join(jumps, ["conv", "id"]).select("conv", "leaf", F.col("far").alias("id"), (F.col("depth") + (1 << k)).alias("depth"))
        paths = tables.keep(paths.union(added))
    return paths


def _leaves(messages: DataFrame, marks: DataFrame) -> DataFrame:
    answered = messages.where("parent is not null").select("conv", F.col("parent").alias("id")).distinct()
    return marks.where("rooted").join(answered, ["conv", "id"], "left_anti").withColumnRenamed("id", "leaf")


def reply_paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, id, depth) for each message on each root-to-leaf path; the root has the greatest depth.

    `messages` has conv (not null), id and parent; ids are unique within a
    conversation.  A message whose parent is null or unknown is a root;
    messages on a cycle have no root and belong to no path.  A step joins every
    path with pointers twice as long as before, so the steps grow with the
    logarithm of the longest path.  All paths of a comb of n messages have
    n * n / 2 rows: best_paths lists chosen ones only.
    """
    tables = Tables(messages.sparkSession)
    messages = messages.select("conv", "id", "parent", F.lit(0.0).alias("score"))
    levels, marks = _pointers(messages, tables)
    return _listed(_leaves(messages, marks), levels, tables)


def best_paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """reply_paths with `path_score` and `rank` of the path in its conversation, the `top` best if given.

    A path's score is the mean score of its messages (null scores count 0);
    ties go to the smaller leaf.
    """
    tables = Tables(messages.sparkSession)
    levels, marks = _pointers(messages, tables)
    scored = _leaves(messages, marks).select("conv", "leaf", (F.col("total") / F.col("depth")).alias("path_score"))
    order = Window.partitionBy("conv").orderBy(F.desc("path_score"), "leaf")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    ranked = tables.keep(ranked)
    return _listed(ranked, levels, tables).join(ranked, ["conv", "leaf"])


def format_paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(conv, leaf, rank, path_score, n_turns, formatted), one row for each chosen path.

    `messages`: conv, id, parent, role, text, score.  Null roles and texts are
    empty; an empty table gives an empty result; other columns are not read.
    """
    messages = messages.select("conv", "id", "parent", "role", "text", "score")
    said = messages.select("conv", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = best_paths(messages, top).join(said, ["conv", "id"])
    turn = F.struct((-F.col("depth")).alias("at"), "role", "text")
    paths = rows.groupBy("conv", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END)))
    return paths.select("conv", "leaf", "rank", "path_score", F.size("turns").cast("long").alias("n_turns"), F.array_join(written, "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns, array of (role, text, start, end), of a formatted path; the span of each written text in code points."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")

    def step(acc: Column, piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, len(TURN) + 1, F.length(piece)), TEXT, 1)
        start = acc["at"] + len(TURN) + F.length(role) + len(TEXT)
        written = F.substring(piece, F.length(role) + len(TURN) + len(TEXT) + 1, F.length(piece))
        turn = F.struct(unescape(role).alias("role"), unescape(written).alias("text"), start.alias("start"), (acc["at"] + F.length(piece)).alias("end"))
        return F.struct((acc["at"] + F.length(piece) + len(END)).alias("at"), F.concat(acc["turns"], F.array(turn)).alias("turns"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,text:string,start:int,end:int>>").alias("turns"))
    return F.aggregate(pieces, start, step, lambda acc: acc["turns"])


def loss_mask(turns: str) -> Column:
    """Spans (start, end) of the formatted text that are learned."""
    return F.transform(F.filter(turns, lambda t: t["role"] == LEARNED), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of conversations whose rows follow one another by turn: each answers the row before.

    Equal turns are ordered by role and text.  `conv` is conv_id as text; rows
    without conv_id are one conversation, whose `conv` is empty.
    """
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), "turn", "role", F.col("text").cast("string").alias("text"))
    numbered = rows.select("conv", F.row_number().over(order).cast("long").alias("id"), "role", "text")
    return numbered.select("conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chat_digest(messages: DataFrame) -> DataFrame:
    """Per conversation what its best path reads back as.

    conv_id, n_turns, turns_sha256 (of role, \\n, text, \\n for each turn),
    loss_chars and loss_sha256 (of the text under the loss mask, unescaped),
    formatted_chars, formatted, from messages as `linear` gives them.  An empty
    table gives an empty result.
    """
    out = format_paths(messages, top=1).withColumn("turns", read_back(F.col("formatted"))).withColumn("mask", loss_mask("turns"))
    masked = F.array_join(F.transform("mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv", "formatted", "turns", masked.alias("_loss"))
    return out.select(
        F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "formatted",
    )
