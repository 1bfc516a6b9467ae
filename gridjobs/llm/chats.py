"""Chat formatting of reply trees, with DataFrame operations only.

A table of messages (tree, node, parent, role, text, score) holds reply trees. Iterative self-joins by doubling find, for
each message, the ancestor 1, 2, 4, ... steps up and the sum of the scores on the way; after as many rounds as the depth
has binary digits, each message knows its depth and the score of its path from the root. The branches of a tree, one
for each leaf, are ranked by that score, and for the chosen ones the same steps are walked down from the leaves to enumerate
the messages of each path. Joins carry ids until the texts join their paths; each path becomes one conversation.

Template: ``<|turn|>role<|says|>text<|end|>`` for each message. Control strings (CONTROLS; those of other common templates
too) within a role or text get a backslash behind their first character, after every backslash was doubled, so formatted
text has no control string but the template's, and read_back() finds exactly the roles and texts that went in. The loss
mask covers the escaped texts of ``learned`` roles: ``start`` in the conversation and ``from`` in its turn, in code points.

Defined results: null roles and texts are empty. A message whose parent is null or missing is a root. Messages of a cycle have
no root and are in no path. Paths of equal score rank by leaf. Messages without tree or node are conversations of their
own. Repeated rows of a node stand next to each other in each path, by role and text. An
empty table gives no conversations. Other columns are not looked at. A conversation is one value, so its size is bounded
by what a value may hold; everything before is spread by message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release, table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: What may not stand unescaped in a role or text.
CONTROLS = [TURN, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in text)


ANY_CONTROL = "|".join(map(quoted, CONTROLS))


def escape(text: Column) -> Column:
    """Backslashes doubled, then one put behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?={ANY_CONTROL})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def ancestors(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """tree, node, depth, total (score from the root to the node) of the messages that have a root, and the rounds: tree,
    node, up, where ``up`` is the ancestor 1, 2, 4, ... steps above. One row for each node."""
    one = messages.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.sum("score").alias("score"))
    nodes = one.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = one.where("node is not null").join(nodes, ["tree", "parent"], "left")
    # ``climbed`` steps lead to ``up``, which they do not count; where up is null, the root is among them
    step = linked.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("climbed"), "score")
    rounds, done, open_before = [], [], None
    while True:
        step = materialize(step, "climb")
        rounds.append(step)
        still = step.where("up is not null")
        left = still.count()
        done.append(step.where("up is null"))
        if left == 0 or left == open_before:  # the number falls with each round until only cycles are left
            break
        open_before = left
        known = reduce(DataFrame.unionByName, done, still)
        above = known.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("climbed").alias("more"), F.col("score").alias("plus"))
        joined = still.join(above, ["tree", "up"])
        step = joined.select("tree", "node", F.col("next").alias("up"), (F.col("climbed") + F.col("more")).alias("climbed"), (F.col("score") + F.col("plus")).alias("score"))
    rooted = reduce(DataFrame.unionByName, done).select("tree", "node", (F.col("climbed") - 1).alias("depth"), F.col("score").alias("total"))
    return rooted, rounds


def paths(messages: DataFrame, branches: int) -> tuple[DataFrame, list[DataFrame]]:
    """tree, path (its leaf), rank, place and node of the messages of the first ``branches`` paths of each tree, best score
    first; ``place`` is a message's distance from the leaf. Also the intermediates, to be released after use."""
    rooted, rounds = ancestors(messages)
    inner = messages.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = rooted.join(inner, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    met = materialize(chosen.select("tree", F.col("node").alias("path"), "rank", F.lit(0).cast("long").alias("place"), "node"), "paths")
    kept = [met]
    for k, step in enumerate(rounds[:-1]):
        up = step.where("up is not null").select("tree", "node", "up")
        further = met.join(up, ["tree", "node"]).select("tree", "path", "rank", (F.col("place") + (1 << k)).alias("place"), F.col("up").alias("node"))
        met = materialize(met.unionByName(further), "paths")
        kept.append(met)
    return met, [*kept, *rounds]


def formatted(messages: DataFrame, branches: int = 1, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, path, rank, formatted (text), n_turns, mask (array of structs turn, start, from, length): a conversation for
    each chosen path of ``messages`` (tree, node, parent, role, text, score)."""
    own = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    of, stored = paths(own.where("tree is not null").select("tree", "node", "parent", "score"), branches)
    bare = own.where("tree is null or node is null").select("tree", F.lit(None).cast(dict(own.dtypes)["node"]).alias("path"), F.lit(None).cast("int").alias("rank"), F.lit(0).cast("long").alias("place"), "role", "text", F.monotonically_increasing_id().alias("alone"))
    every = of.join(own.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "path", "rank", "place", "role", "text", F.lit(-1).cast("long").alias("alone"))
    turns = every.unionByName(bare)
    before = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    body = escape(F.col("text"))
    turns = turns.select("tree", "path", "rank", "alone", "place", "role", "text", F.length(before).alias("from"), F.length(body).alias("length"), F.concat(before, body, F.lit(END)).alias("turn_text"))
    order = ["place", "role", "text"]
    earlier = Window.partitionBy("tree", "path", "rank", "alone").orderBy(F.desc("place"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("turn_text")).over(earlier), F.lit(0))
    nth = F.count(F.lit(1)).over(earlier)
    placed = turns.withColumn("start", at + F.col("from")).withColumn("turn", nth).drop(*order[2:])
    one = placed.groupBy("tree", "path", "rank", "alone").agg(F.array_sort(F.collect_list(F.struct("turn", "turn_text", F.col("role").isin(*learned).alias("learn"), "start", "from", "length"))).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["from"].alias("from"), x["length"].alias("length")))
    done = materialize(one.select("tree", "path", "rank", F.array_join(F.transform("t", lambda x: x["turn_text"]), "").alias("formatted"), F.size("t").cast("long").alias("n_turns"), mask.alias("mask")), "chats")
    release(*stored)
    return done


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` (formatted, mask) with ``turns`` (array of structs role, text) and ``learned`` (text), from these alone."""
    cut = F.filter(F.split("formatted", quoted(TURN)), lambda x: x != "")
    ended = F.transform(cut, lambda x: F.substring(x, F.lit(1), F.length(x) - len(END)))
    parted = F.transform(ended, lambda x: F.split(x, quoted(SAYS), 2))
    turns = F.transform(parted, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))
    spans = F.transform("mask", lambda m: F.substring(F.concat(F.lit(TURN), F.get("cut", m["turn"].cast("int"))), m["from"].cast("int") + 1, m["length"].cast("int")))
    return chats.withColumn("cut", cut).withColumn("turns", turns).withColumn("learned", unescape(F.array_join(spans, ""))).drop("cut")


def linear(rows: DataFrame) -> DataFrame:
    """Messages of ``rows`` (conv_id, turn, role, text), each the reply to the one before it, by turn, then role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    numbered = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, and one with the number -1 that is made of control strings, formatted and read back."""
    more = spark.sql("SELECT -1L AS conv_id, t AS turn, if(t = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2) AS r(t)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    messages = materialize(linear(rows), "messages")
    chats = formatted(messages)
    release(messages)
    back = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.when(F.col("tree") != "null", F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
