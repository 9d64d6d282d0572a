"""Chat formatting: reply trees cut into root-to-leaf conversations.

Messages point to the message they answer. Every leaf ends one root-to-leaf
path. Paths are found by self-joins on doubled pointers: after round k a message
knows its ancestor 2^k steps up and the score of the steps between, so a tree of
depth d takes about log2(d) joins, whatever its size. Branches are ranked by
score within their tree; the chosen ones are walked back down the same pointers,
each step halving the distance, which makes one row per message of a chosen path
and no other. Each path is formatted as one conversation with a loss mask.

Texts join once, at the end; the self-joins carry keys and scores only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.llm.registry import contract, read
from tabularium.operators.ranking import top_k
from tabularium.session import shared_path

# The template. Its marks hold "<" and ">", which escaping keeps out of texts and roles.
_TURN_OPEN, _TURN_HEAD_END, _TURN_CLOSE = "<turn ", ">\n", "</turn>\n"
# Escapes, in the order in which they apply; undone in the reverse order.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape(text: Column) -> Column:
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _kept(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: the rounds do not repeat each other."""
    path = shared_path(spark, f"tree-{name}")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def _pointers(spark: SparkSession, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``tree, node, up, steps, score`` by level, of messages that are not at their root yet, and of all at their root.

    At level k ``up`` is the ancestor ``steps`` = 2^k above. ``steps`` and
    ``score`` count the messages from ``node`` up to, without, ``up``. A message
    that has come to its root, where ``up`` is null, takes no part in later rounds
    but as an ancestor. One in a circle of replies never gets there.
    """
    ids = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    rooted = nodes.select("tree", "node", "parent", "score").join(ids, ["tree", "parent"], "left")
    up = F.when(F.col("known"), F.col("parent")).alias("up")
    level = _kept(spark, rooted.select("tree", "node", up, F.lit(1).cast("long").alias("steps"), "score"), "level")
    opened, done, left = [], level.filter(F.col("up").isNull()), None
    while True:
        still = level.filter(F.col("up").isNotNull())
        n = still.count()
        # After 2^k > n steps only those in circles can be left.
        if n == 0 or (n == left and 2 ** len(opened) > n):
            return opened, done
        opened.append(still)
        left = n
        above = done.unionByName(still).select("tree", F.col("node").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"), F.col("score").alias("gain"))
        joined = still.join(above, ["tree", "up"])
        level = _kept(
            spark,
            joined.select("tree", "node", F.col("top").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("score") + F.col("gain")).alias("score")),
            "level",
        )
        done = done.unionByName(level.filter(F.col("up").isNull()))


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``tree, leaf, score, position, node``: the messages of the best branches of each tree, from the root down.

    ``nodes`` has ``tree, node, parent, score``, node ids unique within a tree. A
    message whose parent is null or missing is a root, so one tree id may hold
    several. A branch scores the sum of its messages; ties go to the smaller leaf
    id. ``branches`` is how many are kept per tree, None for all.
    """
    spark = nodes.sparkSession
    levels, whole = _pointers(spark, nodes)
    answered = nodes.select("tree", F.col("parent").alias("node")).filter(F.col("node").isNotNull())
    leaves = whole.join(answered, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "score", "steps")
    if branches is not None:
        leaves = top_k(leaves, ["tree"], [F.col("score").desc(), F.col("leaf")], branches, spread_by="leaf").drop("rank")
    found = leaves.select("tree", "leaf", F.col("score").alias("total"), (F.col("steps") - 1).alias("position"), F.col("leaf").alias("node"))
    for k in reversed(range(len(levels))):
        jump = levels[k].select("tree", "node", "up")
        up = found.join(jump, ["tree", "node"]).select("tree", "leaf", "total", (F.col("position") - 2**k).alias("position"), F.col("up").alias("node"))
        found = _kept(spark, found.unionByName(up), "path")
    return found.withColumnRenamed("total", "score")


def format_paths(nodes: DataFrame, branches: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """``tree, leaf, score, n_turns, formatted, loss_mask``: one conversation per chosen branch.

    ``nodes`` has ``tree, node, parent, role, text, score``; null roles and texts
    are empty. ``loss_mask`` lists ``(start, length)``, in code points of
    ``formatted``, of the escaped texts of ``loss_role``, in order. An empty table
    gives no conversation. A conversation is one value, so one task builds it.
    """
    whole = nodes.select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    # Read by every join below: what made the nodes is worked out once.
    whole = _kept(nodes.sparkSession, whole, "nodes")
    chosen = paths(whole.select("tree", "node", "parent", "score"), branches)
    head = F.concat(F.lit(_TURN_OPEN), escape(F.col("role")), F.lit(_TURN_HEAD_END))
    pieces = chosen.join(whole.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "score", "position", "role", head.alias("head"), escape(F.col("text")).alias("body")
    )
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + len(_TURN_CLOSE)
    start = F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head")
    placed = pieces.select(
        "tree", "leaf", "score",
        F.struct(
            "position", F.concat("head", "body", F.lit(_TURN_CLOSE)).alias("piece"), (F.col("role") == loss_role).alias("loss"),
            F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")).alias("span"),
        ).alias("turn"),
    )
    turns = placed.groupBy("tree", "leaf", "score").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    masked = F.filter("turns", lambda turn: turn["loss"])
    return turns.select(
        "tree", "leaf", "score", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda turn: turn["piece"]), "").alias("formatted"),
        F.transform(masked, lambda turn: turn["span"]).alias("loss_mask"),
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation, ``array<struct<role, text>>``, unescaped."""
    pieces = F.filter(F.split(formatted, _TURN_CLOSE), lambda piece: piece != "")

    def turn(piece: Column) -> Column:
        end = F.locate(_TURN_HEAD_END, piece)
        role = F.substring(piece, F.lit(len(_TURN_OPEN) + 1), end - len(_TURN_OPEN) - 1)
        text = F.substring(piece, end + len(_TURN_HEAD_END), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    spans = F.transform(loss_mask, lambda span: unescape(F.substring(formatted, (span["start"] + 1).cast("int"), span["length"].cast("int"))))
    return F.array_join(spans, "")


# Conversation of the query besides the table: texts full of other templates' marks.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def with_extra(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    extra = spark.createDataFrame(
        [(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def chain(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the row before it by turn, then role and text.

    The tree is the conversation's id as JSON, so that a null id is a conversation as any other.
    """
    ordered = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.withColumn("tree", F.to_json(F.struct(F.col("conv_id").alias("id"))))
    rows = rows.withColumn("node", F.row_number().over(ordered).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


_SQL_EXTRA = EXTRA_TEXT.replace("'", "''")
_SQL_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT {EXTRA_ID}, 0, 'user', '{_SQL_EXTRA}' UNION ALL SELECT {EXTRA_ID}, 1, 'assistant', '{_SQL_EXTRA}')),
lost AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
    sum(length({_SQL_ESCAPED.format("role")}) + length({_SQL_ESCAPED.format("text")}) + {len(_TURN_OPEN + _TURN_HEAD_END + _TURN_CLOSE)}) AS chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM lost
"""


@contract("op8_reply_trees", _SQL)
def op8_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    made = format_paths(chain(with_extra(read(spark, folder, "conversations"))))
    made = made.withColumn("conv_id", F.from_json("tree", "id long")["id"])
    turns, loss = parse_formatted(F.col("formatted")), masked_text(F.col("formatted"), F.col("loss_mask"))
    back = made.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    lines = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
