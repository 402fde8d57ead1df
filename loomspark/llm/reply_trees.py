"""Chat formatting: root-to-leaf paths of reply trees as training conversations.

Paths come from self-joins of the reply table with itself.  ``jump[k]`` leads from a
message to its ancestor 2^k replies up; joining it with itself gives ``jump[k + 1]``,
so a thread of 400 messages needs nine joins.  Going down from the largest jump, every
ancestor of every leaf is reached once.  Branches are ranked by their mean score, the
best ``keep`` of each conversation are formatted.

The template is ``<|turn|>role<|text|>text<|end|>`` and a line end, for each turn.
Inside roles and texts a backslash is doubled and the ``<`` of ``<|`` becomes ``\\l``,
so the template's marks appear nowhere else and every text can be read back.  The
loss mask is an array of (start, stop) code points, one for each text of ``learn``.

Cases: null texts and roles count as empty; a reply to a missing message starts a
tree; replies in a ring have no root and are left out; equal turns are ordered by
role and text; a null conversation id is one conversation; long threads and
texts stay whole; columns besides those of a reply are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import running_sums
from .scratch import Scratch

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """Reversible: no ``<|`` is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\l|"))


def _unescape(text: str) -> str:
    """SQL that undoes ``escape``: between doubled backslashes, ``\\l`` is ``<``."""
    return rf"array_join(transform(split({text}, '\\\\\\\\'), u -> replace(u, '\\l', '<')), '\\')"


def threads(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Messages of linear conversations, each a reply to the one before."""
    scratch = scratch or Scratch(rows.sparkSession, "threads")
    named = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    numbered = scratch.save(named.withColumn("node", F.monotonically_increasing_id()))  # written, so that numbers stay
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "node")
    parents = numbered.select("node", F.lag("node").over(order).alias("parent"))
    return numbered.join(parents, "node").select("conv_id", "node", "parent", "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, leaf, node, up): for each chosen leaf its path; ``up`` counts replies from the leaf, which has 0."""
    scratch = Scratch(nodes.sparkSession, "reply-trees")
    links = scratch.save(nodes.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    known = links.select(F.col("node").alias("parent"))
    jumps = [scratch.save(links.where(F.col("parent").isNotNull()).join(known, "parent", "left_semi").select("node", F.col("parent").alias("up_node")))]
    most = links.count()
    while (1 << len(jumps)) <= 2 * most:
        j = jumps[-1]
        longer = scratch.save(j.select("node", F.col("up_node").alias("mid")).join(j.select(F.col("node").alias("mid"), "up_node"), "mid").select("node", "up_node"))
        if longer.isEmpty():
            break
        jumps.append(longer)
    else:  # some messages still have ancestors: they hang on a ring
        links = links.join(jumps[-1], "node", "left_anti")
    replied = jumps[0].select(F.col("up_node").alias("node"))
    walked = scratch.save(links.join(replied, "node", "left_anti").select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    for k in range(len(jumps) - 1, -1, -1):
        further = walked.join(jumps[k], "node").select("conv_id", "leaf", F.col("up_node").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        walked = scratch.save(walked.unionByName(further))
    scored = walked.join(links.select("node", "score"), "node").groupBy("conv_id", "leaf").agg(F.avg("score").alias("branch_score"))
    best = Window.partitionBy("conv_id").orderBy(F.desc("branch_score"), "leaf")
    chosen = scored.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= keep)
    return walked.join(chosen.select("leaf", "branch"), "leaf").select("conv_id", "leaf", "branch", "node", "up")


def format_paths(nodes: DataFrame, keep: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, branch, n_turns, formatted, mask: one row per chosen path."""
    said = nodes.select("node", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("said"), F.col("role").isin(*learn).alias("learn"))
    turns = paths(nodes, keep).join(said, "node")
    # One conversation is one row of the result, so its turns meet.
    whole = turns.groupBy("conv_id", "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "said", "learn"))).alias("turns"))
    marks = len(TURN) + len(TEXT) + len(END)
    lens = f"transform(turns, x -> {marks} + length(x.role) + length(x.said))"
    shaped = f"transform(turns, x -> concat('{TURN}', x.role, '{TEXT}', x.said, '{END[:-1]}\\n'))"
    mask = (
        f"transform(array({running_sums(lens)}), ends -> filter(transform(turns, (x, i) -> if(x.learn, named_struct("
        f"'start', ends[i] - {len(END)} - length(x.said), 'stop', ends[i] - {len(END)}), null)), m -> m is not null))[0]"
    )
    return whole.select("conv_id", "branch", F.size("turns").alias("n_turns"), F.expr(f"array_join({shaped}, '')").alias("formatted"), F.expr(mask).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, branch, turns (role, text) and learned text, from the formatted strings and masks alone."""
    parts = rf"filter(split(formatted, '<\\|end\\|>\\n'), p -> p <> '')"
    turn = rf"transform({parts}, p -> transform(array(split(substr(p, {len(TURN) + 1}), '<\\|text\\|>')), q -> named_struct('role', {_unescape('q[0]')}, 'text', {_unescape('q[1]')}))[0])"
    learned = f"array_join(transform(mask, m -> transform(array(substr(formatted, m.start + 1, m.stop - m.start)), v -> {_unescape('v')})[0]), '')"
    return formatted.select("conv_id", "branch", "formatted", F.expr(turn).alias("turns"), F.expr(learned).alias("learned"))
