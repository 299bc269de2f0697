"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its context, and only
its text is trainable. Turns behind the last assistant turn, and conversations without one, end in
an example without any trainable text, so that no turn is missing from the output.

A turn is written as `<turn ROLE>TEXT</turn>` and a line feed. Inside roles and texts a backslash
becomes `\\b`, the `<` of `<turn` and `</turn` becomes `\\l`, and the `>` of a role becomes `\\g`:
no mark can then arise from a text, and three replacements in turn give every text back.

A conversation must fit into a row, as each of its examples is one string. Rows without `conv_id`
form one conversation, a null role or text is empty, turns that tie go by role and text (nulls
first), and repeated rows stay. Other columns are left out, whatever their names; an empty table
gives no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"
#: A conversation whose texts hold the marks themselves.
PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"


def _swap(value: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escaped(text: Column) -> Column:
    return _swap(text, ("\\", "\\b"), ("<turn", "\\lturn"), ("</turn", "\\l/turn"))


def unescaped(text: Column) -> Column:
    return _swap(text, ("\\g", ">"), ("\\l", "<"), ("\\b", "\\"))


def _opening(role: Column) -> Column:
    return F.concat(F.lit(OPEN), _swap(escaped(role), (">", "\\g")), F.lit(">"))


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation as an array of (turn, role, text)."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role"), text("text")).alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example_no, formatted, loss_start, loss_end): one row for each assistant turn.

    `example_no` is the number of turns in it. The loss mask covers the code points from
    `loss_start` (counted from 0) up to, not including, `loss_end` of `formatted`.
    """
    whole = in_order(conversations).withColumn("parts", F.transform("turns", lambda t: F.concat(_opening(t["role"]), escaped(t["text"]), F.lit(CLOSE))))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: (F.get("turns", k - 1)["role"] == "assistant") | (k == n))
    each = whole.select("conv_id", "turns", "parts", F.explode(ends).alias("example_no"))
    last = F.get("turns", F.col("example_no") - 1)
    context = F.array_join(F.slice("parts", F.lit(1), F.col("example_no") - 1), "")
    made = each.select("conv_id", "example_no", context.alias("context"), F.get("parts", F.col("example_no") - 1).alias("part"), last["role"].alias("role"), last["text"].alias("text"))
    begin = F.char_length("context") + F.char_length(_opening(F.col("role")))
    size = F.when(F.col("role") == "assistant", F.char_length(escaped(F.col("text")))).otherwise(0)
    return made.select("conv_id", "example_no", F.concat("context", "part").alias("formatted"), begin.alias("loss_start"), (begin + size).alias("loss_end"))


def parsed(formatted: Column) -> Column:
    """The (role, text) of every turn in a formatted string."""
    parts = F.split(formatted, CLOSE)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(
        unescaped(F.substring(F.substring_index(p, ">", 1), len(OPEN) + 1, 1 << 30)).alias("role"),
        unescaped(F.substring(p, F.locate(">", p) + 1, F.char_length(p))).alias("text"),
    ))


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars, n_examples) from the examples alone.

    The turns come from each conversation's longest example, the loss text from the masks of all.
    """
    masked = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    kept = made.select("conv_id", "example_no", "formatted", unescaped(masked).alias("loss"), F.char_length("formatted").cast("long").alias("chars"))
    longest = F.max("example_no").over(Window.partitionBy("conv_id"))
    kept = kept.withColumn("whole", F.when(F.col("example_no") == longest, F.col("formatted"))).drop("formatted")
    sums = kept.groupBy("conv_id").agg(
        F.get(F.collect_list("whole"), F.lit(0)).alias("whole"),
        F.sort_array(F.collect_list(F.struct("example_no", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    text = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return sums.select("conv_id", parsed(F.col("whole")).alias("turns"), text.alias("loss_text"), "formatted_chars", "n_examples")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, whose two turns hold an end mark and a backslash."""
    roles = F.explode(F.arrays_zip(F.array(F.lit(0), F.lit(1)).alias("turn"), F.array(F.lit("user"), F.lit("assistant")).alias("role")))
    probe = conversations.sparkSession.range(1).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), roles.alias("r"))
    probe = probe.select("conv_id", F.col("r.turn").cast("long").alias("turn"), F.col("r.role").alias("role"), F.lit(PROBE).alias("text"))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.unionByName(probe)


def chat_digests(conversations: DataFrame) -> DataFrame:
    """What the examples of each conversation, and of the probe, hold when read back."""
    back = read_back(examples(with_probe(conversations)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
