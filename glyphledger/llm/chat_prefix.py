"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its reply is trainable.
Turns after a conversation's last assistant turn (all of them, where it has none) form a closing example without a target,
so no turn is lost. All of it is DataFrame code. A conversation is one unit and has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks, and other strings that tokenizers read as control tokens. All are escaped in texts.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")


def escape(text: Column) -> Column:
    r"""Double each backslash, then put one behind the first character of each control string; null becomes empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """Undo escape(): a backslash goes, what follows it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_examples, context, target, tail) of rows (conv_id, turn, role, text).

    The formatted example is context + target + tail; only target is trainable. tail is the mark that ends the reply, and
    in a closing example target is null. Turns go by turn, ties by role and text (repeated rows stay); null turns come
    first, a null role or text counts as empty, rows with a null conv_id form a conversation of their own. Other columns
    are ignored.
    """
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY))
    whole = lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))
    turns = turns.withColumns({"said": F.transform("ts", whole), "asked": F.filter(F.transform("ts", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())})
    turns = turns.withColumn("last", F.coalesce(F.element_at(F.when(F.size("asked") > 0, F.col("asked")), -1), F.lit(-1)))
    turns = turns.withColumn("asked", F.when(F.col("last") < F.size("ts") - 1, F.concat("asked", F.array(F.lit(-1)))).otherwise(F.col("asked")))
    each = turns.select("conv_id", F.size("asked").alias("n_examples"), "ts", "said", F.posexplode("asked").alias("example", "at"))
    reply = F.get("ts", F.col("at"))
    done = F.col("at") < 0
    return each.select(
        "conv_id",
        "example",
        "n_examples",
        F.when(done, F.array_join("said", "")).otherwise(F.concat(F.array_join(F.slice("said", 1, F.greatest(F.col("at"), F.lit(0))), ""), head(reply))).alias("context"),
        F.when(~done, escape(reply["text"])).alias("target"),
        F.when(done, "").otherwise(F.lit(END)).alias("tail"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """The digest of each conversation, parsed from the formatted examples alone."""
    last = F.col("example") == F.col("n_examples") - 1
    whole = F.max(F.when(last, F.concat("context", F.coalesce("target", F.lit("")), "tail")))
    replies = F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target"))))
    out = examples.groupBy("conv_id").agg(whole.alias("whole"), replies.alias("replies"))
    turns = F.filter(F.split("whole", r"<\|turn\|>", -1), lambda x: x != "")
    inner = lambda x: F.substring_index(x, END, 1)
    text = lambda x: F.concat(unescape(F.substring_index(inner(x), BODY, 1)), F.lit("\n"), unescape(F.substring_index(inner(x), BODY, -1)), F.lit("\n"))
    loss = F.array_join(F.transform("replies", lambda r: unescape(r["target"])), "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, text), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
    )
