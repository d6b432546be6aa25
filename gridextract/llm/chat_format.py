"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context and its text as the only part to be
trained on. A turn is written as

    ### role: text</turn>\n

with backslash, "###" and "</turn>" inside a text or role (and ":" inside a role) written as \\s, \\h, \\e and \\c, so no
text can imitate a turn's mark and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"))


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in (*ESCAPES, *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for plain, code in (*([(":", "\\c")] if role else []), *ESCAPES[::-1]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def prefix_examples(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """conv_col, example (from 0), n_turns, text, loss_start, loss_length: one row per turn of the target role, with
    the characters of text to train on. If turns follow the last target, or there is none, a last example holds the
    whole conversation with loss_length 0, so no turn is lost.

    Rows may come in any order; they are taken by turn, then role, then text, null first. Null texts and roles are
    empty. Rows with a null conversation are one conversation. Repeated rows are turns like any other. Other columns are
    not read. Empty table: no rows. An example holds its whole context, so a conversation has to fit into a row; the
    examples of a conversation are as long together as the square of its length, which is what the format asks for.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    conv = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # escaped only once they are in order, which is that of the texts as they came
    conv = conv.select("conv", F.transform("t", lambda x: F.struct(x["role"].alias("role"), escaped(x["text"]).alias("body"))).alias("t"))
    last, n = F.element_at("t", -1)["role"], F.size("t")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("t", i)["role"] == target) | (i == n))
    parts = F.transform("t", lambda x: F.concat(F.lit(HEAD), escaped(x["role"], role=True), F.lit(MIDDLE), x["body"], F.lit(TAIL)))
    conv = conv.select("conv", F.transform("t", lambda x: F.char_length(x["body"])).alias("lengths"), parts.alias("parts"), ends.alias("ends"), (last == target).alias("closed"))
    each = conv.select("conv", "lengths", "parts", "closed", F.size("ends").alias("of"), F.posexplode("ends").alias("example", "n_turns"))
    each = each.withColumn("text", F.array_join(F.slice("parts", 1, F.col("n_turns")), ""))
    own = F.when((F.col("example") < F.col("of") - 1) | F.col("closed"), F.element_at("lengths", F.col("n_turns"))).otherwise(F.lit(0))
    return each.select(
        F.col("conv").alias(conv_col), "example", "n_turns", "text",
        (F.char_length("text") - len(TAIL) - own).alias("loss_start"), own.alias("loss_length"))


def turns_of(text: Column) -> Column:
    """The turns of a formatted text, read back: array of role and text."""
    parts = F.filter(F.split(text, TAIL), lambda x: x != "")
    inner = F.transform(parts, lambda x: F.substring(x, len(HEAD) + 1, F.char_length(x)))
    return F.transform(inner, lambda x: F.struct(
        unescaped(F.substring_index(x, ":", 1), role=True).alias("role"),
        unescaped(F.substring(x, F.char_length(F.substring_index(x, ":", 1)) + len(MIDDLE) + 1, F.char_length(x))).alias("text")))


def loss_text(examples: DataFrame) -> Column:
    """Text under the loss mask of an example, unescaped."""
    return unescaped(F.substring(examples["text"], examples["loss_start"] + 1, examples["loss_length"]))
