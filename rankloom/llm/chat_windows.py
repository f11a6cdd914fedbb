"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are laid along their conversation by prefix sums of their tokens (words plus a fixed cost per turn).
The line is cut every ``fresh`` tokens. Turns that lie between two cuts form one window; a turn that lies
across a cut is a window of its own. So a window is always a span of whole turns and keeps the budget, unless
one turn alone is longer than ``fresh``, or the system turn leaves less than a quarter of the budget. ``fresh`` is the budget less what may be repeated: the system turn, which every
later window retains in front, and whole turns from the last ``history`` tokens before the window. Repeated
turns carry no loss; the loss mask covers each assistant text in the one window it belongs to.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``, the role URL-encoded. Control strings inside texts
(``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, with any number of tildes after the first character) get
one more tilde after that character; taking one away restores the text.

Prefix sums run over blocks of a conversation (``ordered_scan``), so a conversation with a third of all rows
is cut up too; history meets windows in an equi-join on (conversation, cell of the line).

Defined cases: null texts and roles count as empty, a null conversation id is one conversation, null turns
come last, equal turns are ordered by role and text, repeated rows are separate turns, an empty table gives
an empty result. Only the named columns are read, so further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ordered import ordered_scan, value_blocks
from rankloom.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"(\||/?s>|/?INST\])"
#: Runs of bytes that are no ASCII white space count as one token.
WORD = r"[^\x20\x09-\x0D]+"
#: Tokens of a turn's markers.
TURN_COST = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + _CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + _CONTROL, "$1$2$3")


def format_windows(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = 1024,
    history: int = 192,
) -> DataFrame:
    """One row per window: ``conv`` (struct of the id), ``window``, ``n_tokens``, ``repeated`` (leading turns
    without loss that stand in an earlier window), ``formatted``, ``loss_spans`` (start and length, code points)."""
    rows = turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + TURN_COST)
    placed = cut_lineage(
        ordered_scan(
            value_blocks(rows, "turn"), ["conv"], ["turn", "role", "text"],
            {"pos": ("row_number", None), "before": ("sum_before", "tokens")},
        )
    )

    system = (
        placed.where(F.col("role") == "system").groupBy("conv")
        .agg(F.min_by(F.struct("pos", "tokens", "text"), "pos").alias("s"))
        .select("conv", F.col("s.pos").alias("s_pos"), F.col("s.tokens").alias("s_tokens"), F.col("s.text").alias("s_text"))
    )
    fresh = F.greatest(budget - history - F.coalesce(F.col("s_tokens"), F.lit(0)), F.lit(budget // 4))
    homes = (
        placed.join(system.select("conv", "s_pos", "s_tokens"), "conv", "left")
        .withColumn("fresh", fresh)
        .withColumn("after", F.col("before") + F.col("tokens"))
        .withColumn("first_cell", F.expr("before div fresh"))
        .withColumn("last_cell", F.expr("(after - 1) div fresh"))
        .withColumn(
            "window",
            F.when(F.col("first_cell") == F.col("last_cell"), 2 * F.col("first_cell")).otherwise(2 * F.col("last_cell") - 1),
        )
    )
    homes = cut_lineage(
        homes.select("conv", "window", "pos", "before", "after", "tokens", "role", "text", (F.col("pos") == F.col("s_pos")).alias("is_system"))
    )
    windows = homes.groupBy("conv", "window").agg(F.min("before").alias("start"), F.min("pos").alias("first"))

    cell = max(1, history)
    starts = windows.select("conv", "window", "start", F.expr(f"start div {cell}").alias("cell"))
    past = (
        homes.where((F.col("tokens") <= history) & ~F.coalesce(F.col("is_system"), F.lit(False)))
        .select("conv", "pos", "before", "after", "tokens", "role", "text",
                F.explode(F.sequence(F.expr(f"after div {cell}"), F.expr(f"(before + {history}) div {cell}"))).alias("cell"))
        .join(starts, ["conv", "cell"])
        .where((F.col("after") <= F.col("start")) & (F.col("before") >= F.col("start") - history))
    )
    retained = windows.join(system, "conv").where(F.col("first") > F.col("s_pos"))

    def pieces(df: DataFrame, kind: int, pos: str = "pos", tokens: str = "tokens", role: Column | None = None, text: str = "text") -> DataFrame:
        return df.select("conv", "window", F.lit(kind).alias("kind"), F.col(pos).alias("pos"), F.col(tokens).alias("tokens"),
                         (F.col("role") if role is None else role).alias("role"), escape(F.col(text)).alias("text"))

    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    every = (
        pieces(homes, 2)
        .unionByName(pieces(past, 1))
        .unionByName(pieces(retained, 0, "s_pos", "s_tokens", F.lit("system"), "s_text"))
        .withColumn("head", F.length(head))
        .withColumn("piece", F.concat(head, F.col("text"), F.lit(END)))
    )
    ahead = Window.partitionBy("conv", "window").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, -1)
    target = (F.col("kind") == 2) & (F.col("role") == "assistant")
    span = F.struct((F.col("at") + F.col("head")).cast("long").alias("start"), F.length("text").cast("long").alias("length"))
    packed = (
        every.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(ahead), F.lit(0)))
        .groupBy("conv", "window")
        .agg(
            F.sum("tokens").alias("n_tokens"),
            F.sum((F.col("kind") < 2).cast("int")).cast("int").alias("repeated"),
            F.array_sort(F.collect_list(F.struct("kind", "pos", "piece"))).alias("all"),
            F.array_sort(F.collect_list(F.when(target, span))).alias("loss_spans"),
        )
    )
    return packed.select(
        "conv", "window", "n_tokens", "repeated", F.concat_ws("", F.transform("all", lambda x: x["piece"])).alias("formatted"), "loss_spans"
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations from written windows: ``conv``, ``n_turns``, ``content`` (role, newline, text, newline per
    turn), ``loss_text`` (all text under the mask, unescaped) and ``formatted_chars``. A conversation's content
    is one value here, as its digest needs it in one piece."""
    turns = F.slice(
        F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != ""),
        F.col("repeated") + 1, F.length("formatted") + 1,
    )

    def content(piece: Column) -> Column:
        role = F.url_decode(F.regexp_extract(piece, r"^<\|im_start\|>([^\n]*)\n", 1))
        text = F.regexp_replace(piece, r"^<\|im_start\|>[^\n]*\n", "")
        return F.concat(role, F.lit("\n"), unescape(text), F.lit("\n"))

    under_mask = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    parts = windows.withColumn("turns", turns).select(
        "conv", "window", F.size("turns").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.concat_ws("", F.transform("turns", content)).alias("content"), F.concat_ws("", under_mask).alias("loss"),
    )
    def joined(name: str) -> Column:
        return F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("window", name))), lambda x: x[name]))

    return parts.groupBy("conv").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        joined("content").alias("content"), joined("loss").alias("loss_text"),
    )
