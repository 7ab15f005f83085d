"""Chat formatting of typed content parts, with a loss mask and a reversible template."""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from confwarden.llm import words as w

# The marks of the chat template.
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
LEARNED_ROLE = "assistant"

#: A content part; which fields matter depends on its kind.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


class TokenVisitor:
    """Expanded token counts of the parts that are not text, one method for each kind.

    Subclass it for another encoder; a method gets the part as a column and returns a count.
    Missing measures count as 0.
    """

    patch = 14
    audio_tokens_per_second = 25
    tokens_per_page = 258

    def image(self, part):
        tiles = [F.ceil(F.coalesce(part[x], F.lit(0)) / self.patch) for x in ("width", "height")]
        return (tiles[0] * tiles[1]).cast("long")

    def audio(self, part):
        return F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_tokens_per_second).cast("long")

    def document(self, part):
        return (F.coalesce(part["pages"], F.lit(0)) * self.tokens_per_page).cast("long")


def escape(text):
    r"""Text without control strings: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``.

    A ``|`` in front becomes ``\|`` too, since the part before may end in ``<``.
    """
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.when(F.startswith(out, F.lit("|")), F.concat(F.lit("\\"), out)).otherwise(out)


def unescape(text):
    """The inverse of ``escape``, for read-back in Python."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def escape_role(role):
    """As ``escape``; a line end, which would end the role, becomes a backslash and n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def text_part(text):
    """One text part as an array of parts; null text is empty."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))],
        ).cast(PART)
    )


def format_conversations(turns, visitor=None):
    """One formatted text for each conversation of ``turns`` (conv_id, turn, role, parts).

    ``parts`` is an array of ``PART``.  A visitor flattens the parts in order: text is escaped,
    an image, audio or document part becomes a placeholder and an attachment reference with
    its expanded token count; a part of another kind or null gives nothing.  Returns
    ``conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens``; spans and
    offsets are code points of ``formatted``, loss spans cover the assistant's text parts only.

    Rows of a conversation are ordered by turn, then role, then parts, nulls first, so ties and
    repeated rows have one order; null roles are empty, rows with a null conv_id form one
    conversation, null or empty parts an empty turn.  A conversation is one value of the
    result, so its rows meet in one task, once.
    """
    visitor = visitor or TokenVisitor()

    def body(p):
        out = F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit(""))))
        for kind, mark in PLACEHOLDERS.items():
            out = out.when(p["kind"] == kind, F.lit(mark))
        return F.coalesce(out, F.lit(""))

    def tokens(p):
        out = F.lit(None).cast("long")
        for kind in PLACEHOLDERS:
            out = F.when(p["kind"] == kind, getattr(visitor, kind)(p)).otherwise(out)
        return out

    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    rendered = turns.select(
        F.col("conv_id").cast("long"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        parts.alias("parts"),
    ).withColumn("pieces", F.transform("parts", body))
    rendered = rendered.select(
        "*",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        F.transform("pieces", F.length).alias("sizes"),
    ).withColumn("marked", F.concat("head", F.array_join("pieces", ""), F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.select(
        "*",
        F.row_number().over(order).alias("seq"),
        F.coalesce(F.sum(F.length("marked")).over(before), F.lit(0)).alias("at"),
    )

    def start(i):
        ahead = F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, x: a + x)
        return (F.col("at") + F.length("head") + ahead).cast("long")

    numbered = F.transform("parts", lambda p, i: F.struct(p.alias("p"), start(i).alias("start"), F.get("sizes", i).alias("size")))
    learned = F.filter(numbered, lambda x: (x["p"]["kind"] == "text") & (F.col("role") == LEARNED_ROLE))
    attached = F.filter(numbered, lambda x: x["p"]["kind"].isin(*PLACEHOLDERS))
    placed = placed.select(
        "conv_id",
        "seq",
        "marked",
        F.transform(learned, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).cast("long").alias("end"))).alias("learned"),
        F.transform(
            attached,
            lambda x: F.struct(
                x["p"]["kind"].alias("kind"),
                x["p"]["ref"].alias("ref"),
                F.col("seq").alias("turn_no"),
                x["start"].alias("start"),
                tokens(x["p"]).alias("tokens"),
            ),
        ).alias("attached"),
    )
    whole = placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("seq", "marked", "learned", "attached"))).alias("t"),
    )
    attachments = F.flatten(F.transform("t", lambda x: x["attached"]))
    return whole.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("t", lambda x: x["marked"]), "").alias("formatted"),
        F.flatten(F.transform("t", lambda x: x["learned"])).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
_MARKS = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))


def read_turns(formatted):
    """``[(role, text)]`` of a formatted conversation, texts unescaped and without placeholders."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not a turn at character {at}")
        turns.append((unescape(m[1]), "".join(map(unescape, _MARKS.split(m[2])))))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at character {at}")
    return turns


def _digests(batches):
    for batch in w.slices(batches, 2):
        rows = []
        for formatted, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in read_turns(formatted)).encode("utf-8", "surrogatepass"))
            learned = [unescape(formatted[s["start"] : s["end"]]) for s in spans]
            loss = hashlib.sha256("".join(learned).encode("utf-8", "surrogatepass"))
            rows.append((turns.hexdigest(), sum(map(len, learned)), loss.hexdigest(), len(formatted)))
        a, b, c, d = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def read_back(formatted):
    """Digests of what is read back from the output of ``format_conversations`` alone."""
    return formatted.select("conv_id", "n_turns", "formatted", "loss_spans").mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
