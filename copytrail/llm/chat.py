"""Chat formatting: a visitor flattens typed content parts into one template, with loss spans and attachments, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template. Texts can hold none of them: an escaped text has no ``<|``.
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
DOCUMENT_END = "<|document_end|>"
CONTROL = re.compile(r"<\|(im_start|im_end|image|audio|document|document_end)\|>")
#: A piece of a conversation ends after the turn that fills it with so many code points.
PIECE = 1 << 20
#: One image placeholder stands for a token for each patch of so many pixels a side, one of audio for so many tokens a second.
PATCH = 28
AUDIO_RATE = 25
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,inside:int>>"
PIECES = ("conv_id long, piece long, text string, turns int, loss array<struct<begin:int,end:int>>,"
          " attachments array<struct<kind:string,ref:string,place:int,tokens:long>>")


def escape(text: str) -> str:
    """The text with one backslash more inside every ``<|``, ``<\\|``, ``<\\\\|`` and so on."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    """What ``escape`` made the text of."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """A role on one line without ``<``; per cent signs keep it reversible."""
    return role.replace("%", "%25").replace("<", "%3C").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return role.replace("%0A", "\n").replace("%3C", "<").replace("%25", "%")


@dataclass
class Flattener:
    """Visits typed parts in order and collects output, loss spans and attachments. ``size`` is the output's code points."""

    out: list[str] = field(default_factory=list)
    size: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[str, str | None, int, int]] = field(default_factory=list)
    turns: int = 0

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def turn(self, role: str | None, parts: Iterable[dict], trained: bool) -> None:
        """One turn; neighbouring texts are joined before they are escaped, so that no control string arises between them."""
        self.put(f"{START}{escape_role(role or '')}\n")
        begin, held, depth = self.size, [], 0
        for part in parts:
            inside = part.get("inside") or 0
            while depth > inside:  # the document that held the parts before ends
                self._text(held)
                self.put(DOCUMENT_END)
                depth -= 1
            kind = part.get("type") or "text"
            if kind == "text":
                held.append(part.get("text") or "")
                continue
            self._text(held)
            visit = getattr(self, f"visit_{kind}", None)
            if visit is None:
                raise ValueError(f"no such kind of part: {kind}")
            visit(part)
            depth += kind == "document"
        self._text(held)
        self.put(DOCUMENT_END * depth)
        if trained and self.size > begin:
            self.loss.append((begin, self.size))
        self.put(f"{END}\n")
        self.turns += 1

    def _text(self, held: list[str]) -> None:
        if held:
            self.put(escape("".join(held)))
            held.clear()

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((kind, part.get("ref"), self.size, tokens))
        self.put(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, ceil((part.get("width") or 0) / PATCH) * ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        """A document's own parts follow it, one deeper; it stands for itself with one token."""
        self._attach("document", part, 1)

    def piece(self) -> tuple[str, int, list[dict], list[dict]]:
        return ("".join(self.out), self.turns, [{"begin": a, "end": b} for a, b in self.loss],
                [dict(zip(("kind", "ref", "place", "tokens"), a, strict=True)) for a in self.attachments])


def text_parts(text: Column) -> Column:
    """A plain text as one part; null is empty."""
    none = F.lit(None)
    fields = {"type": F.lit("text"), "text": F.coalesce(text.cast("string"), F.lit("")), "ref": none.cast("string"), "width": none.cast("int"),
              "height": none.cast("int"), "seconds": none.cast("double"), "inside": none.cast("int")}
    return F.array(F.struct(*[value.alias(name) for name, value in fields.items()])).cast(PARTS)


def render(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, piece, text, turns, loss, attachments): conversations of rows (conv_id, turn, role, parts) in the template.

    A piece holds whole turns in ascending order, over a million code points at most but for its last turn, so a
    conversation of any length is never held whole; its text is that of its pieces in order. Nearly every conversation is one
    piece. ``loss`` spans (code points of the piece) cover what turns of ``trained`` roles say, ``attachments`` name each image,
    audio and document part with its reference, the place of its placeholder and the tokens it expands to. Parts come in
    order; those of a document follow it with ``inside`` one higher. A kind of part that is none of the four raises a ValueError.

    A null text is empty, a null role too, a turn without parts says nothing. Rows of a null conv_id are a conversation of
    their own; a null turn comes first. Rows with the same turn follow each other in the order of role and parts, repeated rows
    repeat. An empty table gives no rows. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, open_piece = object(), 0, None
        for batch in _short(batches):
            done = []

            def close(piece: Flattener | None, conv: int | None, at: int, done: list = done) -> None:
                if piece:
                    done.append((conv, at, *piece.piece()))

            for conv, role, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != current:
                    close(open_piece, current, number)
                    current, number, open_piece = conv, 0, None
                elif open_piece and open_piece.size >= PIECE:
                    close(open_piece, current, number)
                    number, open_piece = number + 1, None
                open_piece = open_piece or Flattener()
                open_piece.turn(role, parts or [], role in trained)
            yield _batch(done)
        if open_piece:
            yield _batch([(current, number, *open_piece.piece())])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(PARTS))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    return ordered.select("conv_id", "role", "parts").mapInArrow(run, PIECES)


def _short(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int32()), ("tokens", pa.int64())])


def _batch(done: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(_SPAN), pa.list_(_ATTACHMENT))
    return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)],
                                      names=["conv_id", "piece", "text", "turns", "loss", "attachments"])


def parse(text: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of every turn of a formatted text; parts are (kind, unescaped text), placeholders with an empty text."""
    place, role, parts = 0, "", []
    for mark in CONTROL.finditer(text):
        between = text[place:mark.start()]
        kind = mark[1]
        if kind == "im_start":
            end = text.index("\n", mark.end())
            role, parts, place = unescape_role(text[mark.end():end]), [], end + 1
            continue
        if between:
            parts.append(("text", unescape(between)))
        place = mark.end()
        if kind == "im_end":
            yield role, parts
            place += 1  # the line end behind it
        else:
            parts.append((kind, ""))


def trained_text(text: str, loss: list[dict]) -> Iterator[str]:
    """What the loss spans cover, unescaped and without placeholders."""
    for span in loss:
        yield unescape(CONTROL.sub("", text[span["begin"]:span["end"]]))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """Digests of one conversation, fed with its pieces in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def read(self, text: str, loss: list[dict]) -> None:
        self.chars += len(text)
        for role, parts in parse(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{''.join(t for _, t in parts)}\n".encode("utf-8", "surrogatepass"))
        for said in trained_text(text, loss):
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))

    def row(self, conv: int | None) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from what ``render`` gives.

    The pieces of a conversation stand one behind the other in one partition, as ``render`` leaves them; a digest is fed
    piece by piece, for a checksum of a sequence has no parallel form, and holds none of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader = None, None
        for batch in batches:
            done = []
            for k in range(batch.num_rows):
                conv, piece, text, loss = (batch.column(i)[k].as_py() for i in range(4))
                if piece == 0:
                    if reader:
                        done.append(reader.row(current))
                    current, reader = conv, _Reader()
                reader.read(text, loss)
            yield _digest_batch(done)
        if reader:
            yield _digest_batch([reader.row(current)])

    return pieces.select("conv_id", "piece", "text", "loss").mapInArrow(run, DIGESTS)


def _digest_batch(done: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)],
                                      names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
