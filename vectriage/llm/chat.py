"""Chat formatting with typed content parts.

Method: a visitor goes through the parts of a turn in order.  Text is
escaped and written out; an image, audio or document part becomes an ordered
placeholder, its reference is recorded as an attachment, and the number of
model tokens it expands to is added up.  Each turn is written as

    <|im_start|>role\\ncontent<|im_end|>\\n

Control strings inside texts are escaped reversibly: every ``<``, run of
backslashes, ``|`` gets one more backslash, so no text can hold ``<|``.  Text
parts that follow one another are escaped as the one text they make.

The loss mask of a turn is a list of code-point ranges of its segment: the text
of the roles that are trained on, without placeholders and marks.

Formatting is a map over turns.  Reading back streams each conversation in
turn order through one task with the state of a hash, so memory does not
depend on the length of a conversation.

Edge cases: null text or content is empty; a null role is the empty role; a
null turn sorts first; rows with equal turns follow by their formatted text;
repeated rows are repeated turns; rows with a null conversation id form one
conversation; columns other than the named ones are never read.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART_TYPE = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT_TYPE = "struct<kind:string,place:int,uri:string,tokens:long>"

_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


class PartVisitor:
    """Flattens typed parts into text with placeholders; one visitor for a turn.

    ``patch``: pixels of an image's side that make one token; ``rate``: audio
    tokens a second; ``page_tokens``: tokens of a document's page.
    """

    def __init__(self, patch: int = 28, rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.rate, self.page_tokens = patch, rate, page_tokens
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.texts: list[tuple[int, int]] = []      # code-point ranges of the escaped texts
        self.size = 0
        self._run: list[str] = []                   # text parts since the last placeholder

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self._run.append(part.get("text") or "")

    def finish(self) -> str:
        """The content: all parts so far."""
        self._flush()
        return "".join(self.out)

    def _flush(self) -> None:
        text = escape("".join(self._run))
        self._run = []
        if text:
            self.texts.append((self.size, self.size + len(text)))
            self._put(text)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width") or 0, part.get("height") or 0
        self._attach("image", part, max(1, math.ceil(w / self.patch) * math.ceil(h / self.patch)))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0.0) * self.rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"unknown part type {part.get('type')!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._flush()
        place = len(self.attachments)
        self.attachments.append({"kind": kind, "place": place, "uri": part.get("uri"), "tokens": tokens})
        self._put(f"<|{kind}:{place}|>")


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", parts_col: str | None = None, patch: int = 28, rate: float = 25.0,
                 page_tokens: int = 512, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, segment, attachments, expanded_tokens, loss): one formatted row per turn; ``loss`` is its mask.

    ``parts_col`` names an ``array<PART_TYPE>`` column; without it the text column is the only part.
    """
    parts = F.col(parts_col) if parts_col else F.array(F.struct(
        F.lit("text").alias("type"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))
    slim = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                       F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                       parts.cast(f"array<{PART_TYPE}>").alias("parts"))
    kinds = dict(slim.dtypes)

    def run(batches):
        for batch in batches:
            segments, attached, tokens, masks = [], [], [], []
            for role, content in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist()):
                visitor = PartVisitor(patch, rate, page_tokens)
                for part in content or []:
                    visitor.visit(part or {})
                head = f"{START}{escape_role(role)}\n"
                segments.append(f"{head}{visitor.finish()}{END}\n")
                masks.append([{"start": len(head) + a, "end": len(head) + b} for a, b in visitor.texts] if role in loss_roles else [])
                attached.append(visitor.attachments)
                tokens.append(sum(a["tokens"] for a in visitor.attachments))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("place", pa.int32()), ("uri", pa.string()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(segments, pa.string()), pa.array(attached, kind),
                 pa.array(tokens, pa.int64()), pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["conv_id", "turn", "segment", "attachments", "expanded_tokens", "loss"])

    return slim.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, segment string, "
                                f"attachments array<{ATTACHMENT_TYPE}>, expanded_tokens long, loss array<struct<start:long,end:long>>")


def parse_segment(segment: str) -> tuple[str, str]:
    """(role, content) read back from a formatted turn; placeholders stay as they are."""
    if not (segment.startswith(START) and segment.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, _, content = segment[len(START):-len(END) - 1].partition("\n")
    if START in content or END in content:
        raise ValueError("a control string inside a content")
    return unescape_role(role), unescape(content)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns: counts and digests of turns and of the text under the loss mask."""
    slim = formatted.select("conv_id", "turn", "segment", "expanded_tokens", "loss")
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    kind = dict(slim.dtypes)["conv_id"]

    def run(batches):
        open_id, state = None, None

        def closed():
            return [open_id, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(),
                    state["chars"], state["tokens"]]

        for batch in batches:
            done = []
            for conv, segment, tokens, mask in zip(batch.column("conv_id").to_pylist(), batch.column("segment"),
                                                   batch.column("expanded_tokens").to_pylist(), batch.column("loss").to_pylist()):
                if state is None or conv != open_id:
                    if state is not None:
                        done.append(closed())
                    open_id = conv
                    state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0}
                segment = segment.as_py()
                role, content = parse_segment(segment)
                state["n"] += 1
                state["chars"] += len(segment)
                state["tokens"] += tokens
                state["turns"].update(f"{role}\n{content}\n".encode())
                for span in mask:
                    text = unescape(segment[span["start"]:span["end"]])
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
            yield _rows(done, batch.schema.field("conv_id").type)
            id_type = batch.schema.field("conv_id").type
        if state is not None:
            yield _rows([closed()], id_type)

    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long, expanded_tokens long")


def _rows(rows: list, id_type) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"]
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
