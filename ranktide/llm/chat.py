"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role:``, a line with the text and ``</turn>``. Each rendered turn is parsed again by the
deterministic parser below; where the recovered turn differs from the source, the control strings inside its text are
escaped (backslashes before a control string are doubled and one more is added) until both are identical. Turns are
rendered and checked where they lie, in parallel; a conversation's text is its rendered turns in order."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.llm.common import batches, each_row

NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
HEADER = r"### (?:System|User|Assistant|Tool|Role [A-Za-z0-9%._~-]*):"
CLOSE = "</turn>"
CONTROL = re.compile(rf"(\\*)({HEADER}|{CLOSE})")
_HEAD = re.compile(rf"({HEADER})\n")
RENDERED = "conv_id long, turn long, role string, rendered string, text_start long, text_end long"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


class NotParsed(ValueError):
    pass


def header(role: str) -> str:
    return f"### {NAMES[role]}:" if role in NAMES else f"### Role {quote(role, safe='')}:"


def role_of(head: str) -> str:
    name = head[4:-1]
    return unquote(name[5:]) if name.startswith("Role ") else name.lower()


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def wrap(role: str, body: str) -> str:
    return f"{header(role)}\n{body}\n{CLOSE}\n"


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end delimit the escaped text. Raises NotParsed."""
    out, at = [], 0
    while at < len(rendered):
        head = _HEAD.match(rendered, at)
        if not head:
            raise NotParsed(f"no turn at {at}")
        start, end = head.end(), None
        for m in CONTROL.finditer(rendered, start):
            if len(m[1]) % 2 == 0:  # not escaped
                if m[1] or m[2] != CLOSE or rendered[m.start() - 1] != "\n" or rendered[m.end(): m.end() + 1] != "\n":
                    raise NotParsed(f"control string at {m.start()}")
                end = m.start() - 1
                break
        if end is None or end < start:
            raise NotParsed(f"turn at {at} has no end")
        out.append((role_of(head[1]), unescape(rendered[start:end]), start, end))
        at = end + 1 + len(CLOSE) + 1
    return out


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The rendered turn and where its text lies; proven to parse back to the source."""
    role, text = role or "", text or ""
    body = text
    for _ in range(2):
        rendered = wrap(role, body)
        try:
            found = parse(rendered)
        except NotParsed:
            found = []
        if len(found) == 1 and found[0][:2] == (role, text):
            return rendered, found[0][2], found[0][3]
        body = escape(text)
    raise ValueError(f"turn of role {role!r} does not survive the round trip")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, rendered, text_start, text_end): one rendered turn per row, ``text_start`` and
    ``text_end`` delimiting its text in it (the loss mask of assistant turns). Null text and null role count as empty.
    Any other role is percent-encoded in its header. Extra columns are ignored."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                        ("rendered", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64())])

    def work(it):
        yield from batches(((c, t, role, *render_turn(role, text)) for c, t, role, text in each_row(it)), schema)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(work, RENDERED)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, from its rendered turns only, in the order of turn (null first; ties by rendered
    text). The digests run over the turns as a stream: a task keeps one conversation's hash states, never its texts."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digests(rows):
        key = turns = loss = None
        n = loss_chars = chars = 0
        for conv, piece in rows:
            if turns is None or conv != key:
                if turns is not None:
                    yield key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
                key, turns, loss, n, loss_chars, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, _, _ in parse(piece):
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == "assistant":
                    loss_chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
            chars += len(piece)
        if turns is not None:
            yield key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    ordered = (rendered.select("conv_id", "turn", "rendered").repartition("conv_id")
               .sortWithinPartitions("conv_id", "turn", "rendered").select("conv_id", "rendered"))
    return ordered.mapInArrow(lambda it: batches(digests(each_row(it)), schema), DIGESTS)
