"""Online-safe text chunks: cut a growing text where nothing that may still come can change the cut.

``Chunker`` holds the state of one session, its buffer and whether a chunk has left it.
``chunk_stream`` runs it over a stream, ``chunk_texts`` over a batch a character at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.batches import each
from ..functions.text import blank_tokens, col

HARD = frozenset("。！？!?；;：:\n")
SOFT = frozenset("，,、)]}】》」』\"' \t")
_OPEN = (re.compile(r"\[[\w/\-]*\Z", re.A), re.compile(r"</?[\w\-]*\Z", re.A))
_NUMBER_END = re.compile(r"\d(?:\s*|[\d\s]*[.\-:/]|[\d\s.\-:/]*[A-Za-z年月日号点分秒元块兆千百十万亿%])\Z")


def open_special(text: str) -> bool:
    """True where the text ends inside a tag of any kind."""
    if text.rfind("<|") > text.rfind("|>"):
        return True
    square, angle = text.rfind("["), text.rfind("<")
    if square > text.rfind("]") and _OPEN[0].match(text, square):
        return True
    return angle > text.rfind(">") and not text.startswith("<|", angle) and bool(_OPEN[1].match(text, angle))


def numeric_end(text: str) -> bool:
    """True where more digits or a unit may follow."""
    tail = text[-32:]
    return bool(tail) and not tail[-1].isspace() and bool(_NUMBER_END.search(tail))


class Chunker:
    def __init__(
        self,
        least: int = 5,
        most: int = 20,
        first: int | None = None,
        force: int | None = None,
        tag: str = "",
        tokenize: Callable[[str], Sequence] = blank_tokens,
        normalize: Callable[[str], str] = str,
        buffer: str = "",
        started: bool = False,
    ):
        self.least = max(1, least)
        self.most = max(self.least, most)
        self.first = max(self.least, self.least if first is None else first)
        self.force = max(self.most, self.most + max(4, self.most // 2) if force is None else force)
        self.tag, self.tokenize, self.normalize = tag, tokenize, normalize
        self.buffer, self.started = buffer, started

    def feed(self, text: str) -> list[str]:
        self.buffer += text
        return self._emit(self._cut)

    def flush(self) -> list[str]:
        return self._emit(lambda: len(self.buffer) or None)

    def _size(self, text: str) -> int:
        return len(self.tokenize(text.strip()))

    def _emit(self, cut: Callable[[], int | None]) -> list[str]:
        out = []
        while self.buffer and (end := cut()) is not None:
            text = self.normalize(self.buffer[:end]).strip()
            self.buffer = self.buffer[end:]
            if text:
                lead = self.tag if self.tag and not self.started and not text.startswith("<|spk_") else ""
                out.append(lead + text)
                self.started = True
        return out

    def _cut(self) -> int | None:
        """Where the buffer can be cut now; its last character always waits."""
        total = self._size(self.buffer)
        if total < self.least:
            return None
        target = self.most if self.started else self.first
        safe: list[tuple[int, int]] = []
        marks: dict[str, list[tuple[int, int]]] = {"hard": [], "soft": []}
        held = True  # whether the prefix one shorter ends in a number or a tag
        for end in range(1, len(self.buffer)):
            prefix = self.buffer[:end]
            inside = open_special(prefix) or numeric_end(prefix)
            size = 0 if inside else self._size(prefix)
            if not inside and size >= self.least:
                safe.append((end, size))
                # just behind a number or tag a mark may belong to it: safe, but no boundary
                if not (held and end > 1):
                    for kind, chars in (("hard", HARD), ("soft", SOFT)):
                        if prefix[-1] in chars:
                            marks[kind].append((end, size))
            held = inside
        if not safe:
            return None
        for kind in ("hard", "soft"):
            fitting = [(end, size) for end, size in marks[kind] if size <= target]
            if fitting:
                most = max(size for _, size in fitting)
                return next(end for end, size in fitting if size == most)
        if total < target:
            return None
        for kind in ("hard", "soft"):
            longer = [(end, size) for end, size in marks[kind] if size <= self.force]
            if longer:
                least = min(size for _, size in longer)
                return next(end for end, size in longer if size == least)
        if total < self.force:
            return None
        within = [(end, size) for end, size in safe if size <= self.force]
        if not within:
            return safe[-1][0]
        most = max(size for _, size in within)
        return next(end for end, size in within if size == most)


def chunks_of(text: str, **options: Any) -> list[str]:
    """Chunks of a text that arrives a character at a time."""
    chunker = Chunker(**options)
    out = [chunk for ch in text for chunk in chunker.feed(ch)]
    return out + chunker.flush()


def chunk_texts(c: Column | str, **options: Any) -> Column:
    return each(lambda t: chunks_of(t, **options), T.ArrayType(T.StringType()), col(c))


def chunk_stream(stream: DataFrame, session: str, order: str, text: str, final: str, idle: str | None = None, **options: Any) -> DataFrame:
    """(session, chunk) of a stream of text pieces; ``final`` marks a session's last piece.

    State is the buffer and whether a chunk has left. With ``idle``, such as "10 minutes", a
    session without input for that long is flushed and forgotten.
    """
    kind = stream.schema[session].dataType
    output = T.StructType().add(session, kind).add("chunk", T.StringType())
    state = T.StructType().add("buffer", T.StringType()).add("started", T.BooleanType())
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        buffer, started = held.get if held.exists else ("", False)
        chunker = Chunker(buffer=buffer, started=started, **options)
        if held.hasTimedOut:
            out = chunker.flush()
            held.remove()
        else:
            rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
            out = [chunk for piece in rows[text].fillna("") for ch in piece for chunk in chunker.feed(ch)]
            if rows[final].any():
                out += chunker.flush()
                if held.exists:
                    held.remove()
            else:
                held.update((chunker.buffer, chunker.started))
                if wait:
                    held.setTimeoutDuration(wait)
        yield pd.DataFrame({session: [key[0]] * len(out), "chunk": out})

    return stream.groupBy(session).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)
