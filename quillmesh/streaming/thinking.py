"""A model's streamed answer without its reasoning, when tags may be parted between pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import THINKING

_TAG = re.compile("|".join(map(re.escape, sorted(THINKING, key=len, reverse=True))))


class ThinkingFilter:
    """Feed pieces, get what may be shown; the end of a piece that could begin a tag is held back."""

    def __init__(self, held: str = "", thinking: bool = False, started: bool = False):
        self.held, self.thinking, self.started = held, thinking, started

    def feed(self, piece: str) -> str:
        text, out = self.held + piece, []
        at = 0
        for tag in _TAG.finditer(text):
            if not self.thinking:
                out.append(text[at : tag.start()])
            self.thinking, at = THINKING[tag[0]], tag.end()
        tail = text[at:]
        keep = max((n for t in THINKING for n in range(1, min(len(t), len(tail) + 1)) if tail.endswith(t[:n])), default=0)
        self.held = tail[len(tail) - keep :]
        if not self.thinking:
            out.append(tail[: len(tail) - keep])
        return self._shown("".join(out))

    def finish(self) -> str:
        """What is still held back, if it is shown at all."""
        rest, self.held = ("" if self.thinking else self.held), ""
        return self._shown(rest)

    def _shown(self, text: str) -> str:
        if not self.started:
            text = text.lstrip()
            self.started = bool(text)
        return text


def filter_pieces(pieces: DataFrame) -> DataFrame:
    """(conv_id, seq, piece) with pieces filtered in the order of ``seq``, streaming or batch: one group per conversation.

    Batch form; a conversation is bounded by what a model writes in one answer.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq", kind="stable")
        state = ThinkingFilter()
        shown = [state.feed(p or "") for p in group["piece"]]
        if shown:
            shown[-1] += state.finish()
        return group.assign(piece=shown)[["conv_id", "seq", "piece"]]

    return pieces.groupBy("conv_id").applyInPandas(one, "conv_id long, seq long, piece string")


def filter_stream(pieces: DataFrame) -> DataFrame:
    """Streaming form, with the filter's state kept per conversation between batches.

    A null piece ends an answer: its row carries what was held back as a possible
    tag, and the conversation's state is dropped.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = ThinkingFilter(*state.get) if state.exists else ThinkingFilter()
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        shown, ended = [], False
        for piece in rows["piece"]:
            ended = piece is None
            shown.append(kept.finish() if ended else kept.feed(piece))
            kept = ThinkingFilter() if ended else kept
        if ended:
            state.remove()
        else:
            state.update((kept.held, kept.thinking, kept.started))
        yield rows.assign(piece=shown)[["conv_id", "seq", "piece"]]

    return pieces.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, seq long, piece string", "held string, thinking boolean, started boolean", "append", "NoTimeout")


def rebuffered(pieces: list[str], least: int = 50) -> list[str]:
    """Pieces gathered until ``least`` characters or a line end."""
    out, held = [], ""
    for piece in pieces:
        held += piece
        if len(held) >= least or "\n" in held:
            out.append(held)
            held = ""
    return [*out, held] if held else out


def gathered(pieces: DataFrame, least: int = 50) -> DataFrame:
    """(conv_id, n, piece): the pieces of each answer, in the order of ``seq``, gathered until ``least`` characters or a line end; null pieces count as empty.

    Batch form; a fold over the pieces of one answer, in the JVM.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("held"))

    def step(state: Column, item: Column) -> Column:
        held = F.concat(state.held, F.coalesce(item.piece, F.lit("")))
        full = (F.length(held) >= least) | held.contains("\n")
        return F.struct(F.when(full, F.concat(state.done, F.array(held))).otherwise(state.done).alias("done"), F.when(full, "").otherwise(held).alias("held"))

    in_order = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("_pieces"))
    folded = F.aggregate("_pieces", start, step, lambda s: F.when(s.held != "", F.concat(s.done, F.array(s.held))).otherwise(s.done))
    return in_order.select("conv_id", F.posexplode(folded).alias("n", "piece"))


def gathered_stream(pieces: DataFrame, least: int = 50) -> DataFrame:
    """Streaming form of ``gathered``: (conv_id, piece) as they fill; a null piece ends an answer and lets the rest out."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for piece in rows["piece"]:
            held += piece or ""
            if held and (piece is None or len(held) >= least or "\n" in held):
                out.append(held)
                held = ""
        state.update((held,))
        yield pd.DataFrame({"conv_id": [key[0]] * len(out), "piece": out})

    return pieces.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, piece string", "held string", "append", "NoTimeout")
