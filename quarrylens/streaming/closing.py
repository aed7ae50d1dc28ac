"""Stateful streams: statements that close while tokens arrive, and resumable ingest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylens.code.blocks import Block, statement_blocks
from quarrylens.session import spread


class Closer:
    """Emits each statement once: a simple one when its line has ended in a text that parses, a compound one when first seen.

    Only what stands after the last closed statement at the top level is parsed again, so a document costs its length
    times that of its longest top-level statement and not its length squared, and its state holds no more than
    that. ``base`` is the number of lines and of statements before that text.
    """

    def __init__(self, text: str = "", emitted: list[str] | None = None, base: tuple[int, int] = (0, 0)):
        self.text, self.emitted, self.base = text, set(emitted or []), base

    @staticmethod
    def _key(b: Block) -> str:
        return f"{b.node_type}:{b.start_line}:{b.end_line}:{b.block_id}" if b.block_type == "simple" else f"{b.node_type}:{b.start_line}:{b.block_id}"

    def feed(self, token: str) -> list[Block]:
        self.text += token
        if "\n" not in token:
            return []
        # whole lines only: the last, open one may still grow
        end = self.text.rfind("\n") + 1
        blocks = statement_blocks(self.text[:end])
        out = self._new(blocks)
        # All before the last statement at the top level is closed for good: no later line can join it.
        top = [b for b in blocks if b.depth == 0]
        if len(top) > 1 and top[-1].start_line > top[-2].end_line and "\r" not in self.text:
            last = top[-1]
            self.text = self.text.split("\n", last.start_line - 1)[-1]
            self.base = (self.base[0] + last.start_line - 1, self.base[1] + last.block_id)
            self.emitted = {self._key(b) for b in self._placed(statement_blocks(self.text[: self.text.rfind("\n") + 1]))}
        return out

    def flush(self) -> list[Block]:
        return self._new(statement_blocks(self.text))

    def _placed(self, blocks: list[Block]) -> list[Block]:
        lines, n = self.base
        return [replace(b, start_line=b.start_line + lines, end_line=b.end_line + lines, block_id=b.block_id + n) for b in blocks]

    def _new(self, blocks: list[Block]) -> list[Block]:
        fresh = [b for b in self._placed(blocks) if self._key(b) not in self.emitted]
        self.emitted |= {self._key(b) for b in fresh}
        return [b for b in fresh if b.block_type == "simple"] + [b for b in fresh if b.block_type == "compound"]


OUT = "doc_id string, node_type string, block_type string, source string, start_line int, end_line int, at_end boolean"
STATE = "text string, emitted array<string>, lines int, statements int"


def close_statements(tokens: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """A stream of ``(doc_id string, pos int, token string, last boolean)`` to a stream of closed statements.

    State is one text a document; it is dropped at the token marked last or after ``idle_ms`` without any.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, emitted, *base = state.get if state.exists else ("", [], 0, 0)
        c = Closer(text, list(emitted), tuple(base))
        rows, done = [], state.hasTimedOut
        for b in c.flush() if done else []:
            rows.append((key[0], b.node_type, b.block_type, b.text, b.start_line, b.end_line, True))
        if not done:
            tokens = pd.concat(list(batches)).sort_values("pos")
            for token, last in zip(tokens["token"], tokens["last"]):
                rows += [(key[0], b.node_type, b.block_type, b.text, b.start_line, b.end_line, False) for b in c.feed(token)]
                if last:
                    rows += [(key[0], b.node_type, b.block_type, b.text, b.start_line, b.end_line, True) for b in c.flush()]
                    done = True
        if done:
            state.remove()
        else:
            state.update((c.text, sorted(c.emitted), *c.base))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["doc_id", "node_type", "block_type", "source", "start_line", "end_line", "at_end"])

    return tokens.groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _fold(doc: str, tokens: Iterable[str]) -> list[tuple]:
    c, rows = Closer(), []
    for t in tokens:
        rows += [(doc, b.node_type, b.block_type, b.text, b.start_line, b.end_line, False) for b in c.feed(t)]
    return rows + [(doc, b.node_type, b.block_type, b.text, b.start_line, b.end_line, True) for b in c.flush()]


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def close_batch(tokens: DataFrame) -> DataFrame:
    """The same over a table of tokens: one fold a document."""
    return tokens.groupBy("doc_id").applyInPandas(lambda pdf: pd.DataFrame(_fold(pdf.doc_id.iloc[0], pdf.sort_values("pos").token), columns=_COLUMNS), OUT)


def close_texts(texts: DataFrame) -> DataFrame:
    """The same over a table ``(doc_id string, text)`` of whole texts, line by line and without a shuffle; null texts have none."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for k, t in zip(pdf.doc_id, pdf.text) if t is not None for r in _fold(k, t.splitlines(keepends=True))], columns=_COLUMNS)

    return spread(texts.select("doc_id", "text")).mapInPandas(run, OUT)


def ingest_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Append each micro-batch's rows with unknown keys to a Parquet sink; a batch that is run again adds nothing.

    Starts the query and gives it back; keys already in the sink are met by an anti-join, so state does not grow.
    """
    from quarrylens.sources.jsonl import append_new

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_new(df, path, keys)).start()
