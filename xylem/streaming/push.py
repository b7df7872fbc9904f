"""Incremental parsing on Structured Streaming.

Chunks of many documents arrive in any micro-batch; each document's pieces are
put in order and its events come out as soon as they are known. The state is
the text so far and the number of events already given: expat's own state can't
be stored, so a batch reads the document again and gives what is new.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from xylem.sources.parser import Parser

OUTPUT = "doc_id string, seq int, event string, qname string, value string"
STATE = "next int, given int, waiting string, text string, failed boolean"


def advance(text: str, given: int, last: bool) -> tuple[list[tuple], bool]:
    """Events after the first ``given`` of a document read so far, and whether it is malformed. Trailing text waits, as more may come."""
    p = Parser()
    ok = p.feed(text, last)
    new = [(e[0], e[1], e[5] if e[5] is not None else e[4], e[6]) for e in p.events[given:]]
    if not ok:
        new.append((given + len(new), "fatalError", None, p.errors[-1][5]))
    return new, not ok


def push_events(chunks: DataFrame) -> DataFrame:
    """Events of (doc_id string, chunk_no int, data string, last boolean) in a stream. Chunks may come out of order; repeated ones count once."""
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        nxt, given, waiting, text, failed = state.get if state.exists else (0, 0, "{}", "", False)
        held = {int(k): v for k, v in json.loads(waiting).items()}
        for pdf in pdfs:
            for no, data, last in zip(pdf["chunk_no"], pdf["data"], pdf["last"], strict=True):
                if int(no) >= nxt:
                    held[int(no)] = [data or "", bool(last)]
        ended = False
        while nxt in held and not ended:
            data, ended = held.pop(nxt)
            text += data
            nxt += 1
        if failed:
            return
        new, failed = advance(text, given, ended)
        given += len(new)
        state.update((nxt, given, json.dumps(held), text, failed or ended))
        if new:
            yield pd.DataFrame([(key[0], *e) for e in new], columns=["doc_id", "seq", "event", "qname", "value"])

    return chunks.groupBy("doc_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
