"""Chat formatting with a grammar round trip: what a deterministic parser reads back must be the turns that were rendered.

A turn is `### role: text`, a line break and `</turn>`. The parser takes `###` and `</turn>` as control strings unless a
backslash stands before them; of a run of backslashes before a control string it drops one. A text is first rendered as it is;
where the parser would read something else, one backslash goes before each of its control strings.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shuffle_parts

_CONTROL = re.compile(r"\\*(?:###|</turn>)")
_TURN = re.compile(r"### ([^\s:]*): ")
_END = "\n</turn>\n"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start and end of the text in it): raw where the parser reads it back alike, else escaped."""
    head = f"### {quote(role, safe='')}: "
    for body in (text, escape(text)):
        segment = head + body + _END
        if _reads(segment, role, text):
            return segment, len(head), len(head) + len(body)
    raise ValueError("a turn does not survive its round trip")


def _reads(segment: str, role: str, text: str) -> bool:
    try:
        return parse(segment) == [(role, text)]
    except ValueError:
        return False


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; ValueError where it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        if not (head := _TURN.match(formatted, at)):
            raise ValueError(f"no turn begins at {at}")
        out, done = [], head.end()
        while True:
            m = _CONTROL.search(formatted, done)
            if not m or m[0] == "###":
                raise ValueError(f"the turn at {at} is not closed")
            out.append(formatted[done : m.start()])
            done = m.end()
            if m[0] == "</turn>":
                break
            out.append(m[0][1:])
        text = "".join(out)
        if text[-1:] != "\n" or formatted[done : done + 1] != "\n":
            raise ValueError(f"the turn at {at} is not closed by a line")
        turns.append((unquote(head[1]), text[:-1]))
        at = done + 1
    return turns



def format_turns(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, segment, mask_start, mask_end: the formatted conversation in pieces, a row per turn, with the loss mask
    as code-point offsets in the segment (null where the turn bears no loss).

    Rows are independent, so a conversation of any length costs no memory. A null text is empty, a null role is the empty
    role; repeated rows are turns of their own; an empty table gives no rows; other columns are left out.
    """
    schema = "conv_id long, turn long, role string, segment string, mask_start long, mask_end long"

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            out = [render_turn(role or "", text or "") for role, text in zip(cols[2], cols[3], strict=True)]
            loss = [role in loss_roles for role in cols[2]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in out]), pa.array([x[1] if y else None for x, y in zip(out, loss, strict=True)], pa.int64()), pa.array([x[2] if y else None for x, y in zip(out, loss, strict=True)], pa.int64())],
                ["conv_id", "turn", "role", "segment", "mask_start", "mask_end"],
            )

    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation from its segments in order, one at a time: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Rows without conv_id make one conversation."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = formatted.repartition(max(1, shuffle_parts(formatted.sparkSession)), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")

    def run(batches):
        now, open_ = None, False
        for b in batches:
            done = []
            for conv, segment, start, end in zip(*(b.column(x).to_pylist() for x in ("conv_id", "segment", "mask_start", "mask_end")), strict=True):
                if not open_ or conv != now[0]:
                    if open_:
                        done.append(now)
                    now, open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for role, text in parse(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    said = _CONTROL.sub(lambda m: m[0][1:], segment[start:end]) if _masked_escaped(segment, start, end) else segment[start:end]
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(segment)
            if done:
                yield _rows(done, names)
        if open_:
            yield _rows([now], names)

    return rows.mapInArrow(run, schema)


def _masked_escaped(segment: str, start: int, end: int) -> bool:
    return _CONTROL.search(segment, start, end) is not None


def _rows(done: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*([c, n, h.hexdigest(), k, g.hexdigest(), f] for c, n, h, k, g, f in done), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if i in (2, 4) else pa.int64()) for i, v in enumerate(cols)], names)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_turns(given.unionByName(more)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || regexp_replace(text, '(\\*(###|</turn>))', '\\\1', 'g') || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
