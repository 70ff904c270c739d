r"""Chat formatting with offset-aligned loss masks.

Whole conversations are rendered by a template, encoded once with offsets, and the sorted
turn spans are intersected with the token spans by binary search, which gives the token
ranges that carry loss (assistant texts).

Control strings in texts and roles are broken up by a backslash after their first character;
backslashes are doubled. Both are undone by one scan, so the rendering is reversible.

Defined results
* null role or text: empty; an empty assistant text has an empty mask span.
* turns are ordered by turn (null first), then role, then text; repeated rows all count.
* a null conv_id is a conversation of its own; an empty table gives an empty result.
* conversations of any length: beyond `block_chars` the rendering is cut between two turns,
  where a control token separates the pieces anyway, so ids and masks don't change. A
  conversation is then several output rows, numbered by `block`. Memory stays bounded.
* only the four named columns are read; others, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import ship, table, tokenizer_path


@dataclass(frozen=True)
class ChatTemplate:
    """turn + role + body + text + end for each turn. Each control string starts with its only '<' or '['."""

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    reserved: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    loss_role: str = "assistant"

    @property
    def controls(self) -> tuple:
        return (self.turn, self.body, self.end, *self.reserved)


DEFAULT = ChatTemplate()
FORMATTED = "conv_id long, block int, n_turns int, text string, ids array<int>, loss_tokens array<struct<lo:int,hi:int>>, loss_chars array<struct<lo:int,hi:int>>"


@lru_cache(maxsize=8)
def _patterns(template: ChatTemplate):
    controls = sorted(template.controls, key=len, reverse=True)
    parse = re.compile(f"{re.escape(template.turn)}(.*?){re.escape(template.body)}(.*?){re.escape(template.end)}", re.S)
    return re.compile("|".join([r"\\", *map(re.escape, controls)])), parse


def escape(text: str, template: ChatTemplate = DEFAULT) -> str:
    return _patterns(template)[0].sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return text if "\\" not in text else re.sub(r"\\(\\?)", r"\1", text)


def parse(text: str, template: ChatTemplate = DEFAULT) -> list[tuple[str, str]]:
    """(role, text) of each turn in a rendering."""
    return [(unescape(r), unescape(t)) for r, t in _patterns(template)[1].findall(text)]


@lru_cache(maxsize=4)
def _tokenizer(path: str, template: ChatTemplate):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tok = Tokenizer.from_file(path)
    tok.pre_tokenizer = ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    tok.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in template.controls])
    return tok


def render(turns: list[tuple[str, str]], template: ChatTemplate = DEFAULT) -> tuple[str, list[tuple[int, int]]]:
    """The rendering and the sorted code point spans of the texts that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = template.turn + escape(role, template) + template.body, escape(text, template)
        if role == template.loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, template.end]
        at += len(head) + len(body) + len(template.end)
    return "".join(parts), spans


def token_ranges(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each text span the range of tokens that overlap it, by binary search."""
    out, start, end = [], itemgetter(0), itemgetter(1)
    for lo, hi in spans:
        first = bisect_right(offsets, lo, key=end)
        out.append((first, max(first, bisect_left(offsets, hi, key=start))))
    return out


def _spans(rows: list[list[tuple[int, int]]]):
    """A list array of structs lo, hi."""
    import numpy as np
    import pyarrow as pa

    flat = np.array([x for r in rows for x in r], "i4").reshape(-1, 2)
    ends = np.cumsum([0, *map(len, rows)], dtype="i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["lo", "hi"]))


def _format_partition(batches, path: str, template: ChatTemplate, block_chars: int):
    import numpy as np
    import pyarrow as pa

    tok = _tokenizer(path, template)

    def row(conv_id, block, turns):
        text, spans = render(turns, template)
        enc = tok.encode(text, add_special_tokens=False)
        offsets = enc.offsets
        ranges = token_ranges(offsets, spans)
        covered = [(max(s, offsets[a][0]), min(e, offsets[b - 1][1])) if b > a else (s, s) for (a, b), (s, e) in zip(ranges, spans)]
        return conv_id, block, len(turns), text, np.array(enc.ids, "i4"), ranges, covered

    def rows():
        now, block, turns, size = None, 0, [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if now is None or now[0] != conv_id or size >= block_chars:
                    if turns:
                        yield row(now[0], block, turns)
                    block = block + 1 if now is not None and now[0] == conv_id else 0
                    now, turns, size = (conv_id,), [], 0
                turns.append((role or "", text or ""))
                size += len(text or "") + 32
        if turns:
            yield row(now[0], block, turns)

    def out(held):
        conv_id, block, n_turns, text, ids, ranges, covered = zip(*held)
        ends = pa.array(np.cumsum([0, *map(len, ids)], dtype="i4"))
        cols = [pa.array(conv_id, pa.int64()), pa.array(block, pa.int32()), pa.array(n_turns, pa.int32()), pa.array(text, pa.string()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))), _spans(ranges), _spans(covered)]
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", "block", "n_turns", "text", "ids", "loss_tokens", "loss_chars"])

    held, size = [], 0
    for r in rows():
        held.append(r)
        size += len(r[3])
        if size > 1 << 20:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def format_conversations(
    conversations: DataFrame, *, tokenizer: str | None = None, template: ChatTemplate = DEFAULT, block_chars: int = 4_000_000,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row for each conversation (several, by `block`, beyond block_chars): FORMATTED. Rows of a conversation follow each other."""
    ship(conversations.sparkSession)
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(lambda batches: _format_partition(batches, path, template, block_chars), FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def _digest_partition(batches, template: ChatTemplate):
    import pyarrow as pa

    def done(now, sums, turns, loss):
        return {"conv_id": now[0], "n_turns": sums[0], "turns_sha256": turns.hexdigest(), "loss_chars": sums[1], "loss_sha256": loss.hexdigest(), "formatted_chars": sums[2], "n_tokens": sums[3], "loss_tokens": sums[4]}

    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in (x.split()[0] for x in DIGESTS.split(", "))])
    now, sums, turns, loss = None, None, None, None
    for batch in batches:
        out = []
        n_ids = batch.column(4).value_lengths().to_pylist()  # ids are counted, never made Python objects
        under, masked = ([(list(zip(c.field(0).to_pylist(), c.field(1).to_pylist())), o) for c, o in [(col.flatten(), col.value_lengths().to_pylist())]][0] for col in (batch.column(6), batch.column(5)))
        at = [0, 0]
        for i, (conv_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
            if now is None or now[0] != conv_id:
                if now is not None:
                    out.append(done(now, sums, turns, loss))
                now, sums, turns, loss = (conv_id,), [0] * 5, hashlib.sha256(), hashlib.sha256()
            for role, body in parse(text, template):
                turns.update(f"{role}\n{body}\n".encode())
                sums[0] += 1
            spans, ranges = ((flat[k : k + sizes[i]]) for (flat, sizes), k in zip((under, masked), at))
            at = [at[0] + under[1][i], at[1] + masked[1][i]]
            for lo, hi in spans:
                told = unescape(text[lo:hi])
                loss.update(told.encode())
                sums[1] += len(told)
            sums[2] += len(text)
            sums[3] += n_ids[i]
            sums[4] += sum(hi - lo for lo, hi in ranges)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([done(now, sums, turns, loss)], schema=schema)


def digests(formatted: DataFrame, *, template: ChatTemplate = DEFAULT) -> DataFrame:
    """One row for each conversation, read back from the rendering; takes format_conversations' rows in their order."""
    return formatted.mapInArrow(lambda batches: _digest_partition(batches, template), DIGESTS)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(more)))
