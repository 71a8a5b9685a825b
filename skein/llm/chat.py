"""Chat formatting with loss masks aligned by token offsets."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import map_batches, table

#: Vocabulary file of the tokenizer (a line is a token's bytes in base64, and its rank); a parameter of every function that encodes.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts a text into the pieces which this vocabulary's merges never cross, and what it calls white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of this many characters in a row is cut out before the pattern, which would overflow its stack in it.
LONG_BLANK = 1 << 14
#: Role whose texts are learnt.
LEARNT = "assistant"
_HEAD, _MID, _TAIL = "### ", ": ", " </turn>\n"
_SPECIAL = re.compile(r"[\\#<]")
_SPECIAL_ROLE = re.compile(r"[\\#<:]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*) </turn>\n", re.S)


def escape(text: str, pattern: re.Pattern = _SPECIAL) -> str:
    """Backslash, ``#`` and ``<`` become a backslash with itself, ``#`` and ``l``: no control string of the template is left in the text."""
    return pattern.sub(lambda m: "\\" + ("l" if m[0] == "<" else m[0]), text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _UNESCAPE.sub(lambda m: "<" if m[1] == "l" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted conversation, and where each turn's escaped text lies in it (start, end, role), in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = _HEAD + escape(role, _SPECIAL_ROLE) + _MID, escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        parts += [head, body, _TAIL]
        at += len(head) + len(body) + len(_TAIL)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """For sorted token offsets and sorted spans: (first token, last token exclusive, from, to) of each span, by binary search.

    The last two are the characters of the span that its tokens cover; a token
    that reaches over an edge counts for the part inside.
    """
    if not spans:
        return []
    a, b = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    out = []
    for s, e, i, j in zip(a.tolist(), b.tolist(), lo.tolist(), hi.tolist(), strict=True):
        out.append((i, max(i, j), max(s, int(starts[i])), min(e, int(ends[j - 1]))) if s < e and i < j else (i, i, s, s))
    return out


class Encoder:
    """A byte-level BPE that keeps offsets: every character belongs to a token, special strings are ordinary text.

    Tokens are runs of bytes, so the offsets follow from their lengths; a token
    that holds a part of a character has the whole character's offsets.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, vocabulary.splitlines())}
        self.tokenizer = tiktoken.Encoding("chat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.one_piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.blank = re.compile(f"[{WHITE}]{{{LONG_BLANK},}}")
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """Of a long blank the pattern makes one piece, without its last character if other text follows; the rest is cut as if it were not there."""
        out, at = [], 0
        for m in self.blank.finditer(text) if len(text) >= LONG_BLANK else ():
            end = m.end() - (m.end() < len(text))
            out += [self.tokenizer.encode_ordinary(text[at : m.start()]), self.one_piece.encode_ordinary(text[m.start() : end])]
            at = end
        out.append(self.tokenizer.encode_ordinary(text[at:]))
        return np.concatenate([np.array(x, np.int32) for x in out])

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self.ids(text)
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        if not text.isascii():
            raw = np.frombuffer(text.encode(), np.uint8)
            nth = np.cumsum((raw & 0xC0) != 0x80)  # characters up to and with each byte
            starts, ends = nth[starts] - 1, nth[ends - 1]
        return ids, starts, ends


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, turns)``: each conversation's turns in order of (turn, role, text); a null turn comes first, a null role or text is empty.

    A conversation is one row, so its own length, and nothing else, bounds what a task holds.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def formatted(grouped: DataFrame, vocabulary: str = VOCABULARY, learnt: str = LEARNT) -> DataFrame:
    """``(id, formatted, tokens, masked)``: the text, its token ids, and the learnt tokens as (first, last exclusive, from, to) runs.

    ``from`` and ``to`` are characters: where a token holds characters of the
    template as well, only those of the turn are learnt.  Empty learnt turns
    have an empty run, so runs and learnt turns correspond one to one.
    """
    with open(vocabulary, encoding="utf-8") as f:  # a file of the driver; the tasks get its contents
        shared = grouped.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(grouped.dtypes)["id"]

    def make(batch: pa.RecordBatch) -> dict:
        encode = _encoder(shared.value)
        text, ids, counts, masks = [], [], [0], []
        for turns in batch.column(1).to_pylist():
            line, spans = render([(t["role"], t["text"]) for t in turns])
            got, starts, ends = encode(line)
            text.append(line)
            ids.append(got)
            counts.append(len(got))
            masks.append([x for run in align(starts, ends, [(s, e) for s, e, role in spans if role == learnt]) for x in run])
        return {"id": batch.column(0), "formatted": pa.array(text, pa.string()), "tokens": pa.ListArray.from_arrays(np.cumsum(counts, dtype=np.int32), np.concatenate(ids)), "masked": pa.array(masks, pa.list_(pa.int64()))}

    return map_batches(grouped.select("id", "turns"), make, f"id {kind}, formatted string, tokens array<int>, masked array<long>")


_cached: dict[int, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    key = hash(vocabulary)
    if key not in _cached:
        _cached[key] = Encoder(vocabulary)
    return _cached[key]


def digests(out: DataFrame) -> DataFrame:
    """What the formatted text and its mask say when they are read back."""
    kind = dict(out.dtypes)["id"]

    def make(batch: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for line, mask in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            turns = parse(line)
            learnt = "".join(unescape(line[mask[i + 2] : mask[i + 3]]) for i in range(0, len(mask), 4))
            cols["n_turns"].append(len(turns))
            cols["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            cols["loss_chars"].append(len(learnt))
            cols["loss_sha256"].append(hashlib.sha256(learnt.encode()).hexdigest())
            cols["formatted_chars"].append(len(line))
        return {"id": batch.column(0), **cols, "n_tokens": pc.list_value_length(batch.column(2)).cast(pa.int64())}

    return map_batches(out.select("id", "formatted", "tokens", "masked"), make, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long", text_at=1)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says what the template's control strings say."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = digests(formatted(conversations(rows.unionByName(extra))))
    return out.drop("n_tokens").withColumnRenamed("id", "conv_id")  # SQL cannot tell the tokens


ORACLE_OP9 = r"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') txt from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(role) + 4 + 2 + 9 + length(txt) + length(txt) - length(translate(txt, '\#<', '')) + length(role) - length(translate(role, '\#<:', '')) chars from c)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' order by turn, role, txt)) turns_sha256,
  coalesce(sum(length(txt)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(txt, '' order by turn, role, txt) filter (role = 'assistant'), '')) loss_sha256, sum(chars)::bigint formatted_chars
from e group by conv_id
"""
