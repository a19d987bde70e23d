"""Chat formatting with loss masks that follow token offsets.

A conversation is rendered whole: for each turn `<|im_start|>`, the role, `<|im_sep|>`, the text, `<|im_end|>` and a line end. The three
marks are added to the tokenizer's vocabulary as special tokens for encoding (nothing is trained), so no token straddles a mark.
Inside roles and texts `<|` gets a backslash between its characters, and `<` followed by n backslashes and `|` gets one more; taking
one away restores the text, so no text can hold a mark. The rendered string is encoded once with offsets, and each token is set against the
sorted spans of the turns by binary search: a token is trained on if its span lies inside an assistant's text.

Rows: turns in order of turn, null turns last, ties by role and text; null texts and roles are empty; repeated rows are turns of their
own; an empty text has no token and still makes a turn; rows with a null conv_id form one conversation with a null id; an empty
table gives no rows. A conversation is the unit of the format, so its turns are gathered in one row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherflow.llm.common import slices

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SLICE = 1 << 18         # bytes of text encoded before its tokens are handed on
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[bool]]:
    """The rendered conversation, the span of each text in it, and whether it is trained on."""
    parts, spans, trained, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        parts += (head, body, END, "\n")
        spans.append((at + len(head), at + len(head) + len(body)))
        trained.append(role == "assistant")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans, trained


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask(offsets: np.ndarray, spans: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """Whether each token (start, end) lies inside a trained span; spans are sorted and apart."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    inside = (at >= 0) & (offsets[:, 1] <= spans[at, 1]) & (offsets[:, 1] > offsets[:, 0])
    return inside & trained[at]


def masked_text(formatted: str, offsets: np.ndarray, loss: np.ndarray) -> list[str]:
    """Pieces of the string under the mask; tokens that share a character (its bytes) give it once."""
    at = offsets[loss]
    if not len(at):
        return []
    end = np.maximum.accumulate(at[:, 1])
    first = np.flatnonzero(np.r_[True, at[1:, 0] > end[:-1]])
    return [formatted[a:b] for a, b in zip(at[first, 0].tolist(), end[np.r_[first[1:], len(at)] - 1].tolist(), strict=True)]


_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        from tokenizers import AddedToken, Tokenizer
        tok = Tokenizer.from_file(path)
        tok.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (START, SEP, END)])
        _LOADED[path] = tok
    return _LOADED[path]


FORMATTED = ("conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>")


def format_chats(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each conversation: the rendered string, its token ids and offsets, and the mask of trained tokens."""
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"),
                         F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("size"))

    def run(batches):
        tok = _tokenizer(tokenizer)
        for piece in slices(batches, "size", SLICE):
            made = [render(list(zip(r, t, strict=True))) for r, t in zip(piece.column("roles").to_pylist(), piece.column("texts").to_pylist(), strict=True)]
            ids, offsets, masks = [], [], []
            for text, spans, trained in made:
                code = tok.encode(text, add_special_tokens=False)
                ids.append(np.array(code.ids, np.int32))
                offsets.append(np.array(code.offsets, np.int32).reshape(-1, 2))
                masks.append(mask(offsets[-1], np.array(spans, np.int64).reshape(-1, 2), np.array(trained, bool)))
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            both = np.concatenate(offsets)
            flat = (np.concatenate(ids), np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), np.concatenate(masks))
            yield pa.RecordBatch.from_arrays([piece.column("conv_id"), pa.array([m[0] for m in made], pa.string()), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat)],
                                             ["conv_id", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"])
    return chats.mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say when read back: turns, and all text under the mask, as lengths and SHA-256."""
    def run(batches):
        for batch in batches:
            out = []
            cut = batch.column("token_starts").offsets.to_numpy()
            starts, ends = (batch.column(c).values.to_numpy() for c in ("token_starts", "token_ends"))
            masks = batch.column("loss_mask").values.to_numpy(zero_copy_only=False)
            base = batch.column("loss_mask").offsets.to_numpy()
            for n, (conv, text) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted"), strict=True)):
                text, loss = text.as_py(), masks[base[n]:base[n + 1]]
                offsets = np.stack([starts[cut[n]:cut[n + 1]], ends[cut[n]:cut[n + 1]]], axis=1)
                turns = parse(text)
                under = unescape_pieces(text, offsets, loss)
                out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest(), len(under),
                            hashlib.sha256(under.encode("utf-8", "surrogatepass")).hexdigest(), len(text), int(np.sum(loss)), len(loss)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_loss_tokens", "n_tokens"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names)
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
                                     "n_loss_tokens long, n_tokens long")


def unescape_pieces(text: str, offsets: np.ndarray, loss: np.ndarray) -> str:
    return "".join(unescape(p) for p in masked_text(text, offsets, loss))
