"""Token counts by offset-mapped attribution (operator 9).

Each whole text is encoded once with a byte-level BPE vocabulary. The lengths of the tokens in
bytes give their places, and sections, spans of code points that come with the row, are joined
to them as intervals. A token that crosses a boundary goes where RULE says: to the section of
its `first` byte, of its `last` byte, or as a `share` of a token by its bytes in each section.

The vocabulary is a file of ranks that exists on every machine; its path is a parameter. A
task loads it once.

Cases: a null text has no tokens, and its sections count 0; sections that are empty, reach
beyond the text, overlap or repeat are each counted as they are (what reaches beyond is cut
off); runs of white space, or of any one character, may be of any length; a null list of sections gives no rows; ids may be null or repeated; extra columns are
carried in `row`; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary divides a text before merging; fixed with it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The vocabulary's pattern looks back over the whole of a run of white space, on a stack of
#: limited depth; longer runs are encoded by themselves.
LONG_RUN = 1000
_LONG = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_RUN)
RULES = ("first", "last", "share")
SECTIONS = T.ArrayType(T.StructType([T.StructField("section", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and the number of bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def edges(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Where each token of a text begins, in bytes, and at the end the text's length."""
    encoding, size = encoder(path)
    out = np.zeros(1, np.int64)
    if text:
        # of white space before something else, all but the last is a piece of the pattern; at the end, all
        ids, at = [], 0
        for run in _LONG.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += [encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()), encoding._encode_single_piece(text[run.start() : end].encode())]
            at = end
        ids.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
        ids = np.concatenate([np.asarray(x, np.int64) for x in ids])
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size[ids], out=out[1:])
    return out


def attribute(edge: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of the byte spans from start to end."""
    if rule == "share":
        number = np.arange(len(edge), dtype=np.float64)
        return np.interp(end, edge, number) - np.interp(start, edge, number) if len(edge) > 1 else np.zeros(len(start))
    place = edge[:-1] if rule == "first" else edge[1:] - 1
    return (np.searchsorted(place, end) - np.searchsorted(place, start)).astype(np.float64)


def _counter(path: str, rule: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sections = batch["sections"]
            begin = sections.offsets.to_numpy()
            flat = sections.values
            start, end = (np.nan_to_num(flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) for c in ("start", "end"))
            tokens, chars = [], []
            valid = sections.is_valid().to_pylist()
            for i, text in enumerate(batch["text"].to_pylist()):
                a, b = (int(begin[i]), int(begin[i + 1])) if valid[i] else (0, 0)
                if a == b:
                    continue
                text = text or ""
                edge = edges(text, path)
                s = np.clip(start[a:b], 0, len(text))
                e = np.maximum(np.clip(end[a:b], 0, len(text)), s)
                chars.append(e - s)
                if edge[-1] != len(text):  # some characters have several bytes
                    raw = np.frombuffer(text.encode(), np.uint8)
                    place = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]
                    s, e = place[s], place[e]
                tokens.append(attribute(edge, s, e, rule))
            row = np.repeat(np.arange(len(batch)), np.where(valid, np.diff(begin), 0))
            used = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in range(len(batch)) if valid[i]] or [np.zeros(0, np.int64)])
            none = np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"].take(pa.array(row)),
                    flat.field("section").take(pa.array(used)),
                    pa.array(np.concatenate(chars or [none]).astype(np.int64)),
                    pa.array(np.concatenate(tokens or [none]).astype(np.float64)),
                ],
                ["row", "section", "n_chars", "n_tokens"],
            )

    return count


def token_counts(docs: DataFrame, sections: Column, text: str = "text", keep: list[str] | None = None, rule: str = "first", path: str = VOCABULARY) -> DataFrame:
    """row (the columns of docs, or those named), section, n_chars and n_tokens (a double; whole
    unless the rule is `share`), for each section: an array of (section, start, end)."""
    if rule not in RULES:
        raise ValueError(f"the rules are {', '.join(RULES)}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(text).cast("string").alias("text"), sections.cast(SECTIONS).alias("sections"))
    schema = T.StructType([rows.schema["row"], T.StructField("section", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.DoubleType())])
    return rows.mapInArrow(_counter(path, rule), schema)


def head_body_tail(text: Column) -> Column:
    """Three sections: the first line, the lines between, and the last line. A newline belongs
    to the line that it ends. A text of one line is all head."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    head = F.when(F.instr(text, "\n") > 0, F.instr(text, "\n").cast("long")).otherwise(n)
    last = F.greatest(head, n - F.length(F.substring_index(text, "\n", -1)))
    span = lambda name, a, b: F.struct(F.lit(name).alias("section"), a.alias("start"), b.alias("end"))
    head, last = F.coalesce(head, F.lit(0)), F.coalesce(last, F.lit(0))
    return F.array(span("head", F.lit(0).cast("long"), head), span("body", head, last), span("tail", last, n))
