"""Byte-level BPE with forced boundaries.

Two bytes that are never neighbours inside any token of the vocabulary can never
be merged across, so a cut between them is certain.  Texts are cut at such pairs
where the pre-tokenizer too must begin anew: before a blank or line end that
follows a printable ASCII character, and between two ASCII letters.  Each
fragment is encoded on its own and the ids are concatenated: the same ids as of
the whole, from pieces of bounded size however long the text.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pre-tokenizer's pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A fragment ends at the first certain cut after so many bytes.
FRAGMENT = 512


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizer:
    """A vocabulary file of a byte-level BPE whose token ids follow the order of merges: tokens, special tokens, cuts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = _byte_of_char(), spec["model"]["vocab"]
        ids = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = [ids[bytes(alphabet[c] for x in (m.split(" ") if isinstance(m, str) else m) for c in x)] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("token ids do not follow the order of merges")
        self.bytes_of = np.empty(max([*ids.values(), *self.special.values()]) + 1, dtype=object)
        self.bytes_of[:] = b""
        for token, i in [*ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = token
        met = np.zeros((256, 256), dtype=bool)
        for token in ids:
            pair = np.frombuffer(token, np.uint8)
            met[pair[:-1], pair[1:]] = True
        byte = np.arange(256)
        printed, blank = (byte > 32) & (byte < 127), (byte == 32) | (byte == 10)
        letter = ((byte | 32) >= 97) & ((byte | 32) <= 122)
        self.cut = ~met & ((printed[:, None] & blank) | (letter[:, None] & letter))
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fragment_ids = tiktoken.Encoding("fragments", pat_str=PIECES, mergeable_ranks=ids, special_tokens={}).encode_ordinary

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut at certain boundaries, each piece at least FRAGMENT bytes long if a cut comes in time."""
        data = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(self.cut[data[:-1], data[1:]]) + 1
        out, start, n = [], 0, len(raw)
        while n - start > FRAGMENT:
            i = np.searchsorted(at, start + FRAGMENT)
            if i == len(at):
                break
            out.append(raw[start:at[i]])
            start = int(at[i])
        out.append(raw[start:])
        return out

    def _plain(self, text: str) -> list[int]:
        return [i for part in self.fragments(text.encode("utf-8", "surrogatepass")) for i in self.fragment_ids(part.decode("utf-8", "surrogatepass"))]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if self.splitter is None or not self.splitter.search(text):
            found = self._plain(text)
        else:
            found = [i for part in self.splitter.split(text) for i in ([self.special[part]] if part in self.special else self._plain(part))]
        return np.array(found, dtype="<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.bytes_of[ids].tolist()).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(text: str | Column, path: str) -> Column:
    """Token ids of a text column; a missing text counts as empty and has none.

    ``path`` is a tokenizer file every worker can read.  Strings of special tokens in a text become those tokens.
    """

    def run(texts: pa.Array) -> pa.Array:
        own, parts, ends = tokenizer(path), [], [0]
        for x in texts:
            ids = own.encode(x.as_py() or "")
            parts.append(ids)
            ends.append(ends[-1] + len(ids) // 4)
        values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(F.col(text) if isinstance(text, str) else text)


def decode(ids: str | Column, path: str) -> Column:
    """The text of an id column; missing ids count as none.  Bytes that are no UTF-8 become U+FFFD."""

    def run(column: pa.Array) -> pa.Array:
        own = tokenizer(path)
        return pa.array([own.decode(np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64)) if x.is_valid and len(x) else ""
                         for x in column], pa.string())

    return F.arrow_udf(run, T.StringType())(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(text: str | Column, path: str) -> Column:
    """``ids`` of a text column and whether they decode to it (``same``), in one pass; a missing text counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        own, parts, ends, same = tokenizer(path), [], [0], []
        for x in texts:
            whole = x.as_py() or ""
            ids = own.encode(whole)
            parts.append(ids)
            ends.append(ends[-1] + len(ids) // 4)
            same.append(own.decode(np.frombuffer(ids, dtype="<i4")) == whole)
        values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], names=["ids", "same"])

    return F.arrow_udf(run, "ids array<int>, same boolean")(F.col(text) if isinstance(text, str) else text)
